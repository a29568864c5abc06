"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, language, media, minhash, mixing, order_minhash, pii, quality, repeats, sharding, treaps, variants
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.op1_language,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_media": media.op4_media,
    "op5_pii": pii.op5_pii,
    "op6_order_minhash": order_minhash.op6_order_minhash,
    "op7_minhash": minhash.op7_minhash,
    "op8_bpe": bpe.op8_bpe,
    "op9_chat": chat.op9_chat,
    "op10_repeats": repeats.op10_repeats,
    "op11_variants": variants.op11_variants,
    "op12_sharding": sharding.op12_sharding,
    "op13_search": treaps.op13_search,
}
