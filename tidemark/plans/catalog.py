"""All registered queries and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, explore, features, graphs, models, more, streams, wider

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _f in features.registry():
    QUERIES[_f.name] = lambda spark, sf_dir, f=_f: features.compute(f, spark, sf_dir)
    ORACLE_SQL[_f.name] = features.sql_of(_f)
for _m in (cleaning, graphs, explore, more, wider, streams, models):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
