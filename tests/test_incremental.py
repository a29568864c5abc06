"""A log in chunks: the second run sees its own chunk and the state of the first, nothing else."""

import shutil

import pytest

from tidemark.operators.common import shared_path
from tidemark.plans import features, more

SF = "/root/testdata/sf0.001"
SOME = ("intra_pr_count", "intra_success_rate", "intra_unbounded_count", "intra_inclusive_count", "dep_comment_count", "nondep_pr_count", "eco_pair_commented")


def test_two_chunks_give_the_rows_of_one(spark):
    specs = [f for f in features.registry() if f.name in SOME]
    whole = {tuple(r) for r in features.compute_all(specs, spark, SF).collect()}
    early, late = more.halves(spark, SF)
    state = shared_path(spark, "state")
    first = {tuple(r) for r in features.compute_all(specs, spark, early, next_state=f"{state}/1").collect()}
    shutil.rmtree(early.removeprefix("file:"))  # history is gone
    rows = features.compute_all(specs, spark, late, state=f"{state}/1", next_state=f"{state}/2")
    second = {tuple(r) for r in rows.collect()}
    assert len(first) and len(second) and first | second == whole
    again = features.compute_all(specs, spark, late, state=f"{state}/1", next_state=f"{state}/2")
    assert {tuple(r) for r in again.collect()} == second
    with pytest.raises(ValueError, match="state ends"):
        features.compute_all(specs, spark, late, state=f"{state}/2")
    kept = spark.read.parquet(f"{state}/2/people-{90 * 86_400}-after")
    assert 0 < kept.count() < spark.read.parquet(f"{late}/lineitem.parquet").count()
