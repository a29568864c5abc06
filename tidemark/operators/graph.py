"""Dependency and collaboration graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, small
from .degrees import degrees


def transitive_closure(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """All (focal, other) joined by a path; with rounds, by one of at most that many edges.

    Without a bound paths double each round, so few rounds reach a fixpoint; each is
    written to the shared folder, so a lost executor doesn't replay the loop.
    """
    known = shared_table(edges.select("focal", "other").distinct(), "closure")
    first, count, done = known, known.count(), 1
    while rounds is None or done < rounds:
        right = (known if rounds is None else first).select(F.col("focal").alias("other"), F.col("other").alias("far"))
        longer = known.join(right, "other").select("focal", F.col("far").alias("other"))
        known = shared_table(known.union(longer).distinct(), "closure")
        before, count = count, known.count()
        done += 1
        if count == before:
            break
    return known


def cascade_levels(edges: DataFrame, levels: int) -> DataFrame:
    """(level, projects): how many projects begin a path of level + 1 edges."""
    spark = edges.sparkSession
    starts = edges.select("focal").distinct()
    out = []
    for level in range(levels):
        if level:
            starts = shared_table(edges.join(starts.withColumnRenamed("focal", "other"), "other", "left_semi").select("focal").distinct(), "cascade")
        out.append((level, starts.count()))
    return spark.createDataFrame(out, "level long, projects long")


def second_order_degree(queries: DataFrame, edges: DataFrame, window: int, scope: str, direction: str, labels: tuple[str, ...]) -> DataFrame:
    """(id, c, e, degree): second-order degree of each query's person by pairs of edge labels.

    queries: id, ts, seq, u, project.  edges: src, tgt, label, ts, seq, project and
    m, how many equal edges a row stands for; edges of one seq have one ts.
    For a neighbour n with k edges n -> u of label c, in stream order, the i-th of
    them (from 0) counts (k - i) times the edges of label e that enter n (direction
    in) or leave it (out), don't touch u, and are older than it.  Both edges lie in
    the query's window and before it.  scope: edges n -> u within the query's project
    (intra) or outside (ecosystem).

    What a person's degree is made of changes by events only, whoever asks.  Of two edges n -> u of a label, or one
    with itself, the older must come after an edge x of n: they add to the degree from when the newer comes until x
    leaves the window.  How many x there are follows from sums of n up to a time, and what ends is added up by
    person, label, project and time where n's edges are, before anything goes to the person; see degrees().
    Outside of a project counts what counts anywhere less what touches the project.
    """
    counted = shared_table(edges.where("src <> tgt").groupBy("src", "tgt", "label", "project", "ts", "seq").agg(F.sum("m").alias("m")), "edges")
    people = small(queries.where("u is not null").select(F.col("u").alias("_u")).distinct().withColumn("asked", F.lit(True)))
    numbered = counted.where(F.col("label").isin(*labels)).withColumn("label", F.array_position(F.lit(list(labels)), F.col("label")) - 1).join(people, F.col("tgt") == F.col("_u"), "left")
    zero = F.lit(0).cast("long")
    into = F.when(F.col("asked") & F.col("project").isNotNull(), F.col("m")).otherwise(zero)
    fact = lambda n, u, into, m: F.struct(n.alias("n"), u.alias("u"), F.coalesce("project", zero).alias("p"), "ts", "seq", "label", into.alias("into"), m.alias("own"), m.alias("every"))
    src, tgt = F.col("src"), F.col("tgt")
    both = F.array(fact(src, tgt, into, zero), fact(tgt, src, zero, F.col("m"))) if direction == "in" else F.array(fact(src, tgt, into, F.col("m")))
    return degrees(queries, numbered.select(F.inline(both)), window, scope, labels, counted.observed_rows)


def min_label_components(edges: DataFrame) -> DataFrame:
    """(node, component) by spreading the least label, with shortcuts through labels of labels."""
    both = shared_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = shared_table(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = shared_table(step.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
        moved = after.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        label = after
        if not moved:
            return label
