"""Queries over streams that arrive in several batches, out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import stateful
from ..streaming import windows as W
from .activity import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

DAY = 86_400_000_000
SLICES = 4


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _said(rows: DataFrame) -> DataFrame:
    """Events as contributions: the type is the project, and each has one commenter."""
    return rows.select(
        "event_id",
        "ts",
        F.col("event_type").alias("project"),
        F.col("user_id").alias("person"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long")).alias("commenter"),
        (F.col("value") > 20).alias("merged"),
    )


def arriving_events(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events in batches and how late they may be; at last one of a year later, which no query answers."""
    rows = table(spark, d, "events").withColumn("ts", F.to_timestamp("ts"))
    last = rows.select(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    return W.arriving(rows.select("event_id", "ts", "user_id", "event_type", "value", "props"), "ts", SLICES, last)


_SAID = "e AS (SELECT event_id, ts, event_type AS project, user_id AS person, CAST(coalesce(json_extract_string(props, '$.k'), '-1') AS BIGINT) AS commenter, value > 20 AS merged FROM events)"


def _flags_sql(bound: str) -> str:
    before = f"b.project = e.project AND (b.ts < e.ts OR (b.ts = e.ts AND b.event_id < e.event_id)){bound}"
    return (
        f"WITH {_SAID} SELECT event_id, 'first_time' AS flag, NOT EXISTS (SELECT 1 FROM e b WHERE b.person = e.person AND {before}) AS value FROM e "
        f"UNION ALL SELECT event_id, 'external', commenter <> person AND NOT EXISTS (SELECT 1 FROM e b WHERE b.person = e.commenter AND b.merged AND {before}) FROM e"
    )


@query(_flags_sql(""))
def events_contributor_flags(spark: SparkSession, d: str) -> DataFrame:
    """First-time and external-commenter flags of a stream, over all that came before."""
    events, late = arriving_events(spark, d)
    return W.drained(stateful.contributor_flags(_said(events), late), "flags").where("event_id >= 0")


@query(_flags_sql(" AND b.ts > e.ts - INTERVAL 3 DAYS"))
def events_contributor_flags_windowed(spark: SparkSession, d: str) -> DataFrame:
    """The same flags with a memory of three days, after which state is dropped."""
    events, late = arriving_events(spark, d)
    return W.drained(stateful.contributor_flags(_said(events), late, 3 * DAY), "flags").where("event_id >= 0")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 259199999999 MICROSECONDS PRECEDING AND CURRENT ROW) - 1 AS n FROM events")
def events_earlier_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many earlier events of the user lie within three days, of a stream that arrives out of order."""
    events, late = arriving_events(spark, d)
    return W.drained(stateful.earlier_counts(events, 3 * DAY, late), "earlier").where("event_id >= 0")


@query("SELECT o_orderkey, l_linenumber, o_orderstatus, l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAYS")
def order_line_streams(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines of the next 60 days as two streams in batches, joined with bounded state."""
    end = F.expr("TIMESTAMP '2200-01-01 00:00:00'")
    orders = table(spark, d, "orders").select("o_orderkey", F.to_timestamp("o_orderdate").alias("ordered"), "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.to_timestamp("l_shipdate").alias("shipped"), "l_linenumber", "l_returnflag")
    none = spark.range(1)
    last_order = none.select(F.lit(-1).cast("long").alias("o_orderkey"), end.alias("ordered"), F.lit("").alias("o_orderstatus"))
    last_line = none.select(F.lit(-2).cast("long").alias("l_orderkey"), end.alias("shipped"), F.lit(0).alias("l_linenumber"), F.lit("").alias("l_returnflag"))
    (orders, late_orders), (lines, late_lines) = W.arriving(orders, "ordered", SLICES, last_order), W.arriving(lines, "shipped", SLICES, last_line)
    joined = stateful.merged_streams(orders, lines, late_orders, late_lines, "60 DAYS")
    return W.drained(joined, "orders_lines").where("o_orderkey >= 0")
