"""Trace-shaped views over tables of events, conversations, labels and orders.

A trace is a sequence of executed cells; `cells` gives one row a cell with its
place (idx, from 1) in the trace. Views are plain DataFrames: filters and column
lists reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: The error types that the last digits of an event's key stand for.
ERROR_TYPES = ("KeyError", "FileNotFoundError", "NameError", "SyntaxError", "executor:forbidden", "ModuleNotFoundError", "KeyError(wrapped)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace, idx, submitter, failed, error_type, error_key, inspect, value, ts; one trace a user, in order of time."""
    e = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    kind = F.element_at(F.array(*[F.lit(x) for x in ERROR_TYPES]), key % len(ERROR_TYPES) + 1)
    return e.select(
        F.col("user_id").alias("trace"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"),
        (F.col("user_id") % 5).alias("submitter"),
        failed.alias("failed"),
        F.when(failed, kind).alias("error_type"),
        F.when(failed, F.concat(F.lit("k"), key % 10)).alias("error_key"),
        (F.col("event_type") == "view").alias("inspect"),
        F.col("event_type").alias("kind"),
        (key % 12).alias("name"),
        "value",
        "ts",
    )


CELLS_SQL = f"""cells AS (
    SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, user_id % 5 AS submitter,
        event_type = 'error' AS failed,
        CASE WHEN event_type = 'error' THEN ({list(ERROR_TYPES)!r})[k % {len(ERROR_TYPES)} + 1] END AS error_type,
        CASE WHEN event_type = 'error' THEN 'k' || (k % 10) END AS error_key,
        event_type = 'view' AS inspect, event_type AS kind, k % 12 AS name, value, ts
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, seed, arm, correct, cost, line, part: runs of two arms; a unit is an order, a seed a line number; line and part are the place in the log."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.where("l_returnflag in ('A', 'R')").select(
        (F.col("l_orderkey") % 500).alias("unit"),
        F.col("l_linenumber").alias("seed"),
        F.when(F.col("l_returnflag") == "A", "off").otherwise("on").alias("arm"),
        (F.col("l_discount") < 0.05).cast("int").alias("correct"),
        F.col("l_quantity").alias("cost"),
        F.col("l_orderkey").alias("line"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("part"),
    )


PAIRS_SQL = """pairs AS (
    SELECT l_orderkey % 500 AS unit, l_linenumber AS seed, CASE WHEN l_returnflag = 'A' THEN 'off' ELSE 'on' END AS arm,
        CAST(l_discount < 0.05 AS INT) AS correct, l_quantity AS cost, l_orderkey AS line, l_partkey * 100000 + l_suppkey AS part
    FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submission, organisation, format, rows, with_trace, errors: one row a customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("submission"),
        F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("Org | user "), F.col("c_name"))).otherwise(F.concat(F.lit(" Team "), F.col("c_nationkey"))).alias("organisation"),
        F.col("c_mktsegment").alias("format"),
        F.floor("c_acctbal").cast("long").alias("rows"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 3).cast("long").alias("with_trace"),
        (F.col("c_custkey") % 4).alias("errors"),
        F.sha2(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("trace_hash"),
    )


MANIFEST_SQL = """manifest AS (
    SELECT c_custkey AS submission, CASE WHEN c_nationkey % 3 = 0 THEN 'Org | user ' || c_name ELSE ' Team ' || c_nationkey END AS organisation,
        c_mktsegment AS format, CAST(floor(c_acctbal) AS BIGINT) AS rows, CAST(floor(greatest(c_acctbal, 0) / 3) AS BIGINT) AS with_trace,
        c_custkey % 4 AS errors, sha256(c_nationkey || '|' || c_mktsegment) AS trace_hash
    FROM customer)"""
