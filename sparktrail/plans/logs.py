"""Ledgers, memos, streams and branching runs, over the logs as they grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import shared_folder
from ..operators import branches
from ..sources import files
from ..sources.views import CELLS_SQL, cells, table
from .answers import _NESTED_SQL, nested
from .registry import query

#: The part of a ledger that a budget pays for.
_CAP = 40_000_000


@query(f"SELECT o_orderkey, spent FROM (SELECT o_orderkey, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM orders) WHERE spent < {_CAP}")
def stm_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of a ledger that were begun before the budget was spent, and what was spent until then."""
    from ..streaming import folds

    costs = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("cost"))
    return folds.until_budget(costs, "o_orderkey", "cost", _CAP).select("o_orderkey", "spent")


@query(
    """SELECT f.filter, f.asked, CASE WHEN f.filter LIKE '%where%' THEN NULL ELSE (SELECT count(*) FROM nested WHERE CASE WHEN f.s IS NOT NULL THEN status = f.s ELSE coalesce(list_contains(numbers, f.l), false) END) END AS matches FROM (
        SELECT filter, count(*) AS asked, any_value(s) AS s, any_value(l) AS l FROM (
            SELECT CASE o_orderkey % 3 WHEN 0 THEN '{"order.status": "' || o_orderstatus || '"}' WHEN 1 THEN '{"lines.n": ' || o_custkey % 9 || '}' ELSE '{"$where": "x"}' END AS filter,
                CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 9 END AS l FROM orders) GROUP BY 1) f""",
    _NESTED_SQL,
)
def doc_memo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different filter of a log is counted once, over nested documents, and joined back to those who asked. The log comes in two parts; the second extends the memo of the first."""
    from ..streaming import folds

    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit('{"order.status": "'), "o_orderstatus", F.lit('"}'))).when(k == 1, F.concat(F.lit('{"lines.n": '), (F.col("o_custkey") % 9).cast("string"), F.lit("}"))).otherwise('{"$where": "x"}')
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey") % 2 == 0, text.alias("filter")).toDF("early", "filter").groupBy("early", "filter").agg(F.count("*").alias("asked"))
    path, docs = f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}", nested(spark, sf_dir)
    folds.counted_once(docs, "d", asked.where("early"), path, per_batch=8)
    counted = folds.counted_once(docs, "d", asked.where("not early"), path, per_batch=8)
    return asked.groupBy("filter").agg(F.sum("asked").alias("asked")).join(counted, "filter", "left").select("filter", "asked", F.col("n").alias("matches"))


@query(
    """SELECT trace, idx, CAST(CASE WHEN failed THEN row_number() OVER (PARTITION BY trace, ok_before ORDER BY idx) - CASE WHEN ok_before > 0 THEN 1 ELSE 0 END ELSE 0 END AS INT) AS chain
    FROM (SELECT user_id AS trace, event_id AS idx, event_type = 'error' AS failed, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS ok_before FROM events)"""
)
def stm_failure_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of failures that ends at each cell, kept as state by trace over the files of a table as they arrive."""
    from ..streaming import folds

    rows = folds.table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("idx"), (F.col("event_type") == "error").alias("failed"))
    return folds.settled(folds.failure_chains(rows)).select("trace", "idx", "chain")


_BRANCHES = (
    CELLS_SQL,
    "p AS (SELECT trace // 3 AS unit, trace % 3 AS arm, idx, string_agg(kind, ',') OVER (PARTITION BY trace ORDER BY idx) AS prefix FROM cells)",
    "n AS (SELECT unit, idx, prefix, count(*) AS runs FROM p GROUP BY 1, 2, 3)",
)


@query("SELECT unit, sum(runs)::BIGINT AS steps, count(*) AS nodes, count(*) FILTER (runs > 1) AS shared FROM n GROUP BY 1", *_BRANCHES)
def stm_branching_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs a unit: their steps, counted once where they share all that went before."""
    return branches.tree(_branching(spark, sf_dir), ["unit"])


@query(
    """SELECT a.unit, a.arm::VARCHAR AS a, b.arm::VARCHAR AS b, (SELECT coalesce(max(x.idx), 0) FROM p x JOIN p y USING (unit, idx, prefix) WHERE x.unit = a.unit AND x.arm = a.arm AND y.arm = b.arm) AS shared
    FROM (SELECT DISTINCT unit, arm FROM p) a JOIN (SELECT DISTINCT unit, arm FROM p) b ON a.unit = b.unit AND a.arm < b.arm""",
    *_BRANCHES,
)
def stm_partings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After how many shared steps each two arms of a unit part."""
    return branches.partings(_branching(spark, sf_dir), ["unit"], "arm", ["0", "1", "2"])


def _branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = cells(spark, sf_dir).select(F.floor(F.col("trace") / 3).cast("long").alias("unit"), (F.col("trace") % 3).cast("string").alias("arm"), "idx", "kind")
    return branches.with_node(steps, ["unit", "arm"], "idx", "kind")


@query(
    """SELECT CAST(user_id % 16 AS INT) AS folder, (sum(1 + CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id % 16 ORDER BY event_id) - CAST(event_type = 'error' AS INT))::BIGINT AS line, props AS text FROM events"""
)
def src_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as logs, a blank line after each error, and read back with the numbers of their lines."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", F.concat("props", F.lit("\n"))).otherwise(F.col("props"))
    path = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    rows = e.select((F.col("user_id") % 16).cast("int").alias("folder"), "event_id", value.alias("value"))
    rows.repartition(16, "folder").sortWithinPartitions("folder", "event_id").select("folder", "value").write.partitionBy("folder").text(path)
    lines = files.numbered_lines(spark, path)
    return lines.select(F.regexp_extract("file", r"/folder=(\d+)/", 1).cast("int").alias("folder"), "line", "text")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stm_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of keys over the files of a table as they arrive, a file a batch."""
    from ..streaming import folds

    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    e.repartition(4, "event_id").write.parquet(f"{path}/arriving")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arriving")
    folds.appended_once(rows, ["user_id", "event_type"], ["event_id"], f"{path}/log", f"{path}/state").awaitTermination()
    return folds.appended(spark, f"{path}/log", e.schema).select("user_id", "event_type")


@query("SELECT CAST(user_id % 8 AS INT) AS folder, count(*) FILTER (event_type <> 'error' AND k IS NOT NULL) AS n, sum(k) FILTER (event_type <> 'error')::BIGINT AS k, count(*) FILTER (event_type = 'error') AS bad FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1")
def src_tolerant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in which a line of each error is cut short, as by a stopped writer, and blank lines stand: what can be read, and how many lines can't, by folder."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).when(F.col("event_type") == "view", F.concat(F.lit("\n"), "props")).otherwise(F.col("props"))
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    e.select((F.col("user_id") % 8).cast("int").alias("folder"), line.alias("value")).write.partitionBy("folder").text(path)
    good, bad = files.tolerant_records(spark, path, "k int")
    folder = F.regexp_extract("file", r"/folder=(\d+)/", 1).cast("int").alias("folder")
    read = good.where("k is not null").groupBy(folder).agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    return read.join(bad.groupBy(folder).agg(F.sum("bad_lines").alias("bad")), "folder").select("folder", "n", "k", "bad")
