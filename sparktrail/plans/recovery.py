"""What happens after an error: ordered analytics per trace, summed by submitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregates as agg, joins, windows as win
from ..sources.views import CELLS_SQL, cells
from .registry import query

_REC = """rec AS (
    SELECT *, coalesce(NOT lead(failed) OVER w, false) AS next_ok,
        min(CASE WHEN NOT failed THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - idx - 1 AS retry_chain,
        CASE WHEN lead(idx) OVER w IS NOT NULL AND error_key IS NOT NULL THEN coalesce(lead(error_key) OVER w = error_key, false) END AS same_key
    FROM cells WINDOW w AS (PARTITION BY trace ORDER BY idx))"""
_GROUP = """CASE WHEN error_type IN ('KeyError', 'KeyError(wrapped)', 'index-error(wrapped)', 'FileNotFoundError', 'ValueError:usecols') THEN 'data-reference'
    WHEN error_type IN ('executor:forbidden', 'executor:budget', 'ModuleNotFoundError') THEN 'executor' WHEN error_type IS NOT NULL THEN 'other' END"""
_EP = """ep AS (
    SELECT trace, idx, submitter, error_key, ok_idx - idx AS k_success, first_ok_inspects, fix_idx - idx AS k_fix, fix_value,
        coalesce(key_again < coalesce(fix_idx, 1000000000), false) AS repeat
    FROM (SELECT *, lag(failed) OVER w AS before,
            min(CASE WHEN NOT failed THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ok_idx,
            arg_min(inspect, idx) FILTER (NOT failed) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first_ok_inspects,
            min(CASE WHEN NOT failed AND NOT inspect THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fix_idx,
            arg_min(value, idx) FILTER (NOT failed AND NOT inspect) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fix_value,
            min(CASE WHEN failed THEN idx END) OVER (PARTITION BY trace, error_key ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS key_again
        FROM cells WINDOW w AS (PARTITION BY trace ORDER BY idx))
    WHERE failed AND error_type IN ('KeyError', 'KeyError(wrapped)', 'FileNotFoundError') AND NOT coalesce(before, false))"""


@query(
    """SELECT CASE WHEN grouping(submitter) = 1 THEN 'ALL' ELSE CAST(submitter AS VARCHAR) END AS submitter, count(*) AS errors,
        avg(CAST(next_ok AS DOUBLE)) AS next_ok, count(*) FILTER (retry_chain IS NULL) AS never, avg(retry_chain) AS mean_chain,
        median(retry_chain) AS median_chain, avg(CAST(same_key AS DOUBLE)) AS same_key
    FROM rec WHERE failed GROUP BY ROLLUP (submitter)""",
    CELLS_SQL, _REC,
)
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a failure: is the next cell ok, how long is the chain of failures, is the key the same; by submitter, and pooled."""
    failed = win.with_recovery(cells(spark, sf_dir)).where("failed")
    return agg.with_total(
        failed,
        "submitter",
        F.count("*").alias("errors"),
        F.avg(F.col("next_ok").cast("double")).alias("next_ok"),
        F.count_if(F.col("retry_chain").isNull()).alias("never"),
        F.avg("retry_chain").alias("mean_chain"),
        F.median("retry_chain").alias("median_chain"),
        F.avg(F.col("same_key").cast("double")).alias("same_key"),
    )


@query(f"SELECT trace, idx, next_ok, retry_chain, same_key, {_GROUP} AS error_group FROM rec WHERE failed", CELLS_SQL, _REC)
def win_next_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.with_recovery(cells(spark, sf_dir)).where("failed")
    return rows.select("trace", "idx", "next_ok", "retry_chain", "same_key", win.error_group().alias("error_group"))


@query("SELECT trace, idx, submitter, error_key, k_success, first_ok_inspects, k_fix, fix_value, repeat FROM ep", CELLS_SQL, _EP)
def win_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.episodes(cells(spark, sf_dir))


@query(
    """SELECT submitter, count(*) AS episodes, avg(CAST(k_success IS NULL AS DOUBLE)) AS never_ok, count(*) FILTER (k_success = 1)::DOUBLE / count(*) AS next_ok,
        median(k_success) AS median_k_success, avg(CAST(first_ok_inspects AS DOUBLE)) AS first_ok_inspection, count(*) FILTER (k_fix = 1)::DOUBLE / count(*) AS fix_next,
        avg(k_fix - 1) AS mean_room, count(*) FILTER (k_fix = 2)::DOUBLE / count(*) AS fix_2, count(*) FILTER (k_fix >= 3)::DOUBLE / count(*) AS fix_3plus,
        count(*) FILTER (repeat)::DOUBLE / count(*) AS repeat_share
    FROM ep GROUP BY submitter""",
    CELLS_SQL, _EP,
)
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").cast("double")
    part = lambda test: F.count_if(test) / n
    return win.episodes(cells(spark, sf_dir)).groupBy("submitter").agg(
        F.count("*").alias("episodes"),
        part(F.col("k_success").isNull()).alias("never_ok"),
        part(F.col("k_success") == 1).alias("next_ok"),
        F.median("k_success").alias("median_k_success"),
        F.avg(F.col("first_ok_inspects").cast("double")).alias("first_ok_inspection"),
        part(F.col("k_fix") == 1).alias("fix_next"),
        F.avg(F.col("k_fix") - 1).alias("mean_room"),
        part(F.col("k_fix") == 2).alias("fix_2"),
        part(F.col("k_fix") >= 3).alias("fix_3plus"),
        part(F.col("repeat")).alias("repeat_share"),
    )


@query(
    """SELECT trace, idx, coalesce(min(idx) OVER (PARTITION BY trace, name) < idx, false) AS any_cell,
        coalesce(min(CASE WHEN NOT failed THEN idx END) OVER (PARTITION BY trace, name) < idx, false) AS ok_cell FROM cells""",
    CELLS_SQL,
)
def win_earlier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.running_names(cells(spark, sf_dir), "name").withColumnRenamed("reads_earlier", "any_cell")
    return win.running_names(rows, "name", ok_only=True).select("trace", "idx", "any_cell", F.col("reads_earlier").alias("ok_cell"))


@query(
    """SELECT submitter, n, k, NOT (n >= 20 AND CAST(k AS DOUBLE) / n > 0.5) AS keeps_names FROM (
        SELECT submitter, count(*) AS n, count(*) FILTER (error_type = 'NameError') AS k
        FROM (SELECT *, min(idx) OVER (PARTITION BY trace, name) < idx AS e FROM cells) WHERE e GROUP BY submitter)""",
    CELLS_SQL,
)
def win_stateless_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.stateless(cells(spark, sf_dir))


@query(
    "SELECT trace, idx, array_to_string(list(kind) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS context FROM cells",
    CELLS_SQL,
)
def win_previous_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.previous_cells(cells(spark, sf_dir), 3, "kind").select("trace", "idx", "context")
    return rows.select("trace", "idx", F.when(F.size("context") > 0, F.array_join("context", ",")).alias("context"))


@query("SELECT trace, idx, cut FROM (SELECT *, min(CASE WHEN failed AND error_type = 'KeyError' THEN idx END) OVER (PARTITION BY trace) AS cut FROM cells) WHERE idx < cut AND cut - 1 <= 12", CELLS_SQL)
def win_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("failed") & (F.col("error_type") == "KeyError")
    return win.cut_at_first(cells(spark, sf_dir), event, 12).select("trace", "idx", "cut")


@query(
    """SELECT trace, min(CASE WHEN kind = 'purchase' THEN idx END) AS first_idx, arg_min(after_ok, idx) FILTER (kind = 'purchase') AS after_ok
    FROM (SELECT *, coalesce(CAST(NOT lead(failed) OVER (PARTITION BY trace ORDER BY idx) AS VARCHAR), 'none') AS after_ok FROM cells) GROUP BY trace""",
    CELLS_SQL,
)
def win_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = win.first_event(cells(spark, sf_dir), F.col("kind") == "purchase")
    return found.select("trace", "first_idx", F.when(F.col("first_idx").isNotNull(), F.coalesce(F.col("after_ok").cast("string"), F.lit("none"))).alias("after_ok"))


@query(
    """SELECT trace, idx, CASE WHEN coalesce(min(CASE WHEN kind = 'purchase' THEN idx END) OVER (PARTITION BY trace, name) < idx, false) THEN 'yes'
        WHEN coalesce(bool_or(kind = 'signup' AND value > 19) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'unknown' ELSE 'no' END AS there
    FROM cells""",
    CELLS_SQL,
)
def win_written_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.written_earlier(cells(spark, sf_dir), "name", F.col("kind") == "purchase", (F.col("kind") == "signup") & (F.col("value") > 19))
    return rows.select("trace", "idx", F.when(F.col("exists").isNull(), "unknown").when(F.col("exists"), "yes").otherwise("no").alias("there"))


@query(
    """SELECT trace, name, idx, kind, value FROM cells QUALIFY row_number() OVER (PARTITION BY trace, name ORDER BY idx DESC) = 1""",
    CELLS_SQL,
)
def win_last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.last_of_key(cells(spark, sf_dir).select("trace", "name", "idx", "kind", "value"), ["trace", "name"], ["idx"])


@query(
    """SELECT trace, idx, coalesce(sum(CAST(NOT failed AS INT)) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ok_before FROM cells""",
    CELLS_SQL,
)
def win_successes_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.running_count(cells(spark, sf_dir), ~F.col("failed"), "ok_before").select("trace", "idx", "ok_before")


@query(
    """SELECT c.trace, c.idx FROM cells c WHERE c.error_type = 'NameError' AND EXISTS (SELECT 1 FROM cells b WHERE b.trace = c.trace AND b.name = c.name AND b.idx < c.idx AND NOT b.failed)""",
    CELLS_SQL,
)
def win_lost_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name error on a name that an earlier cell without failure had bound."""
    return win.running_names(cells(spark, sf_dir), "name", ok_only=True).where("error_type = 'NameError' and reads_earlier").select("trace", "idx")


@query(
    """SELECT trace, sum(CAST(is_read AND NOT coalesce(w < idx, false) AS INT))::BIGINT AS unwritten_reads FROM (
        SELECT *, kind = 'view' AS is_read, min(CASE WHEN kind = 'purchase' THEN idx END) OVER (PARTITION BY trace, name) AS w FROM cells) GROUP BY trace""",
    CELLS_SQL,
)
def win_reads_not_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.written_earlier(cells(spark, sf_dir), "name", F.col("kind") == "purchase", F.lit(False))
    return rows.groupBy("trace").agg(F.count_if((F.col("kind") == "view") & ~F.col("exists")).alias("unwritten_reads"))


@query(
    """SELECT trace, idx, CASE WHEN ok > 0 THEN 'yes' WHEN bad > 0 THEN 'no' ELSE 'unknown' END AS there FROM (SELECT trace, idx,
        count(*) FILTER (NOT failed) OVER (PARTITION BY submitter, name) - CAST(NOT failed AS INT) AS ok,
        count(*) FILTER (failed) OVER (PARTITION BY submitter, name) - CAST(failed AS INT) AS bad FROM cells)""",
    CELLS_SQL,
)
def join_leave_self_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.leave_self_out(cells(spark, sf_dir), "name")
    return rows.select("trace", "idx", F.when(F.col("exists").isNull(), "unknown").when(F.col("exists"), "yes").otherwise("no").alias("there"))
