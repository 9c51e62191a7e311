"""Ordered analytics inside a trace: window functions over (trace, idx).

All windows of one call share partitioning and order, so Spark plans one shuffle
and one sort for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

#: Error types that name data which is not there, and those of the executor.
DATA_REFERENCE = ("KeyError", "KeyError(wrapped)", "index-error(wrapped)", "FileNotFoundError", "ValueError:usecols")
EXECUTOR = ("executor:forbidden", "executor:budget", "ModuleNotFoundError")


def _trace() -> WindowSpec:
    return W.partitionBy("trace").orderBy("idx")


def _later() -> WindowSpec:
    return _trace().rowsBetween(1, W.unboundedFollowing)


def _earlier() -> WindowSpec:
    return _trace().rowsBetween(W.unboundedPreceding, -1)


def error_group(error_type: Column | str = "error_type") -> Column:
    c = F.col(error_type) if isinstance(error_type, str) else error_type
    return F.when(c.isin(*DATA_REFERENCE), "data-reference").when(c.isin(*EXECUTOR), "executor").when(c.isNotNull(), "other")


def with_recovery(cells: DataFrame) -> DataFrame:
    """next_ok (false on the last cell), retry_chain (failures before the next success; null: never) and same_key (null: no next cell)."""
    ok_at = F.min(F.when(~F.col("failed"), F.col("idx"))).over(_later())
    next_idx = F.lead("idx").over(_trace())
    same = F.lead("error_key").over(_trace()) == F.col("error_key")
    return (
        cells.withColumn("next_ok", F.coalesce(~F.lead("failed").over(_trace()), F.lit(False)))
        .withColumn("retry_chain", ok_at - F.col("idx") - 1)
        .withColumn("same_key", F.when(next_idx.isNotNull() & F.col("error_key").isNotNull(), F.coalesce(same, F.lit(False))))
    )


def episodes(cells: DataFrame) -> DataFrame:
    """One row a recovery episode: a data-reference failure whose previous cell did not fail.

    k_success and k_fix are the distances to the next success, and to the next
    that is more than an inspection; first_ok_inspects and fix_value belong to
    those cells; repeat says that the same key failed again before the fix.
    """
    ok_cell = F.when(~F.col("failed"), F.struct("idx", "inspect"))
    fix_cell = F.when(~F.col("failed") & ~F.col("inspect"), F.struct("idx", "value"))
    seen = (
        cells.withColumn("before", F.lag("failed").over(_trace()))
        .withColumn("ok", F.min(ok_cell).over(_later()))
        .withColumn("fix", F.min(fix_cell).over(_later()))
        # the next failure of the same key
        .withColumn("key_again", F.min(F.when(F.col("failed"), F.col("idx"))).over(W.partitionBy("trace", "error_key").orderBy("idx").rowsBetween(1, W.unboundedFollowing)))
    )
    started = seen.where(F.col("failed") & F.col("error_type").isin(*DATA_REFERENCE) & ~F.coalesce("before", F.lit(False)))
    return started.select(
        "trace",
        "idx",
        "submitter",
        "error_key",
        (F.col("ok.idx") - F.col("idx")).alias("k_success"),
        F.col("ok.inspect").alias("first_ok_inspects"),
        (F.col("fix.idx") - F.col("idx")).alias("k_fix"),
        F.col("fix.value").alias("fix_value"),
        F.coalesce(F.col("key_again") < F.coalesce("fix.idx", F.lit(1 << 30)), F.lit(False)).alias("repeat"),
    )


def running_names(cells: DataFrame, name: Column | str, ok_only: bool = False) -> DataFrame:
    """reads_earlier: the cell's name was bound by an earlier cell of the trace (by an earlier one that did not fail).

    The first place of each name answers it, so no list grows along the trace.
    """
    binds = F.when(~F.col("failed"), F.col("idx")) if ok_only else F.col("idx")
    first = F.min(binds).over(W.partitionBy("trace", name))
    return cells.withColumn("reads_earlier", F.coalesce(first < F.col("idx"), F.lit(False)))


def stateless(cells: DataFrame, name: str = "name", min_cells: int = 20, limit: float = 0.5) -> DataFrame:
    """Per submitter: of cells that read an earlier name, k failed with NameError of n; keeps names unless k/n > limit on at least min_cells."""
    reads = running_names(cells, name).where("reads_earlier")
    n = reads.groupBy("submitter").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("error_type") == "NameError", F.lit(False))).alias("k"))
    return n.withColumn("keeps_names", ~((F.col("n") >= min_cells) & (F.col("k").cast("double") / F.col("n") > limit)))


def previous_cells(cells: DataFrame, n: int, what: str) -> DataFrame:
    """The `what` of up to n cells before, oldest first."""
    return cells.withColumn("context", F.collect_list(what).over(_trace().rowsBetween(-n, -1)))


def cut_at_first(cells: DataFrame, event: Column, most: int | None = None) -> DataFrame:
    """Cells before the first event of their trace; traces without an event, or with more than `most` cells before, are left out."""
    at = F.min(F.when(event, F.col("idx"))).over(W.partitionBy("trace"))
    cut = cells.withColumn("cut", at).where(F.col("idx") < F.col("cut"))
    return cut if most is None else cut.where(F.col("cut") - 1 <= most)


def first_event(cells: DataFrame, event: Column) -> DataFrame:
    """Per trace: the place of its first event (null: none), and whether the cell after it is ok."""
    marked = cells.withColumn("after_ok", ~F.lead("failed").over(_trace())).withColumn("_e", event)
    hit = F.min(F.when(F.col("_e"), F.struct("idx", "after_ok")))
    return marked.groupBy("trace").agg(hit.alias("e")).select("trace", F.col("e.idx").alias("first_idx"), F.col("e.after_ok").alias("after_ok"))


def written_earlier(cells: DataFrame, path: str, writes: Column, opaque: Column) -> DataFrame:
    """exists: true if an earlier cell wrote the path; unknown if not, but an earlier cell wrote what can't be told; else false."""
    wrote = F.min(F.when(writes, F.col("idx"))).over(W.partitionBy("trace", path)) < F.col("idx")
    blurred = F.coalesce(F.bool_or(opaque).over(_earlier()), F.lit(False))
    return cells.withColumn("exists", F.when(F.coalesce(wrote, F.lit(False)), True).when(blurred, None).otherwise(False))


def last_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by `order`: later attempts replace earlier ones. An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def running_count(cells: DataFrame, what: Column, out: str) -> DataFrame:
    """How many earlier cells of the trace it holds for."""
    return cells.withColumn(out, F.coalesce(F.sum(what.cast("long")).over(_earlier()), F.lit(0)))
