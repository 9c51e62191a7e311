"""Group aggregates with the conventions of trace studies."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import cut_lineage
from .joins import small


def share(n: Column, of: Column) -> Column:
    """n / of as a double; 0 where `of` is 0, never null."""
    return n.cast("double") / F.greatest(of, F.lit(1)).cast("double")


def with_total(rows: DataFrame, key: str, *aggs: Column, total: str = "ALL") -> DataFrame:
    """Groups and their pooled total in one pass."""
    grouped = rows.rollup(key).agg(F.grouping(key).alias("_all"), *aggs)
    return grouped.withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_all")


def index_percentile(rows: DataFrame, by: list[str], value: str, p: float, cells: int = 256, few: int = 10_000) -> DataFrame:
    """(by..., n, value): v[int(p * n)] of the sorted values of each group, from 0, exactly; nulls are not counted.

    No task sorts a group: the range of values is cut into cells, counted with
    partial sums, and the cell that holds the place is cut again, until it holds few
    rows or one value only. A round reads the rows again and moves a row a cell; the ranges
    of the groups, where these are measured to be few, are sent to the rows, as a join by
    shuffle would sort all rows of a group in one task.
    """
    v, key = F.col(value).cast("double"), [f"_by{i}" for i in range(len(by))]
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(k) for c, k in zip(by, key)], v.alias("_v"))
    at = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_in"))
    at = cut_lineage(at.withColumn("_k", F.least(F.floor(F.lit(p) * F.col("n")).cast("long"), F.col("n") - 1)))

    def inside() -> DataFrame:
        """The values in the range that is left of each group of more than one value."""
        left = at.where(F.col("_low") < F.col("_high")).select(*[F.col(k).alias(f"_at{k}") for k in key], "n", "_k", "_low", "_high")
        on = [rows[k].eqNullSafe(left[f"_at{k}"]) for k in key]
        return rows.join(small(left), on).where(F.col("_v").between(F.col("_low"), F.col("_high"))).drop(*[f"_at{k}" for k in key])

    while not at.where((F.col("_in") > few) & (F.col("_low") < F.col("_high"))).isEmpty():
        cell = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))
        counted = inside().withColumn("_cell", cell).groupBy(*key, "n", "_k", "_cell").agg(F.count("*").alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_in").over(W.partitionBy(*key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        held = counted.withColumn("_before", before).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_in")))
        next_ = held.select(*key, "n", "_low", "_high", "_in", (F.col("_k") - F.col("_before")).alias("_k"))
        at = cut_lineage(next_.union(at.where(F.col("_low") == F.col("_high")).select(*next_.columns)))
    # of one value that is it; else at most `few` values of each group are sorted
    alone = at.where(F.col("_low") == F.col("_high")).select(*key, "n", F.col("_low").alias("value"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("_v")) - 1
    some = inside().withColumn("_place", place).where(F.col("_place") == F.col("_k")).select(*key, "n", F.col("_v").alias("value"))
    return alone.union(some).toDF(*by, "n", "value")


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value, with their share of all rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n").cast("double") / F.col("total")).alias("share")).orderBy(F.desc("n"), key).limit(k)


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties by value."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct(F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def macro_mean(rows: DataFrame, levels: list[str], value: str, out: str) -> DataFrame:
    """Means of means: over the last level first, then up; `levels` from the outermost."""
    for depth in range(len(levels), 0, -1):
        rows = rows.groupBy(*levels[:depth]).agg(F.avg(value).alias(out))
        value = out
    return rows.groupBy().agg(F.avg(value).alias(out))


def varying(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows of groups in which the value is not constant."""
    w = W.partitionBy(by)
    return rows.withColumn("_d", F.min(value).over(w) != F.max(value).over(w)).where("_d").drop("_d")


def group_hash(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """SHA-256 of the texts of a group, each after its order, in that order; rows without a text or an order are left out, their group isn't.

    Rows are sorted by (group, order) and hashed as they pass: no task holds a group.
    """
    line = F.concat(F.col(order).cast("string"), F.col(text))
    rows = rows.select(F.col(by).alias("by"), F.col(order).alias("order"), line.alias("line"))

    def run(batches):
        at = digest = None
        for batch in batches:
            keys, out = batch.column(0), []
            for key, said in zip(keys, batch.column(2)):
                if digest is None or key != at:
                    if digest is not None:
                        out.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                if said.is_valid:
                    digest.update(said.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in out], keys.type), pa.array([h for _, h in out])], names=["by", "hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], at.type), pa.array([digest.hexdigest()])], names=["by", "hash"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "by").sortWithinPartitions("by", "order", "line").mapInArrow(run, f"by {dict(rows.dtypes)['by']}, hash string").withColumnRenamed("by", by)


def first_examples(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k)


def weighted_mean(rows: DataFrame, value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.col(weight))
