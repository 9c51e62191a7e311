"""Deterministic samples: order by a hash of the key, never by a random number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hash_order(*cols: str, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("|", *([F.lit(salt)] if salt else []), *[F.col(c).cast("string") for c in cols]), 256)


def per_stratum(rows: DataFrame, stratum: str, key: list[str], n: int, salt: str = "") -> DataFrame:
    """The first n of each stratum in hash order. Top-n is kept before the shuffle, as Spark limits a window group by rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(*key, salt=salt), *key))).where(F.col("rank") <= n)


def round_robin(rows: DataFrame, by: str, unit: str, key: list[str], n: int) -> DataFrame:
    """One row a unit, then groups in turn: the first of each group, the second of each, up to n rows."""
    h = hash_order(*key)
    one = rows.withColumn("_h", h).withColumn("_r", F.row_number().over(W.partitionBy(unit).orderBy("_h", *key))).where("_r = 1")
    turn = one.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy("_h", *key)))
    return turn.drop("_r").where(F.col("turn") <= n).orderBy("turn", by).limit(n).drop("_h")


def capped_share(rows: DataFrame, by: str, unit: list[str], key: list[str], most: int) -> DataFrame:
    """One row a unit, at most `most` of each group."""
    h = hash_order(*key)
    one = rows.withColumn("_h", h).withColumn("_r", F.row_number().over(W.partitionBy(*unit).orderBy("_h", *key))).where("_r = 1")
    return one.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("_h", *key))).where(F.col("_k") <= most).drop("_h", "_r", "_k")
