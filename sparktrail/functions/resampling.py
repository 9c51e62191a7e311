"""Resampling of any number of units: weights and signs from hashes, sums in the JVM.

A unit (a question, a trace, a submitter) is drawn whole: its rows are summed first.
The draws of a unit depend on its key, the number of the replicate and a seed only,
so they are the same for any order, partitioning or retry of tasks, and in SQL. A
unit becomes a row for each block of replicates, but sums of a group and block are
made before the shuffle, so what is shuffled does not grow with the units.

Bootstrap weights are Poisson(1), which takes no count of the group's units; for many units the
intervals are those of drawing n of n. Replicate 0 is the sample itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Draws made of one MD5: eight hex digits each.
DRAWS = 4


def poisson_bounds() -> list[str]:
    """Eight hex digits at which the weight goes up by one: the cumulated Poisson(1) shares of 2^32."""
    bounds, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        bounds.append(f"{min(int(total * 2**32), 2**32 - 1):08x}")
        p /= k + 1
    return bounds


def _weight(h: Column, j: int) -> Column:
    digits, weight = F.substring(h, 8 * j + 1, 8), None
    for k, bound in enumerate(poisson_bounds()):
        weight = F.when(digits < bound, float(k)) if weight is None else weight.when(digits < bound, float(k))
    return weight.otherwise(12.0)


def _blocks(whole: DataFrame, unit: list[str], blocks: int, seed: str) -> DataFrame:
    """A row for each unit and block, with the MD5 of `seed|unit|block`; block -1 is the sample. A null key draws as an empty one."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in unit]
    every = whole.withColumn("_block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))
    return every.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), *key, F.col("_block").cast("string"))))


def replicate_sums(rows: DataFrame, by: list[str], unit: list[str], sums: list[str], reps: int = 1000, seed: str = "1") -> DataFrame:
    """by, replicate (0: the sample), and the weighted sum of each column of `sums`, nulls left out."""
    whole = rows.groupBy(*by, *unit).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    drawn = _blocks(whole, unit, -(-reps // DRAWS), seed)
    sample = F.col("_block") < 0
    each = [F.sum(F.when(sample, 1.0 if j == 0 else 0.0).otherwise(_weight(F.col("_h"), j)) * F.col(c)).alias(f"_{j}_{c}") for j in range(DRAWS) for c in sums]
    wide = drawn.groupBy(*by, "_block").agg(*each)
    number = lambda j: F.when(sample, 0 if j == 0 else -1).otherwise(F.col("_block") * DRAWS + j + 1)
    rows = F.inline(F.array(*[F.struct(number(j).cast("int").alias("replicate"), *[F.col(f"_{j}_{c}").alias(c) for c in sums]) for j in range(DRAWS)]))
    return wide.select(*by, rows).where(F.col("replicate").between(0, reps))


def intervals(replicates: DataFrame, by: list[str], value: str, level: float = 0.95, convention: str = "linear") -> DataFrame:
    """by, estimate (of the sample), low, high, replicates (those with a value).

    linear: interpolated percentiles. index: the sorted values at int(.025 n) and
    int(.975 n) - 1, counted from 0. cluster: at int(.975 n) above. A group has as many values as replicates.
    """
    a = round((1 - level) / 2, 12)
    b = round(1 - a, 12)
    value_of = F.when(F.col("replicate") > 0, F.col(value))
    n = F.count(value_of)
    if convention == "linear":
        low, high = F.percentile(value_of, F.lit(a)), F.percentile(value_of, F.lit(b))
    else:
        at = F.sort_array(F.collect_list(value_of))
        low, high = F.try_element_at(at, (F.floor(a * n) + 1).cast("int")), F.try_element_at(at, (F.floor(b * n) + (0 if convention == "index" else 1)).cast("int"))
        low, high = F.when(n > 0, low), F.when(F.floor(b * n) > 0, high)
    return replicates.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col(value))).alias("estimate"), low.alias("low"), high.alias("high"), n.alias("replicates"))


def _mean_replicates(rows: DataFrame, by: list[str], unit: list[str], value: str, reps: int, seed: str) -> DataFrame:
    """by, replicate, mean: null where no unit of the group was drawn."""
    held = rows.where(F.col(value).isNotNull()).select(*by, *unit, F.col(value).alias("_sum"), F.lit(1.0).alias("_n"))
    return replicate_sums(held, by, unit, ["_sum", "_n"], reps, seed).select(*by, "replicate", F.try_divide("_sum", "_n").alias("mean"))


def bootstrap_mean(rows: DataFrame, by: list[str], unit: list[str], value: str, reps: int = 1000, seed: str = "1", convention: str = "linear") -> DataFrame:
    """Interval of the mean of a value, whole units drawn; of pairs, give their difference as the value."""
    return intervals(_mean_replicates(rows, by, unit, value, reps, seed), by, "mean", convention=convention)


def bootstrap_ratio(rows: DataFrame, by: list[str], unit: list[str], num: str, den: str, reps: int = 1000, seed: str = "1", convention: str = "linear") -> DataFrame:
    """Interval of sum(num) / sum(den), whole units drawn; replicates without a denominator are left out."""
    sums = replicate_sums(rows.select(*by, *unit, F.col(num).alias("_num"), F.col(den).alias("_den")), by, unit, ["_num", "_den"], reps, seed)
    return intervals(sums.withColumn("_ratio", F.try_divide("_num", "_den")), by, "_ratio", convention=convention)


def bootstrap_macro(rows: DataFrame, by: list[str], stratum: str, unit: list[str], value: str, reps: int = 1000, seed: str = "1") -> DataFrame:
    """Interval of the mean over strata of their means, units drawn inside each; a stratum of which a replicate draws none is left out of that replicate."""
    means = _mean_replicates(rows, [*by, stratum], unit, value, reps, seed)
    return intervals(means.groupBy(*by, "replicate").agg(F.avg("mean").alias("macro")), by, "macro")


def bootstrap_difference(rows: DataFrame, by: list[str], side: Column, unit: list[str], value: str, reps: int = 1000, seed: str = "1") -> DataFrame:
    """Interval of mean(side true) - mean(side false), the two sides drawn apart; rows of a null side are left out."""
    means = _mean_replicates(rows.withColumn("_side", side).where("_side is not null"), [*by, "_side"], unit, value, reps, seed)
    of = lambda s: F.max(F.when(F.col("_side") if s else ~F.col("_side"), F.col("mean")))
    return intervals(means.groupBy(*by, "replicate").agg((of(True) - of(False)).alias("difference")), by, "difference")


def bootstrap_ranks(rows: DataFrame, group: str, unit: list[str], value: str, reps: int = 1000, seed: str = "1") -> DataFrame:
    """Interval of each group's rank (1: the highest mean, equal to nine places: the smaller group) among all groups of a replicate."""
    means = _mean_replicates(rows, [group], unit, value, reps, seed).where("mean is not null")
    place = F.row_number().over(W.partitionBy("replicate").orderBy(F.round("mean", 9).desc(), group))
    return intervals(means.withColumn("rank", place.cast("double")), [group], "rank")


def sign_flips(rows: DataFrame, by: list[str], unit: list[str], value: str, reps: int = 9984, seed: str = "1") -> DataFrame:
    """by, units, mean, replicates, p: permutation test of a zero mean by random signs, (hits + 1) / (replicates + 1).

    The sign of a unit is the first bit of one of the 32 hex digits of an MD5. `reps` is rounded
    up to a multiple of 32. The value of a unit is the sum of its rows; units of null only are left out.
    """
    whole = rows.where(F.col(value).isNotNull()).groupBy(*by, *unit).agg(F.sum(F.col(value).cast("double")).alias("_v"))
    blocks = -(-reps // 32)
    signed = lambda j: F.when((F.col("_block") < 0) | (F.substring("_h", j + 1, 1) >= "8"), F.col("_v")).otherwise(-F.col("_v"))
    sums = _blocks(whole, unit, blocks, seed).groupBy(*by, "_block").agg(F.count("*").alias("_n"), *[F.sum(signed(j)).alias(f"_{j}") for j in range(32)])
    # a group has one row a block here, whatever the number of its units
    total = F.max(F.when(F.col("_block") < 0, F.abs("_0"))).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    hits = sum((F.abs(f"_{j}") >= F.col("_total") - 1e-12 * F.col("_n")).cast("int") for j in range(32))
    drawn = F.col("_block") >= 0
    marked = sums.withColumn("_total", total)
    p = (F.sum(F.when(drawn, hits).otherwise(0)) + 1) / F.lit(float(32 * blocks + 1))
    return marked.groupBy(*by).agg(F.max("_n").alias("units"), F.max(F.when(~drawn, F.col("_0") / F.col("_n"))).alias("mean"), (F.count_if(drawn) * 32).alias("replicates"), p.alias("p"))


def audit_intervals(labels: DataFrame, population: DataFrame, stratum: str, label: str, unit: list[str], rule: str = "pos", reps: int = 1000, seed: str = "1") -> DataFrame:
    """measure, estimate, low, high, replicates of precision, recall, corrected: a rule's audit, labels drawn anew inside each stratum.

    Label 1 is right, 2 and 3 are wrong, others are left out. `population` has a row a
    stratum with its size `n`; stratum `rule` holds what the rule found, all others what it
    did not. A stratum without labels counts as share 0.
    """
    x = F.col(label)
    counted = labels.select(stratum, *unit, F.when(x == 1, 1.0).otherwise(0.0).alias("_right"), F.when(x.isin(1, 2, 3), 1.0).otherwise(0.0).alias("_n"))
    shares = replicate_sums(counted, [stratum], unit, ["_right", "_n"], reps, seed).select(stratum, "replicate", F.coalesce(F.try_divide("_right", "_n"), F.lit(0.0)).alias("_share"))
    found = shares.join(population.select(stratum, F.col("n").cast("double").alias("_size")), stratum)
    hit = F.col(stratum) == rule
    precision = F.coalesce(F.sum(F.when(hit, F.col("_share"))), F.lit(0.0))
    tp = F.coalesce(F.sum(F.when(hit, F.col("_share") * F.col("_size"))), F.lit(0.0))
    fn = F.coalesce(F.sum(F.when(~hit, F.col("_share") * F.col("_size"))), F.lit(0.0))
    per = found.groupBy("replicate").agg(precision.alias("_p"), tp.alias("_tp"), fn.alias("_fn"))
    measures = {"precision": F.col("_p"), "recall": F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")), "corrected": F.col("_tp") + F.col("_fn")}
    long = per.select("replicate", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()])))
    return intervals(long, ["measure"], "value")
