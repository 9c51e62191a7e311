"""Exact tests and bounds as Columns: sign tests, quantiles of Beta, the signed-rank test.

Counts come from aggregates, so a Column works on a row a group, however many rows
the group had. Sums over the terms of a distribution are array functions of one row.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import cut_lineage

#: Cells of the quadrature of a Beta quantile.
CELLS = 2048


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _named(value: Column, use) -> Column:
    """use(value), with the value worked out once and not at each mention."""
    return F.transform(F.array(value), use)[0]


def sign_test(wins: Column | str, losses: Column | str) -> Column:
    """Two-sided exact binomial test of wins against losses at one half (also McNemar's); null without either.

    Terms C(n, i) / 2^n are summed from the smallest up, each as a multiple of the next, with the logarithm of the last kept apart.
    """
    wins, losses = _d(wins), _d(losses)
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct((-n * math.log(2)).alias("last"), F.lit(1.0).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    add = lambda s, i: F.struct((s["last"] + F.log((n - i + 1) / i)).alias("last"), (s["sum"] * i / (n - i + 1) + 1).alias("sum"))
    p = F.aggregate(steps, start, add, lambda s: 2 * s["sum"] * F.exp(s["last"]))
    return F.when(n > 0, F.least(F.lit(1.0), p))


def beta_quantile(a: Column, b: Column, p: float, cells: int = CELLS) -> Column:
    """Quantile of Beta(a, b), a and b at least one half, by the midpoint rule.

    With x = sin(t)^2 the density is sin(t)^(2a-1) cos(t)^(2b-1), without poles. It is
    summed over cells around its peak, eight spreads to each side, and the cell that holds p is interpolated.
    """
    shape = F.struct((2 * _d(a) - 1).alias("u"), (2 * _d(b) - 1).alias("v"))
    peak = _named(shape, lambda c: F.struct(c["u"].alias("u"), c["v"].alias("v"), F.atan2(F.sqrt(c["u"]), F.sqrt(c["v"])).alias("peak"), (8 / F.sqrt(c["u"] + c["v"] + 1)).alias("reach")))

    def grid(c: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), c["peak"] - c["reach"]), F.least(F.lit(math.pi / 2), c["peak"] + c["reach"])
        log_of = lambda n, x: F.when(n > 0, n * F.log(F.greatest(x, F.lit(1e-300)))).otherwise(0.0)
        top = log_of(c["u"], F.sin(c["peak"])) + log_of(c["v"], F.cos(c["peak"]))
        return F.struct(c["u"].alias("u"), c["v"].alias("v"), low.alias("low"), ((high - low) / cells).alias("step"), top.alias("top"))

    def summed(g: Column) -> Column:
        points = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: g["low"] + (i + 0.5) * g["step"])
        weights = F.transform(points, lambda t: F.exp(g["u"] * F.log(F.sin(t)) + g["v"] * F.log(F.cos(t)) - g["top"]))
        return F.struct(g["low"].alias("low"), g["step"].alias("step"), weights.alias("w"))

    def place(g: Column) -> Column:
        need = F.aggregate(g["w"], F.lit(0.0), lambda s, w: s + w, lambda s: s * p)
        # left: what is still to come of the share; negative once its cell is found
        start = F.struct(need.alias("left"), F.lit(0.0).alias("at"))
        step = lambda s, w: F.when(s["left"] <= 0, s).otherwise(F.struct((s["left"] - w).alias("left"), (s["at"] + F.least(F.lit(1.0), F.try_divide(s["left"], w))).alias("at")))
        found = F.aggregate(g["w"], start, lambda s, w: F.when(w > 0, step(s, w)).otherwise(F.struct(s["left"].alias("left"), (s["at"] + F.when(s["left"] > 0, 1.0).otherwise(0.0)).alias("at"))), lambda s: s["at"])
        return F.pow(F.sin(g["low"] + found * g["step"]), F.lit(2.0))

    return _named(_named(_named(peak, grid), summed), place)


def upper_bound(k: Column | str, n: Column | str, level: float = 0.95) -> Column:
    """One-sided Clopper-Pearson bound of a rate; 1 for k = n or n = 0."""
    k, n = _d(k), _d(n)
    inside = (n > 0) & (k < n)
    return F.when(inside, beta_quantile(F.when(inside, k + 1).otherwise(1.0), F.when(inside, n - k).otherwise(1.0), level)).otherwise(1.0)


def jeffreys(k: Column | str, n: Column | str, level: float = 0.95) -> tuple[Column, Column]:
    """Bounds of a rate under Beta(k + 1/2, n - k + 1/2)."""
    a, b, tail = _d(k) + 0.5, _d(n) - _d(k) + 0.5, round((1 - level) / 2, 12)
    return beta_quantile(a, b, tail), beta_quantile(a, b, round(1 - tail, 12))


def normal_two_sided(z: Column) -> Column:
    """P(|N| >= |z|): the series of the error function up to 3, Laplace's continued fraction beyond."""
    x = F.abs(z) / math.sqrt(2)
    gauss = F.exp(-x * x)
    term = lambda s, i: F.struct((s["t"] * 2 * x * x / (2 * i + 1)).alias("t"), (s["s"] + s["t"] * 2 * x * x / (2 * i + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), term, lambda s: s["s"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda s, i: x + i / 2 / s)
    return F.when(x <= 3 / math.sqrt(2), 1 - 2 * x / math.sqrt(math.pi) * gauss * series).otherwise(gauss / math.sqrt(math.pi) / fraction)


def signed_rank_exact(w: Column, n: Column, most: int = 25) -> Column:
    """Two-sided p of the rank sum w of n different differences: the number of subsets of 1..n for each sum, of 2^n."""
    top = most * (most + 1) // 2
    ways = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.transform(F.sequence(F.lit(0), F.lit(top)), lambda i: F.when(i == 0, 1.0).otherwise(0.0)),
        lambda held, r: F.transform(held, lambda x, i: x + F.when(i >= r, F.get(held, i - r)).otherwise(0.0)),
    )
    tail = F.least(w, n * (n + 1) / 2 - w).cast("int")
    return F.least(F.lit(1.0), 2 * F.aggregate(F.slice(ways, 1, tail + 1), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n))


def running_counts(counts: DataFrame, by: list[str], order: str, n: str, out: str, parts: int = 64) -> DataFrame:
    """Adds the sum of n over the rows of the group that come before: by ranges of (group, order), so that a hot group is many tasks."""
    ranged = cut_lineage(counts.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()))
    starts = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_n"))
    before = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]]
    condition = key[0]
    for k in key[1:]:
        condition = condition & k
    joined = ranged.alias("a").join(starts.alias("b"), condition).select("a.*", "_start")
    inside = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_part", "_start")


def wilcoxon(rows: DataFrame, by: list[str], difference: str) -> DataFrame:
    """by, n, w, p: signed-rank test, two-sided, zeros and nulls dropped; exact up to 25 untied differences, else normal with tie correction.

    Equal sizes are counted first, and share the mean of their ranks. Sizes that agree to nine places are equal.
    """
    size = F.round(F.abs(F.col(difference).cast("double")), 9)
    held = rows.select(*by, size.alias("_size"), (F.col(difference) > 0).cast("long").alias("_up")).where("_size > 0")
    counts = held.groupBy(*by, "_size").agg(F.count("*").alias("_n"), F.sum("_up").alias("_up"))
    ranked = running_counts(counts, by, "_size", "_n", "_before").withColumn("_rank", F.col("_before") + (F.col("_n") + 1) / 2)
    n, ties = F.col("n").cast("double"), F.col("_ties")
    sums = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("w"), F.sum(F.pow(_d("_n"), F.lit(3.0)) - F.col("_n")).alias("_ties"))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    small = (F.col("n") <= 25) & (ties == 0)
    p = F.when(small, signed_rank_exact(F.col("w"), F.when(small, n).otherwise(1.0))).otherwise(normal_two_sided((F.col("w") - mean) / F.sqrt(var)))
    return sums.select(*by, "n", "w", p.alias("p"))


#: Where the variance ratio is looked for: logarithms, and how often the step is made 32 times finer.
LOW, HIGH, STEP, FINER = -16.0, 8.0, 0.25, 2


def random_intercept(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, groups, n, mean, se, group_variance, residual_variance: REML of value = mean + group effect + noise, nulls left out.

    Groups are first brought down to their size, sum and sum of squares. The restricted likelihood at each
    variance ratio of a grid is a sum over groups, made before the shuffle; the
    grid then closes in on its best point. Ratio 0 (no group effect) wins where no other is
    better by a 10^9th. The ratio is right to about 1.2e-4 of itself. Null below two rows.
    """
    v = F.col(value).cast("double")
    # squares from the mean of all, so that a far origin costs no digits
    held = rows.select(*by, group, v.alias("_v")).where("_v is not null")
    centre = held.groupBy(*by).agg(F.avg("_v").alias("_m"))
    keyed = _beside(held, centre, by)
    sizes = cut_lineage(keyed.groupBy(*by, group, "_m").agg(F.count("*").cast("double").alias("_n"), F.sum(F.col("_v") - F.col("_m")).alias("_s"), F.sum(F.pow(F.col("_v") - F.col("_m"), F.lit(2.0))).alias("_q")))
    points = int((HIGH - LOW) / STEP)
    best, step = sizes.select(*by).distinct().withColumn("_grid", F.sequence(F.lit(-1), F.lit(points)).cast("array<double>")).withColumn("_grid", F.transform("_grid", lambda i: F.when(i < 0, F.lit(None)).otherwise(LOW + i * STEP))), STEP
    for _ in range(FINER + 1):
        at = _beside(sizes, best, by).withColumn("_t", F.explode("_grid"))
        r, n, s = F.coalesce(F.exp("_t"), F.lit(0.0)), F.col("_n"), F.col("_s")
        w = 1 / (1 + n * r)
        sums = at.groupBy(*by, "_t", "_m").agg(F.count("*").alias("groups"), F.sum(n).alias("_all"), F.sum(n * w).alias("_xx"), F.sum(s * w).alias("_xy"), F.sum(F.col("_q") - r * w * s * s).alias("_yy"), F.sum(F.log1p(n * r)).alias("_log"))
        s2 = F.try_divide(F.col("_yy") - F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx")), F.col("_all") - 1)
        scored = sums.withColumn("_s2", s2).withColumn("_loss", (F.col("_all") - 1) * F.log(F.greatest("_s2", F.lit(1e-300))) + F.col("_log") + F.log("_xx"))
        found = scored.groupBy(*by).agg(F.min_by(F.struct("groups", "_all", "_m", "_xx", "_xy", "_s2", "_t"), F.struct(F.round("_loss", 9), F.coalesce("_t", F.lit(-99.0)))).alias("_b"))
        step = step / 32
        around = F.array(*[F.col("_b._t") + i * step for i in range(-32, 33)])
        best = cut_lineage(found.withColumn("_grid", F.when(F.col("_b._t").isNull(), F.array(F.lit(None).cast("double"))).otherwise(around)))
        found, best = best.drop("_grid"), best.drop("_b")
    b, ratio = F.col("_b"), F.coalesce(F.exp("_b._t"), F.lit(0.0))
    return found.select(*by, b["groups"].alias("groups"), b["_all"].cast("long").alias("n"), (b["_m"] + b["_xy"] / b["_xx"]).alias("mean"), F.sqrt(F.try_divide(b["_s2"], b["_xx"])).alias("se"), (ratio * b["_s2"]).alias("group_variance"), b["_s2"].alias("residual_variance"))


def _beside(rows: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of the one row of their group; null keys are equal. Without keys that is one row for all."""
    if not by:
        return rows.crossJoin(F.broadcast(one))
    key = functools.reduce(operator.and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    return rows.alias("a").join(one.alias("b"), key).select("a.*", *[F.col(f"b.{c}") for c in one.columns if c not in by])
