"""Statistics of trace studies: closed forms as Columns, resampling as numpy over grouped, small vectors.

Undefined values are null. Counts are cast to double first, as decimal literals
would round. Resampling takes one vector a group (a unit is a question or a
submitter, never a cell), sorted first, so results don't depend on the order of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Z = 1.96


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def wilson(k: Column | str, n: Column | str, z: float = Z, empty: tuple | None = (0.0, 1.0), clamp: bool = False) -> tuple[Column, Column]:
    """Bounds of a proportion; for n = 0 `empty`, or null."""
    k, n = _d(k), _d(n)
    safe = F.greatest(n, F.lit(1.0))
    p, d = k / safe, 1 + z * z / safe
    mid, half = (p + z * z / (2 * safe)) / d, z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / d
    low, high = mid - half, mid + half
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    low_empty, high_empty = (F.lit(None), F.lit(None)) if empty is None else map(F.lit, empty)
    return F.when(n > 0, low).otherwise(low_empty), F.when(n > 0, high).otherwise(high_empty)


def newcombe_paired(a: str, b: str, c: str, d: str, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of paired proportions (a+b)/n - (a+c)/n with its bounds, by Wilson bounds and a continuity-corrected phi."""
    a, b, c, d = (_d(x) for x in (a, b, c, d))
    n = a + b + c + d
    p1, p2 = (a + b) / n, (a + c) / n
    l1, u1 = wilson(a + b, n, z)
    l2, u2 = wilson(a + c, n, z)
    num = a * d - b * c
    num = F.when(num > 0, F.greatest(num - n / 2, F.lit(0.0))).otherwise(num)
    den = (a + b) * (c + d) * (a + c) * (b + d)
    phi = F.when(den > 0, num / F.sqrt(F.greatest(den, F.lit(1e-300)))).otherwise(0.0)
    diff = p1 - p2
    low = diff - F.sqrt(F.greatest((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2, F.lit(0.0)))
    high = diff + F.sqrt(F.greatest((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2, F.lit(0.0)))
    return diff, low, high


def kappa(both: str, neither: str, only_a: str, only_b: str) -> Column:
    """Cohen's kappa of two binary coders; null where chance agreement is 1."""
    yy, nn, yn, ny = (_d(x) for x in (both, neither, only_a, only_b))
    n = yy + nn + yn + ny
    po = (yy + nn) / n
    pe = ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n * n)
    return F.when(pe < 1, (po - pe) / (1 - F.when(pe < 1, pe).otherwise(0.0)))


def at_least(low: Column, high: Column, limit: float) -> Column:
    """fails: the whole interval is below the limit; passes: none of it is."""
    return F.when(high < limit, "fails").when(low >= limit, "passes").otherwise("undecided")


def not_most(low: Column, high: Column, limit: float = 0.5) -> Column:
    """fails: the whole interval is above the limit; passes: all of it is below."""
    return F.when(low > limit, "fails").when(high < limit, "passes").otherwise("undecided")


def rule_of_three(n: Column | str) -> Column:
    """Exact upper 95 % bound of a rate with no event in n trials; 1 for n = 0."""
    n = _d(n)
    return F.when(n > 0, 1 - F.pow(F.lit(0.05), 1 / F.greatest(n, F.lit(1.0)))).otherwise(1.0)


def sign_test(wins: int, losses: int) -> float | None:
    """Two-sided exact binomial test of wins against losses (also McNemar's)."""
    n, k = wins + losses, min(wins, losses)
    return None if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def upper_bound(k: int, n: int, level: float = 0.95) -> float:
    """One-sided Clopper-Pearson bound, by bisection."""
    if n == 0 or k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(mid) + (n - i) * math.log1p(-mid)) for i in range(k + 1)) if 0 < mid < 1 else float(mid == 0)
        low, high = (mid, high) if tail > 1 - level else (low, mid)
    return high


def wilcoxon(x: np.ndarray, y: np.ndarray) -> float | None:
    """Signed-rank test, two-sided, zeros dropped; exact up to 25 untied differences, else normal with tie correction."""
    d = np.asarray(x, float) - np.asarray(y, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return None
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    ranks = np.empty(n)
    values, first, counts = np.unique(size[order], return_index=True, return_counts=True)
    for f, c in zip(first, counts):
        ranks[order[f : f + c]] = f + (c + 1) / 2
    w = float(ranks[d > 0].sum())
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        low = ways[: int(min(w, n * (n + 1) / 2 - w)) + 1].sum() / 2**n
        return min(1.0, 2 * low)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2))


def holm(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted p-values inside each family."""
    from pyspark.sql import Window as W

    family = W.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p)
    raw = F.least(F.lit(1.0), (F.count("*").over(family) - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_raw")


def _means(values: np.ndarray, reps: int, rng: np.random.Generator) -> np.ndarray:
    out = np.empty(reps)
    step = max(1, 4_000_000 // max(1, len(values)))
    for i in range(0, reps, step):
        at = rng.integers(0, len(values), (min(step, reps - i), len(values)))
        out[i : i + step] = values[at].mean(1)
    return out


def bootstrap_interval(values, reps: int = 10_000, seed: int = 20261012, convention: str = "linear") -> tuple[float, float]:
    """Percentile interval of the mean. linear: interpolated; index: v[int(.025 n)], v[int(.975 n) - 1]; cluster: v[int(.975 n)] at the top."""
    values = np.sort(np.asarray(values, float))
    means = _means(values, reps, np.random.default_rng(seed))
    if convention == "linear":
        return tuple(np.percentile(means, [2.5, 97.5]))
    means.sort()
    return means[int(0.025 * reps)], means[int(0.975 * reps) - (convention == "index")]


def sign_flip(values, reps: int = 100_000, seed: int = 20261012) -> float:
    """Permutation test of a zero mean by random signs."""
    values = np.sort(np.asarray(values, float))
    rng, hits = np.random.default_rng(seed), 0
    step = max(1, 4_000_000 // max(1, len(values)))
    for i in range(0, reps, step):
        signs = rng.integers(0, 2, (min(step, reps - i), len(values))) * 2 - 1
        hits += int((np.abs((signs * values).mean(1)) >= abs(values.mean()) - 1e-12).sum())
    return (hits + 1) / (reps + 1)


def resampled(units: DataFrame, by: str, value: str, reps: int = 2000, seed: int = 20261012) -> DataFrame:
    """by, n, mean, low, high, p_flip for one value a unit: bootstrap interval and sign-flip test of each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy(float)
        low, high = bootstrap_interval(v, reps, seed)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(v)], "mean": [np.sort(v).mean()], "low": [low], "high": [high], "p_flip": [sign_flip(v, reps, seed)]})

    return units.select(by, value).groupBy(by).applyInPandas(run, f"{by} {dict(units.dtypes)[by]}, n long, mean double, low double, high double, p_flip double")


def cluster_bootstrap(rows: DataFrame, by: str, cluster: str, num: str, den: str, reps: int = 2000, seed: int = 20261012) -> DataFrame:
    """Interval of sum(num)/sum(den) when whole clusters are drawn. Clusters are summed before they leave the executors."""
    sums = rows.groupBy(by, cluster).agg(F.sum(_d(num)).alias("num"), F.sum(_d(den)).alias("den"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["num", "den"])
        a, b = pdf["num"].to_numpy(float), pdf["den"].to_numpy(float)
        rng, ratios = np.random.default_rng(seed), []
        for _ in range(reps):
            at = rng.integers(0, len(a), len(a))
            if b[at].sum():
                ratios.append(a[at].sum() / b[at].sum())
        ratios.sort()
        n = len(ratios)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "clusters": [len(a)], "ratio": [a.sum() / b.sum() if b.sum() else None], "low": [ratios[int(0.025 * n)] if n else None], "high": [ratios[int(0.975 * n)] if n else None]})

    return sums.groupBy(by).applyInPandas(run, f"{by} {dict(rows.dtypes)[by]}, clusters long, ratio double, low double, high double")


def poisson_bootstrap(rows: DataFrame, by: str, num: str, den: str, unit: str, reps: int = 200) -> DataFrame:
    """replicate ratios of sums at any size: each unit gets a Poisson(1) weight from a hash of (unit, replicate), in JVM code; sums combine before the shuffle."""
    u = (F.pmod(F.xxhash64(unit, "replicate"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, tail, p = F.lit(0), F.lit(0.0), math.exp(-1)
    for k in range(8):
        tail = tail + p
        weight = weight + (u > tail).cast("int")
        p /= k + 1
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_w", weight)
    ratio = F.try_divide(F.sum(_d(num) * F.col("_w")), F.sum(_d(den) * F.col("_w")))
    return drawn.groupBy(by, "replicate").agg(ratio.alias("ratio"))


def fixed_effects_logit(rows: DataFrame, y: str, x: str, effects: list[str], cluster: str, iterations: int = 100) -> dict:
    """Odds ratio of x with fixed effects and cluster-robust errors: Newton steps over counts of equal rows.

    Rows with equal (y, x, effects, cluster) are counted first, in Spark; groups of
    the last effect in which y is constant carry no information and are left out.
    """
    cells = rows.groupBy(y, x, *effects, *[c for c in [cluster] if c not in effects]).agg(F.count("*").alias("_n")).toPandas()
    last = effects[-1]
    cells = cells[cells.groupby(last)[y].transform("nunique") > 1].reset_index(drop=True)
    parts = [pd.get_dummies(cells[e].astype(str), prefix=e, drop_first=True).to_numpy(float) for e in effects]
    design = np.column_stack([np.ones(len(cells)), cells[x].to_numpy(float), *parts])
    target, n = cells[y].to_numpy(float), cells["_n"].to_numpy(float)
    beta = np.zeros(design.shape[1])
    for _ in range(iterations):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        info = (design * (n * mu * (1 - mu))[:, None]).T @ design
        step = np.linalg.pinv(info) @ (design.T @ (n * (target - mu)))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
    score = design * (n * (target - mu))[:, None]
    groups, inverse = np.unique(cells[cluster].astype(str), return_inverse=True)
    sums = np.zeros((len(groups), design.shape[1]))
    np.add.at(sums, inverse, score)
    bread = np.linalg.pinv((design * (n * mu * (1 - mu))[:, None]).T @ design)
    g = len(groups)
    total = n.sum()
    correction = g / (g - 1) * (total - 1) / (total - design.shape[1]) if g > 1 and total > design.shape[1] else 1.0
    se = math.sqrt(max((correction * bread @ sums.T @ sums @ bread)[1, 1], 0.0))
    return {"odds_ratio": math.exp(beta[1]), "low": math.exp(beta[1] - Z * se), "high": math.exp(beta[1] + Z * se), "n": int(total)}


def random_intercept(y: np.ndarray, group: np.ndarray) -> dict:
    """REML of y = mean + group effect + noise: variance ratio by golden-section search, mean and its standard error."""
    groups, inverse = np.unique(group, return_inverse=True)
    n = np.bincount(inverse)
    sums, squares = np.bincount(inverse, y), float((y * y).sum())
    total, g = len(y), len(groups)

    def parts(ratio: float):
        shrink = ratio / (1 + n * ratio)
        xx = (n - shrink * n * n).sum()
        xy = (sums - shrink * n * sums).sum()
        yy = squares - (shrink * sums * sums).sum()
        mean = xy / xx
        return mean, xx, (yy - xy * xy / xx) / (total - 1)

    def loss(t: float) -> float:
        ratio = math.exp(t)
        _, xx, s2 = parts(ratio)
        return (total - 1) * math.log(max(s2, 1e-300)) + np.log1p(n * ratio).sum() + math.log(xx)

    a, b, k = -16.0, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(120):
        c, d = b - k * (b - a), a + k * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    ratio = math.exp((a + b) / 2)
    if loss(-16.0) <= loss((a + b) / 2):
        ratio = 0.0
    mean, xx, s2 = parts(ratio)
    return {"mean": mean, "se": math.sqrt(s2 / xx), "group_variance": ratio * s2, "residual_variance": s2, "groups": g}


def jeffreys_interval(k: int, n: int, draws: int = 400_000, seed: int = 1) -> tuple[float, float]:
    """Monte-Carlo interval of a proportion under Beta(k + 1/2, n - k + 1/2)."""
    return tuple(np.quantile(np.random.default_rng(seed).beta(k + 0.5, n - k + 0.5, draws), [0.025, 0.975]))


def grouped_difference(units: pd.DataFrame, group: str, x: str, y: str, reps: int = 2000, seed: int = 20261012) -> dict:
    """Macro mean over groups of x - y, units drawn inside each group and in pairs, with interval and signed-rank test."""
    units = units.sort_values([group, x, y])
    parts = [g[[x, y]].to_numpy(float) for _, g in units.groupby(group, sort=True)]
    rng = np.random.default_rng(seed)
    draws = np.mean([_means(p[:, 0] - p[:, 1], reps, rng) for p in parts], axis=0)
    d = units[x].to_numpy(float) - units[y].to_numpy(float)
    low, high = np.percentile(draws, [2.5, 97.5])
    return {"estimate": float(np.mean([(p[:, 0] - p[:, 1]).mean() for p in parts])), "low": float(low), "high": float(high), "flat_mean": float(d.mean()), "n": len(d), "n_nonzero": int((d != 0).sum()), "wilcoxon_p": wilcoxon(d, np.zeros(len(d)))}


def two_group_difference(a, b, reps: int = 2000, seed: int = 20261012) -> tuple[float, float, float]:
    """mean(a) - mean(b) and its interval, the groups drawn apart."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    rng = np.random.default_rng(seed)
    draws = _means(a, reps, rng) - _means(b, reps, rng)
    return float(a.mean() - b.mean()), *map(float, np.percentile(draws, [2.5, 97.5]))


def ratio_of_sums(num, den, reps: int = 2000, seed: int = 20261012) -> tuple[float, float, float]:
    """sum(num) / sum(den) over drawn units; replicates without a denominator are left out."""
    order = np.lexsort((den, num))
    num, den = np.asarray(num, float)[order], np.asarray(den, float)[order]
    at = np.random.default_rng(seed).integers(0, len(num), (reps, len(num)))
    n, d = num[at].sum(1), den[at].sum(1)
    return float(num.sum() / den.sum()), *map(float, np.percentile(n[d > 0] / d[d > 0], [2.5, 97.5]))


def audit_estimates(labels: dict[str, list[int]], population: dict[str, int], total: int) -> dict:
    """Precision, recall and corrected count of a rule from labels (1 right, 2 or 3 wrong, others left out) of the strata pos, and neg-*."""

    def share(stratum: str) -> float:
        counted = [x for x in labels.get(stratum, ()) if x in (1, 2, 3)]
        return counted.count(1) / len(counted) if counted else 0.0

    precision = share("pos")
    hits = population["pos"] * precision
    missed = sum(n * share(s) for s, n in population.items() if s != "pos")
    return {"precision": precision, "tp": hits, "fn": missed, "recall": hits / (hits + missed) if hits + missed else None, "corrected": hits + missed, "corrected_share": (hits + missed) / total, "rule_share": population["pos"] / total}


def audit_bootstrap(labels: dict[str, list[int]], population: dict[str, int], total: int, measure: str, reps: int = 2000, seed: int = 20261012) -> tuple[float, float]:
    """Interval of one of the estimates when labels are drawn anew inside each stratum."""
    rng = np.random.default_rng(seed)
    held = {s: np.sort(np.asarray(v)) for s, v in sorted(labels.items())}
    got = [audit_estimates({s: rng.choice(v, len(v)).tolist() for s, v in held.items() if len(v)}, population, total)[measure] for _ in range(reps)]
    return tuple(float(x) for x in np.percentile([g for g in got if g is not None], [2.5, 97.5]))


def rank_bootstrap(units: pd.DataFrame, group: str, value: str, reps: int = 1000, seed: int = 20261012) -> dict[str, tuple[float, float]]:
    """Interval of each group's rank (1: highest mean) when its units are drawn anew."""
    rng = np.random.default_rng(seed)
    names = sorted(units[group].unique())
    draws = np.stack([_means(np.sort(units.loc[units[group] == g, value].to_numpy(float)), reps, rng) for g in names], 1)
    ranks = (-draws).argsort(1, kind="stable").argsort(1, kind="stable") + 1
    return {g: tuple(float(x) for x in np.percentile(ranks[:, i], [2.5, 97.5])) for i, g in enumerate(names)}
