"""Intervals by resampling, and exact tests and bounds, over arms, traces and labels of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact, resampling as res
from ..sources.views import CELLS_SQL, PAIRS_SQL, cells, pairs, table
from .registry import query

_REPS = 200


def _weight_sql(h: str) -> str:
    return "CASE " + " ".join(f"WHEN {h} < '{bound}' THEN {k}e0" for k, bound in enumerate(res.poisson_bounds())) + " ELSE 12e0 END"


def _drawn(rows: str, unit: str, reps: int = _REPS) -> str:
    """A view of all units of `rows` in each replicate r, with their weight w."""
    return f"""drawn AS (
        SELECT *, CASE WHEN r = 0 THEN 1e0 ELSE {_weight_sql(f"substr(md5('1|' || {unit} || '|' || ((r - 1) // 4)), 8 * ((r - 1) % 4)::INT + 1, 8)")} END AS w
        FROM (SELECT *, unnest(range({reps} + 1)) AS r FROM {rows}))"""


def _interval(of: str, by: str = "") -> str:
    """estimate, low, high, replicates of value v by replicate r."""
    at = f"{by}, " if by else ""
    return f"""SELECT {at}max(v) FILTER (r = 0) AS estimate, quantile_cont(v, 0.025) FILTER (r > 0) AS low, quantile_cont(v, 0.975) FILTER (r > 0) AS high, count(v) FILTER (r > 0) AS replicates
        FROM ({of}) {f"GROUP BY {by}" if by else ""}"""


def _arms(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Means of both arms, where a unit has both."""
    of = lambda arm, c: F.avg(F.when(F.col("arm") == arm, F.col(c)))
    p = pairs(spark, sf_dir).groupBy(*by, "unit").agg(of("on", "correct").alias("on"), of("off", "correct").alias("off"))
    return p.where("`on` is not null and off is not null").withColumn("part", F.col("unit") % 7).withColumn("d", F.col("on") - F.col("off"))


_UNITS = """units AS (SELECT *, "on" - off AS d FROM (SELECT unit, unit % 7 AS part, avg(correct) FILTER (arm = 'on') AS "on", avg(correct) FILTER (arm = 'off') AS off FROM pairs GROUP BY unit) WHERE "on" IS NOT NULL AND off IS NOT NULL)"""


@query(
    f"""SELECT part, max(m) FILTER (r = 0) AS estimate, list_sort(list(m) FILTER (r > 0 AND m IS NOT NULL))[5 + 1] AS low, list_sort(list(m) FILTER (r > 0 AND m IS NOT NULL))[195 - 1 + 1] AS high, count(m) FILTER (r > 0) AS replicates
    FROM (SELECT part, r, sum(w * d) / nullif(sum(w), 0) AS m FROM drawn GROUP BY ALL) GROUP BY part""",
    PAIRS_SQL, _UNITS, _drawn("units", "unit"),
)
def stat_bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired difference of arms in each part, the interval read at int(.025 n) and int(.975 n) - 1."""
    return res.bootstrap_mean(_arms(spark, sf_dir), ["part"], ["unit"], "d", _REPS, convention="index")


@query(
    _interval("SELECT submitter, r, sum(w * bad) / nullif(sum(w * n), 0) AS v FROM drawn GROUP BY ALL", "submitter"),
    CELLS_SQL, "units AS (SELECT submitter, trace, count(*) FILTER (failed) AS bad, count(*) AS n FROM cells GROUP BY ALL)", _drawn("units", "trace"),
)
def stat_bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of failed cells by submitter, whole traces drawn."""
    rows = cells(spark, sf_dir).select("submitter", "trace", F.col("failed").cast("int").alias("bad"), F.lit(1).alias("n"))
    return res.bootstrap_ratio(rows, ["submitter"], ["trace"], "bad", "n", _REPS)


@query(_interval("SELECT r, avg(m) AS v FROM (SELECT part, r, sum(w * d) / nullif(sum(w), 0) AS m FROM drawn GROUP BY ALL) GROUP BY r"), PAIRS_SQL, _UNITS, _drawn("units", "unit"))
def stat_bootstrap_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over parts of the paired difference, units drawn inside parts."""
    return res.bootstrap_macro(_arms(spark, sf_dir), [], "part", ["unit"], "d", _REPS)


@query(
    _interval("""SELECT r, sum(w * "on") FILTER (part < 3) / nullif(sum(w) FILTER (part < 3), 0) - sum(w * "on") FILTER (part >= 3) / nullif(sum(w) FILTER (part >= 3), 0) AS v FROM drawn GROUP BY r"""),
    PAIRS_SQL, _UNITS, _drawn("units", "unit"),
)
def stat_bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.bootstrap_difference(_arms(spark, sf_dir), [], F.col("part") < 3, ["unit"], "on", _REPS)


@query(
    _interval("SELECT source, r, row_number() OVER (PARTITION BY r ORDER BY round(m, 9) DESC, source)::DOUBLE AS v FROM (SELECT source, r, sum(w * q) / sum(w) AS m FROM drawn GROUP BY ALL HAVING sum(w) > 0)", "source"),
    "units AS (SELECT source, doc_id, quality AS q FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)", _drawn("units", "doc_id"),
)
def stat_bootstrap_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each source by the share of good documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return res.bootstrap_ranks(rows, "source", ["doc_id"], "quality", _REPS)


@query(
    """SELECT seed, max(n) AS units, max(s / n) FILTER (r = 0) AS mean, count(*) FILTER (r > 0) AS replicates, (count(*) FILTER (r > 0 AND abs(s) >= abs(t) - 1e-12 * n) + 1)::DOUBLE / count(*) AS p FROM (
        SELECT *, max(s) FILTER (r = 0) OVER (PARTITION BY seed) AS t FROM (
            SELECT seed, r, count(*) AS n, sum(CASE WHEN r = 0 OR substr(md5('1|' || unit || '|' || ((r - 1) // 32)), ((r - 1) % 32)::INT + 1, 1) >= '8' THEN d ELSE -d END) AS s
            FROM (SELECT *, unnest(range(641)) AS r FROM by_seed) GROUP BY ALL)) GROUP BY seed""",
    PAIRS_SQL, """by_seed AS (SELECT seed, unit, avg(correct) FILTER (arm = 'on') - avg(correct) FILTER (arm = 'off') AS d FROM pairs GROUP BY ALL HAVING d IS NOT NULL)""",
)
def stat_sign_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the difference of arms zero, in each seed: 640 random flips of the units' signs."""
    return res.sign_flips(_arms(spark, sf_dir, "seed"), ["seed"], ["unit"], "d", 640)


_AUDIT = "CASE WHEN toxic = 1 THEN 'pos' ELSE 'neg-' || source END"


@query(
    _interval(
        """SELECT measure, r, CASE measure WHEN 'precision' THEN p WHEN 'recall' THEN tp / nullif(tp + fn, 0) ELSE tp + fn END AS v FROM (SELECT unnest(['precision', 'recall', 'corrected']) AS measure, * FROM (
            SELECT r, coalesce(sum(share) FILTER (stratum = 'pos'), 0) AS p, coalesce(sum(share * n) FILTER (stratum = 'pos'), 0) AS tp, coalesce(sum(share * n) FILTER (stratum <> 'pos'), 0) AS fn
            FROM (SELECT stratum, r, coalesce(sum(w * good) / nullif(sum(w), 0), 0) AS share FROM drawn GROUP BY ALL) JOIN sizes USING (stratum) GROUP BY r))""",
        "measure",
    ),
    f"strata AS (SELECT doc_id, {_AUDIT} AS stratum, quality FROM documents JOIN labels USING (doc_id))",
    "sizes AS (SELECT stratum, count(*)::DOUBLE AS n FROM strata GROUP BY 1)",
    "units AS (SELECT doc_id, stratum, (quality = 1)::INT::DOUBLE AS good FROM strata WHERE quality IS NOT NULL)", _drawn("units", "doc_id"),
)
def stat_audit_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and corrected count of a rule (toxic), audited (quality) in its stratum and those of each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    strata = rows.select("doc_id", F.when(F.col("toxic") == 1, "pos").otherwise(F.concat(F.lit("neg-"), "source")).alias("stratum"), F.when(F.col("quality") == 1, 1).when(F.col("quality").isNotNull(), 2).alias("label"))
    return res.audit_intervals(strata, strata.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "label", ["doc_id"], reps=_REPS)


# --- exact tests and bounds


@query(
    """SELECT seed, wins, losses, CASE WHEN wins + losses > 0 THEN least(1, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i:
        exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END AS p
    FROM (SELECT seed, count(*) FILTER (x > y)::BIGINT AS wins, count(*) FILTER (x < y)::BIGINT AS losses FROM (
        SELECT seed, unit, avg(correct) FILTER (arm = 'on') AS x, avg(correct) FILTER (arm = 'off') AS y FROM pairs GROUP BY ALL) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY seed)""",
    PAIRS_SQL,
)
def stat_sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in which an arm does better, by seed, and the exact test of one half."""
    counts = _arms(spark, sf_dir, "seed").groupBy("seed").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    return counts.withColumn("p", exact.sign_test("wins", "losses"))


def _beta_sql(a: str, b: str, p: str) -> str:
    """The quadrature of exact.beta_quantile in SQL over rows of `counts`, as a view's text with column q."""
    m = exact.CELLS
    return f"""SELECT trace, pow(sin(low + place * step), 2) AS q FROM (
        SELECT trace, any_value(low) AS low, any_value(step) AS step, max(i + ({p} * t - before) / f) FILTER (before < {p} * t AND {p} * t <= before + f) AS place FROM (
            SELECT *, coalesce(sum(f) OVER (PARTITION BY trace ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(f) OVER (PARTITION BY trace) AS t FROM (
                SELECT trace, low, step, i, exp(u * ln(sin(low + (i + 0.5e0) * step)) + v * ln(cos(low + (i + 0.5e0) * step)) - top) AS f FROM (
                    SELECT *, (high - low) / {m} AS step, unnest(range({m})) AS i FROM (
                        SELECT *, greatest(0e0, peak - 8 / sqrt(u + v + 1)) AS low, least(pi() / 2, peak + 8 / sqrt(u + v + 1)) AS high,
                            CASE WHEN u > 0 THEN u * ln(greatest(sin(peak), 1e-300)) ELSE 0 END + CASE WHEN v > 0 THEN v * ln(greatest(cos(peak), 1e-300)) ELSE 0 END AS top
                        FROM (SELECT *, atan2(sqrt(u), sqrt(v)) AS peak FROM (SELECT trace, 2 * ({a}) - 1 AS u, 2 * ({b}) - 1 AS v FROM counts)))))) GROUP BY trace)"""


@query(
    f"""SELECT trace, k, n, CASE WHEN n > 0 AND k < n THEN c.q ELSE 1 END AS upper, l.q AS low, h.q AS high FROM counts
        JOIN ({_beta_sql('k + 0.5e0', 'n - k + 0.5e0', '0.025e0')}) l USING (trace) JOIN ({_beta_sql('k + 0.5e0', 'n - k + 0.5e0', '0.975e0')}) h USING (trace)
        JOIN ({_beta_sql('CASE WHEN k < n THEN k + 1 ELSE 1 END', 'CASE WHEN k < n THEN n - k ELSE 1 END', '0.95e0')}) c USING (trace)""",
    CELLS_SQL, "counts AS (SELECT trace, count(*) FILTER (failed)::DOUBLE AS k, count(*)::DOUBLE AS n FROM cells GROUP BY trace)",
)
def stat_rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed cells of each trace: the one-sided exact bound, and the interval under Jeffreys' prior. Equal counts are worked out once."""
    counts = cells(spark, sf_dir).groupBy("trace").agg(F.count_if(F.col("failed")).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = exact.jeffreys("k", "n")
    bounds = counts.select("k", "n").distinct().select("k", "n", exact.upper_bound("k", "n").alias("upper"), low.alias("low"), high.alias("high"))
    return counts.join(bounds, ["k", "n"]).select("trace", "k", "n", "upper", "low", "high")


_TAIL = """CASE WHEN x <= 3 / sqrt(2e0) THEN 1 - 2 * x / sqrt(pi()) * exp(-x * x) * list_reduce(list_transform(range(80), lambda i: {'t': 0e0, 's': (80 - i)::DOUBLE}), lambda a, b: {'t': 0e0, 's': 1 + a.s * 2 * x * x / (2 * b.s + 1)}, {'t': 0e0, 's': 1e0}).s
    ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_transform(range(80), lambda i: (80 - i)::DOUBLE), lambda a, k: x + k / 2 / a, x) END"""
_RANKED = """ranked AS (SELECT g, count(*) AS n, sum(CASE WHEN up THEN place END) AS w, count(DISTINCT size) AS sizes, sum(ties * ties - 1) AS t FROM (
    SELECT *, count(*) OVER (PARTITION BY g, size) AS ties, rank() OVER (PARTITION BY g ORDER BY size) + (count(*) OVER (PARTITION BY g, size) - 1) / 2e0 AS place
    FROM (SELECT g, round(abs(d), 9) AS size, d > 0 AS up FROM diffs WHERE round(abs(d), 9) > 0)) GROUP BY g)"""

_WAYS = """ways AS (WITH RECURSIVE held(n, c) AS (SELECT 0, list_transform(range(326), lambda i: CASE WHEN i = 0 THEN 1e0 ELSE 0e0 END)
    UNION ALL SELECT n + 1, list_transform(range(326), lambda i: c[i + 1] + CASE WHEN i > n THEN c[i - n] ELSE 0 END) FROM held WHERE n < 25) SELECT * FROM held)"""


@query(
    f"SELECT seed, n, w, {_TAIL} AS p FROM (SELECT g AS seed, n, coalesce(w, 0)::DOUBLE AS w, abs(coalesce(w, 0) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - t / 48e0) / sqrt(2e0) AS x FROM ranked)",
    PAIRS_SQL, "diffs AS (SELECT seed AS g, unit, avg(cost) FILTER (arm = 'on') - avg(cost) FILTER (arm = 'off') AS d FROM pairs GROUP BY ALL)", _RANKED,
)
def stat_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank test of the units' costs in both arms, by seed."""
    of = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("cost")))
    return exact.wilcoxon(pairs(spark, sf_dir).groupBy("seed", "unit").agg((of("on") - of("off")).alias("d")), ["seed"], "d")


@query(
    """SELECT trace, n, coalesce(w, 0)::DOUBLE AS w, least(1, 2 * list_sum(ways.c[1:least(coalesce(w, 0), n * (n + 1) / 2 - coalesce(w, 0))::INT + 1]) / pow(2e0, n)) AS p
    FROM (SELECT g AS trace, n, w FROM ranked WHERE sizes = n AND n <= 25) JOIN ways USING (n)""",
    CELLS_SQL, _WAYS, "diffs AS (SELECT trace AS g, value - lag(value) OVER (PARTITION BY trace ORDER BY idx) AS d, idx FROM cells WHERE kind = 'purchase')", _RANKED,
)
def stat_wilcoxon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank test of the steps between purchases of a trace, where it has up to 25 untied ones."""
    from pyspark.sql import Window as W

    steps = cells(spark, sf_dir).where("kind = 'purchase'").withColumn("d", F.col("value") - F.lag("value").over(W.partitionBy("trace").orderBy("idx")))
    untied = steps.where("round(abs(d), 9) > 0").groupBy("trace").agg(F.count("*").alias("_n"), F.count_distinct(F.round(F.abs("d"), 9)).alias("_sizes")).where("_n = _sizes and _n <= 25")
    return exact.wilcoxon(steps, ["trace"], "d").join(untied.select("trace"), "trace", "left_semi")


def _reml_views() -> list[str]:
    """The search of exact.random_intercept in SQL: b0, b1, ... are the best points of grids g0, g1, ..."""
    points, step = int((exact.HIGH - exact.LOW) / exact.STEP), exact.STEP
    views = [f"g0 AS (SELECT seed, t FROM (SELECT DISTINCT seed FROM sizes), (SELECT CASE WHEN i >= 0 THEN {exact.LOW} + i * {step} END::DOUBLE AS t FROM range(-1, {points} + 1) r(i)))"]
    for k in range(exact.FINER + 1):
        views.append(f"""b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round((a - 1) * ln(greatest(s2, 1e-300)) + lg + ln(xx), 9), coalesce(t, -99)) AS place FROM (SELECT *, (yy - xy * xy / xx) / (a - 1) AS s2 FROM (
            SELECT seed, t, any_value(m) AS m, count(*) AS groups, sum(n) AS a, sum(n / (1 + n * r)) AS xx, sum(s / (1 + n * r)) AS xy, sum(q - r / (1 + n * r) * s * s) AS yy, sum(ln(1 + n * r)) AS lg
            FROM (SELECT *, CASE WHEN t IS NULL THEN 0e0 ELSE exp(t) END AS r FROM sizes JOIN g{k} USING (seed)) GROUP BY seed, t))) WHERE place = 1)""")
        step = step / 32
        views.append(f"g{k + 1} AS (SELECT DISTINCT seed, t + i * {step!r}::DOUBLE AS t FROM b{k}, range(-32, 33) r(i))")
    return views[:-1]


@query(
    f"SELECT seed, groups, a::BIGINT AS n, m + xy / xx AS mean, sqrt(s2 / xx) AS se, CASE WHEN t IS NULL THEN 0e0 ELSE exp(t) END * s2 AS group_variance, s2 AS residual_variance FROM b{exact.FINER}",
    PAIRS_SQL, "vals AS (SELECT seed, unit, cost + unit % 13 * 4 * (seed % 3) AS v FROM pairs)",
    "sizes AS (SELECT seed, unit, m, count(*)::DOUBLE AS n, sum(v - m) AS s, sum((v - m) * (v - m)) AS q FROM (SELECT *, avg(v) OVER (PARTITION BY seed) AS m FROM vals) GROUP BY 1, 2, 3)", *_reml_views(),
)
def stat_random_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of runs as mean, effect of the unit and noise, by seed, by restricted likelihood."""
    rows = pairs(spark, sf_dir).select("seed", "unit", (F.col("cost") + F.col("unit") % 13 * 4 * (F.col("seed") % 3)).alias("v"))
    return exact.random_intercept(rows, ["seed"], "unit", "v")
