"""Resampling, exact tests and bounds against plain Python."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from sparktrail.functions import exact, resampling as res, statistics as st


def plain_weight(unit, replicate, seed="1"):
    h = hashlib.md5(f"{seed}|{unit}|{(replicate - 1) // 4}".encode()).hexdigest()
    u = h[8 * ((replicate - 1) % 4) :][:8]
    return sum(u >= b for b in res.poisson_bounds())


def test_weights_are_poisson():
    got = np.array([plain_weight(u, r) for u in range(300) for r in range(1, 101)])
    assert abs(got.mean() - 1) < 0.02 and abs(got.var() - 1) < 0.04
    assert abs((got == 0).mean() - math.exp(-1)) < 0.01


def test_replicate_sums_against_plain_python(spark):
    rows = [("a", f"u{i % 9}", float(i), 1) for i in range(40)] + [(None, "u1", 5.0, 1), ("b", None, 2.0, 1), ("b", "", None, 1)]
    df = spark.createDataFrame(rows, "g string, u string, x double, n int")
    got = {(r["g"], r["replicate"]): (r["x"], r["n"]) for r in res.replicate_sums(df, ["g"], ["u"], ["x", "n"], reps=10).collect()}
    for g in {r[0] for r in rows}:
        for k in range(11):
            w = {u: 1 if k == 0 else plain_weight(u or "", k) for _, u, _, _ in rows}
            mine = [r for r in rows if r[0] == g]
            assert got[g, k] == pytest.approx((sum(w[r[1]] * (r[2] or 0) for r in mine), sum(w[r[1]] for r in mine)))
    assert len(got) == 33


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 11).alias("x"))
    one = res.bootstrap_mean(df.repartition(1), ["g"], ["id"], "x", 100).orderBy("g").collect()
    assert one == res.bootstrap_mean(df.repartition(13), ["g"], ["id"], "x", 100).orderBy("g").collect()


def test_bootstrap_interval_agrees_with_drawing_n_of_n(spark):
    x = np.random.default_rng(3).normal(5, 2, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "u long, x double")
    got = res.bootstrap_mean(df, [], ["u"], "x", 2000).first()
    low, high = st.bootstrap_interval(x, 2000)
    assert got["estimate"] == pytest.approx(x.mean()) and got["replicates"] == 2000
    assert got["low"] == pytest.approx(low, abs=0.02) and got["high"] == pytest.approx(high, abs=0.02)


def test_conventions_read_the_sorted_values(spark):
    df = spark.createDataFrame([("g", r, float(r)) for r in range(0, 201)], "g string, replicate int, v double")
    at = lambda c: res.intervals(df, ["g"], "v", convention=c).select("estimate", "low", "high").first()
    values = list(range(1, 201))
    assert tuple(at("index")) == (0, values[5], values[194])
    assert tuple(at("cluster")) == (0, values[5], values[195])
    assert tuple(at("linear")) == pytest.approx((0, *np.percentile(values, [2.5, 97.5])))


def test_intervals_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, u long, x double")
    assert res.bootstrap_mean(empty, ["g"], ["u"], "x", 8).count() == 0
    assert res.sign_flips(empty, ["g"], ["u"], "x", 32).count() == 0
    nulls = spark.createDataFrame([("a", 1, None)], "g string, u long, x double")
    assert res.bootstrap_mean(nulls, ["g"], ["u"], "x", 8).count() == 0
    for c in ("linear", "index", "cluster"):
        row = res.bootstrap_ratio(nulls.withColumn("n", F.lit(0)), ["g"], ["u"], "x", "n", 8, convention=c).first()
        assert row["estimate"] is None and row["low"] is None and row["replicates"] == 0


def test_ratio_of_clusters_is_wider_than_of_rows(spark):
    df = spark.range(3000).select((F.col("id") % 30).alias("c"), "id", ((F.col("id") % 30) < 10).cast("int").alias("bad"), F.lit(1).alias("n"))
    wide = res.bootstrap_ratio(df, [], ["c"], "bad", "n", 400).first()
    thin = res.bootstrap_ratio(df, [], ["id"], "bad", "n", 400).first()
    assert wide["estimate"] == thin["estimate"] == pytest.approx(1 / 3)
    assert wide["high"] - wide["low"] > 4 * (thin["high"] - thin["low"])


def test_macro_difference_and_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k * 1000 + i, float(rng.normal(m, 1))) for k, m, n in ((0, 1, 400), (1, 3, 100), (2, 2, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, u long, x double")
    mean = {k: np.mean([r[2] for r in rows if r[0] == k]) for k in range(3)}
    macro = res.bootstrap_macro(df, [], "k", ["u"], "x", 300).first()
    assert macro["estimate"] == pytest.approx(np.mean(list(mean.values()))) and macro["low"] < 2 < macro["high"]
    diff = res.bootstrap_difference(df.where("k < 2"), [], F.col("k") == 1, ["u"], "x", 300).first()
    assert diff["estimate"] == pytest.approx(mean[1] - mean[0]) and 1.6 < diff["low"] < diff["high"] < 2.5
    ranks = {r["k"]: (r["estimate"], r["low"], r["high"]) for r in res.bootstrap_ranks(df, "k", ["u"], "x", 300).collect()}
    assert ranks == {0: (3, 3, 3), 1: (1, 1, 1), 2: (2, 2, 2)}


def test_audit_intervals_against_the_plain_estimate(spark):
    labels = {"pos": [1] * 30 + [2] * 8 + [3] * 2 + [4] * 5, "neg-a": [1] * 3 + [2] * 37, "neg-b": [4, 4], "neg-c": []}
    population = {"pos": 400, "neg-a": 5000, "neg-b": 70, "neg-c": 10}
    rows = spark.createDataFrame([(k, i, x) for k, v in labels.items() for i, x in enumerate(v)], "stratum string, u int, label int")
    sizes = spark.createDataFrame(list(population.items()), "stratum string, n long")
    got = {r["measure"]: r for r in res.audit_intervals(rows, sizes, "stratum", "label", ["stratum", "u"], reps=1000).collect()}
    want = st.audit_estimates(labels, population, 10_000)
    for m in ("precision", "recall", "corrected"):
        low, high = st.audit_bootstrap(labels, population, 10_000, m)
        assert got[m]["estimate"] == pytest.approx(want[m])
        assert abs(got[m]["low"] - low) < 0.25 * (high - low) and abs(got[m]["high"] - high) < 0.25 * (high - low)


def test_sign_flips_against_all_signs(spark):
    v = [0.5, 1.25, -0.25, 2.0, 0.75, -0.5, 1.0, 0.25, 1.5, -1.0]
    every = [abs(sum(a * b for a, b in zip(v, signs))) >= abs(sum(v)) - 1e-11 for signs in itertools.product((1, -1), repeat=len(v))]
    got = res.sign_flips(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "u int, x double"), [], ["u"], "x", 9984).first()
    assert got["units"] == 10 and got["mean"] == pytest.approx(np.mean(v)) and got["replicates"] == 9984
    assert got["p"] == pytest.approx(np.mean(every), abs=0.015)


def test_sign_test_against_exact_sums(spark):
    pairs = [(a, b) for a in range(12) for b in range(12)] + [(400, 460), (1000, 1400), (3000, 3100)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", exact.sign_test("a", "b").alias("p")).collect()
    for r in got:
        want = st.sign_test(r["a"], r["b"])
        assert r["p"] == (None if want is None else pytest.approx(want, rel=1e-9))


def test_bounds_against_bisection_and_draws(spark):
    counts = [(k, n) for n in (1, 2, 5, 20, 100) for k in {0, 1, n // 2, n - 1, n}] + [(0, 0), (3, 4000), (2000, 4000)]
    low, high = exact.jeffreys("k", "n")
    for r in spark.createDataFrame(counts, "k long, n long").select("k", "n", exact.upper_bound("k", "n").alias("u"), low.alias("low"), high.alias("high")).collect():
        assert r["u"] == pytest.approx(st.upper_bound(r["k"], r["n"]), rel=1e-4, abs=1e-7), r
        want = st.jeffreys_interval(r["k"], r["n"], 200_000)
        assert (r["low"], r["high"]) == pytest.approx(want, rel=0.03, abs=1e-3), r


def test_large_counts_keep_their_quantiles(spark):
    r = spark.createDataFrame([(500_000, 1_000_000)], "k long, n long").select(*exact.jeffreys("k", "n")).first()
    assert tuple(r) == pytest.approx((0.5 - 1.959964 * 0.0005, 0.5 + 1.959964 * 0.0005), abs=2e-7)


def test_normal_tail(spark):
    z = [0.0, 0.1, 1.0, 1.96, 2.9999, 3.0001, 5.0, -2.5, 12.0, 37.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", exact.normal_two_sided(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)


@settings(max_examples=12, deadline=None)
@given(s.lists(s.lists(s.integers(-6, 6) | s.integers(-1000, 1000), max_size=40), min_size=1, max_size=6))
def test_wilcoxon_against_numpy(spark, groups):
    rows = [(g, float(x) / 4) for g, v in enumerate(groups) for x in v] + [(99, None)]
    got = {r["g"]: r["p"] for r in exact.wilcoxon(spark.createDataFrame(rows, "g int, d double"), ["g"], "d").collect()}
    want = {g: st.wilcoxon(np.array(v) / 4, np.zeros(len(v))) for g, v in enumerate(groups)}
    want = {g: p for g, p in want.items() if p is not None}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-9, abs=1e-14) for g in want)


def test_wilcoxon_of_one_hot_group_is_ranked_in_many_tasks(spark):
    d = np.random.default_rng(5).normal(0.05, 1, 4000).round(6)
    df = spark.createDataFrame([(float(x),) for x in d], "d double")
    assert exact.wilcoxon(df, [], "d").first()["p"] == pytest.approx(st.wilcoxon(d, np.zeros(len(d))), rel=1e-9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = df.where("d <> 0").selectExpr("abs(d) as size", "1L as n").groupBy("size").agg(F.sum("n").alias("n"))
        parts = exact.running_counts(sizes, [], "size", "n", "before", 8)
        tasks, parts = parts.select(F.spark_partition_id()).distinct().count(), parts.toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = parts.sort_values("size")
    assert tasks > 2
    assert (parts["before"].to_numpy() == parts["n"].cumsum().to_numpy() - parts["n"].to_numpy()).all()


def test_random_intercept_against_golden_section(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, sd in (("a", 1.0), (None, 0.0), ("c", 3.0)):
        for g in range(40):
            u = rng.normal(0, sd)
            rows += [(k, g, float(1e6 + u + rng.normal())) for _ in range(rng.integers(1, 9))]
    df = spark.createDataFrame([*rows, ("a", 1, None), ("one", 1, 5.0)], "k string, g int, x double")
    got = {r["k"]: r for r in exact.random_intercept(df, ["k"], "g", "x").collect()}
    assert got["one"]["mean"] == 5 and got["one"]["se"] is None and len(got) == 4
    for k in ("a", None, "c"):
        own = [r for r in rows if r[0] == k]
        want = st.random_intercept(np.array([r[2] - 1e6 for r in own]), np.array([r[1] for r in own]))
        r = got[k]
        assert (r["groups"], r["n"]) == (40, len(own)) and r["mean"] - 1e6 == pytest.approx(want["mean"], abs=1e-5)
        assert r["se"] == pytest.approx(want["se"], rel=1e-4) and r["residual_variance"] == pytest.approx(want["residual_variance"], rel=1e-4)
        assert r["group_variance"] == pytest.approx(want["group_variance"], rel=5e-4, abs=1e-5)
