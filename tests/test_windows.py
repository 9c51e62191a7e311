"""Window forms against plain loops over random traces."""

import random

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import aggregates as agg, joins, sampling, windows as win

SCHEMA = "trace long, idx int, submitter int, failed boolean, error_type string, error_key string, inspect boolean, kind string, name int, value double"


def random_cells(seed, traces=25, longest=30):
    rng = random.Random(seed)
    rows = []
    for t in range(traces):
        for i in range(1, rng.randint(1, longest) + 1):
            failed = rng.random() < 0.45
            rows.append((t, i, t % 3, failed, rng.choice(["KeyError", "NameError", "FileNotFoundError", "SyntaxError"]) if failed else None, rng.choice(["a", "b", None]) if failed else None, rng.random() < 0.3, rng.choice("xyz"), rng.randrange(5), rng.random()))
    rng.shuffle(rows)
    return rows


def by_trace(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recovery(spark, seed):
    rows = random_cells(seed)
    got = {(r["trace"], r["idx"]): (r["next_ok"], r["retry_chain"], r["same_key"]) for r in win.with_recovery(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for cells in by_trace(rows).values():
        for i, c in enumerate(cells):
            later = next((j for j in range(i + 1, len(cells)) if not cells[j][3]), None)
            nxt = cells[i + 1] if i + 1 < len(cells) else None
            want = (nxt is not None and not nxt[3], None if later is None else later - i - 1, None if nxt is None or c[5] is None else nxt[5] == c[5])
            assert got[c[0], c[1]] == want


@pytest.mark.parametrize("seed", [3, 4])
def test_episodes(spark, seed):
    rows, want = random_cells(seed), {}
    for cells in by_trace(rows).values():
        for i, c in enumerate(cells):
            if not (c[3] and c[4] in win.DATA_REFERENCE) or (i and cells[i - 1][3]):
                continue
            ok = next((d for d in cells[i + 1 :] if not d[3]), None)
            fix = next((d for d in cells[i + 1 :] if not d[3] and not d[6]), None)
            before_fix = [d for d in cells[i + 1 :] if fix is None or d[1] < fix[1]]
            repeat = any(d[3] and d[5] is not None and d[5] == c[5] for d in before_fix) if c[5] is not None else None
            want[c[0], c[1]] = (ok and ok[1] - c[1], ok and ok[6], fix and fix[1] - c[1], fix and fix[9], repeat)
    got = {(r["trace"], r["idx"]): (r["k_success"], r["first_ok_inspects"], r["k_fix"], r["fix_value"], r["repeat"] if r["error_key"] is not None else None) for r in win.episodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and want


def test_names_files_and_cuts(spark):
    rows = random_cells(5)
    df = spark.createDataFrame(rows, SCHEMA)
    earlier = {(r["trace"], r["idx"]): r["reads_earlier"] for r in win.running_names(df, "name", ok_only=True).collect()}
    wrote = {(r["trace"], r["idx"]): r["exists"] for r in win.written_earlier(df, "name", F.col("kind") == "x", F.col("value") > 0.9).collect()}
    before = {(r["trace"], r["idx"]): r["context"] for r in win.previous_cells(df, 3, "kind").collect()}
    cut = {(r["trace"], r["idx"]) for r in win.cut_at_first(df, F.col("kind") == "z", 4).collect()}
    n_ok = {(r["trace"], r["idx"]): r["n"] for r in win.running_count(df, ~F.col("failed"), "n").collect()}
    first = {r["trace"]: (r["first_idx"], r["after_ok"]) for r in win.first_event(df, F.col("kind") == "z").collect()}
    for t, cells in by_trace(rows).items():
        event = next((i for i, c in enumerate(cells) if c[7] == "z"), None)
        after = None if event is None or event + 1 == len(cells) else not cells[event + 1][3]
        assert first[t] == (None if event is None else cells[event][1], after)
        for i, c in enumerate(cells):
            k, past = (c[0], c[1]), cells[:i]
            assert earlier[k] == any(d[8] == c[8] and not d[3] for d in past)
            assert wrote[k] is (True if any(d[8] == c[8] and d[7] == "x" for d in past) else None if any(d[9] > 0.9 for d in past) else False)
            assert before[k] == [d[7] for d in past[-3:]]
            assert (k in cut) == (event is not None and i < event <= 4)
            assert n_ok[k] == sum(not d[3] for d in past)


def test_leave_self_out(spark):
    rows = random_cells(6)
    got = {(r["trace"], r["idx"]): r["exists"] for r in joins.leave_self_out(spark.createDataFrame(rows, SCHEMA), "name").collect()}
    for c in rows:
        others = [d for d in rows if d[2] == c[2] and d[8] == c[8] and d[:2] != c[:2]]
        assert got[c[:2]] is (True if any(not d[3] for d in others) else False if others else None)


def test_totals_are_sums_and_shares_are_never_null(spark):
    df = spark.createDataFrame(random_cells(7), SCHEMA)
    rows = {r["submitter"]: r for r in agg.with_total(df, "submitter", F.count("*").alias("n"), agg.share(F.count_if(F.lit(False)), F.count_if(F.lit(False))).alias("zero")).collect()}
    assert rows["ALL"]["n"] == sum(r["n"] for k, r in rows.items() if k != "ALL") and all(r["zero"] == 0.0 for r in rows.values())


def test_numbers_in_order_have_no_hot_value(spark):
    rows = spark.range(5000).select(F.lit("same").alias("a"), (F.col("id") % 3).alias("b"), "id").repartition(5)
    got = joins.numbered_rows(rows, ["a", "b"], "k", parts=7)
    assert got.columns == ["a", "b", "id", "k"]
    by = sorted((r["k"], r["b"]) for r in got.collect())
    assert [k for k, _ in by] == list(range(1, 5001)) and [b for _, b in by] == sorted(b for _, b in by)
    assert len({r["id"] for r in got.collect()}) == 5000
    sizes = [n for (n,) in rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(7, "a", "b", "_tie").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2500
    assert joins.numbered_rows(rows.limit(0), ["b"], "k").count() == 0


def test_index_percentile_is_exact_without_sorting_a_group(spark):
    rng = random.Random(5)
    groups = {"even": list(range(4000)), "one": [7.5] * 3000, "skewed": [10.0 ** rng.randrange(-3, 12) * rng.random() for _ in range(3000)], "two": [1.0] * 1500 + [2.0] * 1500, "few": [3, 1, 2], None: [5.0, -1.0], "none": []}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("few", None), ("none", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for p in (0.0, 0.5, 0.95, 0.999, 1.0):
        got = {r["g"]: (r["n"], r["value"]) for r in agg.index_percentile(df, ["g"], "v", p, cells=4, few=50).collect()}
        assert got == {g: (len(v), sorted(v)[min(int(p * len(v)), len(v) - 1)]) for g, v in groups.items() if v}
    plan = agg.index_percentile(df, ["g"], "v", 0.5)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_compare_and_strict_compare(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 1, "y")], "k int, line int, o string")
    b = spark.createDataFrame([(1, None, "z"), (3, 1, "y")], "k int, line int, o string")
    got = {(r["k"], r["line"]): (r["old"], r["new"], r["side"]) for r in joins.compare(a, b, ["k", "line"], "o").collect()}
    assert got == {(1, None): ("x", "z", "both"), (2, 1): ("y", None, "only_old"), (3, 1): (None, "y", "only_new")}
    with pytest.raises(ValueError):
        joins.strict_compare(a, b, ["k", "line"], "o")
    with pytest.raises(ValueError):
        joins.strict_compare(a.union(a), a, ["k", "line"], "o")
    assert joins.strict_compare(a, a, ["k", "line"], "o").count() == 2


def test_paths_numbers_and_last_attempts(spark):
    left = spark.createDataFrame([("a/b/c.csv",), ("c.csv",), ("xc.csv",)], "p string")
    right = spark.createDataFrame([("b/c.csv",), ("c.csv",)], "q string")
    many = spark.range(20000).select(F.concat(F.lit("d"), F.col("id"), F.lit("/data.csv")).alias("p"))
    same = joins.suffix_pairs(many, many.withColumnRenamed("p", "q"), "p", "q")
    assert same.count() == 20000 and same.where("p <> q").count() == 0
    assert {tuple(r) for r in joins.suffix_pairs(left, right, "p", "q").collect()} == {("a/b/c.csv", "b/c.csv"), ("a/b/c.csv", "c.csv"), ("c.csv", "b/c.csv"), ("c.csv", "c.csv")}
    rng = random.Random(3)
    keys = [rng.randrange(50) for _ in range(400)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(7)
    got = {r["i"]: r["line"] for r in joins.numbered_rows(rows, ["k", "i"], "line").collect()}
    assert got == {i: n for n, (k, i) in enumerate(sorted((k, i) for i, k in enumerate(keys)), 1)}
    last = {r["k"]: r["i"] for r in win.last_of_key(rows, ["k"], ["i"]).collect()}
    assert last == {k: max(i for i, x in enumerate(keys) if x == k) for k in set(keys)}


def test_samples_do_not_depend_on_order(spark):
    df = spark.createDataFrame(random_cells(8), SCHEMA)
    take = lambda d: sorted((r["trace"], r["idx"]) for r in sampling.round_robin(d, "submitter", "trace", ["trace", "idx"], 9).collect())
    assert take(df) == take(df.repartition(9).orderBy("value")) and len(take(df)) == 9
    capped = sampling.capped_share(df, "submitter", ["trace"], ["trace", "idx"], 2)
    assert capped.groupBy("submitter").count().agg(F.max("count")).first()[0] == 2 and capped.select("trace").distinct().count() == capped.count()


def test_found_elsewhere_counts(spark):
    df = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n"), ("a", "n"), ("a", "own"), ("a", "two"), ("b", "two"), ("a", None), ("c", None)], "source string, name string")
    got = {(r["source"], r["name"]): (r["others"], r["another"], r["class"]) for r in joins.found_elsewhere(df).collect()}
    assert got["a", "n"] == (2, "c", "several others") and got["b", "n"] == (2, "a", "several others") and got["c", "n"] == (2, "a", "several others")
    assert got["a", "own"] == (0, None, "here only") and got["a", "two"] == (1, "b", "one other") and got["b", "two"] == (1, "a", "one other")
    assert got["c", None] == (1, "a", "one other") and len(got) == 8
