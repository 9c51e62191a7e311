"""Replays, probes and paths against plain Python and worked cases."""

import posixpath
import statistics

from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from sparktrail.operators import existence, replays


@settings(max_examples=25, deadline=None)
@given(s.lists(s.text("a./b", max_size=12) | s.sampled_from(["", "/", "//", "///", "//a/..", "../..", "a/../..", "/..", "./.", "a//b/./../c"]), min_size=1, max_size=60))
def test_normal_path(spark, paths):
    got = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", existence.normal_path("p").alias("n")).collect()
    assert all(r["n"] == existence.normal(r["p"]) for r in got)
    assert all(r["n"] == posixpath.normpath(r["p"]) for r in got if r["p"] is not None)


CELL = "run int, idx int, blocked boolean, lost boolean, ok boolean, error string, kind string, missing string, source string"


def test_block_classes(spark):
    stop = lambda run, idx, error=None, kind="column", missing="a", source=None, ok=False, lost=None: (run, idx, True, lost, ok, error, kind, missing, source)
    rows = [
        stop(1, 2, "KeyError: 'a'"),
        stop(1, 3, "KeyError: 'b'"),
        stop(1, 4, ok=True),
        stop(1, 5, "FileNotFoundError: [Errno 2] No such file or directory: '/work/d/x.csv'", "file", None, "./d//y/../x.csv"),
        stop(1, 6, "FileNotFoundError: [Errno 2] No such file or directory: 'e/x.csv'", "file", None, "x.csv"),
        stop(1, 7, lost=True),
        stop(1, 8, None, None, None),
        (2, 1, False, True, None, None, None, None, None),
        stop(2, 2, "KeyError: 'a'"),
        stop(3, 1, lost=True),
        stop(3, 2, "KeyError: 'a'", "key"),
    ]
    got = {(r["run"], r["idx"]): r["class"] for r in replays.block_classes(spark.createDataFrame(rows, CELL), ["run"]).collect()}
    assert got == {(1, 2): "confirmed", (1, 3): "other_error", (1, 4): "no_error", (1, 5): "confirmed", (1, 6): "other_error", (1, 7): "not_replayed", (1, 8): "other_error", (2, 2): "not_replayed", (3, 1): "not_replayed", (3, 2): "confirmed"}
    assert replays.block_classes(spark.createDataFrame([], CELL), ["run"]).count() == 0


def test_paired_replays_against_a_plain_loop(spark):
    rows = [(u, seed, arm, (u * 5 + seed * 3 + len(arm)) % 7, (u + seed + len(arm)) % 4 != 0, (u * 3 + seed) % 5 != 0, u % 3 != 0) for u in range(20) for seed in range(3) for arm in ("first", "other") if (u, arm, seed) != (4, "other", 1)]
    runs = spark.createDataFrame(rows, "u int, seed int, arm string, steps int, done boolean, reproduced boolean, matches boolean")
    got = {r["mode"]: r for r in replays.paired_replays(runs, "u", "seed", "arm", ("first", "other"), {"steps": F.col("steps")}).collect()}
    by = {(r[0], r[1], r[2]): r for r in rows}
    for mode in ("primary", "stopped_kept", "exact_prefix"):
        held, stopped, lost, kept = {}, 0, 0, 0
        for u in range(20):
            for seed in range(3):
                a, b = by.get((u, seed, "first")), by.get((u, seed, "other"))
                if a is None or b is None:
                    continue
                both = a[4] and b[4]
                if not both and mode != "stopped_kept":
                    stopped += 1
                elif not a[5]:
                    lost += 1
                elif mode != "exact_prefix" or (a[6] and b[6]):
                    kept += not both
                    held.setdefault(u, []).append(a[3] - b[3])
        r = got[mode]
        assert (r["stopped"], r["not_reproduced"], r["kept"], r["pairs"], r["units"]) == (stopped, lost, kept, sum(map(len, held.values())), len(held))
        assert abs(r["mean"] - statistics.mean(statistics.mean(v) for v in held.values())) < 1e-12


def test_probes(spark):
    rows = [("p", h, True, "same") for h in "abc"] + [("q", "a", True, "1"), ("q", "b", False, "1"), ("q", "c", False, None), ("q", "d", False, "1"), ("q", "d", False, "1"), ("r", "a", True, "y" * 200), ("r", "b", True, "y" * 201)]
    got = {r["probe"]: tuple(r)[1:] for r in replays.compared(spark.createDataFrame(rows, "probe string, h string, ok boolean, text string"), ["probe"], "h").collect()}
    assert got["p"] == (3, 3, 1, True, "ok: same", 0)
    assert got["q"] == (4, 1, 3, False, "failed: 1", 2)
    assert got["r"] == (2, 2, 2, False, "ok: " + "y" * 160 + "...[200 chars]", 1)
    long = spark.createDataFrame([("x" * 50 + "[cut]" + "x" * 9,), ("",), (None,)], "t string").select(*replays.returned(F.col("t"))).collect()
    assert [tuple(r) for r in long] == [(64, 59, "[cut]"), (0, 0, ""), (None, None, None)]


def test_runs_to_replay(spark):
    rows = [(1, "c", False, "a", True), (1, "c", False, "a", False), (2, "c", True, "a", True), (3, None, False, "a", True), (4, "c", None, None, None), (5, "c", None, None, True), (6, "c", False, "a", False)]
    df = spark.createDataFrame(rows, "run int, code string, blocked boolean, answer string, touches boolean")
    assert {r["run"]: r["why"] for r in replays.to_replay(df, ["run"]).collect()} == {1: "name touched", 4: "no answer", 5: "no answer, name touched"}
