"""Replays of recorded runs: what a stopped cell would have done, pairs of replayed arms, probes of harnesses, and which runs to replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text
from .existence import normal_path


def absolute(path: Column, base: str = "/work") -> Column:
    """A path seen from a work folder."""
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path)))


def block_classes(cells: DataFrame, run: list[str], order: str = "idx") -> DataFrame:
    """run, order, class of each stopped cell, from what happened when it and the cells that ran before it were run anew.

    `cells` holds blocked, lost (the process went away), ok, error, and of a stopped cell its receipt: kind (column,
    key or file), missing, source. not_replayed: a cell before it, or itself, was lost; no_error;
    confirmed: the error names the receipt's key or file; other_error.
    """
    before = W.partitionBy(*run).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = cells.withColumn("_gone", F.coalesce(F.max((yes("lost") & ~yes("blocked")).cast("int")).over(before), F.lit(0)) > 0)
    names_key = F.col("kind").isin("column", "key") & (F.col("missing") == text.error_key("error"))
    names_file = (F.col("kind") == "file") & (absolute(F.col("source")) == absolute(text.missing_path(F.col("error"))))
    found = F.when(F.col("_gone"), "not_replayed").when(yes("ok"), "no_error").when(names_key | names_file, "confirmed").when(yes("lost"), "not_replayed").otherwise("other_error")
    return rows.where(yes("blocked")).select(*run, order, found.alias("class"))


def paired_replays(runs: DataFrame, unit: str, seed: str, arm: str, arms: tuple[str, str], steps: dict[str, Column]) -> DataFrame:
    """mode, stopped, not_reproduced, kept, pairs, units, mean: steps of the first arm less those of the second, as the mean over units of their seeds' means.

    `runs` holds arm, done, reproduced and matches (all earlier steps came out as recorded) of
    each run; `steps` names the counts of steps to compare. Modes: a pair counts if both arms
    are done (`primary`); also if one stopped early (`stopped_kept`); if both are done and all earlier steps
    match (`exact_prefix`). A pair whose first arm does not show the error again never counts.
    """
    one = lambda c, a: F.max(F.when(F.col(arm) == a, c))
    first, second = arms
    sides = runs.groupBy(unit, seed).agg(
        *[(one(v, first) - one(v, second)).alias(f"_d_{k}") for k, v in steps.items()],
        F.bool_and("done").alias("_done"),
        F.bool_and("matches").alias("_matches"),
        one(F.col("reproduced"), first).alias("_again"),
        F.count_distinct(arm).alias("_arms"),
    )
    sides = sides.where("_arms = 2").withColumns({"_done": F.coalesce("_done", F.lit(False)), "_again": F.coalesce("_again", F.lit(False)), "_matches": F.coalesce("_matches", F.lit(False))})
    done, again = F.col("_done"), F.col("_again")
    # mode, steps, which pairs it looks at, which of these count
    modes = [(f"{m}:{k}" if len(steps) > 1 else m, k, seen, use) for k in steps for m, seen, use in (
        ("primary", done, done & again), ("stopped_kept", F.lit(True), again), ("exact_prefix", done, done & again & F.col("_matches")))]
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), (~seen).alias("_stopped"), (seen & ~again).alias("_lost"), (use & ~done).alias("_kept"), F.when(use, F.col(f"_d_{k}").cast("double")).alias("_d")) for m, k, seen, use in modes]))
    per = sides.select(unit, each).groupBy("mode", unit).agg(*[F.count_if(c).alias(c) for c in ("_stopped", "_lost", "_kept")], F.count("_d").alias("_pairs"), F.avg("_d").alias("_mean"))
    return per.groupBy("mode").agg(F.sum("_stopped").alias("stopped"), F.sum("_lost").alias("not_reproduced"), F.sum("_kept").alias("kept"), F.sum("_pairs").alias("pairs"), F.count("_mean").alias("units"), F.avg("_mean").alias("mean"))


def short(said: Column, most: int = 160) -> Column:
    """The first characters of a text, with a note of its length."""
    return F.when(F.length(said) <= most, said).otherwise(F.concat(F.substring(said, 1, most), F.lit("...["), F.length(said).cast("string"), F.lit(" chars]")))


def returned(said: Column, letter: str = "x") -> list[Column]:
    """Of what came back of one letter printed many times: its length, the letters left, and the marker put in their place."""
    marker = F.replace(said, F.lit(letter), F.lit(""))
    return [F.length(said).alias("returned_chars"), (F.length(said) - F.length(marker)).alias("letters"), short(F.substring(marker, 1, 200), 200).alias("marker")]


def compared(results: DataFrame, probe: list[str], harness: str, ok: str = "ok", said: str = "text") -> DataFrame:
    """A row a probe: harnesses, passed, ways (different outcomes), alike, usual (the outcome of most, of equal ones the smallest) and others (how many do not give it).

    Equal rows of a harness count once; a harness with two outcomes counts in both.
    """
    way = F.concat(F.when(F.col(ok), "ok: ").otherwise("failed: "), short(F.coalesce(F.col(said), F.lit(""))))
    ways = results.select(*probe, harness, F.col(ok).alias("_ok"), way.alias("_way")).distinct().groupBy(*probe, "_way").agg(F.count("*").alias("_n"), F.count_if(F.col("_ok")).alias("_passed"))
    most = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_way").alias("way")))
    total = ways.groupBy(*probe).agg(F.sum("_n").alias("harnesses"), F.sum("_passed").alias("passed"), F.count("*").alias("ways"), most.alias("_most"))
    return total.select(*probe, "harnesses", "passed", "ways", (F.col("ways") == 1).alias("alike"), F.col("_most.way").alias("usual"), (F.col("harnesses") + F.col("_most.n")).alias("others"))


def to_replay(cells: DataFrame, run: list[str], answer: str = "answer") -> DataFrame:
    """run, why: the runs without an answer, and those in which a cell that ran touches the answer's name (`touches`)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    touched = F.coalesce(F.bool_or(yes("touches") & F.col("code").isNotNull() & ~yes("blocked")), F.lit(False))
    flags = cells.groupBy(*run).agg(touched.alias("_touched"), F.max(answer).isNull().alias("_none"))
    why = F.when(F.col("_none"), F.when(F.col("_touched"), "no answer, name touched").otherwise("no answer")).when(F.col("_touched"), "name touched")
    return flags.select(*run, why.alias("why")).where("why is not null")
