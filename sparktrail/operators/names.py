"""Names that are nearly the same, and where a missing key exists."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Letters from rare to common: a fixed order that makes the first tokens of a name rare. Any order gives the same result.
RARE_FIRST = "zqjxkvbywgpfmucdlhrsnioate_"


def _tokens(name: Column) -> Column:
    """The letters of a name as (which time it stands there, letter), the rarest first: a set, whose overlap is that of the letters with repeats."""
    letters = F.array_sort(F.split(name, ""))
    seen = F.transform(letters, lambda x, i: F.struct((-(i - F.array_position(letters, x))).cast("int").alias("again"), F.call_function("locate", x, F.lit(RARE_FIRST)).alias("common"), x.alias("letter")))
    return F.array_sort(seen)


def _least(length: Column, other: Column, cutoff: float) -> Column:
    """The letters that two names of these lengths must share for a ratio of the cutoff."""
    return F.greatest(F.ceil((length + other) * (cutoff / 2) - 1e-9), F.lit(1)).cast("int")


@F.pandas_udf(T.DoubleType())
def _ratio(name: pd.Series, key: pd.Series) -> pd.Series:
    matcher, out = difflib.SequenceMatcher(), []
    for a, b in zip(name, key):
        if matcher.b != b:
            matcher.set_seq2(b)
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return pd.Series(out)


def near_names(keys: DataFrame, known: DataFrame, cutoff: float = 0.8, n: int = 1, key: str = "key", name: str = "name") -> DataFrame:
    """(key, name, ratio, nth): the n known names nearest to each different key, of at least the cutoff by matching blocks, ties to the name that sorts last.

    Letters in matching blocks are shared letters, so a ratio r of names of
    lengths a and b needs r(a+b)/2 of them. In one order of all letters, names that share so
    many have one in common among their first ones: these are an inverted index,
    joined on letter and length. Pairs with enough shared letters are then measured. No pair of the cutoff is lost. A null or empty key has no near name.
    """

    def prefixes(rows: DataFrame, c: str, out: str) -> DataFrame:
        each = rows.select(F.col(c).alias(out)).where(F.length(c) > 0).distinct().withColumn("_len", F.length(out)).withColumn("_set", _tokens(F.col(out)))
        # by the shortest name that can be near; a longer one must share more
        shortest = F.ceil(F.col("_len") * (cutoff / (2 - cutoff)) - 1e-9)
        first = F.col("_len") - _least(F.col("_len"), shortest, cutoff) + 1
        return each.withColumn("_first", F.slice("_set", 1, F.greatest(first, F.lit(0))))

    left = prefixes(keys, key, "key")
    right = prefixes(known, name, "name").select("name", F.col("_len").alias("_len2"), F.col("_set").alias("_set2"), F.explode("_first").alias("_t2"))
    # the lengths that can be near are few, and a key of the join with the letter
    low, high = F.ceil(F.col("_len") * (cutoff / (2 - cutoff)) - 1e-9), F.floor(F.col("_len") * ((2 - cutoff) / cutoff) + 1e-9)
    asked = left.withColumn("_l", F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), high.cast("int")))).withColumn("_t", F.explode("_first"))
    met = asked.join(right, (F.col("_l") == F.col("_len2")) & (F.col("_t") == F.col("_t2")))
    enough = F.size(F.array_intersect("_set", "_set2")) >= _least(F.col("_len"), F.col("_len2"), cutoff)
    pairs = met.where(enough).select("key", "name").distinct().withColumn("ratio", _ratio("name", "key")).where(F.col("ratio") >= cutoff)
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ratio"), F.desc("name")))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= n)


def key_classes(keys: DataFrame, known: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(source, key, class) of each different (source, key): the key is a name of its source, of another one, is one in other letters, nearly one, or none.

    `known` has (source, name). Names are joined, not sent to the tasks.
    """
    asked = keys.select("source", "key").where("key is not null").distinct()
    names = known.select("source", "name").where("name is not null").distinct()
    here = names.select("source", F.col("name").alias("key"), F.lit(True).alias("here"))
    there = names.select(F.col("name").alias("key"), F.lit(True).alias("there")).distinct()
    lower = names.select(F.lower("name").alias("_lower"), F.lit(True).alias("cased")).distinct()
    told = asked.join(here, ["source", "key"], "left").join(there, "key", "left").withColumn("_lower", F.lower("key")).join(lower, "_lower", "left")
    near = near_names(told.where("cased is null"), names, cutoff).select("key", F.lit(True).alias("near"))
    kind = F.when(F.col("here"), "exists-in-main").when(F.col("there"), "exists-elsewhere").when(F.col("cased"), "case-mismatch").when(F.col("near"), "near-miss").otherwise("absent")
    return told.join(near, "key", "left").select("source", "key", kind.alias("class"))
