"""Importance resampling towards a target text: hashed runs of words, long texts cut into overlapping chunks.

A feature is a run of 1 to n consecutive words; its bucket is a CRC-32 modulo
`buckets`. A bucket's gain is the logarithm of how much likelier it is in the
target than in the documents; a document's weight is the mean gain of its
features, and the documents with the highest weight plus Gumbel noise are drawn,
which is sampling without replacement by the weights.

Texts above CHUNK characters are cut. A chunk ends where a word ends, and carries
the next n-1 words, so that every run of words lies whole in one chunk; it is
counted by the chunk that owns its first word. Chunks of long texts are dealt out
anew, so that no task has to do one of them alone, and their counts and gains are
summed by document. The buckets of each chunk are kept as small numbers in files, so
that texts are read and hashed once.

What goes by broadcast is the table of gains, of exactly `buckets` rows. The draw
is by a sort of all scores in ranges.

Defined cases: a null text, or one without a word, has no features and weight 0;
rows are apart, also those that agree in all columns or in their id, and rows
of equal score and id come in any order; a null id is read as the empty text by
the hash and sorts last; an empty table of documents gives no rows; without target
features all gains follow from the documents' counts alone; texts are read whole; a word is
never cut, however long; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, in_order, map_arrow, stored

#: Letters and digits before A-Z are lowered.
WORD, OTHER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CHUNK = 1 << 15


def chunks(text: Column, n: int = 1, size: int = CHUNK) -> Column:
    """An array of (own, carried): what the text is cut into, and the up to n-1 words after each part."""
    carry = rf"(?=((?:{OTHER}*+{WORD}++){{0,{n - 1}}}+))" if n > 1 else "()"
    cut = F.lit(rf"(?s)(.{{1,{size}}}+{WORD}*+){carry}")
    own = F.regexp_extract_all(text, cut, F.lit(1))
    if n > 1:
        return F.transform(F.arrays_zip(own.alias("own"), F.regexp_extract_all(text, cut, F.lit(2)).alias("carried")), lambda c: F.struct(c["own"].alias("own"), c["carried"].alias("carried")))
    return F.transform(own, lambda x: F.struct(x.alias("own"), F.lit("").alias("carried")))


def runs(own: list[bytes], carried: list[bytes], n: int) -> list[bytes]:
    """The runs of 1 to n words, joined by a space, that begin in `own`."""
    both, out = own + carried, list(own)
    for k in range(2, n + 1):
        out += [b" ".join(both[i : i + k]) for i in range(min(len(own), len(both) - k + 1))]
    return out


def hashed(docs: DataFrame, n: int = 1, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(row, doc_id, words, buckets): one row a chunk, in which `row` tells the rows of docs apart, `words` is how many words begin there, and `buckets` has one number a feature."""

    def number(batches):
        word = re.compile(WORD.encode("latin-1") + b"+")  # in UTF-8 all bytes of other letters are of words
        of = lambda t: word.findall(t.encode("utf-8", "surrogatepass").lower())  # noqa: E731  of bytes, lower() is A-Z only
        for batch in batches:
            counts, found = [], []
            for own, carried in zip(batch.column(2), batch.column(3)):
                first = of(own.as_py())
                counts.append(len(first))
                features = runs(first, of(carried.as_py()) if n > 1 else [], n)
                found.append(np.fromiter(map(zlib.crc32, features), np.uint32, len(features)) % np.uint32(buckets))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], names=["row", "doc_id", "words", "buckets"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    short = texts.where(F.length("t") <= size).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("t").alias("own"), F.lit("").alias("carried"))
    long = texts.where(F.length("t") > size).select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", "t")  # first, else each piece gets a number of its own
    long = long.select("row", "doc_id", F.posexplode(chunks(F.col("t"), n, size)).alias("piece", "c"))
    long = long.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "piece")
    return map_arrow(short.union(long.select("row", "doc_id", "c.own", "c.carried")), number, f"row long, doc_id {dict(texts.dtypes)['doc_id']}, words long, buckets array<int>")


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of both sides; exactly `buckets` rows."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    both = checkpoint(both)
    total_s, total_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(total_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(total_t + buckets)))
    return both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def weighed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(row, doc_id, words, n_features, weight) of each document: sums over its chunks. The mean is rounded down."""
    found = rows.select("row", "doc_id", "words", F.posexplode_outer("buckets").alias("at", "bucket")).join(F.broadcast(table), "bucket", "left")
    words = F.sum(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("words")))  # once a chunk
    sums = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), words.alias("words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (g - pmod(g, n_features)) DIV n_features END")
    return sums.select("row", "doc_id", "words", "n_features", mean.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times Gumbel noise, rounded down, from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where it isn't drawn.

    Of the rows with at least min_words words, `percent` of a hundred are drawn (rounded down): those of the highest scores, ties to the smaller id.
    """
    rows = stored(hashed(docs, n, buckets, doc_id, text, size), "buckets")
    wanted = bucket_counts(hashed(target.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), n, buckets, size=size))
    table = checkpoint(gains(bucket_counts(rows), wanted, buckets))
    scored = weighed(rows, table).select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("words") >= min_words).alias("may"))
    placed = in_order(scored, [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    drawn = (placed.where("may").count() * percent) // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))
