"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group and stay together. Groups, largest first,
enter the bin with the least remaining capacity that still holds them; the bins
stand in a balanced tree by remaining capacity, and a new bin is opened only if
none fits.

Every group is packed, whatever its size and the size of the table. Groups of
equal size are one entry of the packing, as best-fit-decreasing places them in
runs; the driver holds an entry for each different size and each run. For a given
number of shards the least capacity is searched for which the packing needs no
more than that; for a given capacity the packing says how many shards there are.

Defined cases: a null text has size 1 like an empty one, and each stands in a
group of its kind; a group above the capacity gets a shard of its own, larger
than the others; groups of equal size are taken in an order set by a hash;
repeated rows belong to one group; texts are never cut, however long; ids may be
null or of any kind that sorts; an empty table gives no rows; other columns are
ignored. Slots number a shard's rows from 0 without a gap, by doc_id inside of
hashed buckets, or with `in_order` as the rows of the input stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .common import HOT, checkpoint, fresh, join_unique, numbered, numbered_in_place, position

LAW, CELL = "bytes", 4096


class Tree:
    """An AA tree of (remaining, bin): insert, remove, and the least entry not below a size."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key) -> None:
        def go(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = go(t[side])
            return self._split(self._skew(t))

        self.root = go(self.root)

    def remove(self, key) -> None:
        def go(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = go(t[2], key)
            elif t[0] < key:
                t[3] = go(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            else:
                side = 2 if t[2] else 3
                near, far = t[side], 5 - side
                while near[far]:
                    near = near[far]
                t[0] = near[0]
                t[side] = go(t[side], near[0])
            level = 1 + min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0)
            if level < t[1]:
                t[1] = level
                if t[3] and t[3][1] > level:
                    t[3][1] = level
            t = self._skew(t)
            if t[3]:
                t[3] = self._skew(t[3])
                if t[3][3]:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3]:
                t[3] = self._split(t[3])
            return t

        self.root = go(self.root, key)

    def ceiling(self, size: int):
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Best-fit-decreasing of classes (size, number of groups), given largest size first: (size, first, end, bin) says that the groups number first to end - 1 of a size are in a bin; and the number of bins. None if there are more than `most`.

    Groups of one size enter the tightest bin one after the other until it holds
    no more of them, as it stays the tightest: so they enter together.
    """
    tree, bins, placed = Tree(), 0, []
    for size, n in classes:
        at = 0
        while at < n:
            found = tree.ceiling(size)
            if found is None:
                found = (max(capacity, size), bins)
                bins += 1
                if most is not None and bins > most:
                    return None
            else:
                tree.remove(found)
            take = min(n - at, found[0] // size)
            tree.insert((found[0] - take * size, found[1]))
            placed.append((size, at, at + take, found[1]))
            at += take
    return placed, bins


def fewest_bytes(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The packing with the least capacity found that takes at most so many bins."""
    if not classes:
        return []
    mean = math.ceil(sum(s * n for s, n in classes) / shards)
    low = max(mean, classes[0][0])
    high = mean + classes[0][0]  # a bin is opened only when all others are above the mean: enough
    bad, step = low - 1, 0
    while (found := best_fit(classes, good := min(high, low + step), shards)) is None:  # the least is mostly near the mean
        bad, step = good, max(1, 2 * step)
    while good - bad > 1:
        mid = (bad + good) // 2
        now = best_fit(classes, mid, shards)
        if now is None:
            bad = mid
        else:
            good, found = mid, now
    return found[0]


def _group(text: str) -> Column:
    """The name of a group: a hash of the text; null and empty texts are apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.when(F.col(text).isNull(), F.lit("0")).otherwise(F.lit("1")), body), 256))


class Packing:
    """The bin of each group of (key, size) rows.

    The driver packs classes of groups of equal size, a row for each different
    size: k different sizes hold at least k * k / 2 bytes, so there are fewer than
    the root of twice the bytes. The groups of a size are numbered in Spark, and
    find their bin by size and number.
    """

    def __init__(self, sized: DataFrame, shards: int | None, capacity: int | None):
        spark = sized.sparkSession
        groups = checkpoint(sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
        classes = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
        placed = fewest_bytes(classes, shards) if capacity is None else best_fit(classes, capacity)[0]
        runs = spark.createDataFrame(placed, "_size long, _first long, _end long, _bin int")
        # Numbers are cut into cells, so that the groups of a size that fill many bins are joined by number as well.
        cells = runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_first") / CELL), F.floor((F.col("_end") - 1) / CELL))))
        ranked = numbered(groups.select("key", "size"), "size", ["key"], "rank").withColumn("cell", F.floor(F.col("rank") / CELL))
        met = (F.col("size") == F.col("_size")) & (F.col("cell") == F.col("_cell")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end"))
        self.bins = checkpoint(ranked.join(cells, met).select(F.col("key").alias("_key"), F.col("_bin")))
        total = groups.agg(F.sum("rows")).first()[0] or 0
        self.hot = [r["key"] for r in groups.where((F.col("rows") > total / HOT) & (F.col("rows") >= 100)).select("key").collect()]  # fewer than HOT

    def assign(self, rows: DataFrame, out: str) -> DataFrame:
        """Adds the bin to rows with a key."""
        return join_unique(rows, "key", self.bins, "_key", hot=self.hot).withColumnRenamed("_bin", out).drop("_key")


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text", in_order: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not `key`) of every row.

    Give the number of shards (sizes near equal) or their capacity in bytes (as few shards as the packing needs).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    at = [position(docs).alias("at")] if in_order else []
    slim = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), _group(text).alias("key"), *at))
    dealt = Packing(slim, shards, capacity).assign(slim, "shard").drop("key")
    ranked = numbered_in_place(dealt, "shard", "at", "slot") if in_order else numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text", file_bytes: int = 256 << 20) -> None:
    """Write all rows with all their columns to path/shard=<n>/, each shard in files of about file_bytes of text, so that no task holds a shard. An input column `shard` is written as `_shard`."""
    slim = checkpoint(docs.select(_group(text).alias("key"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size")))
    packing = Packing(slim, shards, None)
    total = slim.agg(F.sum("size")).first()[0] or 0
    files = max(1, math.ceil(total / shards / file_bytes))
    kept = fresh(docs, "shard")
    columns = [F.col(f"`{c}`").alias(kept if c.lower() == "shard" else c) for c in docs.columns]
    rows = packing.assign(docs.select(F.struct(*columns).alias("_row"), _group(text).alias("key")), "shard")
    # rows of one text may go to several files of its shard
    part = F.pmod(F.hash("_row"), F.lit(files))
    rows.withColumn("_part", part).repartition(shards * files, "shard", "_part").select("shard", "_row.*").write.partitionBy("shard").parquet(path)
