"""SimHash near-dedup: tiles of fingerprints compared exactly, by exclusive-or and bit counts.

A text is lower-cased in A-Z and split at white space (space and U+0009 to
U+000D). Every run of `width` words, repeats included, joined by single spaces,
is hashed by XXH64 (seed 42); fewer words are one run. A bit of the fingerprint
is set if it is set in over half of the hashes. Two fingerprints link if they
differ in at most `radius` bits; a document's component is all that links reach.

Tiles. Equal fingerprints are one class. The 64 bits are cut into `blocks`
blocks; two fingerprints that differ in at most `radius` bits agree in all of
some `blocks - radius` blocks, so for each choice of that many blocks the
classes that agree there make a bucket, and only within buckets are
fingerprints compared. This loses nothing: each link lies in some bucket. The
number of blocks follows from the number of classes, so that an evenly filled
bucket stays about a tile. A bucket above `tile` classes is cut by bit count and
salt into tiles, and each pair of its tiles whose bit counts are within the
radius becomes a task's work of its own: no bucket meets in one task. Within a
task, blocks of rows sorted by bit count are skipped where the counts differ
beyond the radius, the rest is compared in full with numpy. Each tile returns a
spanning forest of its links, never all pairs.

Defined cases: a null text or one without words has fingerprint zero, linked
like any other; a null doc_id counts as above all others (its component is null
if nobody there has an id); ids that are no integers compare as they sort;
rows that share an id but not the text are each linked by their own text;
repeated rows come back as often; texts are read whole, however long; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, components, join_unique, map_arrow

SEED = 42
TILE = 4096


def words(text: str | None) -> list[bytes]:
    # bytes.lower is A-Z only, and bytes.split without a separator knows the six ASCII spaces
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, width: int = 4) -> int:
    import xxhash

    w = words(text)
    if not w:
        return 0
    runs = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    n = max(1, len(w) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # 64 bytes a hash while it is counted
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_arrow(ids, run, f"doc_id {ids.dtypes[0][1]}, fp long")


def tile_links(fps: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a tile: values, and the least value of each tree."""
    counts = np.bitwise_count(fps)
    order = np.lexsort((fps, counts))
    fps, counts = fps[order], counts[order].astype(np.int64)
    n = len(fps)
    root = np.arange(n)
    for i in range(0, n, block):
        a = fps[i : i + block]
        for j in range(i, n, block):
            if counts[j] - counts[min(i + block, n) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + block]) <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if not len(x):
                continue
            x, y = root[x + i], root[y + j]
            while (differ := x != y).any():
                x, y = x[differ], y[differ]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
                x, y = root[x], root[y]
    # the least fingerprint, as a signed long, names the tree
    signed = fps.view(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, signed)
    named = least[root]
    moved = named != signed
    return signed[moved], named[moved]


def _runs(batches, n_keys: int):
    """Whole runs of rows with equal keys, from batches sorted by key. The last column is the value."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys + 1)]
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        n = len(cols[0])
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in cols[:n_keys]:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        edges = [0, *starts.tolist()]
        for s, e in zip(edges, edges[1:]):
            yield cols[-1][s:e]
        held = [c[edges[-1] :] for c in cols]
    if held:
        yield held[-1]


def plan_blocks(n: int, radius: int, tile: int) -> int:
    """The fewest blocks for which an evenly filled bucket holds a tile at most."""
    for blocks in range(radius + 1, radius + 5):
        if n <= tile << (64 * (blocks - radius) // blocks):
            return blocks
    return radius + 4


def links(classes: DataFrame, n: int, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that join all that are within the radius."""
    blocks = plan_blocks(n, radius, tile)
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "val")).withColumn("ones", F.bit_count("fp"))
    # Parts of buckets: one for a bucket of a tile or less, else by bit count and salt.
    sizes = rows.groupBy("band", "val", "ones").agg(F.count("*").alias("n"))
    big = sizes.groupBy("band", "val").agg(F.sum("n").alias("n")).where(F.col("n") > tile)
    parts = checkpoint(sizes.join(big.select("band", "val"), ["band", "val"]).withColumn("salts", F.ceil(F.col("n") / tile).cast("int")))
    salt = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("salts")).cast("int")

    def compare(batches):
        for fps in _runs(batches, 5):
            if len(fps) > 1:
                a, b = tile_links(fps.view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["band", "val", "p", "q", "kind"]

    def compared(tiles: DataFrame) -> DataFrame:
        return map_arrow(tiles.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys), compare, "a long, b long")

    none = F.lit(0)
    if parts.isEmpty():
        return compared(rows.select("band", "val", none.alias("p"), none.alias("q"), none.alias("kind"), "fp"))
    small = rows.join(parts.select("band", "val").distinct(), ["band", "val"], "left_anti")
    # Pairs of tiles of one bucket within the radius; the table of tiles has a row for each `tile` classes.
    ids = parts.select("band", "val", "ones", F.explode(F.sequence(none, F.col("salts") - 1)).alias("salt")).withColumn("p", F.col("ones") * 1_000_000 + F.col("salt"))
    other = ids.select("band", "val", F.col("ones").alias("ones2"), F.col("p").alias("q"))
    pairs = ids.join(other, ["band", "val"]).where((F.col("p") <= F.col("q")) & (F.col("ones2") - F.col("ones") <= radius)).select("band", "val", "p", "q")
    members = rows.join(parts.select("band", "val", "ones", "salts"), ["band", "val", "ones"]).withColumn("me", F.col("ones") * 1_000_000 + salt)
    ends = pairs.withColumn("me", F.col("p")).union(pairs.where("p <> q").withColumn("me", F.col("q")))
    large = members.select("band", "val", "me", "fp").join(ends, ["band", "val", "me"]).withColumn("kind", F.lit(1))
    return compared(small.select("band", "val", none.alias("p"), none.alias("q"), none.alias("kind"), "fp")).union(compared(large))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row."""
    fps = checkpoint(fingerprints(docs, doc_id, text, width))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp"), classes.count(), radius, tile)).withColumnRenamed("node", "fp")
    moved = checkpoint(classes.join(joined, "fp"))
    names = moved.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = classes.join(joined, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = moved.join(names, "root").select("fp", "component_id").union(alone)
    # a fingerprint that very many documents share, as that of texts without words, is a hot key
    return join_unique(fps.withColumnRenamed("fp", "own"), "own", checkpoint(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
