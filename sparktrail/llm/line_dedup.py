"""Line dedup: hashes partitioned by range, sorted by document and position, read as a stream.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Keys are 128-bit hashes, held as two numbers. All lines are dealt by ranges of (hash, document,
position) and sorted so within a partition, so that a line which stands in a
third of all documents takes many partitions. One pass over a sorted partition
decides each run of equal hashes that lies inside it; the first and the last run
may go on in a neighbour and are settled by a small join. What comes out is, for
each document, a compressed bitmap of the lines to keep: no text is written.

Two rules: ``min_docs=None`` keeps the first occurrence of each key, by
(document, position); ``min_docs=n`` drops all lines of keys found in at least n
documents. Keys of fewer than `min_chars` code points are always kept.

Defined cases: a null or empty text is one empty line; a document is a doc_id,
so repeated rows of one doc_id count once and get equal bitmaps if their texts
are equal, ids of any type count as they are ("1" and "01" are two), and a row whose
doc_id is null is a document by its content; texts are read whole, however long, and a document of very many lines is
sorted over as many partitions; equal keys are told apart by document and position
alone; an empty table gives no rows; columns other than those named are carried or
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import checkpoint, map_arrow

BLANKS = " \t\n\x0b\x0c\r"
OUT = "kind int, part int, h1 long, h2 long, dk long, th long, pos int, n_lines int"
DROP, OPEN, MARK = 0, 1, 2  # decided; to be settled with the neighbours; says that this run is here, or dropped here


def pack_bits(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bits(bits: bytes | None, n_lines: int) -> np.ndarray:
    if bits is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines).astype(bool)


def kept_text(text: str | None, bits: bytes | None) -> str:
    lines = (text or "").split("\n")
    return text or "" if bits is None else "\n".join(x for x, keep in zip(lines, unpack_bits(bits, len(lines)).tolist()) if keep)


def _doc_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A long that names a document: an integer id itself, of any other type a hash of it as it is; without an id a hash of the text above all usual ids."""
    whole = isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    named = F.col(doc_id).cast("long") if whole else F.xxhash64(doc_id)
    return F.when(F.col(doc_id).isNotNull(), named).otherwise(F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 61))


def line_rows(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, dk, th, pos, n_lines) of each line whose key is long enough."""
    import xxhash

    own = docs.select(_doc_key(docs, doc_id, text).alias("dk"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.coalesce(text, F.lit("")).alias("t"))
    blanks = BLANKS.encode()

    def hashed(batches):
        for batch in batches:
            hashes, pos, n_lines = [], [], []
            for t in batch.column(2).to_pylist():
                # bytes.lower is A-Z only; a line end is a byte of its own in UTF-8
                keys = [x.strip(blanks) for x in t.encode("utf-8", "surrogatepass").lower().split(b"\n")]
                n_lines.append(len(keys))
                full = [i for i, k in enumerate(keys) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= min_chars)]
                pos.append(full)
                hashes += [xxhash.xxh3_128_digest(keys[i]) for i in full]
            counts = np.array([len(p) for p in pos])
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(counts)), counts)
            dk, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cols = both[:, 0].copy(), both[:, 1].copy(), dk[of], th[of], np.fromiter((i for p in pos for i in p), np.int32, len(of)), np.array(n_lines, np.int32)[of]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "dk", "th", "pos", "n_lines"])

    return map_arrow(own, hashed, "h1 long, h2 long, dk long, th long, pos int, n_lines int")


class _Run:
    """The run of equal hashes that may go on in the next batch."""

    def __init__(self, key, first: bool):
        self.key, self.first, self.docs, self.last, self.held, self.rows = key, first, 0, None, [], 0

    def add(self, cols: list[np.ndarray]) -> None:
        doc = cols[2]
        self.docs += int((doc[1:] != doc[:-1]).sum()) + (self.last != doc[0])
        self.last = doc[-1]


def _stream(min_docs: int | None):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(kind: int, cols: list[np.ndarray]):
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int32)) for x in (kind, part)] + [pa.array(c) for c in cols], names=["kind", "part", "h1", "h2", "dk", "th", "pos", "n_lines"])

        def grow(r: _Run, cols):
            new = r.rows == 0
            r.add(cols)
            r.rows += len(cols[0])
            if min_docs is None:
                if new and r.first:  # the first of this partition only, perhaps
                    yield out(OPEN, [c[:1] for c in cols])
                if len(cols[0]) > new:
                    yield out(DROP, [c[int(new) :] for c in cols])
                r.held = [[c[:1] for c in cols]]
            elif r.docs >= min_docs:
                for h in [*r.held, cols]:
                    yield out(DROP, h)
                r.held, r.mark = [], [c[:1] for c in cols]
            else:
                r.held.append(cols)

        def end(r: _Run, last: bool):
            if r.first or last:
                if min_docs is None:
                    yield out(MARK, r.held[0])
                elif r.docs >= min_docs:
                    yield out(MARK, r.mark)
                else:
                    for h in r.held:
                        yield out(OPEN, h)

        at: _Run | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            h1, h2, doc = cols[:3]
            n = len(h1)
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], n]
            cut = lambda s, e: [c[s:e] for c in cols]  # noqa: B023, E731
            head = 0
            if at is not None and at.key == (h1[0], h2[0]):
                yield from grow(at, cut(0, ends[0]))
                head = 1
            if head == len(starts):
                continue
            if at is not None:
                yield from end(at, False)
            first = at is None
            if first and len(starts) - head > 1:  # the first run of the partition ends here
                r = _Run((h1[0], h2[0]), True)
                yield from grow(r, cut(0, ends[0]))
                yield from end(r, False)
                head, first = 1, False
            lo, hi = starts[head], starts[-1]
            if hi > lo:  # runs that lie inside this batch
                change = np.r_[True, (doc[1:] != doc[:-1])]
                change[starts] = True
                inner = starts[head:-1] - lo
                if min_docs is None:
                    drop = np.ones(hi - lo, bool)
                    drop[inner] = False
                else:
                    docs = np.add.reduceat(change[lo:hi].astype(np.int64), inner)
                    drop = np.repeat(docs >= min_docs, np.diff(np.r_[inner, hi - lo]))
                if drop.any():
                    yield out(DROP, [c[lo:hi][drop] for c in cols])
            at = _Run((h1[hi], h2[hi]), first)
            yield from grow(at, cut(hi, n))
        if at is not None:
            yield from end(at, True)

    return run


def dropped_lines(docs: DataFrame, min_docs: int | None, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """(dk, th, pos, n_lines) of each line to drop; dk and th name the document and its text."""
    rows = line_rows(docs, doc_id, text, min_chars)
    order = ["h1", "h2", "dk", "pos"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = checkpoint(map_arrow(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), _stream(min_docs), OUT))
    opened, cols = out.where(F.col("kind") == OPEN), ["dk", "th", "pos", "n_lines"]
    if min_docs is None:
        # of the partitions that have the run, the first keeps its first line
        least = out.where(F.col("kind") != DROP).groupBy("h1", "h2").agg(F.min("part").alias("least"))
        more = opened.join(least, ["h1", "h2"]).where(F.col("part") > F.col("least"))
    else:
        enough = opened.groupBy("h1", "h2").agg(F.count_distinct("dk").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
        hot = enough.union(out.where(F.col("kind") == MARK).select("h1", "h2")).distinct()
        more = opened.join(hot, ["h1", "h2"], "left_semi")
    return out.where(F.col("kind") == DROP).select(*cols).union(more.select(*cols))


def line_bitmaps(docs: DataFrame, min_docs: int | None = None, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and keep (compressed bitmap, null: all lines stay) of every row, with the columns in carry."""
    lost = dropped_lines(docs, min_docs, doc_id, text, min_chars).groupBy("dk", "th").agg(F.collect_set("pos").alias("lost"), F.max("n_lines").alias("n"))

    def pack(batches):
        for batch in batches:
            lost, n = batch.column(2), batch.column(3).to_pylist()
            bits = [pack_bits(k, np.asarray(x.as_py(), np.int64)) for x, k in zip(lost, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lost], pa.int64()), pa.array(bits, pa.binary())], names=["_dk", "_th", "gone", "keep"])

    bits = map_arrow(lost, pack, "_dk long, _th long, gone long, keep binary")
    named = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in carry if c != doc_id], _doc_key(docs, doc_id, text).alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_t"), F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    joined = named.join(bits, (named["_k"] == bits["_dk"]) & (named["_t"] == bits["_th"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"), "keep", *[c for c in carry if c != doc_id])


def kept_hashes(docs: DataFrame, min_docs: int, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the SHA-256 of the text that the bitmap keeps."""
    import hashlib

    def apply(batches):
        for batch in batches:
            hexes = [hashlib.sha256(kept_text(t, b).encode()).hexdigest() for t, b in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hexes, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = line_bitmaps(docs, min_docs, min_chars=min_chars, carry=("text",))
    return map_arrow(rows, apply, f"doc_id {rows.dtypes[0][1]}, n_lines long, n_dropped long, kept_sha256 string")
