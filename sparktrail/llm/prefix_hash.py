"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each place, the polynomial hash of what
stands before it, modulo a prime. The hash of any span is a difference of two entries,
so two spans are compared in one step, and the longest common extension of two
places is found by binary search over its length (`Prefixes`).

A fingerprint is a prefix array read at few places: every place up to 16, then five to
a doubling, from the start and from the end of the text, and a hash of the whole by two primes. Its size
grows with the logarithm of the text's. Two fingerprints are compared by the same
binary search over their marks: how far the texts agree from their starts, and from their
ends. Their likeness is that length as a share of the longer text, and 1 only if
both are equal in length and hash. Arrays of long texts are made in blocks, so memory
follows the text and not eight bytes a letter of it.

`edited_fingerprints` compares each document with an edited text of its own and
with the next document. Documents are dealt by ranges of their order and read as a
stream, in which the next document is the next row; where a range ends it is the
first row of the next range, of which there is one a range, joined by number.

Defined cases: a null text is empty; two empty texts are alike (1), an empty and
another are not (0); rows of one id are ordered by a hash of their texts, and
equal rows come in any order; null ids are last; a table of one row is its own next; an
empty table gives no rows; texts are read whole; ids may be of any type that sorts; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_arrow, stored

#: Two primes below 2**31, so that products fit in 64 bits, and bases above any code point.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_461_527_891, 1_902_846_539)
BLOCK = 1 << 18
EXACT, STEPS = 16, 5
MARK_DIGITS = 6  # of a hash, for a mark: enough to search by; the whole has both hashes in full


def _powers(which: int, n: int, made: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1), n at most BLOCK + 1."""
    if which not in made:
        p, powers = PRIMES[which], np.array([1], np.uint64)
        while len(powers) <= BLOCK:
            powers = np.concatenate([powers, powers * np.uint64(pow(BASES[which], len(powers), p)) % np.uint64(p)])
        made[which] = powers
    return made[which][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


LADDER = sorted({*range(EXACT + 1), *(int(EXACT * 2 ** (k / STEPS)) for k in range(1, STEPS * 31))})


def marks(n: int) -> list[int]:
    """The lengths at which a text of n code points has marks; those of a shorter text are among them, but for its own."""
    at = bisect_left(LADDER, n)
    return [*LADDER[:at], n]


class Prefixes:
    """Prefix hashes of a text at the given places (all, if none are given), by one prime."""

    def __init__(self, points: np.ndarray, at: list[int] | None = None, which: int = 0):
        self.n, self.p, self.base = len(points), PRIMES[which], BASES[which]
        self.places = at
        wanted = np.arange(self.n + 1) if at is None else np.asarray(at)
        values, before, p = [], 0, np.uint64(self.p)
        for start in range(0, max(self.n, 1), BLOCK):
            part = points[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
            sums = np.cumsum(part * _powers(which, len(part)) % p)  # below 2**31 * BLOCK
            here = wanted[(wanted > start) & (wanted <= start + len(part))] - start
            scale = pow(self.base, start, self.p)
            if len(here):
                values.append((sums[here - 1] % p * np.uint64(scale) + np.uint64(before)) % p)
            if len(part):
                before = (int(sums[-1]) % self.p * scale + before) % self.p
        self.values = np.concatenate([np.zeros(int((wanted == 0).sum()), np.uint64), *values])
        self._at = None if at is None else {k: i for i, k in enumerate(at)}

    def upto(self, i: int) -> int:
        return int(self.values[i if self._at is None else self._at[i]])

    def span(self, i: int, j: int) -> int:
        """The hash of the code points i to j-1, the same wherever they stand."""
        return (self.upto(j) - self.upto(i)) * pow(self.base, -i, self.p) % self.p

    def same(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """How many code points from i here and from j there agree."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low


def fingerprint(text: str) -> str:
    """length . hash of the whole . marks from the start . marks from the end, in hexadecimal digits."""
    points, own = code_points(text), marks(len(text))
    n = len(points)
    one, two = Prefixes(points, own), Prefixes(points, [n], 1)
    digits = lambda p: p.values.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - MARK_DIGITS // 2 :].tobytes().hex()
    # an end of the text is a start of it read backwards
    return f"{n:x}.{int(one.values[-1]):08x}{int(two.values[-1]):08x}.{digits(one)}.{digits(Prefixes(points[::-1], own))}"


def _common(a: str, b: str, places: list[int]) -> int:
    """The largest place up to which the marks agree, by binary search: beyond a difference all marks differ."""
    return places[bisect_right(range(1, len(places)), False, key=lambda i: a[MARK_DIGITS * i : MARK_DIGITS * (i + 1)] != b[MARK_DIGITS * i : MARK_DIGITS * (i + 1)])]


def likeness(a: str | None, b: str | None) -> float | None:
    """The share of the longer text that both have in common from their starts and from their ends, as far as marks tell."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (n, _, forward, backward), (m, _, forward2, backward2) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)
    least, most = min(n, m), max(n, m)
    # marks at the shorter text's own end may be none of the longer's
    places = [p for p in marks(least) if p < least or least == most or p in marks(most)]
    common = min(least, _common(forward, forward2, places) + _common(backward, backward2, places))
    return common / most if common < most else (most - 1) / most  # equal lengths, other hash


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, with the columns in carry."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(doc_id).alias("doc_id"), *[c for c in carry if c != doc_id])

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            cols = [*batch.columns[1:], pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[1:], "n_chars", "fingerprint"])

    return map_arrow(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:]) + ", n_chars long, fingerprint string")


def common_extensions(pairs: DataFrame, a: str = "a", i: str = "i", b: str = "b", j: str = "j") -> DataFrame:
    """pairs with `extension`: how many code points agree from place i of text a and place j of text b (from 0); null if a place is outside its text or anything is null."""
    names = pairs.columns

    def run(batches):
        at = [names.index(c) for c in (a, i, b, j)]
        for batch in batches:
            made: dict[str, Prefixes] = {}
            out = []
            for x, k, y, m in zip(*(batch.column(c).to_pylist() for c in at)):
                if None in (x, k, y, m) or not (0 <= k <= len(x) and 0 <= m <= len(y)):
                    out.append(None)
                    continue
                for t in (x, y):
                    if t not in made:
                        if len(made) > 64:
                            made.clear()
                        made[t] = Prefixes(code_points(t))
                one, two = (made.get(t) or Prefixes(code_points(t)) for t in (x, y))
                out.append(one.extension(k, two, m))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "extension"])

    return map_arrow(pairs, run, ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", extension long")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the other."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


_MADE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple], ids: list, id_type, names: list[str], extra: list):
    """A batch of results of (text, fingerprint, next text, next fingerprint)."""
    cols: list[list] = [[] for _ in range(6)]
    for text, own, following, its in rows:
        changed = edited(text, following)
        new = own if changed == text else fingerprint(changed)
        for c, v in zip(cols, (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, its))):
            c.append(v)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, cols, kinds), *extra], names=names)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row; the next document is that of the next lower id, and the first again after the last."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.asc("h"), F.asc("tie")]
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def stream(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None  # last: id, text and fingerprint of the row before
        none = lambda k, t: pa.array([None] * k, t)
        ends = lambda role, t: [pa.array([role], pa.string()), pa.array([part], pa.int32()), pa.array([t], pa.string())]
        out = [*names, "role", "part", "text"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kind_ = batch.column(0).type
            for a in range(0, len(ids), 256):
                made, whose = [], []
                for k, t in zip(ids[a : a + 256], texts[a : a + 256]):
                    own = fingerprint(t)
                    if last is None:
                        yield pa.RecordBatch.from_arrays([none(1, kind_), none(1, pa.int64()), *(none(1, pa.string()) for _ in range(1)), pa.array([own]), none(1, pa.string()), none(1, pa.float64()), none(1, pa.float64()), *ends("first", t)], names=out)
                    else:
                        made.append((last[1], last[2], t, own))
                        whose.append(last[0])
                    last = k, t, own
                if made:
                    yield _compared(made, whose, kind_, out, [none(len(made), pa.string()), none(len(made), pa.int32()), none(len(made), pa.string())])
        if last is not None:
            k, t, own = last
            yield pa.RecordBatch.from_arrays([pa.array([k], kind_), none(1, pa.int64()), none(1, pa.string()), pa.array([own]), none(1, pa.string()), none(1, pa.float64()), none(1, pa.float64()), *ends("last", t)], names=out)

    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    out = stored(map_arrow(ranged, stream, f"doc_id {kind}, {_MADE}, role string, part int, text string"), "fingerprints")
    firsts = out.where("role = 'first'").select("part", F.col("text").alias("t2"), F.col("fingerprint").alias("f2"))
    # the next range that has rows, or the first of all; there is a row a range
    turn = W.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)).alias("to"))
    lasts = out.where("role = 'last'").select("doc_id", "text", "fingerprint", "part")
    pairs = lasts.join(after, "part").join(firsts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "fingerprint", "t2", "f2")

    def compare(batches):
        for batch in batches:
            yield _compared(list(zip(*(c.to_pylist() for c in batch.columns[1:]))), batch.column(0).to_pylist(), batch.column(0).type, names, [])

    return out.where("role IS NULL").select(*names).union(map_arrow(pairs, compare, f"doc_id {kind}, {_MADE}"))
