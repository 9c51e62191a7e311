"""Language ID: nearest centroid of TF-IDF n-gram vectors, with rejection by distance.

A text is lower-cased, all but letters become single spaces, and its UTF-8 bytes
give n-grams of two and three bytes, hashed into `dims` counts. Counts are
damped by a logarithm, weighted by inverse document frequency and normalised.
Each language has several centroids, found by spherical k-means; the nearest by
cosine over all languages says the language, and its cosine is the score.

Rejection: a text is rejected if its cosine lies below `slack` times the low
quantile of the cosines of training texts of about its length, measured on
pieces of the training texts of every length.

The fit takes a sample of about `per_lang` labelled rows a language, chosen by a
hash of the id, whatever their length. The texts are counted whole, in Spark; the
driver gets the n-gram counts of the sample, whose size doesn't depend on the
length of a text, and the cosines from which the rejection is found.

Defined cases: a text that is null or has no letter (a character of a Unicode
category L) is ``und`` with score 0 and rejected; with no labelled row at all,
every text is ``und``; equal cosines go to the first centroid in order of
language; repeated rows are predicted each; texts are read whole, however long;
ids may be of any kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, map_arrow

PER_LANG, DIMS, CLUSTERS = 300, 8192, 4
CHUNK = 1 << 20


_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Runs of letters, lower-cased, with single spaces between. Of what re counts to words, numerals as \u00bd or \u2460 are no letters; they are rare, so a text is searched for them only if it has some."""
    found = _OTHER.sub(" ", text.lower()).strip()
    if not found or found.replace(" ", "").isalpha():
        return found
    return " ".join("".join(c if c.isalpha() else " " for c in found).split())


def counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Of the hashed n-grams of a whole text; None if it has no letter."""
    letters = _letters(text or "")
    if not letters:
        return None
    raw = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), np.uint8)
    total = np.zeros(dims, np.int64)
    for i in range(0, len(raw), CHUNK):
        b = raw[i : i + CHUNK + 2].astype(np.uint32)
        two = (b[:-1] << 8) | b[1:]
        three = (two[:-1] << 8) | b[2:]
        for code in (two[: CHUNK], (three + np.uint32(1 << 24))[: CHUNK]):
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(16) & np.uint32(dims - 1), minlength=dims)
    return total


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray | None = None
    idf: np.ndarray | None = None
    least: np.ndarray | None = None  # the cosine below which a text is rejected, by the base-2 logarithm of its n-grams
    dims: int = DIMS

    def vector(self, count: np.ndarray) -> np.ndarray:
        v = (np.log1p(count) * self.idf).astype(np.float32)
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def nearest(self, count: np.ndarray) -> tuple[int, float]:
        cosines = self.centroids @ self.vector(count)
        best = int(cosines.argmax())
        return best, float(min(max(cosines[best], 0.0), 1.0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        count = counts(text, self.dims) if self.langs else None
        if count is None:
            return "und", 0.0, True
        best, cosine = self.nearest(count)
        return self.langs[best], cosine, cosine < self.least[_length(count)]


def _length(count: np.ndarray) -> int:
    return min(int(count.sum()).bit_length(), 24)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical; starts far apart, the first nearest to the mean."""
    k = min(k, len(x))
    own = [int((x @ x.mean(0)).argmax())]
    while len(own) < k:
        own.append(int((x @ x[own].T).max(1).argmin()))
    c = x[own]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in (x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k))])
    return c.astype(np.float32)


def _centroids(counted: list[tuple[str, np.ndarray, np.ndarray]], clusters: int, dims: int) -> Model:
    """From (language, places, counts) of the n-grams of each text; the vectors of one language at a time."""
    if not counted:
        return Model(dims=dims)
    with_gram = np.zeros(dims, np.int64)
    for _, at, _ in counted:
        with_gram[at] += 1
    model = Model(dims=dims, idf=np.log((1 + len(counted)) / (1 + with_gram)) + 1, least=np.zeros(25))
    parts = []
    for lang in sorted({lang for lang, _, _ in counted}):
        own = [(at, n) for name, at, n in counted if name == lang]
        vectors = np.zeros((len(own), dims), np.float32)
        for row, (at, n) in zip(vectors, own):
            count = np.zeros(dims, np.int64)
            count[at] = n
            row[:] = model.vector(count)
        found = _k_means(vectors, clusters)
        parts.append(found)
        model.langs += [lang] * len(found)
    model.centroids = np.concatenate(parts)
    return model


def _cosines(text: str, model: Model) -> list[tuple[int, float]]:
    """(length, cosine of the nearest centroid) of a text and of its beginnings of 4, 8, 16, ... characters."""
    pieces = [counts(text[: 1 << k], model.dims) for k in range(2, len(text).bit_length())]
    return [(_length(c), model.nearest(c)[1]) for c in [*pieces, counts(text, model.dims)] if c is not None]


def _rejection(cosines: list[tuple[int, float]], slack: float) -> np.ndarray:
    by: list[list[float]] = [[] for _ in range(25)]
    for length, cosine in sorted(cosines):
        by[length].append(cosine)
    low, least = 0.0, np.zeros(25)
    for i, found in enumerate(by):  # lengths that the sample lacks take the value of the next shorter
        low = float(np.quantile(found, 0.01)) * slack if len(found) >= 20 else low
        least[i] = low
    return least


def fit(docs: DataFrame, train: Column | None = None, per_lang: int = PER_LANG, clusters: int = CLUSTERS, dims: int = DIMS, slack: float = 0.5) -> Model:
    """From docs (doc_id, text, lang), rows where `train` holds."""
    rows = docs if train is None else docs.where(train)
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not n:
        return Model(dims=dims)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(per_lang / k)) for lang, k in sorted(n.items())])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    sample = checkpoint(rows.where(draw < share).select("text", "lang"))

    def count(batches):
        for batch in batches:
            made = [(lang, c) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (c := counts(t, dims)) is not None]
            at = [np.flatnonzero(c).astype(np.int32) for _, c in made]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in made], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([c[a] for (_, c), a in zip(made, at)], pa.list_(pa.int64()))], names=["lang", "at", "n"])

    found = map_arrow(sample, count, "lang string, at array<int>, n array<long>").toArrow()
    counted = [(lang, at.values.to_numpy(), k.values.to_numpy()) for lang, at, k in zip(found["lang"].to_pylist(), found["at"], found["n"])]
    model = _centroids(sorted(counted, key=lambda c: (c[0], c[1].tobytes(), c[2].tobytes())), clusters, dims)
    if not model.langs:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            said = [x for t in batch.column(0).to_pylist() for x in _cosines(t, sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in said], pa.int32()), pa.array([x[1] for x in said], pa.float64())], names=["length", "cosine"])

    said = map_arrow(sample.select("text"), measure, "length int, cosine double").collect()
    model.least = _rejection([(r["length"], r["cosine"]) for r in said], slack)
    return model


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """lang_pred, score and rejected, or by other names, of every row, with the columns in carry, for docs (text, ...)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x dims floats

    def run(batches):
        model = sent.value
        for batch in batches:
            said = [model.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([bool(s[2]) for s in said], pa.bool_())],
                names=[*carry, *out],
            )

    rows = docs.select(F.col("text").alias("_text"), *carry)
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[1:])
    return map_arrow(rows, run, ", ".join(filter(None, [kinds, "`{}` string, `{}` double, `{}` boolean".format(*out)])))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
