"""Operators 11 to 13 against plain versions, on the given and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import importance_resample as ir, prefix_hash as ph, queries, whitening as wh

from . import brute
from .test_operators import LONG, ODD, SCHEMA, SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, "p") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- prefix hashes


def test_spans_and_extensions_against_plain_text():
    rng = random.Random(3)
    for _ in range(60):
        a = "".join(rng.choice("ab\0é\U0001f600") for _ in range(rng.randrange(60)))
        cut = rng.randrange(len(a) + 1)
        b = a[cut:] + "".join(rng.choice("ab") for _ in range(20))
        one, two = ph.Prefixes(ph.code_points(a)), ph.Prefixes(ph.code_points(b))
        for _ in range(40):
            i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            k = rng.randrange(min(len(a) - i, len(b) - j) + 1)
            assert one.same(i, two, j, k) == (a[i : i + k] == b[j : j + k])
            want = next((x for x in range(min(len(a) - i, len(b) - j)) if a[i + x] != b[j + x]), min(len(a) - i, len(b) - j))
            assert one.extension(i, two, j) == want


def test_hashes_of_texts_longer_than_a_block():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3 * ph.BLOCK + 17))
    points = ph.code_points(text)
    for which in (0, 1):
        whole, h = ph.Prefixes(points, which=which), 0
        p, base, power = ph.PRIMES[which], ph.BASES[which], 1
        for i, c in enumerate(text):
            if i % 50_000 == 0:
                assert whole.upto(i) == h
            h, power = (h + (ord(c) + 1) * power) % p, power * base % p
        assert whole.upto(len(text)) == h
        at = sorted({0, 1, ph.BLOCK, ph.BLOCK + 1, 2 * ph.BLOCK, len(text)})
        some = ph.Prefixes(points, at, which)
        assert [some.upto(i) for i in at] == [whole.upto(i) for i in at]
    other = text[: 2 * ph.BLOCK] + "X" + text[2 * ph.BLOCK + 1 :]
    assert ph.Prefixes(points).extension(0, ph.Prefixes(ph.code_points(other)), 0) == 2 * ph.BLOCK
    assert 0.9 < ph.likeness(ph.fingerprint(text), ph.fingerprint(other)) < 1


def plain_likeness(a, b):
    """What both texts share from their starts and ends, down to the marks."""
    if a == b:
        return 1.0
    least, most = min(len(a), len(b)), max(len(a), len(b))
    places = [p for p in ph.marks(least) if p in ph.marks(most)]
    ahead = max(p for p in places if a[:p] == b[:p])
    back = max(p for p in places if a[len(a) - p :] == b[len(b) - p :])
    return min(least, ahead + back) / most if min(least, ahead + back) < most else (most - 1) / most


def test_likeness_against_plain_text():
    rng = random.Random(11)
    for _ in range(400):
        a = "".join(rng.choice("xy ") for _ in range(rng.choice([0, 1, 2, 5, 16, 17, 40, 300])))
        b = rng.choice([a, a[: len(a) // 2], a + "z", "q" + a, a[: len(a) // 3] + "q" + a[len(a) // 3 + 1 :], "".join(rng.choice("xy ") for _ in range(30))])
        got = ph.likeness(ph.fingerprint(a), ph.fingerprint(b))
        assert got == plain_likeness(a, b) and 0 <= got <= 1 and (got == 1) == (a == b)
        assert got == ph.likeness(ph.fingerprint(b), ph.fingerprint(a))
        assert (ph.fingerprint(a) == ph.fingerprint(b)) == (a == b)
    assert ph.likeness(None, "0") is None


def plain_edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for (k, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        m = len(a) // 3
        changed = a[: len(a) - m] + b[:m]
        yield k, len(a), hashlib.sha256(changed.encode()).hexdigest(), ph.fingerprint(a), ph.fingerprint(changed), plain_likeness(a, changed), plain_likeness(a, b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_fingerprint_query_against_plain_version(spark, sf):
    got = [tuple(r) for r in queries.op11_prefix_fingerprints(spark, f"{brute.DATA}/{sf}").collect()]
    assert sorted(got) == sorted(plain_edited([(r["doc_id"], r["text"] or "") for r in brute.rows(sf, "documents")]))
    near = [r[5] for r in got if r[1] >= 30]
    assert min(near) > 0.55


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = ph.edited_fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    by = {}
    for r in ODD:
        by.setdefault((r[0], len(r[1] or "")), ph.fingerprint(r[1] or ""))
    assert all(r["fingerprint"] == by[r["doc_id"], r["n_chars"]] for r in got if r["doc_id"] not in (5,))
    assert ph.edited_fingerprints(none).count() == 0
    alone = ph.edited_fingerprints(odd.where("doc_id = 6")).first()
    assert alone["near_next"] == 1 and alone["n_chars"] == len(LONG)
    same = spark.range(3000).select(F.lit("one").alias("doc_id"), F.lit("the same text of one id").alias("text"))
    assert {(r["near_edited"] > 0.5, r["near_next"]) for r in ph.edited_fingerprints(same).collect()} == {(True, 1.0)}
    plain = ph.fingerprints(odd, carry=("lang", "size")).collect()
    assert all(r["fingerprint"] == by.get((r["doc_id"], r["n_chars"])) for r in plain if r["doc_id"] != 5) and plain[0]["size"] == 1


def test_common_extensions_of_pairs(spark):
    rows = [("abcdef", 0, "xabc", 1), ("abc", 3, "abc", 0), ("abc", 4, "abc", 0), (None, 0, "a", 0), ("a", 0, "a", None), ("", 0, "", 0)]
    got = ph.common_extensions(spark.createDataFrame(rows, "a string, i int, b string, j int").coalesce(1)).collect()
    assert [r["extension"] for r in got] == [3, 0, None, None, None, 0]


# --- whitening


def plain_whitened(vectors, k=16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    e, to = np.linalg.eigh(centred.T @ centred / n)
    trace, e, to = e.sum(), e[::-1][:k], to[:, ::-1][:, :k]
    off = x * n - sums
    return n, (off * off).sum(axis=1).tolist(), (off / n).astype(float) @ to / np.sqrt(e), e / trace


def agrees(got, ids, want, k):
    n, deviations, projected, shares = want
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == len(ids) * k
    mine = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    assert np.abs(mine * np.sign((mine * projected).sum(axis=0)) - projected).max() < 1e-9
    assert [by[i, 1]["deviation"] for i in ids] == deviations
    assert all(r["n"] == n and r["identity_error"] <= 1e-9 for r in got)
    assert all(abs(by[ids[0], c]["explained"] / shares[c - 1] - 1) < 1e-9 for c in range(1, k + 1))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whitening_query_against_plain_version(spark, sf):
    rows = brute.rows(sf, "embeddings")
    got = queries.op12_whitening(spark, f"{brute.DATA}/{sf}").collect()
    agrees(got, [r["vec_id"] for r in rows], plain_whitened([r["embedding"] for r in rows]), 16)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [("v%d" % i, [float(x) for x in rng.standard_normal(3) * (4, 2, 1)]) for i in range(40)]
    bad = [("a", None), ("b", []), ("c", [1.0, None, 2.0]), ("d", [1.0, float("nan"), 2.0]), ("e", [float("inf"), 1.0, 1.0]), ("f", [1.0, 2.0]), ("g", [1e300, 0.0, 0.0]), (None, good[0][1])]
    df = spark.createDataFrame(good + bad + good[:1], "vec_id string, embedding array<double>").withColumn("x", F.lit(1)).withColumn("component", F.lit("c"))
    got = wh.whitened(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 3 for i, _ in good}) + Counter([None] * 3 + [good[0][0]] * 3)
    agrees([r for r in got if r["vec_id"] not in (None, "v0")], [i for i, _ in good[1:]], tuple(x[1:] if k in (1, 2) else x for k, x in enumerate(plain_whitened([v for _, v in good], 3))), 3)
    assert wh.whitened(df.limit(0)).count() == 0
    assert wh.whitened(df.where("vec_id = 'v0'")).count() == 0
    two = wh.whitened(df.where("vec_id in ('v1', 'v2')")).collect()  # of rank one
    assert sorted((r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(1, 1.0), (1, 1.0)]
    large = spark.createDataFrame([("a", [1e14, 0.0]), ("b", [-1e14, 1.0]), ("c", [0.0, 5.0])], "vec_id string, embedding array<double>")
    assert all(r["deviation"] is None for r in wh.whitened(large).where("vec_id <> 'c'").collect())


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 0.01, 200),
        np.r_[[5.0] * 9, np.linspace(4, 0.1, 91)],  # repeated more often than a block is wide
        np.ones(40),
        np.r_[[3.0, 2.0, 1.0], np.zeros(60)],  # of low rank: breakdown
        1.02 ** -np.arange(300.0),
    ],
)
def test_lanczos_against_a_dense_solver(values):
    m = symmetric(values)
    got, vectors, _ = wh.leading(lambda q: m @ q, len(values), 12, block=4, most=44)
    want = np.sort(values)[::-1][:12]
    assert np.allclose(got, want, atol=1e-11 * max(want[0], 1))
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-10
    assert np.linalg.norm(m @ vectors - vectors * got, axis=0).max() < 1e-10


def test_lanczos_does_not_need_the_whole_space():
    values = np.r_[np.geomspace(100, 10, 16), np.full(984, 0.5) + np.linspace(0, 0.4, 984)]
    m = symmetric(values)
    got, _, passes = wh.leading(lambda q: m @ q, 1000, 16)
    assert np.allclose(got, np.geomspace(100, 10, 16)) and passes < 15


# --- importance resampling


def plain_resampled(docs, bench, n=1, buckets=10_000, seed=2024, percent=10, least=20):
    def features(t):
        w = WORD.findall(brute.lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [(d["doc_id"], *features(d["text"])) for d in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for d in bench for b in features(d["text"])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_resampling_query_against_plain_version(spark, sf):
    got = [tuple(r) for r in queries.op13_importance_resample(spark, f"{brute.DATA}/{sf}").collect()]
    want = plain_resampled(brute.rows(sf, "documents"), brute.rows(sf, "benchmark"))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[4] is not None for r in got) >= 10


@pytest.mark.parametrize("n,size", [(1, 64), (2, 64), (3, 37), (3, 1 << 15)])
def test_chunks_lose_and_repeat_no_feature(spark, odd, n, size):
    got = [tuple(r) for r in ir.resampled(odd, odd, n, 500, min_words=5, percent=50, size=size).collect()]
    docs = brute_rows(ODD)
    want = plain_resampled(docs, docs, n, 500, percent=50, least=5)
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_rows(rows):
    return [{"doc_id": r[0], "text": r[1]} for r in rows]


def test_a_chunk_never_cuts_a_word(spark):
    text = "ab " * 40 + "x" * 300 + " cd, ef." + "\n" * 90 + "gh"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(ir.chunks(F.col("t"), 3, 50)).alias("c")).select("c.*").collect()
    assert "".join(r["own"] for r in rows) == text
    words = [WORD.findall(r["own"]) for r in rows]
    assert sum(words, []) == WORD.findall(text)
    for i, r in enumerate(rows):
        assert WORD.findall(r["carried"]) == sum(words[i + 1 :], [])[:2]


def test_resampling_of_odd_rows(spark, odd, none):
    assert ir.resampled(none, odd).count() == 0
    got = {r["n_features"]: r for r in ir.resampled(odd, none).where("doc_id in (1, 6)").collect()}
    assert got[0]["weight"] == 0 and set(got) == {0, len(LONG.split())}
    same = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("word " * 30).alias("text"))
    assert sorted(r["rank"] for r in ir.resampled(same, odd).where("rank is not null").collect()) == list(range(1, 501))
