import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import image_match as im, license_scan as ls, queries

from . import brute

SMALL = f"{brute.DATA}/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_k_grams_are_hashes_of_the_bytes():
    b = np.frombuffer(b"abcabcabcabcxabcabcabcabc", np.uint8)
    for k in (1, 3, 8, 12):
        h = ls.k_grams(b, k)
        assert len(h) == len(b) - k + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (b[i : i + k].tobytes() == b[j : j + k].tobytes())
    assert len(ls.k_grams(b[:5], 12)) == 0


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    kept = set(np.flatnonzero(ls.winnowed(h, np.arange(300), 4)).tolist())
    for i in range(297):
        least = h[i : i + 4].min()
        assert any(j in kept and h[j] == least for j in range(i, i + 4))


def test_templates_are_found_with_their_spans():
    rng, index = random.Random(1), ls.Index(ls.TEMPLATES)
    for name, text in ls.TEMPLATES.items():
        before, after = "Ä " + words(rng, 50) + "\n", " . " + words(rng, 40)
        found = {m[0]: m for m in ls.scan(before + text + after, index)}
        assert found[name][1] == 1.0
        s, e = found[name][2:]
        assert (before + text + after)[s:e].strip(" ./\"'") == text.strip(" ./\"'")
    mit = ls.TEMPLATES["MIT"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 20 != 7).upper().replace(" ", "\n  * ")
    found = {m[0]: m[1] for m in ls.scan(words(rng, 30) + edited + " " + words(rng, 30), index)}
    assert 0.9 < found["MIT"] < 1
    assert ls.scan(words(rng, 5000), index) == [] == ls.scan(None, index) == ls.scan("", index)
    twice = ls.scan("Released under the MIT License.\n" + words(rng, 90) + "\nreleased UNDER the mit license", index)
    assert [m[0] for m in twice] == ["MIT-line"] * 2
    assert not [m for m in ls.scan(" ".join(mit[:20]), index) if m[0] in ("MIT", "MIT-grant")]


def test_repeats_side_by_side_are_reported_each():
    index = ls.Index(ls.TEMPLATES)
    for name in ("All-rights-reserved", "CC-BY-NC-4.0-line", "MIT-line", "Apache-2.0-line"):
        line = ls.TEMPLATES[name]
        for unit in (line + " ", f"Copyright X. {line}\n"):
            text = unit * 40
            found = [m for m in ls.scan(text, index) if m[0] == name]
            assert [m[1] for m in found] == [1.0] * 40
            for n, m in enumerate(found):
                assert text[m[2] : m[3]].strip(".") == line.strip(".") and m[2] // len(unit) == n
    notice = ls.TEMPLATES["Apache-2.0"]
    text = (ls.TEMPLATES["Apache-2.0-line"] + "\n") * 60 + notice
    found = [m for m in ls.scan(text, index) if m[0] == "Apache-2.0"]
    assert [(m[1], text[m[2] : m[3]].rstrip(".")) for m in found] == [(1.0, notice.rstrip("."))]


def test_rivals_for_one_text():
    rng, index = random.Random(7), ls.Index(ls.TEMPLATES)
    for name, notice in ls.TEMPLATES.items():
        text = words(rng, 30) + ". " + notice + " " + words(rng, 30)
        assert [m[0] for m in ls.scan(text, index)] == [name], name
    both = ls.TEMPLATES["GPL-2.0"] + "\n\n" + ls.TEMPLATES["LGPL-3.0"]
    assert [m[0] for m in ls.scan(both, index)] == ["GPL-2.0", "LGPL-3.0"]


def test_edited_copies_are_found():
    rng, index = random.Random(8), ls.Index(ls.TEMPLATES)
    for share, least in ((0.05, 0.98), (0.1, 0.95)):
        found = tried = 0
        for name, notice in ls.TEMPLATES.items():
            own = notice.split()
            if len(own) < 25:
                continue
            for _ in range(10):
                edited = []
                for w in own:
                    kind = rng.random()
                    edited += [] if kind < share / 3 else [words(rng, 1)] if kind < 2 * share / 3 else [w, words(rng, 1)] if kind < share else [w]
                got = {m[0].split("-")[0] for m in ls.scan(words(rng, 40) + " " + " ".join(edited) + " " + words(rng, 40), index)}
                tried += 1
                found += name.split("-")[0] in got
        assert found / tried >= least, (share, found / tried)


def test_licences_of_awkward_tables(spark):
    line = ls.TEMPLATES["MIT-line"]
    long = ("words and more words. " * 20_000) + line + (" yet other words" * 20_000)
    df = spark.createDataFrame([(1, long), (1, long), (2, line * 3), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_matches"], [long[m["start"] : m["end"]].rstrip(".") for m in r["matches"]][:1] if r["doc_id"] == 1 else []) for r in ls.license_matches(df).collect())
    assert got == [(-1, 0, []), (1, 1, [line.rstrip(".")]), (1, 1, [line.rstrip(".")]), (2, 3, [])]
    assert ls.license_matches(df.limit(0)).count() == 0


def test_scan_does_not_depend_on_chunks(monkeypatch):
    rng, index = random.Random(2), ls.Index(ls.TEMPLATES)
    text = "\n".join(words(rng, 17) + " " + rng.choice(list(ls.TEMPLATES.values())) for _ in range(30))
    whole = ls.scan(text, index)
    monkeypatch.setattr(ls, "CHUNK", 101)
    assert ls.scan(text, index) == whole and len(whole) >= 30


def test_license_query_against_plain_search(spark):
    docs = brute.rows("sf0.01", "documents")
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in queries.op4_license_scan(spark, f"{brute.DATA}/sf0.01").collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    for d in docs:
        text = plain(d["text"])
        assert {n for n, t in ls.TEMPLATES.items() if plain(t) in text} <= got[d["doc_id"]]
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "All rights reserved.", "x")], "doc_id long, text string, matches string")
    assert sorted((r["doc_id"] or -1, r["n_matches"]) for r in ls.license_matches(odd).collect()) == [(-1, 1), (1, 0), (1, 0)]


def picture(seed, h=140, w=160):
    rng = np.random.default_rng(seed)
    return np.clip(im._resized(rng.integers(0, 255, (h // 8 + 2, w // 8 + 2)).astype(float), 1 / 8)[:h, :w] + rng.normal(0, 1, (h, w)), 0, 255).astype(np.uint8)


def row(i, a):
    return (i, {"height": a.shape[0], "width": a.shape[1], "gray": a.tobytes()}, "x")


def test_cropped_and_edited_copies_are_linked(spark):
    base = {i: picture(i) for i in range(12)}
    rng = np.random.default_rng(99)
    rows = [row(i, a) for i, a in base.items()]
    copies = {
        100: (0, base[0][12:120, 20:150]),
        101: (1, np.clip(base[1] * 0.7 + 40, 0, 255).astype(np.uint8)),
        102: (2, np.clip(base[2] + rng.normal(0, 2, base[2].shape), 0, 255).astype(np.uint8)),
        103: (3, np.rot90(base[3]).copy()),
        104: (4, base[4].copy()),
    }
    rows += [row(i, a) for i, (_, a) in copies.items()]
    rows += [(200, None, "x"), row(201, np.zeros((5, 5), np.uint8)), row(202, np.full((90, 90), 7, np.uint8)), row(4, base[4]), row(4, base[4])]
    df = spark.createDataFrame(rows, "img_id long, image struct<height:int,width:int,gray:binary>, keys string")
    got = im.image_copies(df).collect()
    root = {r["img_id"]: r["component_id"] for r in got}
    assert {i: root[i] for i in copies} == {i: o for i, (o, _) in copies.items()}
    assert all(root[i] == i for i in [*base, 200, 201, 202])
    assert len(got) == len(rows)
    assert im.image_copies(df.limit(0)).count() == 0


def test_drawn_vectors(spark):
    got = queries.op10_image_copies(spark, SMALL).collect()
    assert {r["img_id"] for r in got} == {r["vec_id"] for r in brute.rows("sf0.001", "embeddings")}
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, float("nan")]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert im.image_copies(im.rendered(df)).count() == 4
    v = [float(x) for x in np.random.default_rng(1).normal(size=64)]
    near = [x + 0.001 for x in v]
    other = [float(x) for x in np.random.default_rng(2).normal(size=64)]
    df = spark.createDataFrame([(5, v), (9, near), (11, other)], "vec_id long, embedding array<float>")
    assert {r["img_id"]: r["component_id"] for r in im.image_copies(im.rendered(df)).collect()} == {5: 5, 9: 5, 11: 11}


def test_every_part_of_a_large_picture_keeps_corners():
    large = picture(50, 400, 400).astype(float)
    large[:, 200:] = large[:, 200:] * 0.2 + 100  # the strongest corners are in the left half
    p, _ = im.describe(large.astype(np.uint8))
    assert ((p[:, 2] == 0) & (p[:, 0] > 220)).sum() >= 40


def test_links_in_a_bucket_are_those_of_all_pairs(spark):
    """Copies 3, 4 and 5 stand in every bucket between 1 and 9, which have the same patches at other places."""
    rng = np.random.default_rng(4)
    bits = rng.random((5, 256)) < 0.5
    rows = []
    for i in (1, 3, 4, 5, 9):
        for k in range(5):
            t = bits[k].copy()
            t[rng.integers(256)] ^= True
            keys = [int((t[b] << np.arange(im.TABLE_BITS)).sum()) | n << im.TABLE_BITS for n, b in enumerate(im.BITS)]
            place = 20 * k if 3 <= i <= 5 else 20 * k + 100 * i * (k + 1) ** 2
            rows.append((i, place << 24 | place, 0.0, *np.packbits(t).view(">i8").tolist(), keys))
    df = spark.createDataFrame(rows, im.KEYPOINT)
    for tile in (2, 2048):
        assert {(r["a"], r["b"]): r["votes"] for r in im.links(df, tile=tile).collect()} == {(3, 4): 5, (3, 5): 5, (4, 5): 5}


def points_of(rng, n, bits, places):
    """Points of n copies of a picture with the same bits, each with one bit of its own turned."""
    rows = []
    for i in range(n):
        for t, place in zip(bits, places):
            t = t.copy()
            t[rng.integers(256)] ^= True
            rows.append((i, int(place) << 24 | int(place), 0.0, *np.packbits(t).view(">i8").tolist(), []))
    return rows


def test_a_group_of_copies_leaves_no_more_rows_than_images_for_each_cell(spark):
    """40 near copies have 780 links; of one cell come 40 rows, of ten cells, in which each image stands with each of four tiles, 160 at most."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(points_of(rng, 40, rng.random((6, 256)) < 0.5, 20 * np.arange(6)), im.KEYPOINT).drop("keys")
    images = im._packed(df, 4).withColumn("n", F.when(F.col("img_id") == 3, 5).otherwise(1).cast("long"))
    for tile, cells in ((1 << 18, 1), (60, 4)):
        want = {(r["a"], r["b"]) for r in im.links(df, tile=tile).collect()}
        found = im.linked(images, tile=tile).collect()
        assert len(want) > 700 and len(found) <= 40 * cells
        others, root = Counter(), list(range(40))
        for r in found:
            others[r["a"]] += r["others"]
        weight = lambda i: 5 if i == 3 else 1
        assert others == Counter({i: sum(weight(a + b - i) for a, b in want if i in (a, b)) for i in range(40)})
        root = im._joined(np.array(root), np.array([r["a"] for r in found]), np.array([r["b"] for r in found]))
        assert set(root.tolist()) == {0}


def test_small_pieces_find_the_same_links():
    """Pieces of few pairs, down to parts of what one image meets, lose and repeat nothing."""
    rng = np.random.default_rng(8)
    rows = points_of(rng, 14, rng.random((6, 256)) < 0.5, 20 * np.arange(6))
    img, corner, angle, *words = zip(*(r[:7] for r in rows))
    parts = [slice(k, k + 3) for k in range(0, len(rows), 3)]
    lists = [[{"corner": corner[i], "angle": angle[i], **{w: words[k][i] for k, w in enumerate(im.WORDS)}} for i in range(len(rows))[p]] for p in parts]
    kind = im.pa.list_(im.pa.struct([("corner", im.pa.int64()), ("angle", im.pa.float32()), *((w, im.pa.int64()) for w in im.WORDS)]))
    for number, tile in ((0, [0] * len(parts)), (1, [img[p][0] % 2 for p in parts])):
        cell = im.pa.table([im.pa.array([number] * len(parts)), im.pa.array(tile), im.pa.array([img[p][0] for p in parts]), im.pa.array([1] * len(parts)), im.pa.array(lists, kind)], names=["cell", "tile", "img_id", "n", "points"])
        got = [sorted(l for a, b, v in im._Points(cell, 2).links(4, most) for l in zip(a.tolist(), b.tolist(), v.tolist())) for most in (1 << 20, 50, 1)]
        assert got[0] == got[1] == got[2] and len(set(got[0])) == len(got[0]) > 40
        assert all(a < b and (number == 0 or a % 2 != b % 2) for a, b, _ in got[0])


def cell_of(rows, number, tiles):
    """One cell, with an image a row, for _Points."""
    images = sorted({r[0] for r in rows})
    lists = [[dict(zip(["corner", "angle", *im.WORDS], r[1:7])) for r in rows if r[0] == i] for i in images]
    kind = im.pa.list_(im.pa.struct([("corner", im.pa.int64()), ("angle", im.pa.float32()), *((w, im.pa.int64()) for w in im.WORDS)]))
    n = len(images)
    return im.pa.table([im.pa.array([number] * n), im.pa.array([i % tiles for i in images]), im.pa.array(images), im.pa.array([1] * n), im.pa.array(lists, kind)], names=["cell", "tile", "img_id", "n", "points"])


def test_images_that_meet_too_seldom_are_not_compared(monkeypatch):
    """200 images meet in a table by one point each, and two of them by all points: of 19,900 pairs few more than theirs are looked at."""
    rng, looked = np.random.default_rng(12), [0]
    bits = rng.random((200, 5, 256)) < 0.5
    bits[:, 0, im.BITS[3]] = bits[0, 0, im.BITS[3]]
    bits[151] = bits[4]
    rows = [(i, 20 * k << 24 | 40 * k, 0.0, *np.packbits(bits[i, k]).view(">i8").tolist()) for i in range(200) for k in range(5)]
    votes = im._Points._votes

    def counted(self, table, i, j, *rest):
        looked[0] += int(rest[1].sum()) if rest else len(i)
        return votes(self, table, i, j, *rest)

    monkeypatch.setattr(im._Points, "_votes", counted)
    for number, tiles in ((0, 1), (1, 2)):
        looked[0] = 0
        assert [l for a, b, v in im._Points(cell_of(rows, number, tiles), tiles).links(5) for l in zip(a.tolist(), b.tolist(), v.tolist())] == [(4, 151, 5)]
        assert im.TABLES * 5 <= looked[0] < 1000


def test_points_that_meet_are_those_of_equal_hashes():
    rng = np.random.default_rng(13)
    hashes = [rng.integers(0, 12, 300, np.uint64) << np.uint64(58) for _ in range(2)]
    own = np.sort(rng.integers(0, 60, 300))
    some = np.flatnonzero(own % 2 == 0), np.flatnonzero(own % 2 == 1)
    for left, right, same in ((*some, False), (some[0], some[0], True)):
        met = im._Met(hashes, left, right, same)
        for most in (1 << 20, 7):  # counted, and too many for that
            got = Counter()
            for table, i, j in met.pairs(3, len(left), own[left], own[met.order], 1, most):
                got.update(zip(table.tolist(), left[i].tolist(), met.order[j].tolist()))
            want = Counter((t, a, b) for t, h in enumerate(hashes) for a in left[3:].tolist() for b in right.tolist() if h[a] == h[b] and (not same or a < b))
            assert got == want and len(want) > 500
        pairs = Counter((own[a], own[b]) for _, a, b in want)
        kept = Counter((own[a], own[b]) for t, i, j in met.pairs(3, len(left), own[left], own[met.order], 3, 1 << 20) for a, b in zip(left[i], met.order[j]))
        assert {p: n for p, n in kept.items() if n >= 3} == {p: n for p, n in pairs.items() if n >= 3} != {}


def test_pictures_described_together_are_as_each_alone(spark):
    sizes = [(72, 72), (140, 160), (40, 300), (20, 20), (72, 72), (72, 72)]
    pictures = [picture(200 + i, h, w) for i, (h, w) in enumerate(sizes)]
    pictures[4] = np.full((72, 72), 9, np.uint8)  # without corners
    of, p, t = im.described(np.stack([pictures[i] for i in (0, 4, 5)]))
    assert set(of.tolist()) == {0, 2}
    for k, i in ((0, 0), (2, 5)):
        one = im.describe(pictures[i])
        assert np.array_equal(p[of == k], one[0]) and np.array_equal(t[of == k], one[1])
    found = im.keypoints(spark.createDataFrame([row(i, a) for i, a in enumerate(pictures)], "img_id long, image struct<height:int,width:int,gray:binary>, x string")).collect()
    for i, a in enumerate(pictures):
        p, t = im.describe(a)
        want = {(int(l) << 48 | int(y) << 24 | int(x), np.packbits(w).tobytes(), tuple(int((w[b] << np.arange(im.TABLE_BITS)).sum()) | n << im.TABLE_BITS for n, b in enumerate(im.BITS))) for (x, y, l, _), w in zip(p, t)}
        assert {(r["corner"], np.array([r[w] for w in im.WORDS]).astype(">i8").tobytes(), tuple(r["keys"])) for r in found if r["img_id"] == i} == want


def test_vectors_of_one_piece_are_drawn_by_many_tasks(spark):
    rng = np.random.default_rng(14)
    vectors = [[float(x) for x in rng.normal(size=n)] for n in (64, 8, 64, 3) * 60]
    vectors[5], vectors[6], vectors[7], vectors[9] = None, [], [0.0, 0.0, 0.0], [1.0, None, float("inf"), float("-inf"), float("nan"), 2.0]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").coalesce(1)
    drawn = im.rendered(df)
    parts = {r["part"] for r in drawn.select(F.spark_partition_id().alias("part")).collect()}
    assert len(parts) > 1
    got = {r["img_id"]: r["image"] for r in drawn.collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(vectors):
        if not v:
            assert got[i] is None
            continue
        v = np.nan_to_num(np.array([0.0 if x is None else x for x in v]), posinf=0.0, neginf=0.0)
        big = im._resized(v[np.random.default_rng(7).integers(0, len(v), (25, 25))], 24 / 72)[:72, :72]
        gray = np.clip(np.round(127.5 + 127.5 * big / (np.abs(v).max() or 1.0)), 0, 255).astype(np.uint8)
        assert (got[i]["height"], got[i]["width"], bytes(got[i]["gray"])) == (72, 72, gray.tobytes())


def test_links_of_edited_and_equal_copies_are_all_counted(spark):
    a, rng = picture(70), np.random.default_rng(1)
    edited = [np.clip(a + rng.normal(0, 1.5, a.shape), 0, 255).astype(np.uint8) for _ in range(4)]
    rows = [row(i, e) for i, e in enumerate([*edited, a, a, a])] + [row(50, picture(71))]
    df = spark.createDataFrame(rows, "img_id long, image struct<height:int,width:int,gray:binary>, keys string")
    got = {r["img_id"]: (r["component_id"], r["n_links"]) for r in im.image_copies(df).collect()}
    assert got == {**dict.fromkeys(range(7), (0, 6)), 50: (50, 0)}


EDITS = {
    "crop to 70 %": lambda a, rng: a[10 : 10 + int(a.shape[0] * 0.84), 8 : 8 + int(a.shape[1] * 0.84)],
    "noise": lambda a, rng: np.clip(a + rng.normal(0, 2, a.shape), 0, 255).astype(np.uint8),
    "gamma": lambda a, rng: np.clip(255 * (a / 255.0) ** 0.8, 0, 255).astype(np.uint8),
    "quarter turn": lambda a, rng: np.rot90(a).copy(),
    "resize to 0.8": lambda a, rng: np.clip(im._resized(a.astype(float), 1.25), 0, 255).astype(np.uint8),
    "resize to 2/3": lambda a, rng: np.clip(im._resized(a.astype(float), 1.5), 0, 255).astype(np.uint8),
}


@pytest.mark.parametrize("seed, first", [(3, 1000), (77, 70000)])
def test_recall_by_edit(spark, seed, first):
    n, rng = 40, np.random.default_rng(seed)
    base = [picture(first + i) for i in range(n)]
    rows = [row(i, a) for i, a in enumerate(base)]
    for k, edit in enumerate(EDITS.values(), 1):
        rows += [row(1000 * k + i, np.ascontiguousarray(edit(a, rng))) for i, a in enumerate(base)]
    df = spark.createDataFrame(rows, "img_id long, image struct<height:int,width:int,gray:binary>, x string")
    points = im.keypoints(df)
    found = {(r["a"], r["b"]) for r in im.links(points).collect()}
    for k, name in enumerate(EDITS, 1):
        assert sum((i, 1000 * k + i) in found for i in range(n)) >= 0.95 * n, name
    pairs = len(rows) * (len(rows) - 1) / 2
    assert sum(a % 1000 != b % 1000 for a, b in found) <= pairs / 2000  # other pictures agree by chance at times


@pytest.mark.parametrize("kind,name", [("string", "i{}.png"), ("double", "{}.25"), ("decimal(6,2)", "{}.5"), ("int", "{}")])
def test_image_ids_of_any_type(spark, kind, name):
    vectors = spark.read.parquet(f"{brute.DATA}/sf0.001/embeddings.parquet").orderBy("vec_id").limit(6)
    named = vectors.select(F.format_string(name.replace("{}", "%d"), "vec_id").cast(kind).alias("vec_id"), "embedding")
    none = named.limit(1).select(F.lit(None).cast(kind).alias("vec_id"), "embedding")
    copied = named.limit(1).select(F.lit(name.format(99)).cast(kind).alias("vec_id"), "embedding")
    got = im.image_copies(im.rendered(named.union(none).union(copied)))
    assert [t for _, t in got.dtypes] == [kind, kind, "bigint"]
    by = {r["img_id"]: r for r in got.collect()}
    first, last = copied.first()["vec_id"], named.first()["vec_id"]
    assert len(by) == 8 and by[None]["component_id"] is None and by[None]["n_links"] == 0
    assert by[first]["component_id"] == by[last]["component_id"] == min(first, last) and by[first]["n_links"] >= 1
