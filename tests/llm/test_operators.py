"""The operators against plain versions, on small and awkward tables."""

import hashlib
import heapq
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import bpe_count, centroid_langid, chat_format, decontaminate, line_dedup, pfair_mix, queries, shard_bfd, simhash_tiles
from sparktrail.llm.common import components

from . import brute

SMALL = f"{brute.DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, pos string"
LONG = "ab cd ef gh " * 30_000
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\r \x0b\x0c", "en", "a"),
    (4, "One two three four five", "en", "b"),
    (5, "one two three four five", "en", "b"),
    (5, "another text of that id", "en", "b"),
    (6, LONG, "de", "a"),
    (7, LONG + "x", "de", "a"),
    (8, "Ünïcödé ÀÉ \U0001f600 中文\n\nÀÉ", "fr", None),
    (9, "12345 --- !!!", "en", "c"),
    (None, "one two three four five", "en", "b"),
    (None, "nobody has this", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, "p") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def dicts(rows):
    return [{"doc_id": r[0], "text": r[1]} for r in rows]


# --- chat formatting


def test_chat_escapes_are_reversible(spark):
    texts = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a<|", "|>", "\\", "\n", "<|im_start|>user\nhi<|im_end|>\n", "$1 \\1", None, "é\U0001f600"]
    roles = ["user", "assistant", "a\nb", "c\\nd", "<|im_start|>", None, "\\", "\\s", "assistant"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate((t, r) for t in texts for r in roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat_format.read_back(chat_format.format_chats(df)).first()
    assert [(t["role"], t["text"]) for t in got["read"]] == [(r or "", t or "") for _, _, r, t in rows]
    assert [t["loss"] for t in got["read"]] == [r == "assistant" for _, _, r, _ in rows]
    assert got["formatted"].count("<|im_start|>") == got["formatted"].count("<|im_end|>") == len(rows)
    assert sum(r["n"] for r in got["loss_runs"]) == len(got["formatted"])


def test_chat_layouts_meet_in_the_same_turns(spark):
    said = [("user", "q"), ("assistant", "a")]
    payloads = [
        {"messages": [{"role": r, "content": t} for r, t in said], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a", "text": {"clash": 1}},
        {"instruction": "q", "output": "a"},
        {"dialogue": [{"speaker": "user", "text": "q", "role": "zz"}, {"speaker": "bot", "text": "a"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(90, None), (91, "{"), (92, '{"x": 1}'), (93, "[]")], "conv_id long, payload string")
    got = {r["conv_id"]: r for r in chat_format.canonical_turns_json(df).collect()}
    for i in range(len(payloads)):
        assert [tuple(t) for t in got[i]["turns"]] == said, got[i]
    assert [got[i]["mapping"] for i in (90, 91, 92, 93)] == ["none"] * 4
    assert got[2]["fingerprint"] == chat_format.fingerprint(["prompt", "response"])
    assert got[0]["fingerprint"] == chat_format.fingerprint(["messages", "messages[].role", "messages[].content"])
    typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], "z")], "conv_id long, messages array<struct<role:string,content:string>>, extra string")
    assert [tuple(t) for t in chat_format.canonical_turns(typed).first()["turns"]] == said
    with pytest.raises(ValueError):
        chat_format.canonical_turns(df.select("conv_id"))


def test_chat_layouts_lose_and_invent_no_text(spark):
    parts = [{"type": "text", "text": "q1 "}, {"type": "image"}, "and ", {"type": "text", "text": "q2"}]
    cases = [
        ({"conversations": [{"from": "human", "value": "q"}], "system": "s"}, "shared_turns", [("system", "s"), ("user", "q")]),
        ({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "a", "meta": {"text": "x", "from": "y"}}]}, "messages", [("user", "q1 and q2"), ("assistant", "a")]),
        ({"instruction": "do", "input": "", "output": "a"}, "instruction_input", [("user", "do"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "a", "system": "s"}, "instruction_input", [("user", "do\nthis"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"system_prompt": "s", "question": "q", "answer": {"text": "a"}, "system": ""}, "question_answer", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user"}, "loose", {"content": "c"}, None]}, "messages", [("user", ""), ("", "c")]),
        ({"messages": [{"body": {"role": "user", "content": "no"}}], "prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ]
    cases[3][2].insert(0, ("system", "s"))
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "conv_id long, payload string")
    got = {r["conv_id"]: r for r in chat_format.canonical_turns_json(df).collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert (got[i]["mapping"], [tuple(t) for t in got[i]["turns"]]) == (name, turns), cases[i][0]
    typed = spark.createDataFrame([(1, [("user", [("q1 ",), (None,), ("q2",)])], "s"), (2, None, None)], "conv_id long, messages array<struct<role:string,content:array<struct<text:string>>>>, system string")
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.canonical_turns(typed).collect()} == {1: [("system", "s"), ("user", "q1 q2")], 2: []}
    typed = spark.createDataFrame([(1, "do", None, "a"), (2, "do", "it", "a")], "conv_id long, instruction string, input string, output string")
    assert [[tuple(t) for t in r["turns"]] for r in chat_format.canonical_turns(typed).orderBy("conv_id").collect()] == [[("user", "do"), ("assistant", "a")], [("user", "do\nit"), ("assistant", "a")]]


def test_chat_ties_repeats_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string, prompt string"
    df = spark.createDataFrame([(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, 1, "user", "n", "x"), (2, 0, "bot", "z", "x")], kind)
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat_format.format_chats(df).collect()}
    assert got == {1: ["a", "a", "b"], None: ["n"], 2: ["z"]}
    assert chat_format.format_chats(df).where("conv_id = 2").first()["turns"][0]["role"] == "bot"
    assert chat_format.format_chats(spark.createDataFrame([], kind)).count() == 0


# --- token counts


def test_token_counts_are_the_library_s(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    merger = bpe_count.piece_merger("piece_bpe_32k.model")
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("abthe \n▁é中😀<s>|\t\x00\xa0,.") for _ in range(rng.randint(0, 40)))
        assert merger.count(text) == len(sp.encode(text)), repr(text)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ODD)
    got = bpe_count.token_counts(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and any(r["over_limit"] for r in got)
    assert bpe_count.token_counts(none).count() == 0
    docs = brute.rows("sf0.001", "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, SMALL).collect()}
    assert got == {d["doc_id"]: len(sp.encode(d["text"] or "")) for d in docs}


# --- mixing


def plain_schedule(blocks, weights):
    """Earliest deadline first over all slots, with fractions: (source, block) of each slot, and the windows."""
    w = {s: Fraction(weights[s]) for s in blocks}
    ends = sorted({Fraction(n) / w[s] for s, n in blocks.items()})

    def x(v):
        return sum(min(v * w[s], n) for s, n in blocks.items())

    assert x(ends[-1]) == sum(blocks.values())
    jobs = {(s, i): (math.floor(x(i / w[s])), math.ceil(x((i + 1) / w[s]))) for s, n in blocks.items() for i in range(n)}
    out, ready, waiting = [], [], sorted((r, d, s, i) for (s, i), (r, d) in jobs.items())
    for t in range(len(jobs)):
        while waiting and waiting[0][0] <= t:
            r, d, s, i = waiting.pop(0)
            heapq.heappush(ready, (d, s, i))
        out.append(heapq.heappop(ready)[1:])
    return out, jobs


def test_schedule_is_plain_earliest_deadline_first():
    rng = random.Random(12)
    for sources in (2, 3, 7, 40):
        weights = {f"s{i:02}": rng.choice([1, 2, 0.5, rng.random(), 1e-3, rng.random() * 50]) for i in range(sources)}
        blocks = {s: rng.randint(1, 30) for s in weights}
        want, jobs = plain_schedule(blocks, weights)
        got = pfair_mix.schedule(blocks, weights)
        assert sorted((t, s, i) for s, own in got.items() for i, t in enumerate(own)) == [(t, s, i) for t, (s, i) in enumerate(want)]
        assert all(r <= t < d for t, job in enumerate(want) for r, d in [jobs[job]])


def test_tiny_and_odd_weights_are_followed_at_every_prefix():
    weights = {"tiny": 1e-6, "odd": 0.12345678, "pi": math.pi / 10, "rest": 0.5623838}
    blocks = {"tiny": 1, "odd": 15_000, "pi": 40_000, "rest": 70_000}
    slots = pfair_mix.schedule(blocks, weights)
    assert sorted(t for own in slots.values() for t in own) == list(range(125_001))
    until = int(min(blocks[s] / weights[s] for s in ("odd", "pi", "rest")) * sum(weights.values()))
    assert until > 100_000
    for s, w in weights.items():
        given = np.searchsorted(slots[s], np.arange(1, until + 1))
        assert np.abs(given - np.arange(1, until + 1) * w / sum(weights.values())).max() < 1


def test_mix_query_is_the_schedule(spark):
    got = queries.op3_pfair_mix(spark, SMALL).collect()
    n = Counter(r["source"] for r in got)
    blocks = {s: -(-k // pfair_mix.BLOCK_ROWS) for s, k in n.items()}
    want, _ = plain_schedule(blocks, {s: math.sqrt(k) for s, k in n.items()})
    assert {(r["slot"], r["source"], r["block"]) for r in got} == {(t, s, i) for t, (s, i) in enumerate(want)}
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in brute.rows("sf0.001", "documents"))
    assert all(len({r["place"] for r in got if r["slot"] == t}) == sum(r["slot"] == t for r in got) for t in range(len(want)))


def test_mix_keeps_all_rows(spark, odd, none):
    got = pfair_mix.mix(odd, block_rows=2).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in ODD)
    assert len({(r["slot"], r["place"]) for r in got}) == len(ODD)
    assert {r["slot"] for r in got} == set(range(max(r["slot"] for r in got) + 1))
    assert pfair_mix.mix(none).count() == 0
    named = pfair_mix.mix(odd.withColumn("doc_id", F.lit("no number")), block_rows=2)
    assert named.count() == len(ODD)
    weighted = pfair_mix.mix(odd, {"a": 0.5, None: 0.5}, block_rows=1).collect()
    assert len(weighted) == len(ODD)
    moved = pfair_mix.in_mixed_order(odd, F.coalesce("doc_id", F.xxhash64("text")))
    assert moved.columns == odd.columns and moved.count() == len(ODD)


def test_mix_prefixes_follow_the_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    weights = {"big": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}
    got = pfair_mix.mix(df, weights, block_rows=10).collect()
    by_slot = {r["slot"]: r["source"] for r in got}
    seen = Counter()
    for t in range(246):  # until s0 has given its 50 blocks
        seen[by_slot[t]] += 1
        assert all(abs(seen[s] - w * (t + 1)) < 1 for s, w in weights.items())


def test_every_source_follows_its_exact_weight():
    weights = {f"s{i:03}": math.sqrt(2 + i) for i in range(400)} | {"big": 400 * math.pi}
    blocks = {s: 100 + int(20 * w) for s, w in weights.items()} | {"big": 40_000}
    slots = pfair_mix.schedule(blocks, weights)
    order = [s for _, s in sorted((t, s) for s, own in slots.items() for t in own)]
    assert len(order) == sum(blocks.values()) == len({t for own in slots.values() for t in own})
    total, span = sum(weights.values()), min(blocks[s] / weights[s] for s in blocks)
    until = int(span * total)  # until the first source ends
    assert until > 150_000
    for s, w in weights.items():
        given = np.searchsorted(slots[s], np.arange(1, until + 1, 7))
        assert np.abs(given - np.arange(1, until + 1, 7) * w / total).max() < 1


def test_mix_keeps_hundreds_of_sources_apart(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 400).alias("source"))
    for weights in (None, {f"s{i}": 1.0 + i for i in range(400)}):
        got = pfair_mix.mix(df, weights, block_rows=5).collect()
        by_slot = {}
        for r in got:
            by_slot.setdefault(r["slot"], set()).add(r["source"])
        assert sorted(by_slot) == list(range(800)) and all(len(s) == 1 for s in by_slot.values())
    seen = Counter(s for t in range(400) for s in by_slot[t])
    assert seen["s399"] == 2 and seen["s0"] == 0


# --- near-dedup


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(400)] + [(-5, -5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_find_all_near_fingerprints(spark, tile):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps[:60]):
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.append(f)
    fps = sorted(set(fps) | {0, 1, 3, 0xFFFF, 2**64 - 1, 2**64 - 16})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash_tiles.links(df, len(fps), 4, tile)).collect()}
    want = brute.linked(fps, signed)
    assert [got.get(s, s) for s in signed] == want


def test_near_duplicates_odd_rows(odd, none):
    got = simhash_tiles.near_duplicates(odd).collect()
    fps = [brute.simhash(r[1]) for r in ODD]
    want = brute.linked(fps, [r[0] for r in ODD])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((r[0], f"{f:016x}", w) for r, f, w in zip(ODD, fps, want))
    assert simhash_tiles.near_duplicates(none).count() == 0


def test_near_duplicates_of_the_documents(spark):
    docs = brute.rows("sf0.001", "documents")
    fps = [brute.simhash(d["text"]) for d in docs]
    want = brute.linked(fps, [d["doc_id"] for d in docs])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_dedup(spark, SMALL).collect()}
    assert got == {d["doc_id"]: (f"{f:016x}", w) for d, f, w in zip(docs, fps, want)}


# --- language


def test_language_of_held_out_documents(spark):
    truth = {d["doc_id"]: d["lang"] for d in brute.rows("sf0.01", "documents")}
    got = queries.op6_language_id(spark, f"{brute.DATA}/sf0.01").collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = centroid_langid.fit(docs)
    got = {(r["doc_id"], r["text"]): r for r in centroid_langid.predict(odd, model, ("doc_id", "text")).collect()}
    for i, text in ((1, None), (2, ""), (9, "12345 --- !!!")):
        assert (got[i, text]["lang_pred"], got[i, text]["score"], got[i, text]["rejected"]) == ("und", 0.0, True)
    assert centroid_langid.predict(none, model).count() == 0
    empty = centroid_langid.fit(none)
    assert {r["lang_pred"] for r in centroid_langid.predict(odd, empty).collect()} == {"und"}
    for text in ("½²", "①", "Ⅷ 12 _", "٣"):  # numerals are no letters
        assert model.predict(text) == ("und", 0.0, True)
    assert model.predict("½a²")[0] != "und" != model.predict("ª")[0]
    assert model.predict("Это совсем другой язык и другие буквы здесь")[2]


def test_counts_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = "das ist ein langer text über vieles " * 300
    whole = centroid_langid.counts(text)
    monkeypatch.setattr(centroid_langid, "CHUNK", 1000)
    assert (centroid_langid.counts(text) == whole).all()


def test_language_of_long_texts_only_is_learned(spark):
    say = {"en": "the river runs under the old bridge and the children watch ", "de": "der Fluss zieht unter der alten Bruecke und die Kinder schauen zu ", "fr": "la riviere coule sous le vieux pont et les enfants regardent "}
    short = [(i, say["en"] * (1 + i), "en") for i in range(4)]
    long = [(10 * k + i, say[lang] * (700 + i), lang) for k, lang in ((1, "de"), (2, "fr")) for i in range(4)]
    for rows in (short + long, long):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = centroid_langid.fit(docs)
        got = centroid_langid.predict(docs, model, ("lang",)).collect()
        assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)


# --- decontamination


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_of_the_documents(spark, most):
    docs, bench = brute.rows("sf0.001", "documents"), brute.rows("sf0.001", "benchmark")
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    got = decontaminate.contamination(read("documents"), read("benchmark"), broadcast_bytes=most).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.contaminated(docs, bench))
    assert any(r["contaminated"] for r in got)


def test_contamination_odd_rows(spark, none):
    rng = random.Random(4)
    bench = [(1, "a b c d e f g h i j k l m n o p"), (2, "Short Item"), (3, None), (4, "..."), (5, "a b c d e f g h i j a b c d e f g h i j"), (5, "x " * 25), (None, "zz yy"), (10, "short item")]
    texts = [None, "", "a B c, d-e f g h i j", "short item short ITEM", "x " * 40, "zz yy xx", LONG, "É short é item"]
    texts += [" ".join(rng.choice("a b c d e f g h i j k".split()) for _ in range(60)) for _ in range(40)]
    texts += ["pre " + "a b c d e f g h i j k l m n o p"[s : s + 24] + " post" for s in range(0, 20, 2)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other text"), (None, texts[3])]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, words string, term string")
    want = Counter(brute.contaminated(dicts(docs), [{"item_id": i, "text": t} for i, t in bench]))
    assert Counter(tuple(r) for r in decontaminate.contamination(d, b).collect()) == want
    assert decontaminate.contamination(none, b).count() == 0
    clean = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_proximity(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta common")], "item_id long, text string")
    d = spark.createDataFrame([(1, "delta x gamma y beta z alpha"), (2, "alpha beta gamma " + "common " * 9), (3, "alpha " + "w " * 30 + "beta gamma delta"), (4, None)], "doc_id long, text string")
    listed = decontaminate.items(b)
    index = decontaminate.build_index(d)
    got = decontaminate.proximity_matches(index, listed, rarest=4, slop=8).select("dk").collect()
    assert [r[0] for r in got] == [1]
    other = decontaminate.items(spark.createDataFrame([("q", "beta gamma common"), ("r", "y z"), ("s", "z beta")], "item_id string, text string"))
    found = {(r["dk"], r["item_id"], r["lo"], r["hi"]) for r in decontaminate.phrase_matches(index, other).collect()}
    assert found == {(2, "q", 1, 4)}  # the same index serves another benchmark


def test_contamination_takes_ids_of_any_kind(spark):
    b = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    d = spark.createDataFrame([("x1", "say one two three"), ("x2", "nothing"), (None, "one two three"), ("7", None)], "doc_id string, text string")
    assert Counter((r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(d, b).collect()) == Counter([("x1", 3), ("x2", 0), (None, 3), ("7", 0)])
    assert decontaminate.contamination(d, b.limit(0)).count() == 4
    lines = line_dedup.kept_hashes(d, 2).collect()
    assert {r["doc_id"] for r in lines} == {"x1", "x2", None, "7"}
    groups = simhash_tiles.near_duplicates(d.union(d)).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {"x1": "x1", "x2": "x2", None: None, "7": "7"}
    assert pfair_mix.mix(d.withColumn("source", F.lit("s"))).count() == shard_bfd.shard(d, 2).count() == 4


# --- shards


def test_tree_against_a_list():
    rng, tree, held = random.Random(1), shard_bfd.Tree(), []
    for i in range(4000):
        if held and rng.random() < 0.5:
            x = held.pop(rng.randrange(len(held)))
            tree.remove(x)
        else:
            x = (rng.randrange(500), i)
            held.append(x)
            tree.insert(x)
        size = rng.randrange(520)
        assert tree.ceiling(size) == min((h for h in held if h[0] >= size), default=None)


def test_best_fit_decreasing():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    free, want = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(free) if r >= s]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(120)
        free[b] -= s
        want.append(b)
    placed, bins = shard_bfd.best_fit(sorted(Counter(sizes).items(), reverse=True), 120)
    assert ([b for _, first, end, b in placed for _ in range(first, end)], bins) == (want, len(free))
    assert shard_bfd.best_fit([(300, 2)], 120) == ([(300, 0, 1, 0), (300, 1, 2, 1)], 2)


def plain_packing(sizes, capacity):
    """Best-fit-decreasing by one search over all bins for each group."""
    free, held = [], defaultdict(list)
    for s in sorted(sizes, reverse=True):
        r, b = min(((r, b) for b, r in enumerate(free) if r >= s), default=(None, len(free)))
        if r is None:
            free.append(max(capacity, s))
        free[b] -= s
        held[b].append(s)
    return held


def test_many_small_groups_are_packed_as_plain_best_fit_does(spark):
    rng = random.Random(6)
    lengths = [min(4000, int(rng.paretovariate(0.9) * 6)) for _ in range(20_000)]
    texts = [f"{i:06}" + "x" * n for i, n in enumerate(lengths)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20_000 + i, "a hot text of many copies") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = Counter(t for _, t in rows)
    sizes = [(len(t) + 1) * n for t, n in sizes.items()]
    for shards, capacity in ((16, None), (None, 60_000)):
        got = shard_bfd.shard(df, shards, capacity).collect()
        loads, held = Counter(), defaultdict(Counter)
        for r in got:
            held[r["shard"]][r["text_crc32"], r["size"]] += r["size"]
            loads[r["shard"]] += r["size"]
        if capacity is None:
            assert max(loads.values()) - min(loads.values()) <= 2 * max(loads.values()) / 1000 or max(loads.values()) == max(sizes)
            capacity = max(loads.values())
        want = plain_packing(sizes, capacity)
        assert Counter(tuple(sorted(x.values())) for x in held.values()) == Counter(tuple(sorted(x)) for x in want.values())


def test_shards_are_whole_and_near_equal(spark, odd, none):
    docs = brute.rows("sf0.01", "documents")
    got = queries.op8_shard(spark, f"{brute.DATA}/sf0.01").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d["doc_id"]: (len(d["text"].encode()) + 1, brute.crc(d["text"])) for d in docs}
    slots, loads, texts = defaultdict(list), Counter(), defaultdict(set)
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        texts[text[r["doc_id"]]].add(r["shard"])
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, texts.values())) == 1
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    got = shard_bfd.shard(odd, 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, brute.crc(r[1])) for r in ODD)
    assert shard_bfd.shard(none).count() == 0
    few = shard_bfd.shard(odd, None, capacity=400_000)
    assert few.select("shard").distinct().count() == 2


def test_shards_are_written_whole(spark, odd, tmp_path):
    shard_bfd.write_shards(odd, str(tmp_path / "s"), shards=3, file_bytes=100_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert back.groupBy("text").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1
    shard_bfd.write_shards(odd.withColumn("shard", F.lit("own")), str(tmp_path / "t"), shards=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == len(ODD) and {r[0] for r in back.select("_shard").collect()} == {"own"}


# --- lines


def test_lines_of_the_documents(spark):
    docs = brute.rows("sf0.01", "documents")
    got = queries.op9_line_dedup(spark, f"{brute.DATA}/sf0.01").collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.lines_kept(docs, 10))


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_lines_odd_rows(spark, none, min_docs):
    rng = random.Random(min_docs)
    pool = ["hot", " HOT ", "", " ", "x", "y", "z", "é", "É", "very hot"] + [f"l{i}" for i in range(30)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "hot\n" * 5000), (103, "\n")] + docs[:5]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id long, text string, pos int, h1 string").repartition(5)
    assert Counter(tuple(r) for r in line_dedup.kept_hashes(df, min_docs).collect()) == Counter(brute.lines_kept(dicts(docs), min_docs))
    assert line_dedup.kept_hashes(none, min_docs).count() == 0


def test_first_occurrences_stay(spark):
    rng = random.Random(8)
    pool = ["hot", "x", "y", ""] + [f"l{i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, want = set(), {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            k = brute.line_key(line)
            if not k or k not in seen:
                kept.append(line)
            seen.add(k)
        want[i] = "\n".join(kept)
    got = line_dedup.line_bitmaps(df, None, carry=("text",)).collect()
    assert {r["doc_id"]: line_dedup.kept_text(r["text"], r["keep"]) for r in got} == want


def test_bitmaps_round_trip():
    bits = line_dedup.pack_bits(21, np.array([0, 3, 20]))
    assert np.flatnonzero(~line_dedup.unpack_bits(bits, 21)).tolist() == [0, 3, 20]
    assert hashlib.sha256(line_dedup.kept_text("a\nb\nc", line_dedup.pack_bits(3, np.array([1]))).encode()).hexdigest() == hashlib.sha256(b"a\nc").hexdigest()


@pytest.mark.parametrize("kind,ids", [("double", [1.25, 1.75, 2.5]), ("string", ["01", "1", " 1"]), ("decimal(5,2)", [1, 1.5, 1.75]), ("boolean", [True, False, None]), ("string", ["a", "b", None]), ("int", [1, 2, None])])
def test_line_dedup_counts_ids_of_any_type(spark, kind, ids):
    rows = [(None if i is None else str(i), f"shared line\nown {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame([*rows, rows[0]], "i string, text string")
    df = df.select(F.col("i").cast(kind).alias("doc_id"), "text")
    got = line_dedup.kept_hashes(df, min_docs=3).collect()
    assert [(r["n_lines"], r["n_dropped"]) for r in got] == [(2, 1)] * 4
    assert all(r["n_dropped"] == 0 for r in line_dedup.kept_hashes(df, min_docs=4).collect())
