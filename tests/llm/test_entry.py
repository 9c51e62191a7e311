"""The registered queries against SQL, and the pipeline against a plain version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparktrail.llm import queries
from sparktrail.llm.common import table

from ..oracle import connect, same
from . import brute

SMALL = f"{brute.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE[name])


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages_against_plain_versions(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = [r["doc_id"] for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == columns
            assert all(rows[r["doc_id"]] == r for r in docs.collect())
    assert len(kept["language_id"]) >= 0.97 * len(rows)
    ids = kept["language_id"]
    parts = brute.linked([brute.simhash(rows[i]["text"]) for i in ids], ids)
    assert sorted(kept["simhash_near_dedup"]) == sorted(set(parts))
    ids = kept["simhash_near_dedup"]
    bad = {r[0] for r in brute.contaminated([rows[i].asDict() for i in ids], brute.rows("sf0.001", "benchmark")) if r[-1]}
    assert sorted(kept["benchmark_decontamination"]) == sorted(set(ids) - bad) and bad
    assert sorted(kept["mixing"]) == sorted(kept["benchmark_decontamination"]) == sorted(kept["sharding"])


def test_the_mixed_stream_follows_the_weights(spark):
    docs = corpus_pipeline.mixing(spark, table(spark, f"{brute.DATA}/sf0.01", "documents"), SMALL)
    order = [r["source"] for r in docs.select("source").collect()]
    n = Counter(order)
    weight = {s: n[s] ** 0.5 / sum(k**0.5 for k in n.values()) for s in n}
    seen = Counter(order[:320])  # twenty blocks
    assert all(abs(seen[s] - 320 * weight[s]) <= 2 * 16 for s in n)


def test_different_texts_of_one_doc_id_are_different_documents(spark):
    words = "stone river lamp green under seven table wind paper north quick silver".split()
    texts = [" ".join(words), " ".join(reversed(words)), "an unlike text of the same id, with much else to say about boats"]
    leak = table(spark, SMALL, "benchmark").where("length(text) > 200").first()["text"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2]), (6, leak), (6, texts[1] + " " + texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a"))
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(set(rows) - {(5, texts[0])})
    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(r for r in rows if r[1] != leak)


def test_slots_are_in_the_mixed_order(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    slots = {}
    for name, weights in (("even", None), ("last", {docs.first()["source"]: 0.0})):
        mixed = corpus_pipeline.pfair_mix.in_mixed_order(docs, F.col("doc_id"), weights)
        mixed.write.parquet(str(tmp_path / name))
        want = {r["doc_id"]: i for i, r in enumerate(mixed.collect())}
        for frame in (mixed, spark.read.parquet(str(tmp_path / name))):
            got = corpus_pipeline.sharding(spark, frame, SMALL).collect()
            slots[name] = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
            for shard in {r["shard"] for r in got}:
                own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
                assert [r["slot"] for r in own] == list(range(len(own)))
                assert [want[r["doc_id"]] for r in own] == sorted(want[r["doc_id"]] for r in own)
    assert slots["even"] != slots["last"]


def test_stages_keep_rows_with_odd_ids(spark):
    rows = [(None, "the same words are here again and again", "en", "a", 1, "x"), (None, "the same words are here again and again", "en", "a", 1, "x"), (7, None, None, None, None, None), (8, "", "en", "a", 0, "y"), (9, "quite other words stand in this one text", "en", None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string").withColumn("score", F.lit(1)).withColumn("rejected", F.lit("no")).withColumn("pos", F.lit(2)).withColumn("term", F.lit("t"))
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == Counter([None, 7, 9])
    assert corpus_pipeline.decontamination(spark, docs, SMALL).count() == corpus_pipeline.mixing(spark, docs, SMALL).count() == corpus_pipeline.sharding(spark, docs, SMALL).count() == 5
    assert corpus_pipeline.language_id(spark, docs, SMALL).count() <= 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
