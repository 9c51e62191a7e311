import json
import os
import time
from types import SimpleNamespace as Stub

import pytest
from pyspark.sql import functions as F

from sparktrail.sources import files
from sparktrail.streaming import folds


def test_lines_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"arm": "x", "query": 1}\n\nnot json\n{"arm": "y", "query": 2}\n')
    path = str(tmp_path / "a.jsonl")
    assert [(r["line"], r["text"][:3]) for r in files.numbered_lines(spark, path).orderBy("line").collect()] == [(1, '{"a'), (3, "not"), (4, '{"a')]
    good, bad = files.tolerant_records(spark, path, "arm string, query int")
    assert [(r["arm"], r["query"]) for r in good.collect()] == [("x", 1), ("y", 2)] and bad.first()["bad_lines"] == 1
    assert files.records(spark, path, files.RUN).where("arm is not null").count() == 2
    assert files.first_lines(files.numbered_lines(spark, path), 1).count() == 1


def test_run_keys(spark):
    df = spark.createDataFrame([("file:/x/results-gpt5.1/query_yelp/q3/a/run_2/tool_calls.jsonl",), ("file:/x/results-m/d/q/last/tool_calls.jsonl",), ("file:/x/other.jsonl",)], "file string")
    got = [tuple(r[1:]) for r in files.run_keys(df).collect()]
    assert got == [("gpt-5.1", "yelp", "q3", "run_2"), ("m", "d", "q", "last")]


def test_headers_and_schemas(spark, tmp_path):
    assert files.header(b",a,a\n1,2,3\n") == ["", "Unnamed: 0", "a", "a.1"]
    assert "x" in files.header(b"\n\nx,y\n1,2\n") and files.header(b"\xff\xfe\x00") is None
    assert files.record_keys(b'[{"a": 1}, {"b": 2}]') == ["a", "b"] and files.record_keys(b"[]") is None and files.record_keys(b"{") is None
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "s.csv").write_text("p,q\n1,2\n")
    (tmp_path / "one" / "t.json").write_text(json.dumps([{"k": 1}]))
    (tmp_path / "one" / "twice.csv").write_text("a\n")
    (tmp_path / "two" / "twice.csv").write_text("b\n")
    got = {r["name"]: r["columns"] for r in files.source_schemas(spark, str(tmp_path)).collect()}
    assert got == {"s.csv": ["p", "q"], "t.json": ["k"]}
    m = files.manifest(spark, str(tmp_path / "one" / "*")).collect()
    assert len(m) == 3 and all(len(r["sha256"]) == 64 for r in m)
    (tmp_path / "one" / "p.bin").write_text("version https://git-lfs.github.com/spec/v1\noid x\n")
    with pytest.raises(ValueError):
        files.manifest(spark, str(tmp_path / "one" / "*"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    files.write_records(df, str(tmp_path / "j"))
    files.write_table(df, str(tmp_path / "c"))
    assert spark.read.schema("x int, y string").json(str(tmp_path / "j")).count() == 2
    assert json.loads(files.summary(df).first()[0]) == [{"x": 1, "y": "a"}, {"x": 2}]
    assert [r[0] for r in files.report(df, {"x": 3, "y": 4}).collect()] == ["1   a", "2   -"]
    names = spark.createDataFrame([("d", f"f{i:02}") for i in range(25)], "dir string, name string")
    assert files.listing(names, "dir", "name").first()["listing"].endswith("f19 (25 in all)")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "trace long, idx long, kind string, failed boolean, ts timestamp"
    row = lambda t, i, f: json.dumps({"trace": t, "idx": i, "kind": "cell", "failed": f, "ts": f"2024-01-01T00:{i:02}:00"})
    (source / "0.json").write_text("\n".join([row(1, 1, True), row(1, 2, True), row(2, 1, False)]))
    (source / "1.json").write_text("\n".join([row(1, 3, True), row(1, 2, True), row(2, 2, True)]))

    for k in (0, 1):  # files are taken in order of their times
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(folds.once_by_key(folds.arriving(spark, str(source), schema), ["trace", "idx"]), "once", "append").count() == 5
    by = run(folds.failures_by_window(folds.arriving(spark, str(source), schema)), "by", "complete")
    assert [(r["cells"], r["failed"]) for r in by.collect()] == [(6, 5)]
    costs = spark.createDataFrame([(i, 4.0) for i in range(6)], "i int, cost double")
    assert sorted((r["i"], r["spent"]) for r in folds.until_budget(costs, "i", "cost", 10.0).collect()) == [(0, 0.0), (1, 4.0), (2, 8.0)]
    ledger = [(i, float(i % 7) if i % 5 else None) for i in range(900)]
    many = spark.createDataFrame(ledger, "i int, cost double").repartition(7)
    before = [0.0]
    for _, cost in ledger:
        before.append(before[-1] + (cost or 0.0))
    for cap in (-1.0, 0.5, 700.0, 1e9):
        got = folds.until_budget(many, "i", "cost", cap, ranges=13).collect()
        assert sorted((r["i"], r["spent"]) for r in got) == [(i, before[i]) for i in range(900) if before[i] < cap]


def test_state_of_traces_over_restarts_and_time(spark, tmp_path):
    """A cell that is late, a stop between files, a trace that goes quiet."""
    source = tmp_path / "in"
    source.mkdir()
    schema = "trace long, idx long, failed boolean"

    def put(k, *cells):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"trace": t, "idx": i, "failed": f}) for t, i, f in cells))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))

    def run(idle=0):
        said = folds.failure_chains(folds.arriving(spark, str(source), schema, 1), idle)
        q = said.writeStream.format("parquet").option("path", str(tmp_path / f"out{idle}")).option("checkpointLocation", str(tmp_path / f"state{idle}")).trigger(**({"once": True} if idle else {"availableNow": True})).start()
        assert q.awaitTermination(60)  # with timers, "available now" would wait for more of them
        return sorted(tuple(r) for r in spark.read.schema(folds.CHAIN_ROW).parquet(str(tmp_path / f"out{idle}")).collect())

    put(0, (1, 1, True), (1, 2, True), (2, 1, False))
    first = run()
    assert first == [(1, 1, 1, False), (1, 2, 2, False), (2, 1, 0, False)]
    put(1, (1, 2, True), (1, 4, False), (1, 3, True), (2, 2, True))  # a late cell, and some out of order
    assert run() == sorted([*first, (1, 3, 3, False), (1, 4, 0, False), (2, 2, 1, False)])  # goes on from the checkpoint
    assert run() == run()
    run(1)
    time.sleep(0.2)
    put(2, (3, 1, True))
    ended = [r for r in run(1) if r[3]]
    assert (1, 4, 0, True) in ended and (2, 2, 1, True) in ended
    put(3, (2, 3, True))
    time.sleep(0.2)
    assert (2, 3, 1, False) in run(1)  # the state was gone: the chain begins anew


def test_memo_is_extended_and_counts_nothing_twice(spark, tmp_path):
    docs = spark.createDataFrame([(json.dumps({"a": i % 5, "b": [i % 3]}),) for i in range(60)], "d string")
    frame = lambda *f: spark.createDataFrame([(x,) for x in f], "filter string")
    path, seen = str(tmp_path / "memo"), []
    texts = [json.dumps({"a": i}) for i in range(5)] + ['{"b": 1}', '{"$where": 1}']
    assert folds.counted_once(docs, "d", frame(*texts), path, seconds=0).count() == 0  # no time: nothing is begun
    for part in ([texts[0], texts[0], None], texts[:4], texts, texts):
        got = {r["filter"]: r["n"] for r in folds.counted_once(docs, "d", frame(*part), path, per_batch=2).collect()}
        seen.append(sorted(os.listdir(path)))
        assert folds.memo(spark, path).count() == len(got)
    assert got == dict.fromkeys(texts[:5], 12) | {'{"b": 1}': 20, '{"$where": 1}': None}
    assert len(seen[0]) == 1 and set(seen[1]) > set(seen[0]) and seen[2] == seen[3]
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text(json.dumps({"filter": '{"a": {"$gt": 2}}'}) + "\n" + json.dumps({"filter": texts[0]}))
    for _ in range(2):
        folds.counted_as_they_arrive(folds.arriving(spark, str(source), "filter string"), docs, "d", path, str(tmp_path / "state")).awaitTermination(120)
    assert folds.memo(spark, path).count() == 8 and folds.memo(spark, path).where("filter like '%$gt%'").first()["n"] == 24


def test_settled_streams_need_a_shared_folder_on_a_cluster(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "t"))
    assert {r["id"] for r in folds.settled(rows).collect()} == set(range(5))
    on_cluster = Stub(conf=Stub(get=lambda name, other: other), sparkContext=Stub(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folds.settled(Stub(sparkSession=on_cluster))


def test_log_gets_each_key_once_also_over_restarts(spark, tmp_path):
    path, state, source = str(tmp_path / "log"), str(tmp_path / "state"), tmp_path / "in"
    source.mkdir()
    schema = "k string, n int"

    def arrive(name, *rows):
        (source / name).write_text("".join(json.dumps({"k": k, "n": n}) + "\n" for k, n in rows))
        stream = folds.arriving(spark, str(source), schema, 1)
        folds.appended_once(stream, ["k"], ["n"], path, state).awaitTermination()
        return sorted((r["k"] or "", r["n"], r["batch"]) for r in folds.appended(spark, path, stream.schema).collect())

    assert folds.appended(spark, path, spark.createDataFrame([], schema).schema) is None
    one = arrive("a.json", ("x", 3), ("x", 1), (None, 4), ("y", 2))
    assert one == [("", 4, 0), ("x", 1, 0), ("y", 2, 0)]
    assert arrive("b.json", ("x", 0), ("z", 9), (None, 1), ("z", 8)) == [*one, ("z", 8, 1)]
    # the second batch was written, but its end was not recorded: it is done again, in its place
    (tmp_path / "state" / "commits" / "1").unlink()
    crc = tmp_path / "state" / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    assert arrive("c.json", ("y", 1), ("w", 1)) == [*one[:1], ("w", 1, 2), *one[1:], ("z", 8, 1)]
