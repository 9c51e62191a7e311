"""What a task holds does not grow with the table."""

import pyarrow as pa

import __spark_entry__ as entry
from sparktrail import tasks_for
from sparktrail.functions import documents as doc
from sparktrail.sources import traces

SF = "/root/testdata/sf0.001"


def test_runs_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from sparktrail.plans import reports

    assert tasks_for(spark.range(10)) == 8 and tasks_for(spark.range(95), 10) == 10
    monkeypatch.setattr(reports, "tasks_for", lambda df, rows: tasks_for(df, 100))
    df = entry.queries()["mis_merge_run_sets"](spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert df.rdd.getNumPartitions() == -(-lines // 100)
    assert df.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()


def test_percentiles_are_not_kept_by_key(spark):
    plan = entry.queries()["agg_spread"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.splitlines() if "percentile(" in line]
    assert held and all("k#" not in line for line in held)


def test_no_task_gets_all_rows_of_a_group(spark):
    from sparktrail.operators import aggregates as agg

    rows = spark.range(40_000).selectExpr("id % 2 AS g", "CAST(id AS double) AS v")
    found = agg.index_percentile(rows, ["g"], "v", 0.95, cells=4)
    assert {r["g"]: r["value"] for r in found.collect()} == {0: 38000.0, 1: 38001.0}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_traces_are_taken_apart_in_pieces(monkeypatch):
    monkeypatch.setattr(traces, "PIECE", 10)
    texts = ["a" * 4, None, "b" * 7, "c" * 30, "", "d"]
    pieces = list(traces._pieces(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0))
    assert [p.column(0).to_pylist() for p in pieces] == [["a" * 4, None, "b" * 7], ["c" * 30], ["", "d"]]


def test_paths_are_dealt_by_the_documents(spark, monkeypatch):
    monkeypatch.setattr(doc, "tasks_for", lambda df: tasks_for(df, 5))
    df = spark.createDataFrame([(i, '{"a": [{"b": {"c": {"d": {"e": %d}}}}, {"b": 1}]}' % i) for i in range(50)], "i int, j string")
    found = doc.document_paths(df, "j", ["i"])
    assert found.rdd.getNumPartitions() == 10
    assert sorted(r["path"] for r in found.where("i = 7").collect()) == ["a", "a.b", "a.b.c", "a.b.c.d", "a.b.c.d.e"] and found.count() == 250


def test_decisions_of_a_comparison_are_made_once(spark, monkeypatch):
    from sparktrail.operators import joins

    made = spark.sparkContext.accumulator(0)
    rows = spark.range(20).selectExpr("id AS k", "'x' AS o")

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert joins.strict_compare(rows.mapInArrow(counted, rows.schema), rows, ["k"], "o").count() == 20
    assert made.value == 20
