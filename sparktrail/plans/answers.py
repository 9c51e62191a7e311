"""Scores of answers, gold labels, paths of documents and of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers as ans, documents as doc
from ..operators import existence
from ..sources.views import CELLS_SQL, cells, table
from .registry import query

_SAID = """said AS (SELECT o_orderkey, round(o_totalprice, 0) AS truth, CASE o_orderkey % 5 WHEN 0 THEN 'about ' || CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) || ' EUR' WHEN 1 THEN CAST(CAST(round(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR) || '%'
    WHEN 2 THEN 'none' WHEN 3 THEN CAST(CAST(round(o_totalprice * 2, 0) AS BIGINT) AS VARCHAR) END AS answer FROM orders)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    answer = F.when(k == 0, F.concat(F.lit("about "), whole(price), F.lit(" EUR"))).when(k == 1, F.concat(whole(price * 100), F.lit("%"))).when(k == 2, "none").when(k == 3, whole(price * 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(price, 0).alias("truth"), answer.alias("answer"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS correct FROM said", _SAID)
def prj_numeric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read out of free text, right within 3 %."""
    return _said(spark, sf_dir).select("o_orderkey", ans.close(ans.number(F.col("answer")), F.col("truth")).alias("correct"))


@query("SELECT o_orderkey, lower(o_orderpriority) LIKE lower(left(o_orderpriority, 1)) || '%' AS choice, o_orderkey % 2 = 0 AS closed FROM orders")
def prj_choice_and_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    shifted = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1e-8).otherwise(F.col("o_totalprice") + 1)
    return o.select("o_orderkey", ans.same_choice(F.upper(p), F.left(p, F.lit(1))).alias("choice"), ans.same_closed_form(shifted.cast("string"), F.col("o_totalprice").cast("string")).alias("closed"))


@query("SELECT l.doc_id, l.quality, d.lang FROM (SELECT doc_id, 'qr-' || doc_id AS key, quality FROM labels) l JOIN (SELECT 'qr-' || doc_id AS key, lang FROM documents) d USING (key)")
def join_gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with gold labels by a key made of a prefix and a number: the join is on the number."""
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality")
    made = table(spark, sf_dir, "documents").select(F.concat(F.lit("qr-"), F.col("doc_id")).alias("key"), "lang")
    by_number = made.withColumn("doc_id", F.regexp_extract("key", r"^qr-(\d+)$", 1).cast("long"))
    return gold.join(by_number, "doc_id").select("doc_id", "quality", "lang")


@query("SELECT trace, idx, CASE WHEN name = 1 THEN 'printed' WHEN name = 2 THEN 'literal' ELSE 'none' END AS source FROM cells WHERE kind = 'purchase'", CELLS_SQL)
def str_answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).where("kind = 'purchase'").select("trace", "idx", F.lit("42").alias("answer"), F.when(F.col("name") == 2, "x = '42'").otherwise("x = 1").alias("code"), F.when(F.col("name") == 1, "a\n 42 \n").otherwise("420").alias("printed"))
    distinct = rows.select("answer", "code", "printed").distinct().withColumn("source", ans.evidence("answer", "code", "printed"))
    return rows.join(distinct, ["answer", "code", "printed"]).select("trace", "idx", "source")


#: The document of an order, nested at three depths; of even orders, what is null is written as null, of odd ones it is left out.
_NESTED_SQL = """nested AS (
    SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority,
        count(l_orderkey) AS n, list(l_linenumber) FILTER (l_orderkey IS NOT NULL) AS numbers, list(l_returnflag) FILTER (l_orderkey IS NOT NULL) AS flags, list(l_tax) FILTER (l_orderkey IS NOT NULL) AS taxes
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and its document as JSON text: an order with its lines, of which there are a few each."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.struct(F.col("l_returnflag").alias("flag")).alias("back"), F.col("l_tax").alias("tax")).alias("ship"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    k = F.col("o_orderkey")
    order = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("priority"))
    rows = table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey"), "left")
    doc_ = F.struct(k.alias("key"), order.alias("order"), (k % 2 == 0).alias("even"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    return rows.select("o_orderkey", F.when(k % 2 == 0, F.to_json(doc_, {"ignoreNullFields": "false"})).otherwise(F.to_json(doc_)).alias("d"))


@query(
    """SELECT path, count(*) AS documents FROM (
        SELECT unnest(['key', 'order', 'order.status', 'order.price', 'even', 'lines'] || CASE WHEN even OR priority IS NOT NULL THEN ['order.priority'] ELSE [] END
            || CASE WHEN n > 0 THEN ['lines.n', 'lines.ship', 'lines.ship.back', 'lines.ship.back.flag', 'lines.ship.tax'] ELSE [] END) AS path FROM nested) GROUP BY 1""",
    _NESTED_SQL,
)
def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dotted paths of the documents of a collection, and how many documents have each."""
    return doc.document_paths(nested(spark, sf_dir), "d", ["o_orderkey"]).groupBy("path").agg(F.count("*").alias("documents"))


#: Filters over the nested documents, and the same in SQL.
_NESTED_FILTERS = {
    '{"lines.n": {"$gte": 7}}': "len(list_filter(numbers, lambda x: x >= 7)) > 0",
    '{"lines.ship.back.flag": "R", "order.status": {"$ne": "F"}}': "list_contains(flags, 'R') AND status <> 'F'",
    '{"lines.ship.back.flag": {"$nin": ["R", "A"]}}': "NOT coalesce(list_has_any(flags, ['R', 'A']), false)",
    '{"order.priority": null}': "priority IS NULL",
    '{"order.priority": {"$exists": true}}': "even OR priority IS NOT NULL",
    '{"order.priority": {"$regex": "^[12]-u", "$options": "i"}}': "regexp_matches(coalesce(priority, ''), '^[12]-[uU]')",
    '{"even": 1}': "false",
    '{"even": true, "key": {"$lt": 1000.5}}': "even AND k < 1000.5",
    '{"key": {"$gt": "a"}}': "false",
    '{"$or": [{"order.status": "P"}, {"lines.ship.tax": {"$lte": 0}}]}': "status = 'P' OR coalesce(list_min(taxes) <= 0, false)",
    '{"$nor": [{"order.status": {"$in": ["F", "P"]}}, {"lines": []}]}': "status NOT IN ('F', 'P') AND n > 0",
    '{"lines.0.n": {"$exists": false}}': "true",
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS filter, count(*) FILTER ({s}) AS n, count(*) FILTER ({s}) > 5 AS cut FROM nested" for t, s in _NESTED_FILTERS.items()) + """ UNION ALL SELECT '{"$where": "x"}', NULL, NULL""", _NESTED_SQL)
def doc_nested_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of several filters over nested documents without a schema, in one pass."""
    return doc.match_counts(nested(spark, sf_dir), [*_NESTED_FILTERS, '{"$where": "x"}'], "d")


@query("SELECT k AS o_orderkey FROM nested WHERE list_contains(flags, 'N') AND (priority IS NULL OR price > 200000)", _NESTED_SQL)
def doc_nested_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = doc.matches({"lines.ship.back.flag": "N", "$or": [{"order.priority": None}, {"order.price": {"$gt": 200000}}]})
    return nested(spark, sf_dir).where(test(F.col("d"))).select("o_orderkey")


@query(
    """SELECT c_nationkey AS folder, p, CASE WHEN p = '/data/x' THEN 'unknown' WHEN p IN ('/', '/data') THEN 'yes' ELSE 'no' END AS mounts, CASE WHEN p = '/data/x' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'unknown' ELSE 'yes' END WHEN p = '/etc' THEN 'yes' ELSE 'no' END AS lake
    FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest(['/', '/data', '/data/x', '/etc']) AS p)"""
)
def prj_mounts_and_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence of paths from a mount table, and from a lake with hidden parts and a listing."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder")).distinct().select("folder", F.explode(F.array(*map(F.lit, ["/", "/data", "/data/x", "/etc"]))).alias("p"))
    said = lambda c: F.when(c.isNull(), "unknown").when(c, "yes").otherwise("no")
    lake = existence.in_lake(F.col("p"), "/data", F.array(F.lit("/data/x")), F.array(F.lit("/etc")), F.col("folder") % 2 == 0)
    return rows.select("folder", "p", said(existence.under_mounts(F.col("p"), ["/data"])).alias("mounts"), said(lake).alias("lake"))


@query("SELECT c_mktsegment AS domain, c_custkey AS task, q FROM customer, (VALUES (1), (2)) t(q)")
def mis_task_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with nested questions, as one JSON text a domain, flattened again."""
    c = table(spark, sf_dir, "customer")
    nested = c.groupBy(F.col("c_mktsegment").alias("domain")).agg(F.to_json(F.collect_list(F.struct(F.col("c_custkey").alias("task"), F.array(F.lit(1), F.lit(2)).alias("questions")))).alias("j"))
    tasks = nested.select("domain", F.explode(F.from_json("j", "array<struct<task:long,questions:array<int>>>")).alias("t"))
    return tasks.select("domain", "t.task", F.explode("t.questions").alias("q"))
