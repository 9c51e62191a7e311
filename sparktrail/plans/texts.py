"""Rules of text and documents over written forms of the tables: each row is written as the text that a log would hold, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import documents as doc, text
from ..sources.views import CELLS_SQL, cells, table
from .registry import query


@query(
    """SELECT trace, count(*) AS cells, sum(length(code)) AS chars, count(*) FILTER (output LIKE 'failed%') AS failed FROM (
        SELECT trace, 'x' || idx || ' = ' || name || chr(10) || 'print(x' || idx || ')' AS code, CASE WHEN failed THEN 'failed: ' || error_type ELSE 'ok ' || kind END AS output FROM cells) GROUP BY 1""",
    CELLS_SQL,
)
def str_xml_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace written as one text of <Code> and <Execute> pairs, and taken apart again. A trace is a run of some tens of cells."""
    code = F.concat(F.lit("x"), "idx", F.lit(" = "), "name", F.lit("\nprint(x"), "idx", F.lit(")"))
    output = F.when(F.col("failed"), F.concat(F.lit("failed: "), "error_type")).otherwise(F.concat(F.lit("ok "), "kind"))
    step = F.concat(F.lit("thought <Code>"), code, F.lit("</Code>\n<Execute>"), output, F.lit("</Execute>\n"))
    traces = cells(spark, sf_dir).groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", step.alias("step")))), lambda s: s["step"]), "").alias("text"))
    read = traces.select("trace", F.explode(text.xml_cells(F.col("text"))).alias("c"))
    return read.groupBy("trace").agg(F.count("*").alias("cells"), F.sum(F.length("c.code")).alias("chars"), F.count_if(F.startswith(F.col("c.output"), F.lit("failed"))).alias("failed"))


@query(
    """SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS fm1, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS fm2, NULL::VARCHAR AS fm3, CASE WHEN toxic = 1 THEN 'BLOCK' ELSE 'RUN' END AS verdict FROM labels"""
)
def str_judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's reply of several lines, read back."""
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("NO")
    reply = F.concat(F.lit("I looked at it.\nFM1: "), yes("quality"), F.lit("\nfm2 "), yes("toxic"), F.lit("\nSo I would "), F.when(F.col("toxic") == 1, "block").otherwise("Run"), F.lit(" it."))
    said = table(spark, sf_dir, "labels").select("doc_id", reply.alias("r"))
    return said.select("doc_id", *[text.judge_label(F.col("r"), n).alias(f"fm{n}") for n in (1, 2, 3)], text.verdict(F.col("r")).alias("verdict"))


@query(
    r"""SELECT CASE WHEN path IS NULL THEN 'unparsed' WHEN path LIKE '/mnt/data%' THEN '/mnt/data' WHEN path LIKE '/%' THEN 'absolute' ELSE 'relative' END AS class, count(*) AS pages FROM (
        SELECT CASE page_id % 4 WHEN 0 THEN '/mnt/data' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) WHEN 2 THEN substr(url, 9) END AS path FROM pages) GROUP BY 1"""
)
def str_path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that an error names, by where they lie."""
    k, path = F.col("page_id") % 4, F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    named = F.when(k == 0, F.concat(F.lit("/mnt/data"), path)).when(k == 1, path).when(k == 2, F.substring("url", 9, 1_000_000))
    message = F.when(named.isNotNull(), F.concat(F.lit("FileNotFoundError: [Errno 2] No such file or directory: '"), named, F.lit("'"))).otherwise("FileNotFoundError: gone")
    read = F.nullif(F.regexp_extract(message, "directory: '([^']*)'", 1), F.lit(""))
    return table(spark, sf_dir, "pages").groupBy(text.path_class(read).alias("class")).agg(F.count("*").alias("pages"))


@query(
    """SELECT path, count(*) AS asked, CASE WHEN path = 'lines.0.n' THEN NULL ELSE path NOT IN ('status', 'order.status', 'lines.n') END AS missing FROM (
        SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN ['status', 'zone.' || o_orderstatus] WHEN 1 THEN ['order.status', 'lines.0.n'] ELSE ['lines.n'] END) AS path FROM orders) GROUP BY 1"""
)
def doc_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that projections ask for, and whether a collection has none of the name; places in lists can't be told."""
    k = F.col("o_orderkey") % 3
    asked = F.when(k == 0, F.concat(F.lit('{"_id": 0, "status": 1, "zone.'), "o_orderstatus", F.lit('": 1}'))).when(k == 1, '{"order.status": 1, "lines.0.n": 1, "$slice": 2}').otherwise('{"lines.n": true}')
    fields = table(spark, sf_dir, "orders").select(F.explode(doc.projected_fields(asked)).alias("path"))
    known = F.array(*map(F.lit, ["status", "order.status", "lines.n"]))
    return fields.groupBy("path").agg(F.count("*").alias("asked")).withColumn("missing", doc.field_missing(F.col("path"), known))


@query(
    """SELECT o_orderkey, ['key', 'status'] AS keys, 'No "' || o_orderstatus || '" here' AS said FROM orders"""
)
def doc_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the first record of a list that a log has cut, and a message that was cut inside its quotes."""
    row = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    cut = F.concat(F.lit("["), row, F.lit(", "), F.left(row, F.lit(9)))
    message = F.concat(F.lit('"No \\"'), "o_orderstatus", F.lit('\\" here'), F.when(F.col("o_orderkey") % 2 == 0, '"').otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.first_record_keys(cut).alias("keys"), doc.preview_text(message).alias("said"))
