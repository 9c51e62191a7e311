"""Text rules, program facts and the checker over cells with program text and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import cut_lineage
from ..checker import replay as chk
from ..functions import code as facts, text
from ..operators import existence
from ..sources.views import CELLS_SQL, cells, table
from .registry import query

SCHEMA = {"payments.csv": ["merchant", "year", "eur_amount", "day_of_year"], "fees.json": ["ID", "rate"], "merchant_data.json": ["merchant", "account_type"]}
#: Programs that the events stand for, by key.
CODE = (
    "import pandas as pd\ndf = pd.read_csv('data/payments.csv')",
    "print(df['merchant'].unique())",
    "print(df['amount'].sum())",
    "df['amount'] = df['eur_amount'] * 2\nprint(df['amount'].sum())",
    "import json\nfees = json.load(open('data/fees.json'))\nfor f in fees:\n    print(f['rates'])",
    "x = df.groupby('country')['eur_amount'].mean()",
    "out = df[df['year'] == 2023]\nout.to_csv('out.csv')",
    "final_answer('Not Applicable')",
    "if True:\n    print(df['none'])",
    "print(df.columns.tolist())",
    "def f(:\n    pass",
    "other = df.rename(columns={'year': 'y'})\nprint(other['year'])",
)
#: Outputs that the events stand for, by key.
OUTPUT = (
    "KeyError: 'amount'",
    "Traceback (most recent call last)\n  File x\nValueError: could not convert string to float: 'a'\n",
    "InterpreterError: Could not index  merchant year with 'country': KeyError: 'country'",
    "FileNotFoundError: [Errno 2] No such file or directory: '/mnt/data/fees.csv'",
    "Forbidden function evaluation: 'exec' is not among the explicitly allowed tools",
    "NameError: name 'df' is not defined",
    "IndentationError: unexpected indent",
    "Reached the max number of operations",
    "ValueError: Usecols do not match columns",
    "something else went wrong",
    "@total[12.5] and @name[abc] and @total[13]",
    "Duration: 3.5 s ... Duration 10 s",
)
#: Errors of tool calls that the events stand for, by key.
TOOL = (
    ("query_db", "sqlite", "no such column: x"),
    ("query_db", "postgres", "psycopg.errors.UndefinedTable: relation \"a\" does not exist"),
    ("query_db", "duckdb", "DuckDB Parser Error: syntax error at or near"),
    ("query_db", "mongo", "Invalid Mongo query: bad JSON"),
    ("query_db", "mongo", "Collection does not exist: things"),
    ("query_db", "duckdb", "No function matches the given name"),
    ("execute_python", None, "Execution failed with exit code 1\nKeyError: 'amount'"),
    ("execute_python", None, "Execution failed with exit code 1\nKeyError: 'var_call_1'"),
    ("execute_python", None, "Execution failed with exit code 124\n"),
    ("execute_python", None, "Execution failed with exit code 1\njson.decoder.JSONDecodeError: Expecting value"),
    ("execute_python", None, "Execution failed with exit code 1\nNameError: name 'var_x' is not defined"),
    ("list_db", None, "anything"),
)


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at % len(values) + 1)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    return rows.withColumns({"code": _pick(CODE, F.col("name")), "output": _pick(OUTPUT, F.col("name"))})


#: What the programs that fail would say, by their place in CODE.
SAYS = {2: "KeyError: 'amount'", 4: "KeyError: 'rates'", 5: "KeyError: 'country'", 10: "SyntaxError: invalid syntax", 11: "KeyError: 'year'"}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs with failures that fit them."""
    said = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in SAYS.items()])
    return programs(spark, sf_dir).withColumn("output", said).withColumn("failed", F.col("output").isNotNull())


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


_OUT = f"""outs AS (SELECT trace, idx, ({_sql_list(OUTPUT)})[name % {len(OUTPUT)} + 1] AS o FROM cells)"""


_GROUPS = ["sql:missing-column", "sql:missing-table", "sql:syntax", "mongo:query-json", "mongo:missing-collection", "sql:function", "py:data-key", "interface:var-key", "py:timeout", "py:JSONDecodeError", "interface:var-name", "other"]


@query(f"SELECT trace, idx, ({_sql_list(_GROUPS)})[name + 1] AS error_group, ({_sql_list([None, 'postgres', 'duckdb', 'mongo'] + [None] * 8)})[name + 1] AS engine FROM cells", CELLS_SQL)
def str_tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    tool, db, error = (_pick([t[i] for t in TOOL], F.col("name")) for i in range(3))
    return rows.select("trace", "idx", text.tool_error(tool, db, error).alias("error_group"), text.engine(error).alias("engine"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def str_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.nullif(F.regexp_extract(html, "<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"),
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"),
    )


@query(
    """SELECT trace, idx, CASE WHEN contains(o, '@total') THEN '13' END AS total, CASE WHEN contains(o, '@name') THEN 'abc' END AS name, CASE WHEN contains(o, 'Duration') THEN 13.5e0 END AS seconds FROM outs""",
    CELLS_SQL, _OUT,
)
def str_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("output")
    answers = text.answer_map(o)
    seconds = F.aggregate(text.durations(o), F.lit(0.0), lambda a, x: a + x)
    return programs(spark, sf_dir).select("trace", "idx", F.try_element_at(answers, F.lit("total")).alias("total"), F.try_element_at(answers, F.lit("name")).alias("name"), F.when(seconds > 0, seconds).alias("seconds"))




@query("SELECT status, count(*) AS n FROM (SELECT ['same', 'changed', 'outer_structure', 'inner_syntax'][name % 4 + 1] AS status FROM cells) GROUP BY 1", CELLS_SQL)
def cod_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a triple-quoted wrapper does to programs."""
    code = _pick(["x = 1", "print('a\\\\b')", 'x = 1\n"""; y = """', "x = 'a\\nb'"], F.col("name"))
    rows = cells(spark, sf_dir).select(code.alias("code"))
    known = rows.groupBy("code").agg(F.count("*").alias("n")).withColumn("w", facts.wrapper("code"))
    return known.groupBy("w.status").agg(F.sum("n").alias("n"))


@query(
    """SELECT path, CASE WHEN path IN ('.', 'file_storage', 'a.json', 'out/b.csv') THEN 'yes' WHEN path = '/tmp' THEN 'yes' WHEN path LIKE '/tmp/%' THEN 'no' WHEN path LIKE '/%' OR path LIKE '~%' THEN 'unknown' ELSE 'no' END AS there
    FROM (SELECT unnest(['.', 'file_storage', 'a.json', 'out/b.csv', '/tmp', '/tmp/x', '/etc/x', '~/x', 'c.csv']) AS path)"""
)
def prj_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ["/workspace", "./file_storage/", "/workspace/a.json", "out/../out/b.csv", "/tmp/", "/tmp/x", "/etc/x", "~/x", "c.csv"]
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in raw])).alias("raw"))
    path = existence.relative_to_workspace(existence.normal_path("raw"))
    known = existence.in_workspace(F.col("path"), F.array(F.lit("a.json")), F.array(F.lit("out/b.csv")), F.lit(False))
    return rows.select(path.alias("path")).select("path", F.when(known.isNull(), "unknown").when(known, "yes").otherwise("no").alias("there"))


@query(None)
def chk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checker's decision for every cell, with the state of the trace."""
    return chk.replay(judged(spark, sf_dir), SCHEMA).drop("ms")


@query(None)
def chk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many failures on data a block would have named, and how many blocks fall on cells that were fine."""
    rows = judged(spark, sf_dir)
    said = chk.replay(rows, SCHEMA).drop("failed")
    key = text.error_key("output")
    joined = rows.withColumn("key", key).join(said, ["trace", "idx"]).withColumn("cause", chk.cause_match("missing", "key")).withColumn("data_reference", F.col("key").isNotNull())
    return chk.scores(joined)


@query(None)
def chk_replay_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes: what each cell reads and writes, then decisions with the evidence of the other cells."""
    rows = judged(spark, sf_dir).withColumn("missing_path", text.missing_path(F.col("output")))
    # made once, as the reads and what was written are read from it for several joins
    first = cut_lineage(chk.replay(rows, SCHEMA).select("trace", "idx", "failed", "reads", "written"))
    return chk.replay(chk.file_evidence(rows, first), SCHEMA, existing="existing").drop("ms")


@query("SELECT outcome, count(*) AS cells, count(*) FILTER (failed) AS failed FROM (SELECT failed, CASE WHEN name IN (0, 3, 6, 7, 8, 9) THEN 'run' WHEN name = 10 THEN 'unknown' WHEN name IN (4) THEN 'block' ELSE 'run' END AS outcome FROM cells) GROUP BY 1", CELLS_SQL)
def chk_without_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell judged alone: only what a cell reads itself can be blocked."""
    said = chk.replay(programs(spark, sf_dir), SCHEMA, carry=False)
    return said.groupBy("outcome").agg(F.count("*").alias("cells"), F.count_if(F.col("failed")).alias("failed"))


@query(
    """SELECT old, new, count(*) AS cells FROM (SELECT CASE WHEN name = 4 THEN 'block' WHEN name = 10 THEN 'unknown' ELSE 'run' END AS old, CASE WHEN name = 10 THEN 'unknown' ELSE 'run' END AS new FROM cells) GROUP BY 1, 2""",
    CELLS_SQL,
)
def chk_compare_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under a strict and a tolerant profile, where missing keys are replaced silently."""
    from ..operators.joins import strict_compare

    rows = programs(spark, sf_dir)
    both = strict_compare(chk.replay(rows, SCHEMA, carry=False), chk.replay(rows, SCHEMA, carry=False, tolerant=True), ["trace", "idx"], "outcome")
    return both.groupBy("old", "new").agg(F.count("*").alias("cells"))


@query("SELECT path, count(*) AS asked, path IN ('k', 'tag') AS known FROM (SELECT unnest(['k', 'tag', 'deep.x', 'k']) AS path) GROUP BY 1")
def join_filter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that filters ask for, and whether the collection has them."""
    from ..functions import documents as doc

    filters = [{"k": 1}, {"tag": {"$ne": "x"}}, {"$or": [{"deep.x": 1}, {"k": {"$gt": 2}}]}]
    asked = spark.createDataFrame([p for f in filters for p in doc.filter_fields(f)], "path string, loose boolean")
    have = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("path")).distinct().union(spark.createDataFrame([("tag",)], "path string"))
    return asked.groupBy("path").agg(F.count("*").alias("asked")).join(have.withColumn("known", F.lit(True)), "path", "left").select("path", "asked", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT trace, idx, name FROM cells WHERE (trace, idx) IN (SELECT (trace, idx) FROM cells WHERE error_type = 'FileNotFoundError')", CELLS_SQL)
def join_two_pass_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells whose text is needed, named by a first pass."""
    rows = programs(spark, sf_dir)
    need = cells(spark, sf_dir).where("error_type = 'FileNotFoundError'").select("trace", "idx")
    return rows.join(need, ["trace", "idx"], "left_semi").select("trace", "idx", "name")


@query(
    """SELECT arm, count(*) AS calls, count(*) FILTER (syntax) AS syntax, count(*) FILTER (syntax AND arm = 'A') AS harness FROM (
        SELECT ['A', 'B', 'C'][trace % 3 + 1] AS arm, error_type = 'SyntaxError' AS syntax FROM cells WHERE failed) GROUP BY 1""",
    CELLS_SQL,
)
def mis_calls_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls by arm; only arm A unpacks its programs from a literal, so only there the harness can cause a syntax error."""
    arm = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("trace") % 3 + 1).cast("int"))
    rows = cells(spark, sf_dir).where("failed").select(arm.alias("arm"), (F.col("error_type") == "SyntaxError").alias("syntax"))
    return rows.groupBy("arm").agg(F.count("*").alias("calls"), F.count_if(F.col("syntax")).alias("syntax"), F.count_if(F.col("syntax") & (F.col("arm") == "A")).alias("harness"))


@query(
    """SELECT k.source, k.key, CASE WHEN EXISTS (SELECT 1 FROM known WHERE known.source = k.source AND known.name = k.key) THEN 'exists-in-main' WHEN k.key IN (SELECT name FROM known) THEN 'exists-elsewhere'
            WHEN lower(k.key) IN (SELECT lower(name) FROM known) THEN 'case-mismatch' WHEN bool_or(k.cut) THEN 'near-miss' ELSE 'absent' END AS class
        FROM (SELECT p_brand AS source, p_partkey % 5 = 3 AS cut, CASE p_partkey % 5 WHEN 2 THEN upper(p_name) WHEN 3 THEN left(p_name, 5) || substr(p_name, 7) WHEN 4 THEN repeat('#', 20) || p_type ELSE p_name END AS key FROM part) k GROUP BY 1, 2""",
    "known AS (SELECT p_brand AS source, p_name AS name FROM part WHERE p_partkey % 5 = 0 UNION SELECT 'other', p_name FROM part)",
)
def str_key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a missing key exists: in the main source, another, in other letters, nearly, or nowhere. Keys are the names of parts, some changed; the vocabulary is a table."""
    from ..operators import names

    k, name = F.col("p_partkey") % 5, F.col("p_name")
    parts = table(spark, sf_dir, "part")
    changed = F.when(k == 2, F.upper(name)).when(k == 3, F.concat(F.left(name, F.lit(5)), F.substring(name, 7, 1000))).when(k == 4, F.concat(F.lit("#" * 20), "p_type")).otherwise(name)
    known = parts.where(k == 0).select(F.col("p_brand").alias("source"), name.alias("name")).union(parts.select(F.lit("other"), name))
    return names.key_classes(parts.select(F.col("p_brand").alias("source"), changed.alias("key")), known)


@query(None)
def cod_miss_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the key that was missing stands in the program of the failed cell, given the programs before it."""
    from ..operators import runs

    rows = programs(spark, sf_dir).select("trace", "idx", "code", "failed", text.error_key("output").alias("key"), F.lit(None).cast("string").alias("error_type"))
    return runs.miss_classes(rows)


@query(
    """SELECT s.trace, s.idx, EXISTS (SELECT 1 FROM b WHERE b.trace = s.trace AND b.name = s.name AND b.idx < s.idx) AS reassigns,
        EXISTS (SELECT 1 FROM l WHERE l.trace = s.trace AND l.name = s.name AND l.idx > s.idx AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace = s.trace AND b.name = s.name AND b.idx > s.idx AND b.idx < l.idx)) AS name_error,
        EXISTS (SELECT 1 FROM b WHERE b.trace = s.trace AND b.name = s.name AND b.idx < s.idx)
            AND EXISTS (SELECT 1 FROM r WHERE r.trace = s.trace AND r.name = s.name AND r.idx > s.idx AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace = s.trace AND b.name = s.name AND b.idx > s.idx AND b.idx <= r.idx)) AS stale_read
    FROM s""",
    CELLS_SQL,
    "b AS (SELECT trace, idx, name FROM cells WHERE kind IN ('click', 'purchase'))",
    "r AS (SELECT trace, idx, (name + 1) % 12 AS name FROM cells WHERE NOT failed)",
    "s AS (SELECT trace, idx, name FROM cells WHERE failed AND error_type = 'KeyError')",
    "l AS (SELECT trace, idx, name FROM cells WHERE failed AND error_type = 'NameError')",
)
def win_stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a stopped cell would have set: set before, missed or read later. A cell sets the name of its number, and reads the next."""
    from ..operators import runs

    rows = cells(spark, sf_dir)
    sets = rows.where("kind in ('click', 'purchase')").select("trace", "idx", "name", F.lit(True).alias("bound"), F.lit(False).alias("read"))
    reads = rows.where("not failed").select("trace", "idx", ((F.col("name") + 1) % 12).alias("name"), F.lit(False).alias("bound"), F.lit(True).alias("read"))
    of = lambda kind: rows.where(f"failed and error_type = '{kind}'").select("trace", "idx", "name")
    return runs.stale_names(sets.union(reads), of("KeyError"), of("NameError"))
