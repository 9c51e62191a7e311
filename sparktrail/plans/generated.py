"""Queries over programs and messages that are made anew for each cell, with SQL that says what each must give.

A message or a program is put together from parts chosen by the cell's numbers,
with names of its own. The SQL knows what each part means, and the rule by which
parts add up, but none of the patterns with which the operators find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..checker import replay as chk
from ..functions import code as facts, statistics as st, text
from ..operators import joins
from ..sources import files
from ..sources.views import CELLS_SQL, cells, table
from .registry import query
from .studies import _wilson_sql

#: What a failed cell says, by name; @k is a key of the cell's own, @pad some letters.
MESSAGES = (
    "KeyError: '@k'",
    "InterpreterError: @pad Could not index frame with '@k': KeyError: '@k'",
    "InterpreterError: Could not index the thing; KeyError: '@k'",
    "Import of os.@k is not allowed",
    "Reached the max number of operations in @k",
    "IndentationError: unexpected indent",
    "ValueError: Usecols do not match columns ['@k']",
    "The variable `@k` is not defined",
    "InterpreterError: 'X' object has no attribute '@k'",
    "KeyError: 17",
    "[Errno 2] No such file or directory: '/mnt/data/@k.csv'",
    "something else went wrong with @k",
)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_KEY = "'c' || (trace * 31 + idx) % 97"
_SAID_SQL = f"""said AS (SELECT *, replace(replace(([{', '.join(map(_sql_text, MESSAGES))}])[name + 1], '@k', k), '@pad', repeat('x', pad)) AS o
    FROM (SELECT *, {_KEY} AS k, CAST(idx * 7 % 260 AS INT) AS pad FROM cells))"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    key = F.concat(F.lit("c"), (F.col("trace") * 31 + F.col("idx")) % 97)
    return rows.withColumn("k", key).withColumn("pad", (F.col("idx") * 7 % 260).cast("int"))


def _filled(parts, at: Column) -> Column:
    part = F.element_at(F.array(*map(F.lit, parts)), (at + 1).cast("int"))
    return F.replace(F.replace(part, F.lit("@k"), F.col("k")), F.lit("@pad"), F.repeat(F.lit("x"), F.col("pad")))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).withColumn("output", _filled(MESSAGES, F.col("name")))


@query(
    """SELECT trace, idx, CASE name WHEN 0 THEN 'KeyError' WHEN 1 THEN (CASE WHEN pad + 34 <= 200 THEN 'index-error(wrapped)' ELSE 'KeyError(wrapped)' END) WHEN 2 THEN 'KeyError(wrapped)' WHEN 3 THEN 'executor:forbidden'
        WHEN 4 THEN 'executor:budget' WHEN 5 THEN 'SyntaxError' WHEN 6 THEN 'ValueError:usecols' WHEN 7 THEN 'NameError' WHEN 8 THEN 'AttributeError' WHEN 9 THEN 'KeyError' WHEN 10 THEN 'FileNotFoundError' ELSE 'other' END AS error_type,
        CASE WHEN name <= 2 THEN k END AS error_key FROM said""",
    CELLS_SQL, _SAID_SQL,
)
def str_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the key of each message. A failed look-up is one only if its phrase ends within 200 characters and a key follows."""
    return said(spark, sf_dir).select("trace", "idx", text.error_type("output").alias("error_type"), text.error_key("output").alias("error_key"))


@query(
    """SELECT trace, idx, CASE WHEN name = 10 THEN '/mnt/data/' || k || '.csv' END AS path, CASE WHEN name = 7 THEN k END AS name_, CASE WHEN name IN (0, 2, 5, 6, 8, 9) OR (name = 1 AND length(o) - 18 <= 300) THEN o END AS last_line FROM said""",
    CELLS_SQL, _SAID_SQL,
)
def str_error_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("output")
    return said(spark, sf_dir).select("trace", "idx", text.missing_path(o).alias("path"), text.undefined_name(o).alias("name_"), text.last_error_line(o).alias("last_line"))


#: Parts of programs: text, does it look at structure, does it do no work, its writes, does it answer with a constant, does it call anything else, is it a program?
PARTS = (
    ("import pandas as pd\ndf = pd.read_csv('data/@k.csv')", 0, 1, 0, 0, 1, 1),
    ("print(df['@k'].unique())", 1, 1, 0, 0, 1, 1),
    ("print(df['@k'].sum())", 0, 1, 0, 0, 1, 1),
    ("df['@k'] = df['a'] * 2", 0, 0, 0, 0, 0, 1),
    ("for c in df.columns:\n    print(c)", 1, 1, 0, 0, 1, 1),
    ("x = df.groupby('@k')['a'].mean()", 0, 0, 0, 0, 1, 1),
    ("out = df[df['@k'] == 3]\nout.to_csv('@k.csv')", 0, 0, 1, 0, 1, 1),
    ("final_answer('@k')", 0, 0, 0, 1, 0, 1),
    ("print(df.@k.value_counts())", 0, 1, 0, 0, 1, 1),
    ("import os\nprint(os.listdir('/@k'))", 1, 1, 0, 0, 1, 1),
    ("open('@k', 'w').write('x')", 0, 0, 1, 0, 1, 1),
    ("with open('@k') as f:\n    d = f.read()\nlist(d.keys())", 1, 1, 0, 0, 1, 1),
    ("shape = df.shape", 1, 1, 0, 0, 0, 1),
    ("def f(:", 0, 0, 0, 0, 0, 0),
)
_PARTS_SQL = "parts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(str, p[1:]))})" for i, p in enumerate(PARTS)) + ") AS t(part, looks, quiet, writes, answers, calls, valid))"


@query(
    """SELECT trace, idx, a.valid * b.valid = 1 AS compiles, CASE WHEN a.valid * b.valid = 1 THEN a.writes + b.writes ELSE 0 END AS writes,
        a.valid * b.valid = 1 AND a.looks + b.looks > 0 AND a.quiet * b.quiet = 1 AS inspects, a.valid * b.valid = 1 AND a.answers + b.answers > 0 AND a.calls + b.calls = 0 AS gave_up
    FROM cells JOIN parts a ON a.part = name JOIN parts b ON b.part = (trace + idx) % 14""",
    CELLS_SQL, _PARTS_SQL,
)
def cod_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of programs of two parts; equal programs are parsed once and joined back."""
    rows = _made(spark, sf_dir)
    code = F.concat(_filled([p[0] for p in PARTS], F.col("name")), F.lit("\n"), _filled([p[0] for p in PARTS], (F.col("trace") + F.col("idx")) % len(PARTS)))
    rows = rows.select("trace", "idx", code.alias("code"))
    known = rows.select("code").distinct().withColumn("f", facts.facts("code"))
    return rows.join(known, "code").select("trace", "idx", "f.compiles", "f.writes", "f.inspects", "f.gave_up")


_FIX_SQL = """steps AS (SELECT trace, idx, failed, a.valid * b.valid = 1 AND a.looks + b.looks > 0 AND a.quiet * b.quiet = 1 AS inspects FROM cells JOIN parts a ON a.part = name JOIN parts b ON b.part = (trace + idx) % 14)"""


@query(
    """SELECT s.trace, s.idx, min(n.idx) FILTER (NOT n.failed AND NOT n.inspects) - s.idx AS k_fix, min(n.idx) FILTER (NOT n.failed) - s.idx AS k_success
    FROM steps s LEFT JOIN steps n ON n.trace = s.trace AND n.idx > s.idx WHERE s.failed GROUP BY s.trace, s.idx""",
    CELLS_SQL, _PARTS_SQL, _FIX_SQL,
)
def win_fix_by_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each failure to the next success, and to the next that does more than look, as its program says."""
    from pyspark.sql import Window as W

    steps = cod_facts(spark, sf_dir).join(cells(spark, sf_dir).select("trace", "idx", "failed"), ["trace", "idx"])
    later = W.partitionBy("trace").orderBy("idx").rowsBetween(1, W.unboundedFollowing)
    first = lambda ok: F.first(F.when(ok, F.col("idx")), ignorenulls=True).over(later) - F.col("idx")
    rows = steps.withColumns({"k_fix": first(~F.col("failed") & ~F.col("inspects")), "k_success": first(~F.col("failed"))})
    return rows.where("failed").select("trace", "idx", "k_fix", "k_success")


#: Comparisons of a column with a literal, and how many pairs each holds.
FILTERS = ("df[df['@k'] == 'v1']", "df[df.@k == \"v2\"]", "df[df['@k'].isin(['v1', 'v3', \"v4\"])]", "df.query('@k == \"v5\"')", "df.query(\"a > 2 and @k == 'v6'\")", "df[df['@k'] > 3]")


@query(
    """SELECT trace, idx, k AS "column", unnest(CASE name % 6 WHEN 0 THEN ['v1'] WHEN 1 THEN ['v2'] WHEN 2 THEN ['v1', 'v3', 'v4'] WHEN 3 THEN ['v5'] WHEN 4 THEN ['v6'] ELSE [] END) AS literal FROM said""",
    CELLS_SQL, _SAID_SQL,
)
def str_filter_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column and literal of the comparisons in a program: by ==, every value of isin, and in query texts."""
    rows = _made(spark, sf_dir).withColumn("code", _filled(FILTERS, F.col("name") % len(FILTERS)))
    return rows.select("trace", "idx", F.explode(text.literal_filters(F.col("code"))).alias("f")).select("trace", "idx", "f.column", "f.literal")


@query(
    """SELECT trace, sum(n)::BIGINT AS events FROM (SELECT trace, count(DISTINCT (CASE WHEN name <= 2 THEN k || 'key' ELSE '' END, left(o, 120))) AS n FROM said WHERE idx <= 40 AND name IN (0, 7, 10) GROUP BY trace) GROUP BY trace""",
    CELLS_SQL, _SAID_SQL,
)
def str_error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of whole logs, each class, key and beginning once a log. A log is the messages of a trace behind their marks."""
    rows = said(spark, sf_dir).where("idx <= 40 and name in (0, 7, 10)")
    line = F.concat(F.lit("Step: Code execution failed at line 'f(x)' due to: "), F.col("output"), F.lit("\n"), F.repeat(F.lit("."), F.lit(3100)))
    logs = rows.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("log"))
    return text.error_events(logs, ["trace"], "log").groupBy("trace").agg(F.count("*").alias("events"))


@query(
    """SELECT trace, idx, CASE WHEN name IN (0, 1, 2) THEN k2 = k WHEN name = 10 THEN name2 < 2 ELSE false END AS cause
    FROM (SELECT *, (trace + idx) % 3 AS name2, CASE WHEN (trace + idx) % 3 = 0 THEN k ELSE 'other' END AS k2 FROM said WHERE name IN (0, 1, 2, 3, 10))""",
    CELLS_SQL, _SAID_SQL,
)
def chk_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a verdict name what the recorded error names? A key may stand in brackets or quotes; a path may be given by its end or its base name."""
    rows = said(spark, sf_dir).where("name in (0, 1, 2, 3, 10)")
    turn = (F.col("trace") + F.col("idx")) % 3
    key = F.when(turn == 0, F.concat(F.lit("['"), F.col("k"), F.lit("'] "))).otherwise("other")
    path = F.when(turn == 0, F.concat(F.lit("/elsewhere/"), F.col("k"), F.lit(".csv"))).when(turn == 1, F.concat(F.lit("data/"), F.col("k"), F.lit(".csv"))).otherwise("other.csv")
    named = F.when(F.col("name") == 10, path).otherwise(key)
    kind, lost = text.error_type("output"), text.missing_path(F.col("output"))
    return rows.select("trace", "idx", chk.named_cause(named, kind, text.error_key("output"), lost).alias("cause"))


_LOW, _HIGH = _wilson_sql("k", "n")


@query(
    f"""SELECT submitter, CASE WHEN high < 0.1 THEN 'fails' WHEN low >= 0.1 THEN 'passes' ELSE 'undecided' END AS enough, CASE WHEN low > 0.5 THEN 'fails' WHEN high < 0.5 THEN 'passes' ELSE 'undecided' END AS few
    FROM (SELECT submitter, {_LOW} AS low, {_HIGH} AS high FROM (SELECT submitter, count(*) FILTER (failed) AS k, count(*) AS n FROM cells GROUP BY 1))""",
    CELLS_SQL,
)
def stat_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop rules on an interval: a share must be enough, or must not be most."""
    rows = cells(spark, sf_dir).groupBy("submitter").agg(F.count_if(F.col("failed")).alias("k"), F.count("*").alias("n"))
    low, high = st.wilson("k", "n")
    return rows.select("submitter", st.at_least(low, high, 0.1).alias("enough"), st.not_most(low, high, 0.5).alias("few"))


@query(
    """SELECT page AS file FROM (SELECT 'results-m' || (p_partkey % 4) || '/query_' || (p_partkey % 7) || '/q' || (p_partkey % 5) || '/run_' || p_partkey || '/tool_calls.jsonl' AS page, p_partkey FROM part)
    WHERE p_partkey % 4 <> 3 AND p_partkey % 7 NOT IN (1, 2) AND NOT (p_partkey % 7 = 5 AND p_partkey % 5 IN (2, 3)) UNION ALL SELECT 'rerun/results-m' || (s_suppkey % 4) || '/query_1/q0/run_' || s_suppkey || '/tool_calls.jsonl' FROM supplier WHERE s_suppkey % 4 <> 3"""
)
def src_select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs chosen by exclusion lists, with those of a second root in place of a data set."""
    name = lambda root, a, b, c, run: F.concat(F.lit(f"{root}results-m"), a.cast("string"), F.lit("/query_"), b.cast("string"), F.lit("/q"), c.cast("string"), F.lit("/run_"), run.cast("string"), F.lit("/tool_calls.jsonl"))
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    first = table(spark, sf_dir, "part").select(name("", p % 4, p % 7, p % 5, p).alias("file"))
    second = table(spark, sf_dir, "supplier").select(name("rerun/", s % 4, F.lit(1), F.lit(0), s).alias("file"))
    without = {"model": ["m3"]}
    chosen = files.selected(first, without | {"dataset": ["1", "2"]}, [{"dataset": ["5"], "query": ["q2", "q3"]}])
    return chosen.unionByName(files.selected(second, without))


@query(
    """SELECT r.trace, r.idx, p.idx AS made_by FROM (SELECT *, 'var_' || (trace % 9) || '_' || (idx * 5 % 23) AS v FROM cells) r
    LEFT JOIN (SELECT trace, 'var_' || (trace % 9) || '_' || (idx % 23) AS v, max(idx) AS idx FROM cells WHERE NOT failed AND idx <= 23 GROUP BY 1, 2) p ON p.trace = r.trace AND p.v = r.v AND p.idx < r.idx""",
    CELLS_SQL,
)
def join_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which call of its run made the stored variable that a call reads, if one before it did."""
    rows = cells(spark, sf_dir).withColumn("reads", F.concat(F.lit("var_"), F.col("trace") % 9, F.lit("_"), F.col("idx") * 5 % 23))
    made = cells(spark, sf_dir).where("not failed and idx <= 23").select("trace", "idx", F.concat(F.lit("var_"), F.col("trace") % 9, F.lit("_"), F.col("idx") % 23).alias("variable"))
    return joins.made_before(rows, made, "trace", "idx", "reads", "variable").select("trace", "idx", "made_by")
