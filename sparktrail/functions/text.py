"""Text rules over recorded outputs, as Columns.

Patterns are Java's with (?d), so that only \\n ends a line. Where a rule needs
match offsets or a parser, a Python function runs in Arrow batches.
"""

from __future__ import annotations

import ast
import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

ANSI = r"\x1b\[[0-9;]*m|\\u001b\[[0-9;]*m"


#: Escapes and what they stand for, undone one after the other.
UNESCAPED = (("\\\\n", "\n"), ("\\n", "\n"), ("\\'", "'"), ('\\"', '"'), ("\\\\", "\\"))


def plain(text: Column | str) -> Column:
    """Colour codes go; then escaped line ends, quotes and backslashes are undone, in that order."""
    t = F.regexp_replace(text, ANSI, "")
    for escaped, shown in UNESCAPED:
        t = F.replace(t, F.lit(escaped), F.lit(shown))
    return t


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: The rules for messages that don't begin with an error's name, in order; the first that matches decides.
WRAPPED = (
    ("executor:forbidden", r"not permitted to evaluate other functions|Forbidden function|is not among the explicitly allowed|Import of .{1,60} is not allowed|Forbidden access|Cannot assign to name .{1,40} erase the existing tool", 600),
    ("executor:budget", r"(?i)max number of operations|Reached the max|operations limit|timed? ?out", 600),
    ("KeyError(wrapped)", r"KeyError: '[^'\n]{1,80}'", 800),
    ("NameError", r"is not defined|The variable `", 1500),
    ("SyntaxError", r"SyntaxError|invalid syntax|Code parsing failed|unterminated|IndentationError", 1500),
    ("AttributeError", r"has no attribute", 1500),
    ("TypeError", r"TypeError|unsupported operand|not callable|not subscriptable|not iterable", 1500),
    ("ValueError", r"ValueError|could not convert|invalid literal", 1500),
    ("IndexError", r"IndexError|out of bounds|index out of range", 1500),
    ("FileNotFoundError", r"FileNotFound|No such file", 1500),
)
NAMED = r"^\s*([A-Za-z]+(?:Error|Exception))"


_INDEXED = "Could not index"


def _own_name(m: Column) -> Column:
    """The error's name that a message begins with; that of an interpreter wraps another."""
    own = _first(m.substr(1, 200), NAMED)
    return F.when(own != "InterpreterError", own)


def _indexed_key(m: Column) -> Column:
    """The key of a failed look-up that a message begins by telling of; the message may repeat a whole table before it names the key."""
    begins = F.concat(m.substr(1, 200), m.substr(1, 40)).contains(_INDEXED)
    key = F.coalesce(_first(m.substr(1, 3000), r"(?s)Could not index .{0,2500}? with '([^'\n]{1,80})'"), _first(m, r"(?s) with '([^'\n]{1,80})': KeyError: '"))
    return F.when(begins, key)


def error_type(message: Column | str) -> Column:
    """The class of an error from its message: its own name if it begins with one, else the first rule that matches. A failed look-up counts as such only if its key is found, after the rules of the executor."""
    m = F.col(message) if isinstance(message, str) else message
    own = _own_name(m)
    named = F.when(own == "IndentationError", "SyntaxError").when((own == "ValueError") & m.substr(1, 300).contains("Usecols do not match"), "ValueError:usecols").otherwise(own)
    rule = [F.when(m.substr(1, n).rlike(p), F.lit(name)) for name, p, n in WRAPPED]
    wrapped = F.coalesce(*rule[:2], F.when(_indexed_key(m).isNotNull(), "index-error(wrapped)"), *rule[2:], F.lit("other"))
    return F.when(m.isNull(), None).when(own.isNull(), wrapped).otherwise(named)


def error_key(message: Column | str) -> Column:
    """The missing key that the message names, or null."""
    m = F.col(message) if isinstance(message, str) else message
    kind = error_type(m)
    return (
        F.when(kind == "index-error(wrapped)", _indexed_key(m))
        .when(kind == "KeyError(wrapped)", _first(m.substr(1, 800), r"KeyError: '([^'\n]{1,80})'"))
        .when(kind == "KeyError", _first(m.substr(1, 200), r"^\s*KeyError:?\s*'([^'\n]{1,80})'"))
    )


LAST_LINE = r"(?md)^\s*([A-Za-z_][A-Za-z_.]*(?:Error|Exception)): ?([^\n]{0,300})$"


def last_error_line(output: Column | str) -> Column:
    found = F.regexp_extract_all(output, F.lit(LAST_LINE), F.lit(0))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


#: What the messages of tools say, in order; the first that matches decides.
SQL_RULES = (
    ("sql:missing-column", r"(?s)UndefinedColumn|no such column|Referenced column .{1,200}? not found|column .{1,200}? does not exist|does not have a column named"),
    ("sql:missing-table", r"(?s)UndefinedTable|no such table|Table with name .{1,200}? does not exist|relation .{1,200}? does not exist"),
    ("sql:function", r"(?s)UndefinedFunction|No function matches|function .{1,120}? does not exist|Scalar Function with name|Could not choose a best candidate function"),
    ("sql:syntax", r"(?i)syntax error|Parser Error|ParserException|SyntaxError|unrecognized token|incomplete input"),
)
PYTHON_ERROR = r"[A-Za-z_][\w.]*(?:Error|Exception|Exit|Interrupt)"
VARIABLE = r"var_[\w.:\-]+|file_storage|\b\d{15,}\.json\b|function-call-\d+|functions\.\w+:\d+"
EXIT = r"Execution failed with exit code (-?\d+)\n"
ENGINES = (("DuckDB", "duckdb"), ("SQLite", "sqlite"), ("Postgres", "postgres"), ("psycopg", "postgres"), ("Mongo", "mongo"))


def tool_error(tool: Column, db_type: Column, error: Column) -> Column:
    """The group of a failed tool call: SQL, document store, Python or interface."""
    e = F.coalesce(error, F.lit(""))
    sql = F.coalesce(*[F.when(e.rlike(p), F.lit(name)) for name, p in SQL_RULES], F.lit("sql:other"))
    store = F.when(e.substr(1, 60).contains("JSON"), "mongo:query-json").otherwise("mongo:other")
    asked_store = e.startswith("Invalid Mongo query") | F.coalesce(db_type == "mongo", F.lit(False))
    db = F.when(e.startswith("Collection does not exist"), "mongo:missing-collection").when(asked_store, store).otherwise(sql)
    exit_code = _first(e, f"^{EXIT}")
    last = F.regexp_replace(e, f"^{EXIT}", "")
    full = _first(last, rf"^\s*({PYTHON_ERROR})\b")
    name = F.element_at(F.split(full, r"\."), -1)
    name = F.when(name.isin("IndentationError", "TabError"), "SyntaxError").otherwise(name)
    rest = F.regexp_replace(last, rf"(?s)^\s*{PYTHON_ERROR}\b:?\s?", "")
    interface = rest.rlike(VARIABLE)
    own_name = F.coalesce(_first(rest, r"name '([^']+)' is not defined").startswith("var_"), F.lit(False))
    python = (
        F.when(e.startswith("Failed to parse the printed result"), "py:print-format")
        .when((exit_code == "124") | F.lower(e).contains("timed out"), "py:timeout")
        .when(full.isNull(), "py:other")
        .when(name == "KeyError", F.when(interface, "interface:var-key").otherwise("py:data-key"))
        .when(name == "FileNotFoundError", F.when(interface, "interface:var-file").otherwise("py:data-file"))
        .when((name == "NameError") & own_name, "interface:var-name")
        .otherwise(F.concat(F.lit("py:"), name))
    )
    return F.when(tool == "query_db", db).when(tool == "execute_python", python).otherwise("other")


def engine(message: Column) -> Column:
    return F.coalesce(*[F.when(message.contains(p), F.lit(e)) for p, e in ENGINES])


def missing_path(output: Column) -> Column:
    return F.coalesce(_first(output, r"No such file or directory: '([^']+)'"), _first(output, r"File (\S+) does not exist"), _first(output, r"\[Errno 2\][^'\n]*'([^']+)'"))


def undefined_name(message: Column) -> Column:
    return F.coalesce(_first(message, r"name '([^']+)' is not defined"), _first(message, r"The variable `([^`]+)` is not defined"), _first(message, r"local variable '([^']+)'"))


def xml_cells(trace: Column) -> Column:
    """array<struct<code,output>> of <Code>…</Code> … <Execute>…</Execute> pairs, in order."""
    code = F.regexp_extract_all(trace, F.lit(r"(?s)<Code>(.*?)</Code>\s*<Execute>(.*?)</Execute>"), F.lit(1))
    out = F.regexp_extract_all(trace, F.lit(r"(?s)<Code>(.*?)</Code>\s*<Execute>(.*?)</Execute>"), F.lit(2))
    return F.arrays_zip(code.alias("code"), out.alias("output"))


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"'([^'\n]{1,80})'"), F.lit(1))


def literal_filters(code: Column) -> Column:
    """array<struct<column,literal>> of the comparisons of a column with a text literal in program text: by ==, every value of isin, and in the text of query()."""
    every = lambda text, p, n: F.regexp_extract_all(text, F.lit(p), F.lit(n))
    pair = lambda a, b: F.struct(a.alias("column"), b.alias("literal"))
    entry = lambda text, p, c, v: F.zip_with(every(text, p, c), every(text, p, v), pair)
    literal = r"""['"]([^'"\n]{1,80})['"]"""
    isin = r"""\[\s*['"](\w+)['"]\s*\]\.isin\(\s*\[([^\]]*)\]"""
    listed = F.flatten(F.zip_with(every(code, isin, 1), every(code, isin, 2), lambda c, values: F.transform(every(values, literal, 1), lambda v: pair(c, v))))
    queried = F.flatten(F.transform(every(code, r"""query\(\s*(['"])(.*?)\1\s*\)""", 2), lambda q: entry(q, r"""\b(\w+)\s*==\s*\\?['"`]([^'"`]{1,80})\\?['"`]""", 1, 2)))
    return F.array_distinct(F.concat(entry(code, rf"""\[\s*['"](\w+)['"]\s*\]\s*==\s*{literal}""", 1, 2), entry(code, rf"\.(\w+)\s*==\s*{literal}", 1, 2), listed, queried))


#: Where a log tells of a failed cell, and of an error by its last line.
EVENT = r"(?s)Code execution failed(?=.{0,20000}?(?:due to|because of the following error)[^:]*:(.{0,3000}))"


def error_events(logs: DataFrame, key: list[str], log: str) -> DataFrame:
    """key, error_type, error_key, head: the error events of whole logs, each class, key and beginning of 120 characters once a log."""
    text = plain(F.col(log))
    told = F.regexp_extract_all(text, F.lit(EVENT), F.lit(1))
    lines = F.when(text.contains("Traceback (most recent call last)") | text.contains("[Error]"), F.regexp_extract_all(text, F.lit(LAST_LINE), F.lit(0)))
    rows = logs.select(*key, F.explode(F.concat(told, F.coalesce(lines, F.array().cast("array<string>")))).alias("_m"))
    return rows.select(*key, error_type("_m").alias("error_type"), error_key("_m").alias("error_key"), F.left("_m", F.lit(120)).alias("head")).distinct()


def lenient_record(value: str | None):
    """A record written as Python or as JSON, or None."""
    for read in (ast.literal_eval, json.loads):
        try:
            found = read(value or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        return found if isinstance(found, dict) else None
    return None


def answer_map(text: Column) -> Column:
    """map of @name[value] in a text; the last of a name wins."""
    p = r"@(\w+)\[(.*?)\]"
    return F.map_from_entries(
        F.aggregate(
            F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("v")),
            F.array().cast("array<struct<k:string,v:string>>"),
            lambda acc, x: F.concat(F.filter(acc, lambda y: y["k"] != x["k"]), F.array(F.struct(x["k"].alias("k"), x["v"].alias("v")))),
        )
    )


def judge_label(text: Column, n: int) -> Column:
    """yes or no after FM<n>, lower-cased; null if it isn't there."""
    return F.lower(_first(text, rf"(?i)FM{n}\s*:?\s*(yes|no)"))


def verdict(text: Column) -> Column:
    return F.upper(_first(text, r"(?i)\b(BLOCK|RUN)\b"))


def durations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"Duration:? ([0-9]+(?:\.[0-9]+)?) ?s"), F.lit(1)), lambda x: x.cast("double"))


def path_class(path: Column) -> Column:
    return F.when(path.isNull(), "unparsed").when(path.startswith("/mnt/data"), "/mnt/data").when(path.startswith("/"), "absolute").otherwise("relative")


def head_tail(text: Column, n: int, mark: str = " ... ") -> Column:
    """A text of more than n characters keeps n/2 at either end."""
    half = n // 2
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def named_keys(text: pd.Series) -> pd.Series:
    """Keys that a lookup error names: one quoted key, or those of a listing."""

    def keys(t):
        if t is None:
            return None
        t = t.strip()
        listed = re.search(r"Index\(\[(.*?)\]", t, re.S) or re.search(r"\[([^\[\]]*)\] (?:not in index|are in the|do not exist)", t, re.S)
        if listed:
            return re.findall(r"'([^']*)'", listed[1])
        try:
            v = ast.literal_eval(t)
        except (ValueError, SyntaxError):
            return [t]
        return [str(x) for x in v] if isinstance(v, (list, tuple)) else [str(v)]

    return text.map(keys)


def nearest(known: list[str], n: int = 1, cutoff: float = 0.8):
    """A column function: the known names nearest to a key (matching blocks, not edit distance)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def near(key: pd.Series) -> pd.Series:
        met = {k: difflib.get_close_matches(k, known, n=n, cutoff=cutoff) for k in key.dropna().unique()}
        return key.map(lambda k: met.get(k, []))

    return near


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("after", T.StringType())])))
def fenced_blocks(text: pd.Series) -> pd.Series:
    """Fenced program blocks with the text between each and the next."""
    fence = re.compile(r"```(?:py|python)?\n(.*?)```", re.S)

    def blocks(t):
        found = list(fence.finditer(t or ""))
        ends = [m.start() for m in found[1:]] + [len(t or "")]
        return [{"code": m[1], "after": t[m.end() : e]} for m, e in zip(found, ends)]

    return text.map(blocks)


def texts_of(value):
    """The texts of a JSON value, in order."""
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    if isinstance(value, str):
        yield value
    for part in parts:
        yield from texts_of(part)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(text: pd.Series) -> pd.Series:
    """All text leaves of a JSON value, in order; the text itself if it is no JSON."""

    def leaves(t):
        if t is None:
            return None
        try:
            return list(texts_of(json.loads(t)))
        except ValueError:
            return [t]

    return text.map(leaves)
