"""Runs with nested cells: measures per run, and what depends on the order of their cells."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.code import compiles, parse, used_names


def measures(cells: str = "cells") -> list[Column]:
    """n_cells, blocked, name_failures, first_blocked (place) and after_ok (of the cell that follows it) of an array of structs (ok, error_type, blocked)."""
    c = F.col(cells)
    places = F.filter(F.transform(c, lambda x, i: F.when(x["blocked"], i)), lambda i: i.isNotNull())
    first = F.get(places, F.lit(0))
    return [
        F.size(c).alias("n_cells"),
        F.size(F.filter(c, lambda x: x["blocked"])).alias("blocked"),
        F.size(F.filter(c, lambda x: x["error_type"] == "NameError")).alias("name_failures"),
        first.alias("first_blocked"),
        F.get(c, first + 1)["ok"].alias("after_ok"),
    ]


def at_limit_without_answer(cells: str, answer: str, limit: int = 15) -> Column:
    return (F.size(cells) >= limit) & F.col(answer).isNull()


def steps_to_fix(cells: str, otherwise: int = 7) -> Column:
    """Place (from 1) of the first cell that is ok and no inspection; `otherwise` if there is none."""
    fixed = F.filter(F.transform(cells, lambda x, i: F.when(x["ok"] & ~x["inspects"], i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(fixed, F.lit(0)), F.lit(otherwise))


def cut_after_answer(runs: DataFrame, cells: str, replayed: str, stop: str, answer: str) -> DataFrame:
    """Recovered answers: the cells up to the answer's stay, unless an earlier cell went another way in the replay; then the recording stands.

    `replayed` are the outcomes (ok, error_type) of the replay, `stop` the place of the answer or null.
    """
    earlier = F.slice(replayed, F.lit(1), F.coalesce(F.col(stop), F.lit(0)))
    other = lambda x, i: ~(x["ok"].eqNullSafe(F.get(cells, i)["ok"]) & x["error_type"].eqNullSafe(F.get(cells, i)["error_type"]))
    diverged = F.exists(F.transform(earlier, other), lambda x: x)
    use = F.col(stop).isNotNull() & F.col(answer).isNotNull() & ~diverged
    return runs.withColumn("recovered", use).withColumn(cells, F.when(use, F.slice(cells, F.lit(1), F.coalesce(F.col(stop), F.lit(0)) + 1)).otherwise(F.col(cells)))


def followed_by(rows: DataFrame, by: str, order: str, note: Column, event: Column) -> DataFrame:
    """Per group: is any note followed by an event?"""
    first = F.min(F.when(note, F.col(order)))
    last = F.max(F.when(event, F.col(order)))
    return rows.groupBy(by).agg(F.coalesce(last > first, F.lit(False)).alias("followed"))


def stale_names(uses: DataFrame, skipped: DataFrame, lost: DataFrame) -> DataFrame:
    """(trace, idx, reassigns, name_error, stale_read) of each cell that was stopped and had set names: did an earlier cell set one of them, is one missed later, or its old value read?

    `uses`: (trace, idx, name, bound, read) of cells that ran, one row a name;
    `skipped`: (trace, idx, name) of what stopped cells would have set; `lost`: (trace,
    idx, name) of cells that failed for want of a name. All of a name in a trace is one sorted
    run, in which a skipped name holds until the next cell that sets it: work grows as the rows.
    """
    none = F.lit(None).cast("int")
    at = lambda c: F.when(c, F.col("idx"))
    ran = uses.groupBy("trace", "idx", "name").agg(F.bool_or("bound").alias("bound"), F.bool_or("read").alias("read"))
    # a cell that sets a name has set it before it reads it
    rows = ran.select("trace", "idx", "name", at(F.col("bound")).alias("set"), at(F.col("read") & ~F.col("bound")).alias("got"), none.alias("miss"), F.lit(False).alias("stop"))
    rows = rows.union(lost.distinct().select("trace", "idx", "name", none, none, F.col("idx"), F.lit(False)))
    rows = rows.union(skipped.distinct().select("trace", "idx", "name", none, none, none, F.lit(True)))
    # frames that grow from one end, so that each row is added once; the next one is the last, seen from the other end
    before, after = (W.partitionBy("trace", "name").orderBy(o).rangeBetween(W.unboundedPreceding, -1) for o in (F.asc("idx"), F.desc("idx")))
    next_ = lambda c: F.last(c, ignorenulls=True).over(after)
    until = F.coalesce(next_("set"), F.lit(2**31 - 1))
    known = F.last("set", ignorenulls=True).over(before).isNotNull()
    said = rows.withColumns({"known": known, "missed": F.coalesce(next_("miss") < until, F.lit(False)), "stale": known & F.coalesce(next_("got") < until, F.lit(False))}).where("stop")
    return said.groupBy("trace", "idx").agg(F.bool_or("known").alias("reassigns"), F.bool_or("missed").alias("name_error"), F.bool_or("stale").alias("stale_read"))


def after_blocked(cells: DataFrame) -> DataFrame:
    """stale_names for each blocked cell of (trace, idx, code, ok, blocked, line, error), where the lines above `line` are what was stopped; each program is parsed once."""
    rows = cells.select("trace", "idx", "ok", "blocked", "error", used_names("code", F.when(F.col("blocked"), F.col("line")).cast("double")).alias("u"))
    ran, key = rows.where("ok and not blocked"), ["trace", "idx"]
    uses = ran.select(*key, F.explode("u.bound").alias("name"), F.lit(True).alias("bound"), F.lit(False).alias("read"))
    uses = uses.union(ran.select(*key, F.explode("u.read"), F.lit(False), F.lit(True)))
    skipped = rows.where("blocked").select(*key, F.explode("u.bound_above").alias("name"))
    lost = rows.where("not ok and not blocked").select(*key, F.nullif(F.regexp_extract("error", "name '([^']+)' is not defined", 1), F.lit("")).alias("name")).where("name is not null")
    told = stale_names(uses, skipped, lost)
    every = rows.where("blocked and u.bound_above is not null").select(*key)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("reassigns", "name_error", "stale_read")]
    return every.join(told, key, "left").select(*key, *flags)


def answer_code(reply: str) -> str | None:
    """The program in a model's reply: its fenced block, else the reply if it is one valid call."""
    fenced = re.search(r"```(?:python|py)?[ \t]*\n(.*?)```", reply or "", re.S)
    if fenced:
        return fenced[1]
    bare = (reply or "").strip()
    tree = parse(bare) if bare else None
    one_call = tree is not None and len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr) and isinstance(tree.body[0].value, ast.Call)
    return bare if one_call and compiles(bare) else None


#: What an expression makes, by the first pattern that its form matches: how it is called and by what name, or its kind of node.
MAKES = (
    (r"method (read_csv|read_json|read_excel|read_parquet)", "frame from a reader"),
    (r"(method|function) (load|loads|read_json_metadata_file|read_csv_metadata_file|safe_read_file)", "JSON or text from a file"),
    (r"method (DataFrame|concat|merge|json_normalize)", "frame built in code"),
    (r"method .*", "result of a method call"),
    (r"(function|call) .*", "result of a function call"),
    (r"node (Subscript|Attribute)", "subscript or attribute of another object"),
    (r"node (Dict|List|ListComp|DictComp)", "literal or comprehension"),
    (r".*", "other"),
)
ROW_LOOP = r"method (iterrows|itertuples)"
COLUMN_METHOD = (
    r"method (groupby|sort_values|merge|drop|set_index|pivot|pivot_table|value_counts|drop_duplicates|dropna|"
    r"agg|rename|explode|melt|nlargest|nsmallest|get|filter|join)"
)


def _form(e: ast.expr) -> str:
    match e:
        case ast.Call(func=ast.Attribute(attr=name)):
            return f"method {name}"
        case ast.Call(func=ast.Name(id=name)):
            return f"function {name}"
        case ast.Call():
            return "call -"
    return f"node {type(e).__name__}"


def _matches(pattern: str, e: ast.expr) -> bool:
    return re.fullmatch(pattern, _form(e)) is not None


BINDING = T.StructType([T.StructField("name", T.StringType()), T.StructField("made", T.StringType())])


def origins(code: str | None) -> list[tuple[str, str]]:
    """(name, what it was made by), once a name of a program: its last binding, where those of outer parts come before those of inner ones."""
    rows = []
    for node in ast.walk(parse(code or "") or ast.Module([], [])):
        match node:
            case ast.Assign(targets=targets, value=value):
                made = next(label for pattern, label in MAKES if _matches(pattern, value))
                rows += [(t.id, made) for t in targets if isinstance(t, ast.Name)]
            case ast.For(target=target, iter=over) | ast.comprehension(target=target, iter=over):
                made = "row of a DataFrame loop" if _matches(ROW_LOOP, over) else "loop variable"
                rows += [(n.id, made) for n in ast.walk(target) if isinstance(n, ast.Name)]
            case ast.arg(arg=name):
                rows.append((name, "function argument"))
    return list(dict(rows).items())


PLACE = T.StructType([T.StructField("how", T.StringType()), T.StructField("of", T.StringType())])


def place_of(key: str | None, code: str | None) -> tuple[str, str | None]:
    """Where a program writes a key: how, and the name it is looked up in or the method it is given to."""
    tree = parse(code or "")
    if tree is None or not key:
        return ("invalid" if tree is None else "no key"), None
    written = lambda n: isinstance(n, ast.Constant) and n.value == key
    nodes = sorted((n for n in ast.walk(tree) if isinstance(n, ast.expr)), key=lambda n: (n.lineno, n.col_offset))
    subscripts = [n.value for n in nodes if isinstance(n, ast.Subscript) and written(n.slice)]
    if subscripts:
        return ("name", subscripts[0].id) if isinstance(subscripts[0], ast.Name) else ("expression", None)
    given = [_form(n).removeprefix("method ") for n in nodes if _matches(COLUMN_METHOD, n) and any(map(written, ast.walk(n)))]
    return ("argument", given[0]) if given else ("elsewhere" if any(map(written, nodes)) else "absent", None)


@F.pandas_udf(T.ArrayType(BINDING))
def _origins(code: pd.Series) -> pd.Series:
    return code.map(lambda c: [{"name": n, "made": m} for n, m in origins(c)])


@F.pandas_udf(PLACE)
def _place(key: pd.Series, code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([place_of(k, c) for k, c in zip(key, code)], columns=PLACE.names)


def miss_classes(cells: DataFrame) -> DataFrame:
    """(trace, idx, miss) of the failed cells of (trace, idx, code, failed, key, error_type): where the missing key stands in the program, and what made the object it was looked up in.

    Each program gives its bindings once. A lookup in a name meets the last of them
    in its trace, its own cell included, by a sort of the name's places.
    """
    failed = cells.where("failed and (key is not null or error_type in ('FileNotFoundError', 'ValueError:usecols'))")
    asked = failed.select("trace", "idx", "error_type", _place("key", "code").alias("p"))
    bound = cells.select("trace", "idx", F.explode(_origins("code")).alias("b"))
    one = bound.select("trace", "idx", F.col("b.name").alias("name"), F.lit(0).alias("ask"), F.col("b.made").alias("made"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast(PLACE).alias("p"))
    two = asked.select("trace", "idx", F.col("p.of").alias("name"), F.lit(1), F.lit(None).cast("string"), "error_type", "p")
    so_far = W.partitionBy("trace", "name").orderBy("idx", "ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.coalesce(F.last("made", ignorenulls=True).over(so_far), F.lit("not bound in the trace"))
    how = F.col("p.how")
    miss = (
        F.when(F.col("error_type") == "FileNotFoundError", "missing file")
        .when(F.col("error_type") == "ValueError:usecols", "usecols")
        .when(how == "invalid", "invalid Python")
        .when(how == "no key", "error text without a key")
        .when(how == "name", F.concat(F.lit("x['key'], x = "), "known"))
        .when(how == "expression", "expr['key'] (derived expression)")
        .when(how == "argument", F.concat(F.lit("key as a method argument (."), "p.of", F.lit(")")))
        .when(how == "elsewhere", "key in another position")
        .otherwise("key not written in this cell")
    )
    return one.union(two).withColumn("known", known).where("ask = 1").select("trace", "idx", miss.alias("miss"))
