"""Recorded logs and data files as DataFrames."""

from __future__ import annotations

import csv
import functools
import io
import json
import operator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

#: Schemas of the records that are read.
CELL = "submission_file string, task_id string, trace_line int, cell_index int, code string, output string, failed boolean, error_type string, error_key string, executor_rule string"
RUN = "arm string, dataset string, query int, block int, attempt int, is_valid boolean, terminate_reason string, llm_calls int, tool_calls int, failed_tool_calls int, prompt_tokens long, completion_tokens long, wall_s double"
TOOL_CALL = "tool_name string, args struct<query:string,code:string>, val_args struct<db_type:string,exec_args:struct<collection:string,filter:string,projection:string,limit:int>>, result struct<success:boolean,preview:string>"
#: The alias of a model name in folder names.
MODELS = {"gpt5.1": "gpt-5.1"}


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema given, never inferred; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def tolerant_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The readable records, and how many lines of each file were not. Lines are read once as text and parsed."""
    parsed = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    full = parsed.where(F.trim("value") != "")
    bad = full.groupBy("file").agg(F.count_if(F.col("r._bad").isNotNull()).alias("bad_lines"))
    names = T._parse_datatype_string(schema).names
    return full.where("r._bad is null").select("file", *[f"r.`{n}`" for n in names]), bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) with physical line numbers from 1, blank lines counted but not returned.

    Files are read in byte ranges, as Spark splits them, whatever their size: the
    lines of each range are counted, the counts of the ranges before it in the file are
    added, and a line's place in its range is the difference of row ids. What is
    joined back is one row a range. A line ends with \\n, \\r\\n or \\r, the last
    one may end with the file.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("row"), "value")
    ranges = lines.groupBy(F.col("file").alias("_f"), F.col("start").alias("_s")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("_f").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = lines.join(ranges, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")))
    return placed.where(F.trim("value") != "").select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def run_keys(files: DataFrame, file: str = "file") -> DataFrame:
    """model, dataset, query and run from .../results-<model>/query_<dataset>/<query>/.../run_<k>/tool_calls.jsonl."""
    part = lambda p: F.regexp_extract(file, p, 1)
    model = part(r"/results-([^/]+)/")
    known = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    keyed = files.where(F.col(file).rlike(r"/results-[^/]+/.*tool_calls\.jsonl$"))
    return keyed.withColumns({
        "model": F.coalesce(F.try_element_at(known, model), model),
        "dataset": part(r"/results-[^/]+/(?:query_)?([^/]+)/"),
        "query": part(r"/results-[^/]+/[^/]+/([^/]+)/"),
        "run": F.coalesce(F.nullif(part(r"/(run_\d+)/"), F.lit("")), part(r"/([^/]+)/tool_calls\.jsonl$")),
    })


def selected(files: DataFrame, without: dict[str, list[str]], without_pairs: list[dict[str, list[str]]] = (), file: str = "file") -> DataFrame:
    """Logs of runs whose path has none of the named models, data sets or queries, nor any of the combinations."""
    keyed = run_keys(files.select(F.concat(F.lit("/"), F.col(file)).alias("_at"), file), "_at")
    any_of = lambda names, together: functools.reduce(together, [F.col(k).isin(v) for k, v in names.items()], F.lit(together is operator.and_))
    out = any_of(without, operator.or_)
    for pair in without_pairs:
        out = out | any_of(pair, operator.and_)
    return keyed.where(~out).select(file)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of each file; an error if one is only a pointer to a file elsewhere."""
    files = spark.read.format("binaryFile").load(path)
    pointers = files.where((F.col("length") < 200) & F.startswith(F.col("content").cast("string"), F.lit("version https://git-lfs")))
    if not pointers.isEmpty():
        raise ValueError("some files are pointers, their content was not fetched")
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def header(content: bytes) -> list[str] | None:
    """All names that a CSV's columns may go by: as pandas reads them, and as the first row stands."""
    try:
        read = list(map(str, pd.read_csv(io.BytesIO(content), nrows=0).columns))
        first = next(csv.reader(io.StringIO(content.decode())), [])
    except Exception:  # unreadable in any way: nothing is known of it
        return None
    return sorted({*read, *first})


def record_keys(content: bytes) -> list[str] | None:
    """The union of the keys of a JSON list of objects, if it is one and not empty."""
    try:
        value = json.loads(content)
    except ValueError:
        return None
    if not (isinstance(value, list) and value and all(isinstance(r, dict) for r in value)):
        return None
    return sorted(set().union(*value))


def source_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(name, columns) of the CSV and JSON files below a path; a name that stands in two folders is left out."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def columns(name: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([header(c) if n.endswith(".csv") else record_keys(c) if n.endswith(".json") else None for n, c in zip(name, content)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    known = named.withColumn("columns", columns("name", "content")).where("columns is not null")
    return known.groupBy("name").agg(F.first("columns").alias("columns"), F.count("*").alias("n")).where("n = 1").drop("n")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of each file."""
    return lines.withColumn("_k", F.row_number().over(W.partitionBy("file").orderBy("line"))).where(F.col("_k") <= n).drop("_k")


def listing(names: DataFrame, folder: str, name: str, most: int = 20, cut: int = 6000) -> DataFrame:
    """Names of each folder, at most so many with a note of the rest, cut at so many characters."""
    all_ = F.array_sort(F.collect_set(name))
    rows = names.groupBy(folder).agg(all_.alias("_all"))
    more = F.when(F.size("_all") > most, F.concat(F.lit(" ("), F.size("_all").cast("string"), F.lit(" in all)"))).otherwise("")
    return rows.select(folder, F.concat(F.array_join(F.slice("_all", 1, most), ", "), more).substr(1, cut).alias("listing"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def summary(df: DataFrame) -> DataFrame:
    """One JSON text of all rows of a small result, in order of their text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("summary"))


def report(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]
    return df.select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))
