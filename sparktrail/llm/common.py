"""What several operators of this folder share: checkpoints, components, numbering."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sparktrail import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, with this package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextmanager
def _settings(spark: SparkSession, **own: str):
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: The shuffle files of a plan go when it has ended, as its result is in files of its own.
_SHUFFLES_END = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that all executors share."""
    folder(df.sparkSession)
    with _settings(df.sparkSession, **_SHUFFLES_END):
        return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` of the session. Only where that is unset and all runs on one machine, as in tests, a temporary folder is taken."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As checkpoint(), for tables that are large or read by column: compressed Parquet in the same shared folder.

    The files stay until the folder is cleared, as the frames made from them are read later.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, **_SHUFFLES_END):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT = 256


def hot_keys(rows: DataFrame, key: str, least: int = 100) -> list:
    """The keys that hold over 1/HOT of the rows each: fewer than HOT, whatever the table."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return [r[0] for r in counts.where((F.col("_n") > total / HOT) & (F.col("_n") >= least)).collect()]


def join_unique(rows: DataFrame, key: str, unique: DataFrame, name: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows joined with `unique`, whose column `name` has each value once, so that no hot key of rows lands in one task.

    Where rows have hot keys, these meet the rows of `unique` that have them, of
    which there are fewer than HOT, by broadcast; the rest is joined by a shuffle.
    Give `hot` where the keys are known.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    hot = [k for k in hot if k is not None]
    on = rows[key] == unique[name]
    if not hot:
        return rows.join(unique, on, how)
    values = rows.sparkSession.createDataFrame([(k,) for k in hot], f"_hot {dict(unique.dtypes)[name]}")
    some = F.broadcast(unique.join(F.broadcast(values), unique[name] == F.col("_hot"), "left_semi"))
    at = F.col(key).isin(hot) if not isinstance(hot[0], (bytes, bytearray)) else F.coalesce(*[F.when(F.col(key) == F.lit(bytes(k)), F.lit(True)) for k in hot], F.lit(False))
    at = F.coalesce(at, F.lit(False))
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else a union a round doubles them
    return rows.where(~at).join(unique, on, how).unionByName(rows.where(at).join(some, on, how)).coalesce(most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z only. In text of one byte a character that is lower(), which is much faster."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def row_key(df: DataFrame) -> Column:
    """An integer that names a row of documents: its doc_id, or where that is null or no integer a hash of the row above all usual ids."""
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.coalesce(F.col("doc_id").try_cast("long"), F.shiftrightunsigned(F.xxhash64(*rest), 2) + F.lit(1 << 61))


def whole_row_key(df: DataFrame) -> Column:
    """A struct that names a row and sorts by its id: rows of one doc_id that differ are apart."""
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.struct(row_key(df).alias("id"), F.xxhash64(*rest).alias("row"))


def numbered(df: DataFrame, group: str, order: list[str], out: str, bucket_rows: int = 1000) -> DataFrame:
    """Number the rows of each group from 0 without a gap, whatever the size of a group.

    A group is cut into buckets by a hash of `order`, each bucket is numbered by
    a window of its own, and the sizes of the buckets before it are added. No
    task holds a whole group. Rows that agree in all of `order` get their
    numbers in any order. `group` must not be null.
    """
    key = F.xxhash64(*[F.col(c) for c in order])
    sizes = checkpoint(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_rows")).withColumn("_n", F.ceil(F.col("_rows") / bucket_rows).cast("long")))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    hot = [r[0] for r in sizes.where((F.col("_rows") > total / HOT) & (F.col("_rows") >= 100) & F.col("_g").isNotNull()).select("_g").collect()]
    cut = join_unique(df, group, sizes.select("_g", "_n"), "_g", hot=hot).drop("_g").withColumn("_b", F.pmod(key, F.col("_n"))).drop("_n")
    starts = cut.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_rows"))
    before = W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = W.partitionBy(group, "_b").orderBy(*order)
    ranked = cut.withColumn("_row_in_bucket", F.row_number().over(inside).cast("long") - 1)
    return (
        ranked.join(starts, ranked[group].eqNullSafe(starts["_g"]) & (ranked["_b"] == starts["_c"]))
        .withColumn(out, F.col("_row_in_bucket") + F.col("_start"))
        .drop("_g", "_b", "_c", "_row_in_bucket", "_start")
    )


def in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows of df from 0 by `order`, without a task that holds more than its range.

    Rows are dealt by ranges, rows that agree in all of `order` by their place in
    df, so that no value is too hot; each range is numbered as it is sorted, and
    the sizes of the ranges before it, one row a range, are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, at = fresh(df, "tie"), fresh(df, "at")
    cut = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = stored(cut.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie).withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(at, 33)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(starts.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    return ranged.join(starts, part == F.col("_part")).withColumn(out, F.col("_start") + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, "_part", "_start")


def position(df: DataFrame) -> Column:
    """Where a row stands in df, as a struct that sorts: its file and row, where df only reads files, else its partition and row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # files are not read in the order of their names
        return F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.lit("").alias("part"), F.monotonically_increasing_id().alias("row"))


def numbered_in_place(df: DataFrame, group: str, at: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of `at`, made by position(): stretches of 1024 rows are numbered each, and the sizes of those before are added."""
    cut = df.withColumn("_b", F.struct(F.col(f"{at}.part"), F.shiftright(F.col(f"{at}.row"), 10)))
    starts = cut.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_rows"))
    before = W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    ranked = cut.withColumn("_row", F.row_number().over(W.partitionBy(group, "_b").orderBy(at)).cast("long") - 1)
    return ranked.join(starts, ranked[group].eqNullSafe(starts["_g"]) & (ranked["_b"] == starts["_c"])).withColumn(out, F.col("_row") + F.col("_start")).drop("_g", "_b", "_c", "_row", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node reachable.

    Rounds of contraction: each node moves to the least node next to it, twice,
    and the edges are carried over to where their ends moved. The image of a
    connected graph stays connected, so no link is lost. Every other round takes
    the least by a hash, so that long ordered chains shrink as fast as others.
    Nothing grows on the driver. A node with very many edges is an aggregate with
    partial sums, and is joined by a broadcast of its one row: it holds over
    1/HOT of the ends of edges, or of the labels, so there are few of these.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("at", F.col("node"))
    turn = 0
    while n := edges.count():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        if turn % 2:
            rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))
            step = both.groupBy("u").agg(F.min(rank("v")).alias("m"), F.count("*").alias("n")).select("u", F.least("m", rank("u"))["x"].alias("p"), "n")
        else:
            step = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("p"), "n")
        step = checkpoint(step)
        # a node that many others move to has as many edges
        hot = [r[0] for r in step.where((F.col("n") > 2 * n / HOT) & (F.col("n") >= 100)).select("u").collect()]
        step = step.drop("n")
        again = step.select(F.col("u").alias("w"), F.col("p").alias("q"))
        step = checkpoint(join_unique(step, "p", again, "w", hot=hot).select("u", F.col("q").alias("p")))
        labels = checkpoint(join_unique(labels, "at", step, "u", "left", hot=hot_keys(labels, "at") if turn else []).select("node", F.coalesce("p", "at").alias("at")))
        one = join_unique(edges, "a", step, "u", hot=hot).select(F.col("p").alias("a"), "b")
        two = join_unique(one, "b", step, "u", hot=hot).select("a", F.col("p").alias("b")).where("a <> b")
        # as files, whose sizes are known: a checkpoint's estimate would be multiplied by each join, to numbers of millions of digits
        edges = stored(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    least = checkpoint(labels.groupBy("at").agg(F.min("node").alias("root")).withColumnRenamed("at", "_at"))
    return join_unique(labels, "at", least, "_at").select("node", "root")
