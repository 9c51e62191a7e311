"""Streaming forms: logs that grow, read once, with state kept by key.

The studies themselves read finished logs; this mode takes the same files as
they arrive. Windows by event time are an addition.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import tempfile
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import cut_lineage, shared_folder
from ..functions.documents import match_counts


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once_by_key(rows: DataFrame, key: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, also over restarts; a key is forgotten when the watermark passes it."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def failures_by_window(rows: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "kind").agg(F.count("*").alias("cells"), F.count_if(F.col("failed")).alias("failed")).select(F.col("w.start").alias("start"), "kind", "cells", "failed")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of its files."""
    files = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(files.schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def settled(stream: DataFrame) -> DataFrame:
    """All that a stream in append mode says of the files that are there, through a file sink in the shared folder of `spark.checkpoint.dir`."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{base or tempfile.mkdtemp(prefix='streams')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def until_budget(costs: DataFrame, order: str, cost: str, cap: float, ranges: int | None = None) -> DataFrame:
    """Rows in the order of a column while the sum of those before is below the cap, with that sum as `spent`.

    A prefix sum in parts: rows are dealt by ranges of the order and kept in files of
    their range, whose sums, one row a range, are added up; only ranges that
    begin below the cap are read again and summed inside. Rows of equal order come in any order; a null cost is 0.
    """
    spark = costs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    tie = F.monotonically_increasing_id()
    costs.withColumn("_tie", tie).repartitionByRange(n, order, "_tie").withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    kept = spark.read.schema(costs.withColumn("_tie", tie).withColumn("_range", F.lit(0)).schema).parquet(path)
    sums = kept.groupBy("_range").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start")).where(F.col("_start") < cap)
    last = starts.agg(F.max("_range")).first()[0]
    read = kept.where(F.col("_range") <= F.lit(-1 if last is None else last))
    inside = F.coalesce(F.sum(cost).over(W.partitionBy("_range").orderBy(order, "_tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return read.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn("spent", F.col("_start") + F.col("_inside")).where(F.col("spent") < cap).select(*costs.columns, "spent")


def memo(spark: SparkSession, path: str) -> DataFrame:
    """(filter, n) of all finished batches of a memo; empty if there are none."""
    try:
        return spark.read.schema("filter string, n long").parquet(f"{path}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], "filter string, n long")


def counted_once(docs: DataFrame, json_text: str, filters: DataFrame, path: str, per_batch: int = 64, seconds: float | None = None) -> DataFrame:
    """(filter, n): the memo at `path`, extended by the different filters of the column `filter` that it doesn't hold; n is how many documents match, null if that is not supported.

    A batch of filters is counted in one pass over the documents and written as a
    folder, whose name follows from its filters, by Spark's commit protocol: one that was stopped leaves nothing and is
    done again, one that is finished is in the memo. After `seconds` no new batch begins; the next call goes on.
    """
    spark, began = docs.sparkSession, time.monotonic()
    asked = cut_lineage(filters.select("filter").where("filter is not null").distinct())
    while seconds is None or time.monotonic() - began < seconds:
        batch = [r["filter"] for r in asked.join(memo(spark, path), "filter", "left_anti").orderBy("filter").limit(per_batch).collect()]
        if not batch:
            break
        name = hashlib.sha256(json.dumps(batch).encode()).hexdigest()[:32]
        match_counts(docs, batch, json_text).select("filter", "n").write.mode("overwrite").parquet(f"{path}/batch={name}")
    return memo(spark, path)


def counted_as_they_arrive(stream: DataFrame, docs: DataFrame, json_text: str, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of filters: each batch extends the memo, so one that is repeated after a restart counts nothing twice."""

    def extend(batch: DataFrame, _: int) -> None:
        counted_once(docs, json_text, batch, path)

    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended_once(stream: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """A log at `path` that gets each key once for ever: of a batch the first row of a key in the order given, if the log does not hold the key.

    The log itself is the state, so none is kept in memory. A batch is a folder
    of its number: one that is repeated after a restart is written again in its place, and looks only at the others. Null keys are equal.
    """
    # an empty folder is a log without rows; the stream's schema is the log's
    spark, schema = stream.sparkSession, stream.schema

    def extend(batch: DataFrame, number: int) -> None:
        first = W.partitionBy(*key).orderBy(*order)
        new = batch.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
        held = appended(spark, path, schema)
        if held is not None:
            known = held.where(F.col("batch") != number).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)])
            new = new.join(known, functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(key)]), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The rows of such a log with the number of their batch; None before its first batch."""
    try:
        return spark.read.option("basePath", path).schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


CHAIN_ROW = "trace long, idx long, chain int, ends boolean"


class FailureChains(StatefulProcessor):
    """Per trace: the length of the chain of failures that ends at each cell. Cells of a batch are put in order; one that is late is not counted again.

    A trace of which nothing is heard for `idle_ms` is closed: its last row is given again with ends = true, and its state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "last long, chain int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, chain, due = self.state.get() if self.state.exists() else (-1, 0, -1)
        cells = pd.concat(list(rows)).sort_values("idx")
        out = []
        for idx, failed in zip(cells["idx"], cells["failed"]):
            if idx > last:
                last, chain = int(idx), chain + 1 if failed else 0
                out.append((int(key[0]), last, chain, False))
        if due >= 0:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if self.idle_ms else -1
        if due >= 0:
            self.handle.registerTimer(due)
        self.state.update((last, chain, due))
        yield pd.DataFrame(out, columns=["trace", "idx", "chain", "ends"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, chain, _ = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(int(key[0]), last, chain, True)], columns=["trace", "idx", "chain", "ends"])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def failure_chains(rows: DataFrame, idle_ms: int = 0) -> DataFrame:
    """(trace, idx, chain, ends) of a stream of (trace, idx, failed), with state in RocksDB; idle_ms = 0 keeps the state of a trace for good."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.select("trace", "idx", "failed").groupBy("trace").transformWithStateInPandas(FailureChains(idle_ms), CHAIN_ROW, "append", "processingTime" if idle_ms else "none")
