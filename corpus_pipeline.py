"""A training corpus from documents: five stages, each one operator of sparktrail.llm.

Each stage takes what the one before kept, and all but the last return the
columns of documents. Stages 1 to 3 take documents out, stage 4 puts all that
are left in mixed order, stage 5 deals them to shards, whose slots keep that order.

Defined cases, for all stages: an empty table gives an empty one; columns may be
null, and their names may clash with those of an operator; ids may be null or
repeated, as rows are told apart by all their columns; texts are read whole. A null
text, or one without letters, goes in stage 1; equal rows are one document in stage
2, and stay as often as they are in the others; a null source is one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktrail import ship
from sparktrail.llm import centroid_langid, decontaminate, pfair_mix, shard_bfd, simhash_tiles
from sparktrail.llm.common import fresh, row_key, table, whole_row_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no letters, or too far from every centroid."""
    ship(spark)
    model = centroid_langid.fit(docs)
    names = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "rejected")
    said = centroid_langid.predict(docs, model, tuple(docs.columns), names)
    return said.where(~F.col(names[-1])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of the least doc_id. Of equal rows one stays too; different rows of one doc_id are different documents."""
    ship(spark)
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, whole_row_key(docs))
    said = simhash_tiles.near_duplicates(keyed, doc_id=key)
    kept = said.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(whole_row_key(docs)))
    said = decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(said.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order of their sources: the part files in turn are the mixed stream."""
    ship(spark)
    return pfair_mix.in_mixed_order(docs, row_key(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the slots of a shard are in the mixed order."""
    ship(spark)
    return shard_bfd.shard(docs, in_order=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
