"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. Rows are told apart by doc_id; rows that share an id, or
have none, by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from panelmill.llm._common import ascii_lower, left_out, materialize, may_match, remove, tune
from panelmill.llm.queries import tokenizer_file


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any other."""
    tune(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) one row stays: the one with the largest doc_id."""
    rows = materialize(exact_dedup.exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "decisions")
    by_id = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")), "ids")
    drop = by_id.where("n = 1 and kept = 0 and doc_id is not null")
    shared = by_id.where("n > 1 or doc_id is null")
    rest = left_out(docs, drop, ["doc_id"])
    if shared.isEmpty():
        return rest
    digest = F.sha2(ascii_lower("text"), 256)
    own = Window.partitionBy("doc_id", "digest_").orderBy("text")
    several = _held(rest, shared).withColumn("digest_", digest).withColumn("nth_", F.row_number().over(own))
    keep = rows.where("kept").alias("k")
    stays = several.where("nth_ = 1").alias("d").join(keep, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.digest_") == F.col("k.text_sha256")), "left_semi")
    return left_out(rest, shared, ["doc_id"]).unionByName(stays.select(docs.columns))


def _held(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with an id (null-safe) in ``ids``."""
    some = may_match(docs, ids, ["doc_id"]).alias("d")
    return some.join(ids.select("doc_id").hint("merge").alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (null last), then of least set.

    Rows that share an id, or have none, are told apart by their sets; texts without words link with nothing and stay.
    """
    rows = materialize(jaccard_join.jaccard_components(docs).select("doc_id", "component_id", "root", "set_a", "set_b"), "decisions")
    by_id = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("goes")), "ids")
    drop = by_id.where("n = 1 and goes and doc_id is not null")
    shared = by_id.where("n > 1 or doc_id is null")
    rest = left_out(docs, drop, ["doc_id"])
    if shared.isEmpty():
        return rest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_a", "set_b")).alias("k")
    keep = rows.where("root is not null").groupBy("root").agg(first).select("k.*").alias("k")
    own = Window.partitionBy("doc_id", "set_a", "set_b").orderBy("text")
    several = jaccard_join.with_set_keys(_held(rest, shared))
    one = several.where("set_a is not null").withColumn("nth_", F.row_number().over(own)).where("nth_ = 1").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.set_a") == F.col("k.set_a")) & (F.col("d.set_b") == F.col("k.set_b"))
    stays = one.join(keep, same, "left_semi").select(docs.columns).unionByName(several.where("set_a is null").select(docs.columns))
    return left_out(rest, shared, ["doc_id"]).unionByName(stays)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    rows = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    drop = materialize(rows.where("contaminated").select("doc_id", F.col("text_key").alias("key_")), "drop")
    return left_out(docs.withColumn("key_", decontamination.text_key()), drop, ["doc_id", "key_"]).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece, as query op2_packing returns them."""
    return packing.pack_digests(docs, tokenizer_file())


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: A trained model has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
