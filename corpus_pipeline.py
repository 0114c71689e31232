"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.llm import decontam, mixing, neardup, queries, tokens, toxicity
from tallyrill.llm.workspace import Workspace, columns, discard, fresh


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "score")
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*columns(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at similarity 0.8 on five-word shingles the row of the smallest doc_id stays.

    Rows that share a doc_id or have none are documents of their own (without one last in order);
    rows without words stay, but only one for each doc_id.
    """
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if seen.n == seen.ids:
        found = neardup.near_duplicates(docs, width=5, percent=80)
        gone = found.filter(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
    ws = Workspace(spark, "neardup-rows")
    # all columns travel in one struct, so that no name among them can clash
    ordered = docs.select(F.struct(*columns(docs)).alias("row")).orderBy(F.col("row.doc_id").asc_nulls_last(), F.xxhash64("row.text"))
    rows = ws.table(ordered.withColumn("key", F.monotonically_increasing_id()), "rows")
    found = ws.table(neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text"), width=5, percent=80), "found")
    found = found.withColumnRenamed("doc_id", "key")
    blank = rows.filter("row.doc_id is not null").join(found.filter("n_shingles = 0"), "key", "left_semi").select("row.doc_id", "key")
    again = blank.join(blank.groupBy("doc_id").agg(F.min("key").alias("first")), "doc_id").filter("key > first")
    gone = found.filter(~F.col("kept")).select("key").unionByName(again.select("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), remove="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; one row for each document with its place in them."""
    return tokens.token_files(docs, queries.default_tokenizer(), end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Classifier, sketches and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = len(Workspace.opened)
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if k < len(STAGES) - 1:  # the last stage's files are the result
            discard(spark, made)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
