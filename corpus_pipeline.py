"""From raw documents to packed training sequences, in five stages that each work on what the one before kept.

A row goes through a stage as one struct beside what the stage's operator needs of it, so columns of any name and number
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.bitmaps import bit_blocks, having_bit
from evidentia.llm.ngram_jaccard import join_documents
from evidentia.llm.packing import pack
from evidentia.llm.quality_classifier import classify
from evidentia.llm.quality_rules import apply_rules
from evidentia.llm.scratch import Scratch
from evidentia.llm.secret_scan import scan


def _with_whole_row(docs: DataFrame, *needed: str) -> DataFrame:
    """``_doc``, the whole row, and the needed columns."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), *needed)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels' training folds, takes for good ones. Repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(_with_whole_row(docs, "doc_id", "text"), labels).where("predicted = 1").select("_doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and blank texts are rejected; repeated rows are judged each."""
    return apply_rules(_with_whole_row(docs, "text"), statistics=False).where("kept").select("_doc.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of the smallest doc_id, its first row if that id is there repeatedly.

    Rows are told apart by their place in the input, not by doc_id: different texts under one id that aren't alike all stay,
    and copies go whatever their ids, null ones included. Texts without words are alone in their groups. The rows that stay are
    told by a bit each, so that texts are not shuffled for it.
    """
    row = "row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    joined = join_documents(numbered, row=row)
    of_least_id = joined.where("component is not null and doc_id <=> component_id").groupBy("component").agg(F.min("row").alias(row))
    kept = of_least_id.select(row).unionByName(joined.where("component is null").select(F.col("row").alias(row)))
    bits = Scratch(spark, "firsts").keep(bit_blocks(kept, row), "bits")
    return having_bit(numbered.select(F.struct(*docs.columns).alias("_doc"), row), row, bits, bits.count()).select("_doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew where that changed the text."""
    found = scan(_with_whole_row(docs, "text", *[c for c in ("source",) if c in docs.columns]))
    size = F.when(F.col("n_secrets") > 0, F.length("redacted").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("redacted"), "n_chars": size}
    return found.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("packing", packing)]

#: Several stages can't be expressed in SQL; tests compare run() and each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return scratch.last(STAGES[-1][1](spark, docs, sf_dir), "packed")
