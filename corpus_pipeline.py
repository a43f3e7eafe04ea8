"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written and read again as the next one's
docs. All but the last return the columns of ``documents``. Rows without a doc_id can't be told apart and are left out by the
first stage. Nulls in other columns, empty texts, repeated rows, empty tables and further columns are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_duplicates
from quire.llm.mixing import mix_sources
from quire.llm.neardup import near_components
from quire.llm.packing import pack_documents
from quire.llm.quality import quality_scores
from quire.llm.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go. Where a doc_id has several texts, one good one keeps it."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.join(scores.where("predicted = 1").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, once."""
    kept = exact_duplicates(docs).where("kept").select("doc_id", "text_sha256")
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    once = kept.groupBy("doc_id", "text_sha256").agg(F.lit(1).alias("one")).drop("one")
    return marked.join(once, ["doc_id", "text_sha256"], "left_semi").dropDuplicates(["doc_id", "text_sha256"]).select(*COLUMNS)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share enough of their five-word shingles (a similarity of 0.8 and more, proposed by SimHash), and those they lead to, the one with the smallest doc_id stays."""
    kept = near_components(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the Pfair schedule. Readers of files don't keep an order, so packing finds it again."""
    return mix_sources(docs).orderBy("mix_slot", "mix_row").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Pieces and, by their first piece, sequences are numbered in the
    order of the Pfair schedule, which the rows alone decide."""
    return pack_documents(mix_sources(docs), order=("mix_slot", "mix_row"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_neardup", simhash_neardup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: Kernels, fingerprints and a genetic algorithm are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
