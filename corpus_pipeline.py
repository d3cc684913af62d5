"""From documents to training sequences: toxicity, quality, near-duplicates, packing.

Each stage takes all documents that the stage before kept, as (spark, docs, sf_dir), and all but the last return them
with their columns. Models are fitted on bounded samples of labelled documents (see their modules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard, packing, quality, queries, store, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    # a column of the documents that is called score keeps its values
    scored = toxicity.score(docs.withColumnRenamed("score", "quill_own"), model).where(F.col("score") < 0.5)
    return scored.withColumnsRenamed({"score": "quill_toxic", "quill_own": "score"}).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, quality.train(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, the one with the smallest id."""
    return jaccard.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Classifiers and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.kept(docs, f"stage{k}")
    return docs
