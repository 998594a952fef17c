"""A training corpus from documents: quality classifier, line dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florile.llm import line_dedup, near_dedup, packing, pii, quality
from florile.llm.common import scratch
from florile.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. A null text is scored like an empty one; rows that repeat are scored alike; without labels of both classes all stay, or none if all labels are 0."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of a smaller doc_id holds. All documents stay, if need be with an empty text; a null text becomes an empty one; a null doc_id is the smallest."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest doc_id. Texts without words and rows without doc_id stay."""
    return near_dedup.drop_near_copies(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that give it away, replaced. All rows stay; a null text becomes an empty one."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is one piece of the end id; each row is a document of its own."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("pii", hide_private), ("packing", pack)]

#: SQL can't express the classifier and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder (until the driver ends) and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs
