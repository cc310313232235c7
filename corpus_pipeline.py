"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing, each stage on all that the one before kept.

run(spark, sf_dir) applies STAGES to documents. Each stage's result is written as Parquet to the shared folder and read
again as the next one's docs. ORACLE_SQL is None: SQL can't express the learned language model, the signatures or the
linear program; tests compare every stage with a plain one on its own input.

Null and empty texts have no letter and go in the first stage. Very long texts are kept whole, and only packing cuts them into pieces. Rows that repeat a text or an id:
one of equal texts stays in the second stage, one of near ones in the third. A null language is no label to learn from; a null source is a source of its own in
mixing. With an empty table every stage gives no rows. Extra columns travel along to the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, mixing, near_dedup, packing
from tidemark.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go (no letter, or a score below the calibrated threshold)."""
    model = langid.fit(docs)
    # Rows travel as one column, so that no name of theirs meets one of the model's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return langid.predicted(rows, model, keep=["doc"]).where("not rejected").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    return near_dedup.kept_documents(docs, near_dedup.Rule(words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: a document is repeated or goes as its source's rate says."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document."""
    return packing.packed(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
