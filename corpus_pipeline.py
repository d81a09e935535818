"""A training corpus from the table of documents: every stage reads what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared checkpoint folder and
reads it again for the next one. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, near_join, pii, quality_rules
from quire.llm.common import read, stored

#: The key of the surrogates; a production job passes its own secret.
KEY = "surrogates of the corpus"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go (null and empty texts among them)."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return near_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; ``n_chars`` follows the new text. No document goes."""
    done = pii.replace(docs, KEY, out="pii_entities")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("pii_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: the documents that the mix takes, with ``copies``, how often it takes each (1 to 3)."""
    mixed = mixing.mix(docs).filter("taken > 0")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"], (F.col("taken") / F.col("size")).cast("long").alias("copies"))


STAGES = [
    ("quality_rules", quality), ("near_join", near_copies), ("decontaminate", benchmark), ("pii_surrogates", private), ("mix_sources", mix),
]
#: SQL cannot state the surrogates; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
