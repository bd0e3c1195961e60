"""From raw documents to a training mix: quality, near duplicates, benchmark leaks, secrets, source weights.

Every stage takes the documents that the one before kept and gives back the columns of documents; the last adds how often the
mix takes each. Stages are written as Parquet and read again, so each is computed once and lineage stays short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.decontaminate import without_leaks
from foreshock.llm.mixing import cuts, measured, mixed
from foreshock.llm.near_dup import without_copies
from foreshock.llm.quality_model import THRESHOLD, train, with_score
from foreshock.llm.secrets import mask_secrets
from foreshock.sources.tables import cut_lineage, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees give at least ``THRESHOLD``. The trees learn from labelled rows of ``docs``."""
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, trees, COLUMNS, "_score").where(F.col("_score") >= THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 percent), the one with the smallest id."""
    return without_copies(docs.select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark, reworded or not."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mask_credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and lengths counted anew."""
    masked = mask_secrets(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies and words taken."""
    rows = cut_lineage(measured(docs))
    mix = mixed(measured(docs, ("text", "lang", "n_chars")), cuts(rows)).where("copies > 0")
    return mix.select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_credentials),
    ("source mix", mix_sources),
]

#: The stages are hashed, learned and sampled; they are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
