"""The corpus pipeline: STAGES, each (name, function of (spark, docs, sf_dir)).

Every stage but the last returns the columns of documents; its result is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.llm.common import shared_table
from traitscan.llm.langid import keep_language
from traitscan.llm.linededup import drop_boilerplate
from traitscan.llm.minhash import keep_one
from traitscan.llm.packing import pack_documents
from traitscan.llm.queries import BOILERPLATE_PAGES, SITE_LINE_RATIO, word_bpe_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that are no language go."""
    return keep_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: boilerplate lines of a source go, and documents of nothing else; n_chars follows the text."""
    named = docs.withColumn("_had", F.col("text").rlike(r"\S"))
    clean = drop_boilerplate(named, SITE_LINE_RATIO, BOILERPLATE_PAGES, copies_once=True, counts=False)
    clean = clean.where(F.coalesce(~F.col("_had") | F.col("text").rlike(r"\S"), F.lit(True)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate group stays (five words, 0.8)."""
    return keep_one(docs, width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what is left goes into windows of 4096 tokens."""
    return pack_documents(docs, word_bpe_path(), window=4096, end_id=2)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL has no encoder and no prototypes; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, f"stage-{name}")
    return docs
