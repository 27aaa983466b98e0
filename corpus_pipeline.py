"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and
returns what it keeps with the same columns; the last returns packed pieces.
The caller may write each result and read it again before the next stage.

Rows that share a doc_id share its fate in near-duplicate removal; of rows with
equal doc_id and equal text one stays; a null doc_id is never a near-duplicate.  Empty inputs give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.llm import language_id, near_dedup, packing, pii, quality_rules
from tasklattice.llm.common import checkpointed, fresh_name

#: Ids of removed copies are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_IDS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without an accepted language; ``lang`` becomes the identified one."""
    found = language_id.identify_documents(docs).where("accepted")
    return found.withColumn("lang", F.col("language")).select(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the quality rules; the others lose their failing lines."""
    kept = quality_rules.apply_quality_rules(docs).where("kept")
    return kept.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    gone = checkpointed(near_dedup.link_near_duplicates(docs).where("not kept").select("doc_id").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Only rows that repeat are moved; equal rows are met map-side, however many they are.
    key = fresh_name(docs, "_text_key")
    keyed = rest.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    repeated = checkpointed(keyed.where("doc_id is not null").groupBy("doc_id", key).count().where("count > 1").select("doc_id", key))
    n = repeated.count()
    if not n:
        return rest
    if n <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    once = keyed.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return keyed.join(repeated, ["doc_id", key], "left_anti").unionByName(once).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each span of personal data."""
    found = pii.mask(pii.find_personal_data(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The iterative stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
