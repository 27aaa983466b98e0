"""What the training-data operators share: tables, shared folders, word rules."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D.
GAP_CHARS = " \t\n\x0b\f\r"
GAP_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"tasklattice-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text; null or blank text gives an empty array."""
    bare = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, GAP_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        name, k = f"{stem}_{k}", k + 1
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of ``rows``, unless the session sets a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def sealed(df: DataFrame, kept: list[str], results: list[str]) -> DataFrame:
    """``df`` with the columns ``kept`` and then ``results``, such that later filters on results stay above them.

    A filter that the optimiser pushes below a projection takes the results'
    expressions with it, and an array that was computed once for a row is then
    computed anew for each element that a lambda visits.  A generator stops it.
    """
    seal = fresh_name(df, "_sealed")
    own = [F.col(f"`{c}`") for c in kept]
    return df.select(*own, F.explode(F.array(F.struct(*results))).alias(seal)).select(*own, f"{seal}.*")
