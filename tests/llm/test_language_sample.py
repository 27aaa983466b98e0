"""The training sample of op9 holds distinct texts, however often each is copied."""

import numpy as np
from pyspark.sql import functions as F

from tasklattice.llm import language_id as li


def by_hash(spark, n):
    """Texts in the order of their hashes, and the hashes."""
    rows = spark.range(n).select(F.concat(F.lit("la maison numero "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text")).withColumn("h", F.xxhash64("text"))
    return [(r.text, r.h) for r in rows.orderBy("h").collect()]


def test_language_of_few_texts_with_many_copies_is_trained(spark):
    few = [t for t, h in by_hash(spark, 60) if h > 0][:3]
    rows = spark.createDataFrame([("fr", t) for t in few], "declared string, text string").crossJoin(spark.range(2000)).drop("id")
    assert li.fit(rows).languages == ("fr",)


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    texts = [t for t, _ in by_hash(spark, 500)]
    once = spark.createDataFrame([("fr", t) for t in texts], "declared string, text string")
    copied = once.union(once.where(F.col("text") == texts[0]).crossJoin(spark.range(1000)).drop("id"))
    seen, want = (li.fit(rows).table for rows in (copied, once))
    assert np.array_equal(seen > seen.min(), want > want.min())
