"""Small documents with the awkward cases that every operator must define."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(20_000))

ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t \r\n", "en", "s", 6),
    (4, "one two three", None, "s", 13),
    (5, "The same text stands here twice, and it is long enough to be hashed in shingles.", "en", "s", 80),
    (6, "The same text stands here twice, and it is long enough to be hashed in shingles.", "en", "s", 80),
    (6, "The same text stands here twice, and it is long enough to be hashed in shingles.", "en", "s", 80),
    (7, LONG, "en", None, len(LONG)),
    (8, LONG + " tail", "en", None, len(LONG)),
    (9, "x" * 50_000, "de", "s", 50_000),
    (10, "Grüße aus Köln – naïve café \U0001f600 " * 30, "de", "t", 1000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def write(spark: SparkSession, df: DataFrame, folder, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
