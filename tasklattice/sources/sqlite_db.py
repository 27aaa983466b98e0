"""Issues from SQLite, through a Python data source.

The file is opened where the reader runs: for one file on one machine that is
the driver's machine or a shared folder.  Key ranges of the row id make the
partitions, so a large table is read by several tasks.  Equalities and lists of
texts and whole numbers are pushed into the database's own WHERE.
"""

from __future__ import annotations

import datetime as dt
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from tasklattice.functions.scalars import string_array

REQUIRED = ("id", "title", "status")
COLUMNS = {
    "id": "string", "title": "string", "description": "string", "status": "string", "priority": "int", "issue_type": "string", "assignee": "string",
    "estimated_minutes": "int", "created_at": "timestamp", "updated_at": "timestamp", "due_date": "timestamp", "closed_at": "timestamp", "external_ref": "string",
    "compaction_level": "int", "compacted_at": "timestamp", "compacted_at_commit": "string", "original_size": "int", "labels": "string", "design": "string",
    "acceptance_criteria": "string", "notes": "string", "source_repo": "string", "tombstone": "int",
}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "4"))
        self.where, self.values = "", []

    def pushFilters(self, filters):
        """Takes the equalities on text and whole numbers of columns that the table has; the others stay with the caller."""
        have = set(columns_of(self.path, self.table))
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if name in have and kinds.get(name) in ("string", "int", "bigint") and values and None not in values:
                self.where += f' AND "{name}" IN ({", ".join("?" * len(values))})'
                self.values += values
            else:
                yield f

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range):
        names = self.schema.fieldNames()
        kinds = [f.dataType.simpleString() for f in self.schema.fields]
        with self._open() as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            wanted = ", ".join(f'"{c}"' if c in have else f'NULL AS "{c}"' for c in names)
            for row in db.execute(f'SELECT {wanted} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?{self.where}', (partition.low, partition.high, *self.values)):
                try:
                    yield tuple(_cell(v, k) for v, k in zip(row, kinds, strict=True))
                except (TypeError, ValueError):
                    continue


def _cell(value, kind: str):
    if value is None:
        return None
    if kind in ("int", "bigint"):
        return int(value)
    if kind == "timestamp":
        if isinstance(value, (int, float)):
            return dt.datetime.fromtimestamp(value, dt.timezone.utc)
        text = str(value).strip()
        if not text:
            return None
        head, dot, tail = text.partition(".")
        digits = len(tail) - len(tail.lstrip("0123456789"))
        stamp = dt.datetime.fromisoformat((head + dot + tail[: min(digits, 6)] + tail[digits:]).replace("Z", "+00:00"))
        return stamp if stamp.tzinfo else stamp.replace(tzinfo=dt.timezone.utc)
    return str(value)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def table(spark: SparkSession, path: str, name: str, schema: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_table").schema(schema).options(table=name, partitions=str(partitions)).load(path)


def write_table(df: DataFrame, path: str, name: str, batch: int = 10_000) -> None:
    """``df`` as a new table of the database on the driver's machine; rows come a partition at a time."""
    kinds = {"int": "INTEGER", "bigint": "INTEGER"}
    rows = df.toLocalIterator()
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)} {kinds.get(t, "TEXT")}" for c, t in df.dtypes)})')
        while part := [tuple(r) for _, r in zip(range(batch), rows)]:
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', part)


def columns_of(path: str, name: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[1] for r in db.execute(f'PRAGMA table_info("{name}")')]


def validate(path: str) -> str | None:
    """What is wrong with the database, or None.  An empty table is valid."""
    try:
        have = columns_of(path, "issues")
    except sqlite3.Error as e:
        return str(e)
    if not have:
        return "no table issues"
    missing = [c for c in REQUIRED if c not in have]
    return f"missing columns: {', '.join(missing)}" if missing else None


def _live() -> Column:
    return F.coalesce("tombstone", F.lit(0)) == 0


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    if not columns_of(path, "dependencies"):
        return spark.createDataFrame([], "issue_id string, depends_on_id string, type string")
    rows = table(spark, path, "dependencies", "issue_id string, depends_on_id string, dependency_type string")
    return rows.withColumnRenamed("dependency_type", "type")


def comments(spark: SparkSession, path: str) -> DataFrame:
    schema = "id bigint, issue_id string, author string, text string, created_at timestamp"
    return table(spark, path, "comments", schema) if columns_of(path, "comments") else spark.createDataFrame([], schema)


def read_issues(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Live issues with labels, dependencies and comments; columns that the table lacks are null.

    ``where`` reads the issue's own columns, and its equalities go into the database.

    The order of the source (updated last first) is an explicit sort for the
    caller, :func:`latest_first`.  Statuses are taken as they stand.
    """
    rows = table(spark, path, "issues", ", ".join(f"{c} {t}" for c, t in COLUMNS.items())).where(_live()).drop("tombstone")
    rows = rows.withColumn("labels", string_array(F.col("labels")))
    if where is not None:
        rows = rows.where(where)
    d = dependencies(spark, path).groupBy(F.col("issue_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("issue_id", "depends_on_id", "type"))).alias("dependencies"))
    c = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "issue_id", "author", "text"))), lambda x: F.struct(x["id"], x["issue_id"], x["author"], x["text"], x["created_at"]))
    notes = comments(spark, path).groupBy(F.col("issue_id").alias("key")).agg(c.alias("comments")).withColumnRenamed("key", "id")
    return rows.join(d, "id", "left").join(notes, "id", "left")


def latest_first(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.desc_nulls_last("updated_at"), "id")


def count_issues(spark: SparkSession, path: str) -> int:
    return table(spark, path, "issues", "id string, tombstone int").where(_live()).count()


def issue_by_id(spark: SparkSession, path: str, item_id: str) -> DataFrame:
    found = latest_first(read_issues(spark, path, F.col("id") == item_id)).limit(1)
    if found.isEmpty():
        raise LookupError(item_id)
    return found


def last_modified(spark: SparkSession, path: str) -> dt.datetime | None:
    """Tombstones count."""
    return table(spark, path, "issues", "updated_at timestamp").agg(F.max("updated_at")).first()[0]
