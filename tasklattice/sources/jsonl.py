"""Issues and sprints from JSON Lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice import schema

#: Lines of this size or more are skipped.
MAX_LINE_BYTES = 10 * 1024 * 1024
SPRINT_LINE_BYTES = 1024 * 1024


def without_mark(value: Column) -> Column:
    """Drops a byte order mark; only a file's first line can begin with one."""
    return F.regexp_replace(value, "^\\x{FEFF}", "")


def normal_status(status: Column) -> Column:
    """Lower case without outer blanks; a blank status stays and fails validation."""
    return F.when(F.trim(status) != "", F.lower(F.trim(status))).otherwise(status)


def reject_reason(i: Column) -> Column:
    """Why an issue struct is invalid, or null."""
    return (
        F.when(F.coalesce(i["id"], F.lit("")) == "", "no id")
        .when(F.coalesce(i["title"], F.lit("")) == "", "no title")
        .when(~F.coalesce(i["status"], F.lit("")).isin(*schema.STATUSES), "unknown status")
        .when(F.coalesce(i["issue_type"], F.lit("")) == "", "no type")
        .when(F.coalesce(i["updated_at"] < i["created_at"], F.lit(False)), "updated before created")
    )


def parse(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(issues, warnings) of ``lines`` (value): bad lines are skipped, each with a reason, never fatal."""
    with_bad = schema.ISSUE.add("_bad", "string") if "_bad" not in schema.ISSUE.fieldNames() else schema.ISSUE
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    value = without_mark(F.col("value"))
    rows = lines.where(F.trim(value) != "").select(value.alias("value"), (F.octet_length("value") >= max_bytes).alias("long"))
    # The generator keeps later filters from taking the parse with them, so each line is parsed once.
    parsed = F.when(~F.col("long"), F.from_json("value", with_bad, options))
    rows = rows.select("value", "long", F.explode(F.array(parsed)).alias("i"))
    rows = rows.withColumn("i", F.when(F.col("i").isNotNull(), F.col("i").withField("status", normal_status(F.col("i.status")))))
    reason = F.when(F.col("long"), "line too long").when(F.col("i").isNull() | F.col("i._bad").isNotNull(), "malformed").otherwise(reject_reason(F.col("i")))
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(*[_filled(f.name) for f in schema.ISSUE.fields if f.name != "_bad"])
    return good, rows.where("reason is not null").select(F.left("value", F.lit(200)).alias("line"), "reason")


def _filled(name: str) -> Column:
    c = F.col(f"i.{name}")
    if name in schema.BLANK_TEXT:
        c = F.coalesce(c, F.lit(""))
    elif name in schema.ZERO_INT:
        c = F.coalesce(c, F.lit(0))
    elif name in ("labels", "dependencies", "comments"):
        c = F.filter(F.coalesce(c, F.array().cast(schema.ISSUE[name].dataType)), lambda x: x.isNotNull())
    return c.alias(name)


def read_issues(spark: SparkSession, path: str, where: Column | None = None, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Valid issues of a file or folder; ``where`` is applied after validation.  A missing path is an error."""
    issues, _ = parse(spark.read.text(path), max_bytes)
    return issues if where is None else issues.where(where)


def read_warnings(spark: SparkSession, path: str, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    return parse(spark.read.text(path), max_bytes)[1]


def line_count(spark: SparkSession, path: str) -> int:
    """Lines, a last one without line end included."""
    return spark.read.text(path).count()


def validate(spark: SparkSession, path: str, threshold: float = 0.10) -> DataFrame:
    """(good, bad, valid): lines with the keys id, title and status, and whether few enough lack them; empty is valid."""
    limit = threshold or 0.10
    keys = F.from_json(without_mark(F.col("value")), "map<string,string>", {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.map_contains_key(keys, "id") & F.map_contains_key(keys, "title") & F.map_contains_key(keys, "status"), F.lit(False))
    counts = spark.read.text(path).where(F.trim("value") != "").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))
    return counts.withColumn("valid", (F.col("bad") == 0) | (F.col("bad") / (F.col("good") + F.col("bad")) <= limit))


def edges(issues: DataFrame) -> DataFrame:
    """The dependencies of ``issues``: issue_id, depends_on_id, type."""
    rows = issues.select("id", F.explode("dependencies").alias("d"))
    return rows.select(F.col("id").alias("issue_id"), F.coalesce("d.depends_on_id", F.lit("")).alias("depends_on_id"), F.coalesce("d.type", F.lit("")).alias("type"))


def read_sprints(spark: SparkSession, path: str) -> DataFrame:
    """Valid sprints; a missing file gives none, a line over a megabyte is an error."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema.SPRINT)
    value = F.when(F.octet_length("value") > SPRINT_LINE_BYTES, F.raise_error(F.lit("sprint line too long"))).otherwise(without_mark(F.col("value")))
    rows = lines.where(F.trim("value") != "").select(F.from_json(value, schema.SPRINT, {"mode": "PERMISSIVE"}).alias("s")).where("s is not null").select("s.*")
    named = rows.where("coalesce(id, '') <> '' and coalesce(name, '') <> ''")
    return named.where(~F.coalesce(F.col("end_date") < F.col("start_date"), F.lit(False)))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON Lines.  The committer publishes a task's file whole or not at all."""
    df.write.mode("overwrite").json(path)


def apply_updates(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """``issues`` with the non-null cells of ``updates`` (id, ...) in place."""
    cells = [c for c in updates.columns if c != "id"]
    one = updates.groupBy("id").agg(*[F.last(c, ignorenulls=True).alias(f"new_{c}") for c in cells])
    rows = issues.join(one, "id", "left")
    return rows.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in cells else F.col(c) for c in issues.columns])


def edit_delta(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, value) of the cells that changed."""
    old = before.select("id", *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    rows = after.join(old, "id")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"old_{f}").alias("old")) for f in fields]))
    return rows.select("id", cells.alias("c")).where("not (c.value <=> c.old)").select("id", "c.field", "c.value")
