"""Content hash and size of a set of issues."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL, END = "\x00", "\x01"

#: Fixed order of the text fields in the canonical form.
TEXT_FIELDS = ("id", "title", "description", "notes", "design", "acceptance_criteria", "assignee", "source_repo", "external_ref", "status", "issue_type")


def _time(c: Column) -> Column:
    """RFC 3339 in UTC, fractions without closing zeros."""
    whole, part = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.when(c.isNull(), "").otherwise(F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z")))


def canonical(df: DataFrame) -> Column:
    """The canonical text of one issue.  A missing created or updated time is that of year 1."""
    have = set(df.columns)
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    time = lambda c, none: F.when(F.col(c).isNull(), none).otherwise(_time(F.col(c))) if c in have else F.lit(none)
    zero = "0001-01-01T00:00:00Z"
    parts = [F.concat(field(c), F.lit(NUL)) for c in TEXT_FIELDS]
    parts += [F.concat(F.coalesce(F.col("priority"), F.lit(0)).cast("string"), F.lit(NUL))]
    parts += [F.concat(time(c, none), F.lit(NUL)) for c, none in (("created_at", zero), ("updated_at", zero), ("closed_at", ""))]
    each = lambda a, f: F.concat(F.array_join(F.transform(a, f), ""), F.lit(NUL))
    labels = F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))) if "labels" in have else F.array().cast("array<string>")
    parts.append(each(labels, lambda x: F.concat(x, F.lit(NUL))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    if "dependencies" in have:
        deps = F.array_sort(F.transform("dependencies", lambda d: F.struct(blank(d["depends_on_id"]).alias("a"), blank(d["type"]).alias("b"))))
        parts.append(each(deps, lambda d: F.concat(d["a"], F.lit(NUL), d["b"], F.lit(NUL))))
    else:
        parts.append(F.lit(NUL))
    if "comments" in have:
        notes = F.array_sort(F.transform("comments", lambda c: F.struct(c["id"].cast("string").alias("a"), blank(c["text"]).alias("b"))))
        parts.append(F.array_join(F.transform(notes, lambda c: F.concat(c["a"], F.lit(NUL), c["b"], F.lit(NUL))), ""))
    return F.concat(*parts, F.lit(END))


def data_hash(issues: DataFrame) -> str:
    """First 16 hex digits of the SHA-256 over the canonical texts in order of id; 'empty' without issues.

    The texts are made and sorted by all tasks; the driver streams them, a
    partition at a time, through the one hash that needs them in order.
    """
    rows = issues.select("id", canonical(issues).alias("text")).sort("id", "text")
    h, n = hashlib.sha256(), 0
    for r in rows.select("text").toLocalIterator():
        h.update(r["text"].encode())
        n += 1
    return h.hexdigest()[:16] if n else "empty"


def unordered_hash(issues: DataFrame) -> DataFrame:
    """(n, hash): equal for equal sets of issues, from one aggregation; for sets too large for one ordered pass."""
    h = F.xxhash64(canonical(issues))
    return issues.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))


def snapshot_bytes(issues: DataFrame) -> DataFrame:
    """(bytes): texts, and fixed costs of 256 an issue, 16 a label, 64 a dependency and 128 a comment."""
    have = set(issues.columns)
    texts = ("id", "title", "description", "design", "acceptance_criteria", "notes", "assignee", "source_repo", "external_ref")
    size = F.lit(256).cast("long")
    long = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    for c in texts:
        if c in have:
            size = size + long(F.col(c))
    total = lambda a, f: F.aggregate(F.coalesce(F.transform(a, f), F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    if "labels" in have:
        size = size + total("labels", lambda x: 16 + long(x))
    if "dependencies" in have:
        size = size + total("dependencies", lambda d: 64 + long(d["issue_id"]) + long(d["depends_on_id"]) + long(d["created_by"]))
    if "comments" in have:
        size = size + total("comments", lambda c: 128 + long(c["text"]) + long(c["author"]))
    return issues.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
