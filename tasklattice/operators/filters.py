"""Named filters, the predicate language, and searches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.functions import scalars as fn


def one_per_id(issues: DataFrame) -> DataFrame:
    """The row of each id that was created last."""
    return issues.groupBy("id").agg(F.max_by("status", F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), "status")).alias("status"))


def open_blockers(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """Blocking dependencies whose target exists and is not closed-like; a missing target never blocks."""
    live = issues.where(~fn.closed_like(F.col("status"))).select(F.col("id").alias("depends_on_id"))
    return deps.where(fn.blocking(F.col("type"))).join(live.distinct(), "depends_on_id", "left_semi")


def ready(issues: DataFrame, deps: DataFrame) -> DataFrame:
    held = open_blockers(issues, deps).select(F.col("issue_id").alias("id"))
    return issues.where(~fn.closed_like(F.col("status")) & (F.col("status") != "blocked")).join(held, "id", "left_anti")


def list_filter(issues: DataFrame, deps: DataFrame, name: str, unknown_keeps: bool = False) -> DataFrame:
    """'all', 'open', 'closed', 'ready' or 'label:x'.  Other names keep nothing, or in the tree everything."""
    if name in ("", "all"):
        return issues
    if name == "open":
        return issues.where(~fn.closed_like(F.col("status")))
    if name == "closed":
        return issues.where(fn.closed_like(F.col("status")))
    if name == "ready":
        return ready(issues, deps)
    if name.startswith("label:"):
        return issues.where(F.array_contains("labels", name[6:]))
    return issues if unknown_keeps else issues.limit(0)


def workspace_filter(prefix: Column, repos: list[str] | None) -> Column:
    """Rows without a prefix always pass; None passes all."""
    return F.lit(True) if repos is None else F.lower(prefix).isin(*repos) | (prefix == "")


def open_if_huge(issues: DataFrame, huge: int = 20_000) -> DataFrame:
    """All rows of fewer than ``huge`` issues, of more only those that are not closed."""
    return issues if issues.count() < huge else issues.where(~fn.closed_like(F.col("status")))


def repo_filter(item_id: Column, source_repo: Column, repo: str) -> Column:
    f = repo.lower()
    return F.lower(item_id).startswith(f) | (~source_repo.isin("", ".") & F.lower(source_repo).startswith(f))


def recipe_status(status: Column, wanted: str) -> Column:
    wanted = wanted.lower()
    return fn.closed_like(status) if wanted == "closed" else F.lower(status) == wanted


@dataclass(frozen=True)
class Predicate:
    field: str
    value: str
    negated: bool = False


def parse_predicates(query: str) -> list[Predicate]:
    """``field:value``, ``!field:value`` and ``!status`` tokens; all other tokens form one phrase."""
    found, phrase = [], []
    for token in query.split():
        body = token.removeprefix("!")
        field, colon, value = body.partition(":")
        if colon and field:
            found.append(Predicate(field.lower(), value.lower(), body != token))
        elif body != token:
            found.append(Predicate("status", body.lower(), True))
        else:
            phrase.append(token.lower())
    return found + [Predicate("", " ".join(phrase))] * bool(phrase)


def predicate_column(p: Predicate) -> Column:
    known = {
        "status": lambda: F.lower("status") == p.value,
        "priority": lambda: F.col("priority").cast("string") == p.value,
        "type": lambda: F.lower("issue_type") == p.value,
        "": lambda: contains_text(p.value),
    }
    match = known.get(p.field, lambda: F.lit(False))()
    return ~match if p.negated else match


def predicates(query: str) -> Column:
    return reduce(lambda a, b: a & b, map(predicate_column, parse_predicates(query)), F.lit(True))


def contains_text(text: str) -> Column:
    return F.lower("title").contains(text.lower()) | F.lower("id").contains(text.lower())


def is_advanced(query: str) -> bool:
    return ":" in query or query.startswith("!")


def search(query: str) -> Column:
    """A substring of title or id, or the predicate language if the query looks like it."""
    return predicates(query) if is_advanced(query) else contains_text(query)


def occur(pattern: str) -> Column:
    """A regular expression on title or id, letter case aside; an invalid one is taken literally."""
    try:
        re.compile(pattern)
    except re.error:
        return contains_text(pattern)
    return F.col("title").rlike(f"(?i){pattern}") | F.col("id").rlike(f"(?i){pattern}")


def fuzzy(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose best score over ``columns`` is positive, with ``score``, best first; a blank query keeps all."""
    if not query.strip():
        return df.withColumn("score", F.lit(0)).orderBy(*columns)
    scores = [fn.fuzzy_score(F.col(c), query.strip()) for c in columns]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return df.withColumn("score", best).where("score > 0").orderBy(F.desc("score"), *columns)


def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")
