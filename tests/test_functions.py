import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from tasklattice.functions import scalars as fn
from tasklattice.operators import diff, filters, rollups

NOW = dt.datetime(2026, 3, 1, 12)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


def text(spark, f, value):
    return one(spark, f(F.col("s")), s=("string", value))


def test_ids_and_text(spark):
    assert [text(spark, fn.repo_prefix, x) for x in ("api-1", "web:2", "lib_3", "toolongprefix-1", "a.b-1", "", "plain")] == ["api", "web", "lib", "", "", "", ""]
    assert [text(spark, fn.short_suffix, x) for x in ("a-b-12", "a-", "x")] == ["12", "a-", "x"]
    assert [text(spark, lambda s: fn.truncate(s, n), "abcdef") for n in (0, 2, 4, 6)] == ["", "ab", "abc…", "abcdef"]
    assert text(spark, fn.created_id, "x\nCreated issue: ab-1 \ny") == "ab-1"


@pytest.mark.parametrize("s", ["plain", "日本語", "a日", "é", "é", "🚀 go", ""])
def test_display_width(spark, s):
    expected = sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)
    assert text(spark, fn.display_width, s) == expected
    assert len(text(spark, lambda c: fn.pad_right(c, 12), s)) == len(s) + 12 - expected


def test_times(spark):
    rel = lambda t: one(spark, fn.relative_time(F.col("t"), F.lit(NOW).cast("timestamp_ntz")), t=("timestamp_ntz", t))
    ago = lambda **k: NOW - dt.timedelta(**k)
    assert [rel(t) for t in (None, ago(days=-1), ago(seconds=59), ago(minutes=5), ago(hours=3), ago(days=6), ago(days=8), ago(days=65))] == ["unknown", "now", "now", "5m ago", "3h ago", "6d ago", "1w ago", "2mo ago"]
    days = lambda t: one(spark, fn.age_days(F.col("t"), F.lit(NOW).cast("timestamp_ntz")), t=("timestamp_ntz", t))
    assert [days(t) for t in (None, ago(hours=23), ago(hours=49), ago(hours=-30))] == [0, 0, 2, -1]


def test_fuzzy_score(spark):
    score = lambda label, q: text(spark, lambda s: fn.fuzzy_score(s, q), label)
    assert [score("abc", "ABC"), score("abcd", "ab"), score("xabx", "ab"), score("abc", "ac"), score("abc", "ca"), score("a-b", "ab")] == [1000, 502, 202, 40, 0, 55]


def test_lists_and_buckets(spark):
    arr = lambda f, v: one(spark, f(F.col("a")), a=("array<string>", v))
    assert arr(fn.normalised_prefixes, [" API- ", "api:", "", "-_", "Web_"]) == ["api", "web"]
    assert [arr(lambda a: fn.repo_list(a, n), ["api", "web", "lib"]) for n in (0, 2, 3)] == ["3 repos", "api,web+1", "api,web,lib"]
    num = lambda f, v: one(spark, f(F.col("v")), v=("double", v))
    assert [num(lambda v: fn.sparkline(v, 4), x) for x in (float("nan"), 0.0, 0.01, 0.5, 1.0, 9.0)] == ["    ", "    ", "▂   ", "██  ", "████", "████"]
    assert [num(fn.heat_bucket, x) for x in (0.9, 0.8, 0.3, 0.2)] == ["peak", "high", "mid", "low"]
    assert [text(spark, fn.string_array, x) for x in (None, "", "null", "[]", '["a","b"]', "[a, 'b']")] == [None, None, None, None, ["a", "b"], ["a", "b"]]


def test_breadcrumb(spark):
    crumb = lambda types, titles, w=80: one(spark, fn.breadcrumb(F.col("t"), F.col("n"), w), t=("array<string>", types), n=("array<string>", titles))
    assert crumb(["epic"], ["A"]) == "" and crumb(["epic", ""], ["A", "B"]) == "Epic: A > Issue: B"
    assert crumb(["epic", "task"], ["A" * 50, "B"], 20).startswith("...") and len(crumb(["epic", "task"], ["A" * 50, "B"], 20)) == 20


def test_predicate_language(spark):
    p = filters.Predicate
    assert filters.parse_predicates("  Fix Status:Open !type:bug !closed :x it ") == [p("status", "open"), p("type", "bug", True), p("status", "closed", True), p("", "fix :x it")]
    rows = spark.createDataFrame([("a-1", "Fix it", "open", 1, "bug"), ("a-2", "Other", "closed", 2, "task")], "id string, title string, status string, priority int, issue_type string")
    ids = lambda q: [r.id for r in rows.where(filters.search(q)).orderBy("id").collect()]
    assert [ids(q) for q in ("priority:1", "!closed", "owner:x", "!owner:x", "fix", "A-2", "")] == [["a-1"], ["a-1"], [], ["a-1", "a-2"], ["a-1"], ["a-2"], ["a-1", "a-2"]]
    assert [r.id for r in rows.where(filters.occur("[")).collect()] == [] and rows.where(filters.occur("^fix")).count() == 1
    assert filters.list_filter(rows, None, "nonsense").count() == 0 and filters.list_filter(rows, None, "nonsense", True).count() == 2


def test_diff_and_top_k(spark):
    a = spark.createDataFrame([("1", "open"), ("2", "open"), ("3", "tombstone")], "id string, status string")
    b = spark.createDataFrame([("2", "closed"), ("4", "open")], "id string, status string")
    assert sorted((r.kind, r.id) for r in diff.diff_sources(a, b).collect()) == [("missing_in_a", "4"), ("missing_in_b", "1"), ("status_mismatch", "2")]
    assert diff.diff_sources(a, b, tombstones=True).count() == 4
    assert {r.line for r in diff.summary(diff.diff_sources(a, b)).collect()} == {"missing_in_a 1: 4", "missing_in_b 1: 1", "status_mismatch 1: 2"}
    scored = spark.createDataFrame([("x", -1.0), ("y", 5.0), ("z", 5.0)], "id string, s double")
    top = lambda k: [r.id for r in rollups.top_k(scored, k, "s", [F.asc("id")]).collect()]
    assert [top(k) for k in (-1, 0, 2, 9)] == [[], [], ["y", "z"], ["y", "z", "x"]]
