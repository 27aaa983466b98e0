"""Queries of the operators that read and write files: each writes the tables' rows to the shared folder and reads them back."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.operators import rollups
from tasklattice.plans.catalogue import CLOSED, C, query
from tasklattice.sources import catalog, git_history, jsonl, sqlite_db, tables
from tasklattice.streaming import snapshots
from tasklattice.workspace import scratch


def _local(spark, stem: str) -> str:
    """A scratch folder as a plain path; these operators open files by path, as their users do."""
    path = scratch(spark, stem).removeprefix("file:").replace("///", "/")
    os.makedirs(path)
    return path


def _json_lines(issues: DataFrame) -> DataFrame:
    names = [c for c in ("id", "title", "status", "priority", "issue_type", "assignee", "labels") if c in issues.columns]
    return issues.select(F.to_json(F.struct(*names)).alias("value"))


def _file_of(issues: DataFrame, path: str) -> None:
    """One JSON Lines file at ``path``, put together from the files that executors wrote."""
    parts = scratch(issues.sparkSession, "lines")
    _json_lines(issues).write.text(parts)
    with open(path, "wb") as f:
        for part in sorted(glob.glob(parts.removeprefix("file:").replace("///", "/") + "/part-*")):
            with open(part, "rb") as p:
                shutil.copyfileobj(p, f)
            os.unlink(part)


def _database(spark, sf_dir: str, narrow: bool = False) -> str:
    """A database of issues (each 19th a tombstone row), dependencies and comments."""
    path = f"{_local(spark, 'db')}/beads.db"
    wide = tables.issues(spark, sf_dir, not narrow)
    text = lambda c: C(c).cast("string").alias(c)
    columns = ["id", "title", "status", "priority", "issue_type", text("created_at")]
    if narrow:
        sqlite_db.write_table(wide.select(*columns), path, "issues")
        return path
    labels = F.to_json("labels").alias("labels")
    sqlite_db.write_table(wide.select(*columns, text("updated_at"), "assignee", "source_repo", labels, F.when(C("key") % 19 == 0, 1).otherwise(0).alias("tombstone")), path, "issues")
    sqlite_db.write_table(tables.dependencies(spark, sf_dir).select("issue_id", "depends_on_id", C("type").alias("dependency_type")), path, "dependencies")
    notes = tables.read(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.concat(F.lit("ord-"), C("o_orderkey").cast("string")).alias("issue_id"), C("o_orderpriority").alias("text"), C("o_orderdate").cast("string").alias("created_at"))
    sqlite_db.write_table(notes, path, "comments")
    return path


# JSON Lines


@query("a04_rescan", "SELECT id, 2::BIGINT AS n FROM issues")
def a04(spark, sf_dir):
    path = scratch(spark, "issues")
    _json_lines(tables.issues(spark, sf_dir)).write.text(path)
    twice = jsonl.read_issues(spark, path).select("id").union(jsonl.read_issues(spark, path).select("id"))
    return twice.groupBy("id").agg(F.count("*").alias("n"))


@query("a05_byte_order_mark", "SELECT id, title FROM issues")
def a05(spark, sf_dir):
    marked = _json_lines(tables.issues(spark, sf_dir)).select(F.concat(F.lit("﻿"), "value").alias("value"))
    return jsonl.parse(marked)[0].select("id", "title")


@query("a06_status_normalised", "SELECT id, status FROM issues")
def a06(spark, sf_dir):
    rows = tables.issues(spark, sf_dir).withColumn("status", F.concat(F.lit(" \t"), F.upper("status"), F.lit("  ")))
    return rows.select("id", jsonl.normal_status(F.translate("status", "\t", " ")).alias("status"))


@query("a07_row_validation", "SELECT CASE key % 10 WHEN 0 THEN 'no id' WHEN 1 THEN 'no title' WHEN 2 THEN 'unknown status' WHEN 3 THEN 'no type' ELSE 'kept' END AS reason, count(*) AS n FROM issues GROUP BY 1")
def a07(spark, sf_dir):
    k = C("key") % 10
    faulty = {"id": F.when(k == 0, "").otherwise(C("id")), "title": F.when(k == 1, "").otherwise(C("title")), "status": F.when(k == 2, "lost").otherwise(C("status")), "issue_type": F.when(k == 3, "").otherwise(C("issue_type"))}
    good, bad = jsonl.parse(_json_lines(tables.issues(spark, sf_dir).withColumns(faulty)))
    return good.select(F.lit("kept").alias("reason")).union(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("a08_long_lines", "SELECT CASE WHEN octet_length(encode(text)) >= 2000 THEN 'line too long' ELSE 'kept' END AS verdict, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a08(spark, sf_dir):
    """Each document's text gives the length of a line, so that long ones meet the limit of 2,000 bytes."""
    docs = tables.read(spark, sf_dir, "documents").where("text is not null")
    line = F.to_json(F.struct(C("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("open").alias("status"), F.lit("task").alias("issue_type")))
    good, bad = jsonl.parse(docs.select(F.rpad(line, F.greatest(F.octet_length("text"), F.lit(100)), F.lit(" ")).alias("value")), 2000)
    return good.select(F.lit("kept").alias("verdict")).union(bad.select("reason")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("a26_line_count", "SELECT count(*) AS n FROM issues")
def a26(spark, sf_dir):
    path = scratch(spark, "issues")
    _json_lines(tables.issues(spark, sf_dir)).write.text(path)
    return spark.range(1).select(F.lit(jsonl.line_count(spark, path)).cast("long").alias("n"))


# SQLite

LIVE = "key % 19 <> 0"


@query("a09_sqlite_scan", f"SELECT id, title, status, priority, issue_type, assignee, source_repo, array_to_string(labels, ',') AS labels, epoch(created_at)::BIGINT AS created, epoch(updated_at)::BIGINT AS updated FROM issues WHERE {LIVE}")
def a09(spark, sf_dir):
    rows = sqlite_db.read_issues(spark, _database(spark, sf_dir))
    return rows.select("id", "title", "status", "priority", "issue_type", "assignee", "source_repo", F.array_join("labels", ",").alias("labels"), F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))


@query("a10_sqlite_narrow", "SELECT id, title, status, priority, issue_type FROM issues")
def a10(spark, sf_dir):
    rows = sqlite_db.read_issues(spark, _database(spark, sf_dir, narrow=True))
    return rows.select("id", "title", "status", "priority", "issue_type")


@query("a11_sqlite_dependencies", f"SELECT issue_id AS id, count(*) AS n, min(depends_on_id) AS first FROM deps JOIN issues ON id = issue_id WHERE {LIVE} GROUP BY 1")
def a11(spark, sf_dir):
    rows = sqlite_db.read_issues(spark, _database(spark, sf_dir)).where("size(dependencies) > 0")
    return rows.select("id", F.size("dependencies").cast("long").alias("n"), F.array_min(F.transform("dependencies", lambda d: d["depends_on_id"])).alias("first"))


@query("a12_sqlite_comments", f"SELECT 'ord-' || o_orderkey AS id, o_orderpriority AS text FROM orders WHERE o_orderkey % 19 <> 0")
def a12(spark, sf_dir):
    rows = sqlite_db.read_issues(spark, _database(spark, sf_dir))
    return rows.select("id", F.explode("comments").alias("c")).select("id", "c.text")


@query("a14_sqlite_count", f"SELECT count(*) AS n FROM issues WHERE {LIVE}")
def a14(spark, sf_dir):
    return spark.range(1).select(F.lit(sqlite_db.count_issues(spark, _database(spark, sf_dir))).cast("long").alias("n"))


@query("a15_sqlite_lookup", f"SELECT id, title, status FROM issues WHERE key = (SELECT min(key) FROM issues WHERE {LIVE})")
def a15(spark, sf_dir):
    first = tables.issues(spark, sf_dir).where(LIVE.replace("<>", "!=")).agg(F.min("key")).first()[0]
    return sqlite_db.issue_by_id(spark, _database(spark, sf_dir), f"ord-{first}").select("id", "title", "status")


@query("a16_sqlite_last_modified", "SELECT epoch(max(updated_at))::BIGINT AS at FROM issues")
def a16(spark, sf_dir):
    at = sqlite_db.last_modified(spark, _database(spark, sf_dir))
    return spark.range(1).select(F.unix_seconds(F.lit(at)).alias("at"))


@query("n01_pushed_predicate", f"SELECT id, priority FROM issues WHERE {LIVE} AND status = 'open' AND priority = 2")
def n01(spark, sf_dir):
    return sqlite_db.read_issues(spark, _database(spark, sf_dir), (C("status") == "open") & (C("priority") == 2)).select("id", "priority")


# Git


def _repository(spark, sf_dir: str) -> str:
    """Three commits: the open issues, then all, then all with the priority of each 10th raised."""
    repo = _local(spark, "repo")
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x.org", "-c", "core.bigFileThreshold=1m", *a], check=True, capture_output=True, env={**os.environ, "GIT_COMMITTER_DATE": a[-1], "GIT_AUTHOR_DATE": a[-1]} if a[0] == "commit" else None)
    git("init", "-q")
    os.makedirs(f"{repo}/.beads")
    rows = tables.issues(spark, sf_dir)
    versions = (("open ones", rows.where(f"not ({CLOSED})")), ("all", rows), ("raised", rows.withColumn("priority", F.when(C("key") % 10 == 0, 9).otherwise(C("priority")))))
    for k, (name, df) in enumerate(versions):
        _file_of(df, f"{repo}/.beads/issues.jsonl")
        git("add", "-A")
        git("commit", "-q", "-m", name, "--date", f"2024-01-0{k + 1}T12:00:00Z")
    return repo


@query("a17_issues_at_revision", f"SELECT id, status FROM issues WHERE NOT {CLOSED}")
def a17(spark, sf_dir):
    return git_history.History(spark, _repository(spark, sf_dir)).load("HEAD~2").select("id", "status")


@query("a18_issues_at_instant", "SELECT id, priority FROM issues")
def a18(spark, sf_dir):
    return git_history.History(spark, _repository(spark, sf_dir)).load_at(git_history.parse_date("2024-01-02T18:00:00+0000")).select("id", "priority")


@query("a19_resolution", "SELECT * FROM (VALUES ('HEAD~1', 'all'), ('2024-01-01T13:00:00+0000', 'open ones'), ('HEAD', 'raised')) t(revision, message)")
def a19(spark, sf_dir):
    h = git_history.History(spark, _repository(spark, sf_dir))
    asked = ("HEAD~1", "2024-01-01T13:00:00+0000", "HEAD")
    commits = spark.createDataFrame([(r, h.resolve(r)) for r in asked], "revision string, sha string")
    return commits.join(h.revisions(), "sha").select("revision", "message")


@query("a20_commit_log", "SELECT * FROM (VALUES ('open ones', 1704110400::BIGINT), ('all', 1704196800), ('raised', 1704283200)) t(message, moment)")
def a20(spark, sf_dir):
    return git_history.History(spark, _repository(spark, sf_dir)).revisions().select("message", F.unix_seconds("timestamp").alias("moment"))


@query("a21_commit_range", "SELECT * FROM (VALUES ('all'), ('raised')) t(message)")
def a21(spark, sf_dir):
    return git_history.History(spark, _repository(spark, sf_dir)).between("HEAD~2", "HEAD").select("message")


@query("a22_exists_at_revision", "SELECT true AS found")
def a22(spark, sf_dir):
    return spark.range(1).select(F.lit(git_history.History(spark, _repository(spark, sf_dir)).exists_at("HEAD~1")).alias("found"))


@query("a23_revision_cache", "SELECT 2::BIGINT AS total, 2::BIGINT AS valid")
def a23(spark, sf_dir):
    h = git_history.History(spark, _repository(spark, sf_dir))
    for revision in ("HEAD", "HEAD~1", "HEAD"):
        h.load(revision)
    stats = h.cache_stats()
    return spark.range(1).select(*[F.lit(stats[c]).cast("long").alias(c) for c in ("total", "valid")])


# Source catalogue


def _project(spark, sf_dir: str) -> str:
    """A folder with a database, two JSON Lines files and one that is mostly broken; each newer than the one before."""
    path = _database(spark, sf_dir)
    folder = os.path.dirname(path)
    rows = tables.issues(spark, sf_dir)
    _file_of(rows, f"{folder}/issues.jsonl")
    _file_of(rows.where("key % 3 <> 0"), f"{folder}/beads.jsonl")
    with open(f"{folder}/broken.jsonl", "w", encoding="utf-8") as f:
        f.write('{"id": "a"}\n' * 9 + "no json\n")
    for k, name in enumerate(("beads.db", "issues.jsonl", "beads.jsonl", "broken.jsonl")):
        os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return folder


def _sources(spark, folder: str) -> list[catalog.Source]:
    return [s.validate(spark) for s in catalog.discover(folder)]


name_of = lambda c="path": F.element_at(F.split(c, "/"), -1)


@query("a31_discovery", "SELECT * FROM (VALUES ('beads.db', 'sqlite', 100), ('beads.jsonl', 'jsonl_local', 50), ('broken.jsonl', 'jsonl_local', 50), ('issues.jsonl', 'jsonl_local', 50)) t(name, type, priority)")
def a31(spark, sf_dir):
    return catalog.as_table(spark, catalog.discover(_project(spark, sf_dir))).select(name_of().alias("name"), "type", "priority")


@query("a32_source_validation", f"SELECT 'beads.db' AS name, true AS valid, (SELECT count(*) FROM issues WHERE {LIVE}) AS issue_count UNION ALL SELECT 'issues.jsonl', true, (SELECT count(*) FROM issues) UNION ALL SELECT 'beads.jsonl', true, (SELECT count(*) FROM issues WHERE key % 3 <> 0) UNION ALL SELECT 'broken.jsonl', false, 0")
def a32(spark, sf_dir):
    return catalog.as_table(spark, _sources(spark, _project(spark, sf_dir))).select(name_of().alias("name"), "valid", "issue_count")


@query("a33_best_source", "SELECT 'beads.jsonl' AS freshest, 'beads.db' AS foremost")
def a33(spark, sf_dir):
    t = catalog.as_table(spark, _sources(spark, _project(spark, sf_dir)))
    return catalog.best(t).select(name_of().alias("freshest")).join(catalog.best(t, prefer_freshest=False).select(name_of().alias("foremost")))


@query("f06_source_order", "SELECT * FROM (VALUES ('beads.jsonl', 1), ('issues.jsonl', 2), ('beads.db', 3)) t(name, place)")
def f06(spark, sf_dir):
    rows = catalog.ranked(catalog.as_table(spark, _sources(spark, _project(spark, sf_dir)))).select(name_of().alias("name")).collect()
    return spark.createDataFrame([(r["name"], k + 1) for k, r in enumerate(rows)], "name string, place int")


@query("a34_fallback_chain", "SELECT 'beads.jsonl' AS source, count(*) AS n FROM issues WHERE key % 3 <> 0")
def a34(spark, sf_dir):
    source, rows = catalog.load_first(spark, catalog.discover(_project(spark, sf_dir)))
    return rows.agg(F.lit(os.path.basename(source.path)).alias("source"), F.count("*").alias("n"))


@query("a35_smart_load", "SELECT id, status FROM issues WHERE key % 3 <> 0")
def a35(spark, sf_dir):
    folder = _project(spark, sf_dir)
    repo = _local(spark, "project")
    os.rename(folder, f"{repo}/.beads")
    return catalog.smart_load(spark, repo).select("id", "status")


@query("a36_file_choice", "SELECT 'beads.jsonl' AS name")
def a36(spark, sf_dir):
    return spark.range(1).select(F.lit(os.path.basename(catalog.find_jsonl(_project(spark, sf_dir)))).alias("name"))


@query("a43_accessible", "SELECT * FROM (VALUES ('beads.db', true), ('beads.jsonl', true), ('broken.jsonl', true), ('issues.jsonl', true)) t(name, accessible)")
def a43(spark, sf_dir):
    found = [s.refresh() for s in catalog.discover(_project(spark, sf_dir))]
    return spark.createDataFrame([(os.path.basename(s.path), s.accessible() and s.size > 0) for s in found], "name string, accessible boolean")


@query("n02_load_function", "SELECT id FROM issues WHERE key % 3 <> 0 AND priority = 0")
def n02(spark, sf_dir):
    return catalog.load_first(spark, catalog.discover(_project(spark, sf_dir)), lambda s: s.load(spark).where("priority = 0"))[1].select("id")


@query("g02_stored_sources", "SELECT 'issues.jsonl' AS held_by, count(*) AS n FROM issues WHERE key % 3 = 0 AND status <> 'tombstone'")
def g02(spark, sf_dir):
    by = {os.path.basename(s.path): s for s in _sources(spark, _project(spark, sf_dir))}
    rows = catalog.compare(spark, by["issues.jsonl"], by["beads.jsonl"])
    return rows.agg(F.lit("issues.jsonl").alias("held_by"), F.count("*").alias("n"))


@query("d08_all_pairs", "SELECT pair, count(*) AS n FROM (SELECT unnest(['beads.jsonl/issues.jsonl']) AS pair FROM issues WHERE status <> 'tombstone' AND key % 3 = 0 UNION ALL SELECT unnest(['beads.db/issues.jsonl']) FROM issues WHERE status <> 'tombstone' AND key % 19 = 0 UNION ALL SELECT unnest(['beads.db/beads.jsonl']) FROM issues WHERE status <> 'tombstone' AND (key % 19 = 0) <> (key % 3 = 0)) GROUP BY 1")
def d08(spark, sf_dir):
    return catalog.compare_all(spark, _sources(spark, _project(spark, sf_dir))).groupBy("pair").agg(F.count("*").alias("n"))


# Streams


@query("m01_change_stream", "SELECT count(*) AS n FROM issues")
def m01(spark, sf_dir):
    """Files that are already there when the stream starts count as added."""
    folder, out = scratch(spark, "changes"), scratch(spark, "seen")
    _json_lines(tables.issues(spark, sf_dir)).write.text(folder)
    stream = snapshots.change_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True)
    stream.start(out).awaitTermination()
    return jsonl.parse(spark.read.parquet(out))[0].agg(F.count("*").alias("n"))


@query("m04_source_reselection", "SELECT * FROM (VALUES (1, 'beads.jsonl', true), (2, 'beads.jsonl', false), (3, 'issues.jsonl', true)) t(step, name, changed)")
def m04(spark, sf_dir):
    folder = _project(spark, sf_dir)
    follower, rows = snapshots.SourceFollower(spark, folder), []
    for step in (1, 2, 3):
        if step == 3:
            os.utime(f"{folder}/issues.jsonl", (1_800_000_000, 1_800_000_000))
        changed = follower.refresh()
        rows.append((step, os.path.basename(follower.current.path), changed))
    return spark.createDataFrame(rows, "step int, name string, changed boolean")


@query("m05_batches_to_snapshots", f"SELECT count(CASE WHEN NOT {CLOSED} THEN 1 END) AS open_count, count(CASE WHEN {CLOSED} THEN 1 END) AS closed_count FROM issues")
def m05(spark, sf_dir):
    folder = scratch(spark, "changes")
    _json_lines(tables.issues(spark, sf_dir)).write.text(folder)
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    snaps.follow(snapshots.change_stream(spark, folder), scratch(spark, "stream")).awaitTermination()
    return snaps.read("counts").select("open_count", "closed_count")


@query("m08_failure_keeps_snapshot", "SELECT 1::BIGINT AS version, false AS healthy, count(*) AS n FROM issues")
def m08(spark, sf_dir):
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    rows = tables.issues(spark, sf_dir)
    snaps.publish(rows)
    snaps.publish(rows.withColumn("title", F.raise_error(F.lit("broken batch")).cast("string")))
    kept = snaps.metrics()
    return snaps.read().agg(F.lit(kept["version"]).cast("long").alias("version"), F.lit(kept["healthy"]).alias("healthy"), F.count("*").alias("n"))


@query("e15_worker_metrics", "SELECT 1::BIGINT AS version, 1::BIGINT AS passed_over, true AS healthy")
def e15(spark, sf_dir):
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    for _ in range(2):
        snaps.publish(tables.issues(spark, sf_dir))
    found = snaps.metrics()
    return spark.range(1).select(F.lit(found["version"]).cast("long").alias("version"), F.lit(found["passed_over"]).cast("long").alias("passed_over"), F.lit(found["healthy"]).alias("healthy"))
