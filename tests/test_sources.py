import datetime as dt
import json
import os
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from tasklattice.functions import digest
from tasklattice.operators import filters, hierarchy, rollups
from tasklattice.operators.graph import Graph
from tasklattice.sources import catalog, git_history, graph_json, jsonl, sqlite_db
from tasklattice.streaming import snapshots

GOOD = [
    {"id": "t-1", "title": "First", "status": " Open ", "priority": 1, "issue_type": "epic", "created_at": "2026-01-01T10:00:00Z"},
    {"id": "t-2", "title": "Second", "status": "blocked", "issue_type": "task", "labels": ["a", "b"], "dependencies": [{"depends_on_id": "t-1"}, None]},
    {"id": "t-3", "title": "Third", "status": "closed", "issue_type": "odd", "comments": [{"id": 10, "text": "x"}, {"id": 9, "text": "y"}]},
    {"id": "t-4", "title": "Fourth", "status": "open", "issue_type": "task", "dependencies": [{"depends_on_id": "t-1", "type": "parent-child"}, {"depends_on_id": "t-9", "type": "blocks"}]},
]
BAD = ['{"id": "x"', "{}", '{"id":"b","title":"b","status":"nope","issue_type":"task"}', '{"id":"b","title":"b","status":"open","issue_type":""}', '{"id":"b","title":"","status":"open","issue_type":"bug"}', '{"id":"b","title":"b","status":"open","issue_type":"bug","created_at":"2026-01-02T00:00:00Z","updated_at":"2026-01-01T00:00:00Z"}', '{"id":"b","title":"b","status":"open","issue_type":"bug","priority":"zz"}', "not json"]


def write(path, lines, mark=False):
    with open(path, "w", encoding="utf-8-sig" if mark else "utf-8") as f:
        f.write("\n".join(lines))
    return str(path)


@pytest.fixture
def file(tmp_path):
    return write(tmp_path / "issues.jsonl", [json.dumps(GOOD[0]), "", *BAD, *map(json.dumps, GOOD[1:])], mark=True)


def test_scan_skips_bad_lines(spark, file):
    rows = {r.id: r for r in jsonl.read_issues(spark, file).collect()}
    assert sorted(rows) == ["t-1", "t-2", "t-3", "t-4"]
    assert rows["t-1"].status == "open" and rows["t-2"].priority == 0 and rows["t-2"].description == "" and rows["t-2"].due_date is None
    assert len(rows["t-2"].dependencies) == 1 and rows["t-1"].labels == []
    assert jsonl.read_warnings(spark, file).count() == len(BAD)
    assert jsonl.line_count(spark, file) == len(GOOD) + len(BAD) + 1
    assert jsonl.read_issues(spark, file, F.col("status") == "open").count() == 2
    assert jsonl.read_issues(spark, file, max_bytes=120).count() < 4


def test_ready_and_hash_of_a_scan(spark, file):
    issues = jsonl.read_issues(spark, file)
    deps = jsonl.edges(issues)
    assert sorted(r.id for r in filters.ready(issues, deps).collect()) == ["t-1", "t-4"]
    counts = rollups.status_counts(issues, deps).first()
    assert (counts.open_count, counts.ready_count, counts.blocked_count, counts.closed_count) == (3, 2, 1, 1)
    a = digest.data_hash(issues)
    assert len(a) == 16 and a == digest.data_hash(issues.orderBy(F.desc("id"))) != digest.data_hash(issues.where("id <> 't-1'"))
    assert digest.data_hash(issues.where("false")) == "empty"
    text = issues.where("id = 't-3'").select(digest.canonical(issues)).first()[0]
    assert text.endswith("\x0010\x00x\x009\x00y\x00\x01") and "0001-01-01T00:00:00Z" in text


def test_validation_threshold(spark, tmp_path, file):
    assert not jsonl.validate(spark, file).first().valid
    few = write(tmp_path / "few.jsonl", ['{"id":null,"title":"a","status":"open"}'] * 9 + ["broken"])
    assert jsonl.validate(spark, few).first().valid
    assert jsonl.validate(spark, write(tmp_path / "none.jsonl", [])).first().valid


def test_sprints(spark, tmp_path):
    path = write(tmp_path / "sprints.jsonl", ['{"id":"s","name":"n","bead_ids":["a"],"velocity_target":2.5}', '{"id":"","name":"n"}', '{"id":"s2","name":"n","start_date":"2026-02-01T00:00:00Z","end_date":"2026-01-01T00:00:00Z"}'])
    assert [r.id for r in jsonl.read_sprints(spark, path).collect()] == ["s"]
    assert jsonl.read_sprints(spark, str(tmp_path / "missing.jsonl")).count() == 0
    jsonl.write_lines(jsonl.read_sprints(spark, path), str(tmp_path / "out"))
    assert jsonl.read_sprints(spark, str(tmp_path / "out")).first().bead_ids == ["a"]


def test_graph_json_round_trip(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"description": "d", "nodes": ["a", "b", "c", "a"], "edges": [[0, 1], [3, 2], [1, 9]]}))
    g = graph_json.read_graph(spark, str(path))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 1), (0, 2)]
    assert json.loads(graph_json.to_json(g).first()[0]) == {"nodes": ["a", "b", "c"], "edges": [[0, 1], [0, 2]]}


def test_graph_document_in_lines(spark, tmp_path, monkeypatch):
    """A graph is written by lines of a few elements, which make one document and read back as they were."""
    monkeypatch.setattr(graph_json, "LINE_ELEMENTS", 7)
    names = ['a"', "b,c", "[0,1]", "ü", ",", *[f"n{k}" for k in range(95)]]
    pairs = sorted({(k * 7 % 100, k * 13 % 100) for k in range(300)})
    g = Graph.build(spark.createDataFrame([(3 * k, x) for k, x in enumerate(names)], "id long, name string"), spark.createDataFrame([(3 * a, 3 * b) for a, b in pairs], "src long, dst long"))
    path = tmp_path / "g"
    graph_json.write_graph(g, str(path))
    parts = sorted(path.glob("part-*"))
    assert max(len(x) for p in parts for x in p.read_text().split("\n")) < 200
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["nodes"] == names and whole["edges"] == [list(p) for p in pairs]
    read = graph_json.read_graph(spark, str(path))
    assert sorted((r.id, r.name) for r in read.nodes.collect()) == list(enumerate(names))
    assert sorted((r.src, r.dst) for r in read.edges.collect()) == pairs
    lone = Graph.build(spark.createDataFrame([(5, "x")], "id long, name string"), spark.createDataFrame([], "src long, dst long"))
    graph_json.write_graph(lone, str(tmp_path / "lone"))
    assert graph_json.read_graph(spark, str(tmp_path / "lone")).nodes.count() == 1


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "beads.db")
    with sqlite3.connect(path) as db:
        cols = ", ".join(f"{c} {'INTEGER' if t == 'int' else 'TEXT'}" for c, t in sqlite_db.COLUMNS.items())
        db.execute(f"CREATE TABLE issues ({cols})")
        db.execute("CREATE TABLE dependencies (issue_id TEXT, depends_on_id TEXT, dependency_type TEXT)")
        db.execute("CREATE TABLE comments (id INTEGER, issue_id TEXT, author TEXT, text TEXT, created_at TEXT)")
        for k in range(20):
            db.execute("INSERT INTO issues (id, title, status, priority, issue_type, labels, updated_at, tombstone) VALUES (?,?,?,?,?,?,?,?)", (f"T-{k}", f"t{k}", "open", k % 5, "task", ["", "null", '["x","y"]', "[p, 'q']"][k % 4], f"2026-01-{k + 1:02d}T00:00:00.123456789Z", int(k == 19)))
        db.execute("INSERT INTO dependencies VALUES ('T-1', 'T-2', 'blocks')")
        db.executemany("INSERT INTO comments VALUES (?,?,?,?,?)", [(2, "T-1", "b", "late", "2026-01-02 00:00:00"), (1, "T-1", "a", "early", "2026-01-01 00:00:00")])
    return path


def test_sqlite(spark, database, tmp_path):
    rows = {r.id: r for r in sqlite_db.read_issues(spark, database).collect()}
    assert len(rows) == 19 == sqlite_db.count_issues(spark, database)
    assert rows["T-2"].labels == ["x", "y"] and rows["T-3"].labels == ["p", "q"] and rows["T-0"].labels is None
    assert rows["T-1"].dependencies[0].depends_on_id == "T-2" and [c.text for c in rows["T-1"].comments] == ["early", "late"]
    assert sqlite_db.latest_first(sqlite_db.read_issues(spark, database)).first().id == "T-18"
    assert sqlite_db.issue_by_id(spark, database, "T-3").first().title == "t3"
    with pytest.raises(LookupError):
        sqlite_db.issue_by_id(spark, database, "nope")
    assert sqlite_db.last_modified(spark, database).day == 20
    narrow = str(tmp_path / "narrow.db")
    with sqlite3.connect(narrow) as db:
        db.execute("CREATE TABLE issues (id TEXT PRIMARY KEY, title TEXT, status TEXT)")
        db.execute("INSERT INTO issues VALUES ('A', 'a', 'open')")
    assert sqlite_db.validate(narrow) is None and sqlite_db.read_issues(spark, narrow).first().labels is None
    (tmp_path / "bad.db").write_bytes(b"not a database" * 100)
    assert sqlite_db.validate(str(tmp_path / "bad.db"))


def test_catalog_chooses_the_freshest_valid_source(spark, tmp_path, database):
    folder = tmp_path / ".beads"
    folder.mkdir()
    os.rename(database, folder / "beads.db")
    write(folder / "issues.jsonl", [json.dumps(GOOD[0])])
    write(folder / "beads.left.jsonl", ["x"])
    write(folder / "broken.jsonl", ["x"])
    for k, name in enumerate(("beads.db", "issues.jsonl", "broken.jsonl")):
        os.utime(folder / name, (1000 + k, 1000 + k))
    found = [s.validate(spark) for s in catalog.discover(str(folder))]
    assert {os.path.basename(s.path): s.valid for s in found} == {"beads.db": True, "issues.jsonl": True, "broken.jsonl": False}
    table = catalog.as_table(spark, found)
    assert catalog.best(table).first().path.endswith("issues.jsonl")
    assert catalog.best(table, prefer_freshest=False).first().type == "sqlite"
    assert catalog.ranked(table, max_age_seconds=0.5).count() == 1
    source, issues = catalog.load_first(spark, found)
    assert source.path.endswith("issues.jsonl") and issues.count() == 1
    assert catalog.smart_load(spark, str(tmp_path)).count() == 1
    pairs = catalog.compare_all(spark, found).groupBy("pair", "kind").count().collect()
    assert {(r.pair, r.kind): r["count"] for r in pairs} == {("beads.db/issues.jsonl", "missing_in_a"): 1, ("beads.db/issues.jsonl", "missing_in_b"): 19}
    assert catalog.find_jsonl(str(folder)).endswith("issues.jsonl")
    follower = snapshots.SourceFollower(spark, str(folder))
    assert follower.refresh() and not follower.refresh()
    os.utime(folder / "beads.db", (2000, 2000))
    assert follower.refresh(force=True) and follower.current.type == "sqlite"


def test_projects(tmp_path):
    for name in ("one", "deep/two", "a/b/c/d/far", ".hidden/x"):
        (tmp_path / name / ".beads").mkdir(parents=True)
    config = catalog.Config({"named": str(tmp_path / "one")}, roots=[str(tmp_path)])
    assert sorted(n for n, _ in catalog.discover_projects(config)) == ["named", "two"]
    config.set_favourite(1, "named")
    config.set_favourite(2, "named")
    assert config.favourite(1) is None and config.favourite_number("named") == 2
    config.save(str(tmp_path / "c.json"))
    again = catalog.Config.load(str(tmp_path / "c.json"))
    assert again.projects == config.projects and again.favourites == {2: "named"}
    assert catalog.Config.load(str(tmp_path / "none.json")).projects == {}
    inside = tmp_path / "one" / "sub"
    inside.mkdir()
    assert catalog.current_project(str(inside)) == str(tmp_path / "one")
    assert catalog.project_error(str(tmp_path / "one" / ".beads"))


def test_git_history(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / ".beads").mkdir(parents=True)
    run = lambda *a, when="2026-01-01T00:00:00Z": subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, env={**os.environ, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when})
    run("init", "-q")
    for k in range(3):
        write(repo / ".beads" / "issues.jsonl", [json.dumps(x) for x in GOOD[: k + 1]])
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k} | more", when=f"2026-01-0{k + 1}T00:00:00Z")
    h = git_history.History(spark, str(repo))
    assert [h.load(r).count() for r in ("HEAD", "HEAD~1", "2026-01-01T12:00:00Z")] == [3, 2, 1]
    assert h.load_at(dt.datetime(2026, 1, 2, 12, tzinfo=dt.timezone.utc)).count() == 2
    log = h.revisions().collect()
    assert [r.message for r in log] == ["step 2 | more", "step 1 | more", "step 0 | more"] and h.revisions(1).count() == 1
    assert h.between("HEAD~2", "HEAD").count() == 2 and h.exists_at("HEAD")
    assert h.cache_stats()["total"] == 3
    h.clear()
    with pytest.raises(LookupError):
        h.load("no-such-revision")


def test_a_revision_never_passes_through_the_driver_as_text(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    (repo / ".beads").mkdir(parents=True)
    write(repo / ".beads" / "issues.jsonl", [json.dumps({**GOOD[0], "id": f"t-{k}", "title": "x" * 500}) for k in range(4000)])
    for a in (["init", "-q"], ["add", "-A"], ["-c", "user.name=n", "-c", "user.email=e@x", "commit", "-q", "-m", "all"]):
        subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True)
    sizes, git = [], git_history.History._git
    monkeypatch.setattr(git_history.History, "_git", lambda self, *a: (sizes.append(len(out := git(self, *a))), out)[1])
    h = git_history.History(spark, str(repo))
    assert h.exists_at("HEAD") and h.load("HEAD").count() == 4000 and h.load("HEAD").select("id").distinct().count() == 4000
    assert sizes and max(sizes) < 100


def test_tree_of_a_scan(spark, file):
    issues = jsonl.read_issues(spark, file)
    rows = hierarchy.forest(issues, jsonl.edges(issues))
    assert sorted((r.id, r.depth) for r in rows.collect()) == [("t-1", 0), ("t-2", 0), ("t-3", 0), ("t-4", 1)]
    loop = spark.createDataFrame([("a", "b", "parent-child"), ("b", "a", "parent-child"), ("c", "d", "parent-child"), ("d", "c", "parent-child"), ("c", "r", "parent-child")], "issue_id string, depends_on_id string, type string")
    nodes = spark.createDataFrame([(x, 0, dt.datetime(2026, 1, 1)) for x in "abcdr"], "id string, priority int, created_at timestamp")
    assert sorted((r.id, r.depth, r.repeats) for r in hierarchy.forest(nodes, loop).collect()) == [("c", 1, False), ("c", 3, True), ("d", 2, False), ("r", 0, False)]


def test_snapshots_follow_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    snaps = snapshots.Snapshots(spark, str(tmp_path / "out"))
    run = lambda: snaps.follow(snapshots.change_stream(spark, str(folder)), str(tmp_path / "ck")).awaitTermination()
    write(folder / "v1.txt", [json.dumps(x) for x in GOOD])
    run()
    assert snaps.version == 1 and snaps.read().count() == 4 and snaps.read("board").count() == 12
    write(folder / "v2.txt", [json.dumps(x) for x in GOOD])
    run()
    assert snaps.version == 1 and snaps.passed_over == 1
    snaps.force()
    write(folder / "v3.txt", [json.dumps(x) for x in GOOD])
    run()
    assert snaps.version == 2
    broken = spark.createDataFrame([("x",)], "id string")
    assert snaps.publish(broken) is None and snaps.version == 2 and not snaps.metrics()["healthy"]


def test_a_huge_snapshot_keeps_closed_issues(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").cast("string"), F.lit("t").alias("title"), F.when(F.col("id") % 4 == 0, "closed").otherwise("open").alias("status"), F.lit(1).alias("priority"), F.lit("task").alias("issue_type"))
    snaps = snapshots.Snapshots(spark, str(tmp_path / "out"))
    assert snaps.publish(rows) == 1 and snaps.read().count() == 20_000
    counts = snaps.read("counts").first()
    assert (counts.open_count, counts.closed_count) == (15_000, 5_000)
    assert snaps.publish(rows.withColumn("title", F.when(F.col("status") == "closed", "u").otherwise("t"))) == 2


def large(spark):
    from pyspark.sql import functions as F

    return spark.range(5_000).select(F.col("id").cast("string"), F.lit("t").alias("title"), F.lit("open").alias("status"), F.lit(1).alias("priority"), F.lit("task").alias("issue_type"), F.lit(dt.datetime(2026, 1, 1)).alias("created_at"))


def test_a_followed_snapshot_of_any_size_has_a_board(spark, tmp_path):
    from pyspark.sql import functions as F

    large(spark).select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "in"))
    snaps = snapshots.Snapshots(spark, str(tmp_path / "out"))
    snaps.follow(snapshots.change_stream(spark, str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    board = snaps.read("board").groupBy("mode", "lane").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert sorted((r.mode, r.n, r["last"]) for r in board) == [("priority", 5000, 5000), ("status", 5000, 5000), ("type", 5000, 5000)]


def test_a_failing_batch_keeps_the_board_of_any_size(spark, tmp_path):
    from pyspark.sql import functions as F

    snaps = snapshots.Snapshots(spark, str(tmp_path / "out"))
    assert snaps.publish(large(spark)) == 1
    assert snaps.publish(large(spark).withColumn("title", F.raise_error(F.lit("broken batch")).cast("string"))) is None
    assert snaps.version == 1 and not snaps.metrics()["healthy"] and snaps.read("board").count() == 15_000


def test_ticks_leave_a_board_of_any_size(spark, tmp_path):
    from pyspark.sql import functions as F

    large(spark).select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "in"))
    snaps = snapshots.Snapshots(spark, str(tmp_path / "out"))
    ticks = snaps.follow(snapshots.change_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), processingTime="1 second")
    try:
        ticks.processAllAvailable()
    finally:
        ticks.stop()
    assert snaps.version == 1 and snaps.read("board").count() == 15_000


def test_debounce(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=s)
    events = spark.createDataFrame([("a", at(x)) for x in (0, 50, 99, 100, 150, 210, 400)] + [("b", at(0))], "k string, t timestamp_ntz")
    kept = sorted((r.k, r.kept_at) for r in snapshots.leading(events, "k", "t", 0.1).collect())
    assert kept == [("a", at(0)), ("a", at(100)), ("a", at(210)), ("a", at(400)), ("b", at(0))]
    fired = sorted((r.k, r.fired_at, r.events) for r in snapshots.trailing(events, "k", "t", "100 milliseconds").collect())
    assert fired == [("a", at(310), 6), ("a", at(500), 1), ("b", at(100), 1)]


def test_leading_debounce_in_a_stream(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "events"
        folder.mkdir()
        rows = [("a", 0), ("a", 50), ("b", 10), ("a", 120), ("a", 180), ("a", 230)]
        write(folder / "e.json", [json.dumps({"k": k, "t": f"2026-01-01T00:00:00.{ms:03d}Z"}) for k, ms in rows])
        events = spark.readStream.schema("k string, t timestamp").json(str(folder))
        out = snapshots.leading_stream(events, "k", "t", 100)
        q = out.writeStream.format("memory").queryName("kept_events").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        base = 1767225600000000
        assert sorted((r.key, (r.at - base) // 1000) for r in spark.table("kept_events").collect()) == [("a", 0), ("a", 120), ("a", 230), ("b", 10)]
    finally:
        spark.conf.unset(name)


def test_equalities_are_pushed_into_the_database(spark, tmp_path):
    from pyspark.sql import functions as F

    from tasklattice.sources import sqlite_db

    rows = spark.createDataFrame([(f"i-{k}", "t", "open" if k % 2 else "closed", k % 5) for k in range(25)], "id string, title string, status string, priority int")
    path = str(tmp_path / "beads.db")
    sqlite_db.write_table(rows, path, "issues", batch=10)
    assert sqlite_db.count_issues(spark, path) == 25
    read = sqlite_db.table(spark, path, "issues", "id string, status string, priority int, notes string")
    found = read.where((F.col("status") == "open") & F.col("priority").isin(1, 3) & F.col("notes").isNull())
    assert {r.id for r in found.collect()} == {f"i-{k}" for k in range(25) if k % 2 and k % 5 in (1, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status" in plan or "status = open" not in plan
    assert sqlite_db.issue_by_id(spark, path, "i-7").first().status == "open"
