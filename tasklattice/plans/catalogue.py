"""Queries over the driver's tables, one for each operator, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.functions import digest
from tasklattice.functions import scalars as fn
from tasklattice.operators import diff, filters, hierarchy, rollups
from tasklattice.operators.graph import Graph
from tasklattice.operators.order import numbered
from tasklattice.sources import jsonl, tables, topologies
from tasklattice.streaming import snapshots
from tasklattice.workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW_TEXT = "1999-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {tables.SQL}\n{sql}"
        return f

    return add


def of_issues(name: str, column: Callable[[], Column], sql: str, wide: bool = False) -> None:
    """A query (id, out) of one expression over all issues."""
    query(name, f"SELECT id, {sql} AS out FROM issues")(lambda s, d: tables.issues(s, d, wide).select("id", column().alias("out")))


def kept_issues(name: str, where: Callable[[], Column], sql: str, wide: bool = False) -> None:
    query(name, f"SELECT id FROM issues WHERE {sql}")(lambda s, d: tables.issues(s, d, wide).where(where()).select("id"))


C = F.col
AGE = f"CAST(trunc(epoch(TIMESTAMP '{NOW_TEXT}' - created_at) / 86400) AS INTEGER)"
DAYS = "CASE WHEN {d} = 0 THEN '<1d' WHEN {d} < 7 THEN {d} || 'd' WHEN {d} < 30 THEN ({d} // 7) || 'w' ELSE ({d} // 30) || 'mo' END"
CLOSED = "status IN ('closed', 'tombstone')"
TYPE_RANK = "CASE issue_type WHEN 'epic' THEN 0 WHEN 'feature' THEN 1 WHEN 'task' THEN 2 WHEN 'bug' THEN 3 WHEN 'chore' THEN 4 ELSE 5 END"
STATUS_RANK = "CASE status WHEN 'open' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'blocked' THEN 2 WHEN 'closed' THEN 3 WHEN 'tombstone' THEN 4 ELSE 5 END"
HELD = f"SELECT issue_id FROM deps WHERE type IN ('', 'blocks') AND depends_on_id IN (SELECT id FROM issues WHERE NOT {CLOSED})"
READY = f"NOT {CLOSED} AND status <> 'blocked' AND id NOT IN ({HELD})"


def case(table: dict[str, str], column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


# A: scans and sinks


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as JSON Lines with a broken line for each 50th key and no title for each 49th."""
    k = C("key")
    title = F.when(k % 49 == 0, "").otherwise(C("title"))
    text = F.to_json(F.struct("id", title.alias("title"), F.concat(F.lit(" "), F.upper("status")).alias("status"), "priority", "issue_type", "labels", F.lit("x").alias("unknown_key")))
    return tables.issues(spark, sf_dir, True).select(F.when(k % 50 == 0, F.left(text, F.lit(20))).otherwise(text).alias("value"))


@query("a01_issue_scan", "SELECT id, title, status, priority, issue_type, array_to_string(labels, ',') AS labels FROM issues WHERE key % 50 <> 0 AND key % 49 <> 0")
def a01(spark, sf_dir):
    path = scratch(spark, "issues")
    _lines(spark, sf_dir).write.text(path)
    return jsonl.read_issues(spark, path).select("id", "title", "status", "priority", "issue_type", F.array_join("labels", ",").alias("labels"))


@query("a02_parse_lines", "SELECT count(*) AS n FROM issues WHERE key % 50 <> 0 AND key % 49 <> 0")
def a02(spark, sf_dir):
    return jsonl.parse(_lines(spark, sf_dir))[0].agg(F.count("*").alias("n"))


@query("a03_scan_warnings", "SELECT CASE WHEN key % 50 = 0 THEN 'malformed' ELSE 'no title' END AS reason, count(*) AS n FROM issues WHERE key % 50 = 0 OR key % 49 = 0 GROUP BY 1")
def a03(spark, sf_dir):
    return jsonl.parse(_lines(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("a13_string_arrays", "SELECT id, array_to_string(labels, '|') AS out FROM issues")
def a13(spark, sf_dir):
    rows = tables.issues(spark, sf_dir, True)
    text = F.when(C("key") % 2 == 0, F.to_json("labels")).otherwise(F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("]")))
    return rows.select("id", F.array_join(fn.string_array(text), "|").alias("out"))


@query("a40_apply_updates", f"SELECT id, CASE WHEN key % 10 = 0 THEN 'closed' ELSE status END AS status, priority FROM issues")
def a40(spark, sf_dir):
    rows = tables.issues(spark, sf_dir)
    edits = rows.where("key % 10 = 0").select("id", F.lit("closed").alias("status"), F.lit(None).cast("int").alias("priority"))
    return jsonl.apply_updates(rows, edits).select("id", "status", "priority")


@query("a41_edit_delta", f"SELECT id, 'status' AS field, 'closed' AS value FROM issues WHERE key % 10 = 0 AND status <> 'closed' UNION ALL SELECT id, 'priority', CAST(priority + 1 AS VARCHAR) FROM issues WHERE key % 20 = 0")
def a41(spark, sf_dir):
    rows = tables.issues(spark, sf_dir)
    after = rows.withColumns({"status": F.when(C("key") % 10 == 0, "closed").otherwise(C("status")), "priority": F.when(C("key") % 20 == 0, C("priority") + 1).otherwise(C("priority"))})
    return jsonl.edit_delta(rows, after, ["status", "priority"])


@query("a46_topologies", "SELECT * FROM (VALUES ('chain', 9), ('cycle', 10), ('star', 9), ('diamond', 16), ('tree', 14), ('complete', 90), ('bipartite', 12), ('ladder', 28), ('disconnected', 12)) t(name, n)")
def a46(spark, sf_dir):
    t = topologies
    made = {"chain": t.chain(spark, 10), "cycle": t.cycle(spark, 10), "star": t.star(spark, 10), "diamond": t.diamond(spark, 8), "tree": t.tree(spark, 3, 2), "complete": t.complete(spark, 10), "bipartite": t.bipartite(spark, 3, 4), "ladder": t.ladder(spark, 10), "disconnected": t.disconnected(spark, 4, 4)}
    rows = [e.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, (_, e) in made.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# B: scalar functions

of_issues("b01_repo_prefix", lambda: fn.repo_prefix(C("id")), "regexp_extract(id, '^([A-Za-z0-9]{1,10})-', 1)")
of_issues("b02_short_suffix", lambda: fn.short_suffix(C("id")), "regexp_extract(id, '-([^-]+)$', 1)")
of_issues("b03_search_text", lambda: fn.search_text(C("title"), C("id"), C("status"), C("issue_type"), C("assignee"), C("labels"), fn.repo_prefix(C("id"))), "concat_ws(' ', title, id, status, issue_type, nullif(assignee, ''), array_to_string(labels, ' '), 'ord')", True)
of_issues("b04_caption", lambda: fn.caption(C("id"), C("status"), C("assignee")), "id || ' ' || status || ' • ' || assignee", True)
of_issues("b05_relative_time", lambda: fn.relative_time(C("created_at"), now()), f"CASE WHEN {AGE} < 0 OR epoch(TIMESTAMP '{NOW_TEXT}' - created_at) < 60 THEN 'now' WHEN {AGE} < 7 THEN {AGE} || 'd ago' WHEN {AGE} < 30 THEN ({AGE} // 7) || 'w ago' ELSE ({AGE} // 30) || 'mo ago' END")
of_issues("b06_age_days", lambda: fn.age_days(C("created_at"), now()), AGE)
of_issues("b07_age_badge", lambda: fn.age_badge(C("created_at"), now()), DAYS.format(d=AGE))
of_issues("b08_age_bucket", lambda: fn.age_bucket(C("created_at"), now()), f"CASE WHEN {AGE} < 7 THEN 'fresh' WHEN {AGE} < 30 THEN 'aging' ELSE 'stale' END")
of_issues("b09_priority_label", lambda: F.concat_ws("/", fn.priority_label(C("priority") * 2), fn.priority_clamped(C("priority") * 2), fn.priority_icon(C("priority"))), "concat_ws('/', CASE WHEN priority * 2 BETWEEN 0 AND 4 THEN 'P' || (priority * 2) ELSE 'P?' END, 'P' || least(4, priority * 2), " + case(fn.PRIORITY_ICONS, "CAST(priority AS VARCHAR)", "  ") + ")")
of_issues("b10_icons", lambda: F.concat(fn.status_icon(C("status")), fn.type_icon(C("issue_type"))), f"{case(fn.STATUS_ICONS, 'status', '⚪')} || {case(fn.TYPE_ICONS, 'issue_type', '·')}")
of_issues("b11_type_rank", lambda: fn.type_rank(C("issue_type")), TYPE_RANK)
of_issues("b12_status_rank", lambda: fn.status_rank(C("status")), STATUS_RANK)
of_issues("b13_truncate", lambda: F.concat(fn.truncate(C("title"), 10), fn.truncate(C("title"), 3)), "left(title, 9) || '…' || left(title, 3)")
of_issues("b14_pad_right", lambda: fn.pad_right(C("id"), 14), "rpad(id, greatest(14, length(id))::INTEGER, ' ')")
of_issues("b15_compact_count", lambda: fn.compact_count(C("key")), "CASE WHEN key >= 1000 THEN (key // 1000) || 'k' ELSE CAST(key AS VARCHAR) END")
of_issues("b16_dataset_tier", lambda: fn.dataset_tier(C("key")), "CASE WHEN key <= 0 THEN 'unknown' WHEN key < 1000 THEN 'small' WHEN key < 5000 THEN 'medium' WHEN key < 20000 THEN 'large' ELSE 'huge' END")
of_issues("b18_normalise_prefixes", lambda: F.array_join(fn.normalised_prefixes(F.transform("labels", lambda x: F.concat(F.lit(" "), x, F.lit("-:")))), ","), "array_to_string(list_sort(list_distinct(list_transform(labels, lambda x: lower(x)))), ',')", True)
of_issues("b19_repo_list", lambda: fn.repo_list(C("labels"), 2), "CASE WHEN len(labels) <= 2 THEN array_to_string(labels, ',') ELSE array_to_string(labels[1:2], ',') || '+' || (len(labels) - 2) END", True)
of_issues("b20_hash_bucket", lambda: fn.hash_bucket(C("issue_type"), 8), "list_reduce(list_prepend(0, list_transform(string_split(issue_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 8)::INTEGER")
of_issues("b21_heat", lambda: F.concat_ws("/", fn.heat_bucket(C("priority") / 4), fn.heat_step(C("priority") / 4, 6).cast("string"), fn.sparkline(C("priority") / 4, 2)), "CASE priority WHEN 0 THEN 'low/0/  ' WHEN 1 THEN 'mid/2/▅ ' WHEN 2 THEN 'mid/3/█ ' WHEN 3 THEN 'high/4/█▅' ELSE 'peak/5/██' END")
of_issues("b24_status_predicates", lambda: F.concat_ws(",", *[x.cast("string") for x in (fn.status_valid(C("status")), fn.closed_like(C("status")), fn.status_open(C("status")))]), f"concat_ws(',', 'true', CAST({CLOSED} AS VARCHAR), CAST(status IN ('open', 'in_progress') AS VARCHAR))")
of_issues("b26_validity", lambda: F.concat_ws(",", *[x.cast("string") for x in (fn.sprint_active(C("created_at"), C("created_at") + F.expr("INTERVAL 1000 DAYS"), now()), fn.sprint_valid(C("id"), C("title"), C("created_at"), C("created_at")), fn.forecast_valid(C("id"), C("priority") / 3), fn.burndown_valid(C("created_at"), C("priority"), C("priority") - 1))]), f"concat_ws(',', CAST(TIMESTAMP '{NOW_TEXT}' BETWEEN created_at AND created_at + INTERVAL 1000 DAY AS VARCHAR), 'true', CAST(priority <= 3 AS VARCHAR), CAST(priority >= 1 AS VARCHAR))")
of_issues("b29_created_id", lambda: fn.created_id(F.concat(F.lit("ok\nCreated issue: "), C("id"), F.lit(" \nbye"))), "id")


@query("b17_fuzzy_score", "SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#11' THEN 1000 WHEN starts_with(lower(p_brand), 'brand#11') THEN 508 END AS score FROM part WHERE starts_with(lower(p_brand), 'brand#11')")
def b17(spark, sf_dir):
    scored = tables.read(spark, sf_dir, "part").select("p_partkey", fn.fuzzy_score(C("p_brand"), "Brand#11").alias("score"))
    return scored.where("score >= 500")


@query("b22_content_hash")
def b22(spark, sf_dir):
    return digest.unordered_hash(tables.issues(spark, sf_dir, True))


@query("b23_snapshot_bytes", "SELECT sum(256 + octet_length(encode(id)) + octet_length(encode(title)) + octet_length(encode(assignee)) + octet_length(encode(source_repo)) + list_sum(list_transform(labels, lambda x: 16 + octet_length(encode(x)))))::BIGINT AS bytes FROM issues")
def b23(spark, sf_dir):
    return digest.snapshot_bytes(tables.issues(spark, sf_dir, True))


@query("b25_dependency_predicates", f"SELECT type, count(*) AS n, bool_and(type IN ('', 'blocks')) AS blocking, min({case(fn.DEPENDENCY_ICONS, 'type', '•')}) AS icon FROM deps GROUP BY type")
def b25(spark, sf_dir):
    return tables.dependencies(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.bool_and(fn.blocking(C("type"))).alias("blocking"), F.min(fn.dependency_icon(C("type"))).alias("icon"))


@query("b30_lane_header", f"SELECT lane, concat_ws(' ', 'LANE', CASE WHEN p0 > 0 THEN 'P0:' || p0 END, CASE WHEN p1 > 0 THEN 'P1:' || p1 END, 'AGE:' || ({DAYS.format(d='age')})) AS header FROM (SELECT CASE WHEN priority < 3 THEN priority ELSE 3 END AS lane, count(CASE WHEN priority = 0 THEN 1 END) AS p0, count(CASE WHEN priority = 1 THEN 1 END) AS p1, max({AGE}) AS age FROM issues GROUP BY 1)")
def b30(spark, sf_dir):
    stats = rollups.lane_stats(tables.issues(spark, sf_dir), tables.dependencies(spark, sf_dir), "priority", now())
    return stats.select("lane", fn.lane_header(F.lit("LANE"), 140, C("lane"), "priority", C("total"), C("p0"), C("p1"), C("blocked"), C("oldest_days")).alias("header"))


# C: filters

kept_issues("c01_open", lambda: ~fn.closed_like(C("status")), f"NOT {CLOSED}")
kept_issues("c02_closed", lambda: fn.closed_like(C("status")), CLOSED)
query("c03_ready", f"SELECT id FROM issues WHERE {READY}")(lambda s, d: filters.ready(tables.issues(s, d), tables.dependencies(s, d)).select("id"))
kept_issues("c04_label", lambda: F.array_contains("labels", "BUILDING"), "list_contains(labels, 'BUILDING')", True)
kept_issues("c05_workspace_repos", lambda: filters.workspace_filter(F.when(C("key") % 3 == 0, "").when(C("key") % 3 == 1, "API").otherwise("web"), ["api"]), "key % 3 IN (0, 1)")
kept_issues("c06_repo", lambda: filters.repo_filter(C("id"), C("source_repo"), "NATION_1"), "starts_with(lower(source_repo), 'nation_1')", True)
kept_issues("c07_recipe_status", lambda: filters.recipe_status(C("status"), "closed"), CLOSED)
kept_issues("c08_predicates", lambda: filters.predicates("!status:closed priority:1 order 2"), "status <> 'closed' AND priority = 1 AND (contains(lower(title), 'order 2') OR contains(id, 'order 2'))")
kept_issues("c09_unknown_field", lambda: filters.predicates("!owner:me !closed type:bug"), "status <> 'closed' AND issue_type = 'bug'")
kept_issues("c10_tree_search", lambda: filters.search("ORD-12"), "contains(lower(title), 'ord-12') OR contains(lower(id), 'ord-12')")
kept_issues("c12_occur", lambda: filters.occur("order 1[0-3]+ "), "regexp_matches(lower(title), 'order 1[0-3]+ ') OR regexp_matches(lower(id), 'order 1[0-3]+ ')")
query("c15_project_filter", "SELECT c_custkey, CASE WHEN contains(lower(c_name), '00012') THEN 205 END AS score FROM customer WHERE contains(lower(c_name), '00012')")(lambda s, d: filters.fuzzy(tables.read(s, d, "customer"), ["c_name"], "00012").where("score >= 200").select("c_custkey", "score"))
query("c16_label_filter", "SELECT DISTINCT lower(l) AS label, 1000 AS score FROM (SELECT unnest(labels) AS l FROM issues) WHERE lower(l) = 'building'")(lambda s, d: filters.fuzzy(rollups.label_counts(tables.issues(s, d, True)), ["label"], "building").where("score > 500").select(F.lower("label").alias("label"), "score"))


@query("c14_context_filter", """, up AS (SELECT issue_id AS id, depends_on_id AS parent FROM deps WHERE type = 'parent-child'), hit AS (SELECT id FROM issues WHERE key % 101 = 0)
SELECT id, false AS is_context FROM hit UNION ALL SELECT DISTINCT parent, true FROM up WHERE id IN (SELECT id FROM hit) AND parent NOT IN (SELECT id FROM hit)""")
def c14(spark, sf_dir):
    rows, deps = tables.issues(spark, sf_dir), tables.dependencies(spark, sf_dir)
    return hierarchy.with_context(hierarchy.forest(rows, deps), rows.where("key % 101 = 0")).select("id", "is_context")


@query("c17_subtrees", "SELECT depends_on_id AS root, count(*) + 1 AS n FROM deps WHERE type = 'parent-child' GROUP BY 1")
def c17(spark, sf_dir):
    rows = hierarchy.forest(tables.issues(spark, sf_dir), tables.dependencies(spark, sf_dir))
    return rows.select(F.explode("path").alias("root")).groupBy("root").agg(F.count("*").alias("n")).where("n > 1")


query("c19_marks", "SELECT id FROM issues WHERE key % 77 = 0")(lambda s, d: filters.marked(tables.issues(s, d), tables.issues(s, d).where("key % 77 = 0")).select("id"))

# D: lookups

query("d01_blocker_lookup", "SELECT issue_id, depends_on_id, type, status AS target_status FROM deps JOIN issues ON id = depends_on_id")(lambda s, d: rollups.blocker_details(tables.issues(s, d), tables.dependencies(s, d)).select("issue_id", "depends_on_id", "type", "target_status"))
query("d02_no_open_blocker", f"SELECT id FROM issues WHERE id NOT IN ({HELD})")(lambda s, d: tables.issues(s, d).join(filters.open_blockers(tables.issues(s, d), tables.dependencies(s, d)).select(C("issue_id").alias("id")), "id", "left_anti").select("id"))
query("d03_open_blocker", f"SELECT id FROM issues WHERE id IN ({HELD})")(lambda s, d: rollups.has_open_blocker(tables.issues(s, d), tables.dependencies(s, d)).select("id"))
query("d04_blocks_index", "SELECT depends_on_id AS id, array_to_string(list_sort(list(issue_id)), ',') AS blocked FROM deps WHERE type IN ('', 'blocks') GROUP BY 1")(lambda s, d: rollups.blocks_index(tables.dependencies(s, d)).select("id", F.array_join("blocked", ",").alias("blocked")))
query("d05_children_index", "SELECT depends_on_id AS parent, array_to_string(list_sort(list(issue_id)), ',') AS children FROM deps WHERE type = 'parent-child' GROUP BY 1")(lambda s, d: rollups.children_index(tables.dependencies(s, d)).select("parent", F.array_join("children", ",").alias("children")))


@query("d06_child_tables", "SELECT i.id, coalesce(d.n, 0) AS deps, coalesce(c.n, 0) AS comments FROM issues i LEFT JOIN (SELECT issue_id, count(*) AS n FROM deps GROUP BY 1) d ON d.issue_id = i.id LEFT JOIN (SELECT 'ord-' || l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) c ON c.id = i.id")
def d06(spark, sf_dir):
    notes = tables.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("ord-"), C("l_orderkey").cast("string")).alias("issue_id"), C("l_shipdate").alias("created_at"), F.lit("a").alias("author"), C("l_returnflag").alias("text"))
    rows = rollups.with_children_tables(tables.issues(spark, sf_dir), tables.dependencies(spark, sf_dir), notes)
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return rows.select("id", F.greatest(size("dependencies"), F.lit(0)).alias("deps"), F.greatest(size("comments"), F.lit(0)).alias("comments"))


def _sides(spark, sf_dir):
    rows = tables.issues(spark, sf_dir)
    status = F.when(C("key") % 7 == 0, "review").otherwise(C("status"))
    return rows.where("key % 10 <> 0"), rows.where("key % 10 <> 1").withColumn("status", status)


SIDES = """, a AS (SELECT * FROM issues WHERE key % 10 <> 0 AND status <> 'tombstone'), b AS (SELECT * REPLACE (CASE WHEN key % 7 = 0 THEN 'review' ELSE status END AS status) FROM issues WHERE key % 10 <> 1),
b2 AS (SELECT * FROM b WHERE status <> 'tombstone'),
diff AS (SELECT CASE WHEN a.id IS NULL THEN 'missing_in_a' WHEN b2.id IS NULL THEN 'missing_in_b' ELSE 'status_mismatch' END AS kind, coalesce(a.id, b2.id) AS id, a.status AS status_a, b2.status AS status_b
 FROM a FULL JOIN b2 ON a.id = b2.id WHERE a.id IS NULL OR b2.id IS NULL OR a.status <> b2.status)
"""
query("d07_full_outer_diff", SIDES + "SELECT * FROM diff")(lambda s, d: diff.diff_sources(*_sides(s, d)))
query("d09_new_ids", "SELECT id FROM issues WHERE key % 10 = 0 ORDER BY created_at DESC, id LIMIT 1")(lambda s, d: diff.first_new(tables.issues(s, d).where("key % 10 <> 0"), tables.issues(s, d), rollups.list_order("default")).select("id"))
query("d10_project_ready", f""", held AS (SELECT x.issue_id FROM deps x JOIN issues o ON o.id = x.issue_id JOIN issues t ON t.id = x.depends_on_id WHERE x.type IN ('', 'blocks') AND t.status NOT IN ('closed', 'tombstone') AND t.source_repo = o.source_repo)
SELECT source_repo AS project, count(CASE WHEN NOT {CLOSED} AND status <> 'blocked' AND id NOT IN (SELECT issue_id FROM held) THEN 1 END) AS ready_count FROM issues GROUP BY 1""")(lambda s, d: rollups.project_counts(tables.issues(s, d, True), tables.dependencies(s, d), "source_repo").select("project", "ready_count"))
query("d11_point_lookup", "SELECT id, title, status FROM issues WHERE id = 'ord-7'")(lambda s, d: tables.issues(s, d).where(C("id") == "ord-7").select("id", "title", "status"))

# E: roll-ups

COUNTS = f"count(CASE WHEN NOT {CLOSED} THEN 1 END) AS open_count, count(CASE WHEN {READY} THEN 1 END) AS ready_count, count(CASE WHEN status = 'blocked' THEN 1 END) AS blocked_count, count(CASE WHEN {CLOSED} THEN 1 END) AS closed_count"
query("e01_status_rollup", f"SELECT {COUNTS} FROM issues")(lambda s, d: rollups.status_counts(tables.issues(s, d), tables.dependencies(s, d)))
query("e01_rollup_by_priority", f"SELECT priority, {COUNTS} FROM issues GROUP BY 1")(lambda s, d: rollups.status_counts(tables.issues(s, d), tables.dependencies(s, d), ["priority"]))
query("e02_project_counts", "SELECT source_repo AS project, count(CASE WHEN status = 'open' THEN 1 END) AS open_count, count(CASE WHEN status = 'in_progress' THEN 1 END) AS in_progress_count, count(CASE WHEN status = 'blocked' THEN 1 END) AS blocked_count FROM issues GROUP BY 1")(lambda s, d: rollups.project_counts(tables.issues(s, d, True), tables.dependencies(s, d), "source_repo").drop("ready_count"))
query("e03_label_counts", "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM issues) GROUP BY 1")(lambda s, d: rollups.label_counts(tables.issues(s, d, True)))
query("e04_label_order", "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM issues) GROUP BY 1)")(lambda s, d: numbered(rollups.label_counts(tables.issues(s, d, True)), [F.desc("n"), F.asc("label")], "place").select("label", "n", (C("place") + 1).alias("place")))
LANE = {"status": f"CASE WHEN status = 'in_progress' THEN 1 WHEN status = 'blocked' THEN 2 WHEN {CLOSED} THEN 3 ELSE 0 END", "priority": "CASE WHEN priority IN (0, 1, 2) THEN priority ELSE 3 END", "type": "CASE issue_type WHEN 'bug' THEN 0 WHEN 'feature' THEN 1 WHEN 'epic' THEN 3 ELSE 2 END"}
query("e05_lane_stats", f"SELECT {LANE['status']} AS lane, count(*) AS total, count(CASE WHEN priority = 0 THEN 1 END) AS p0, count(CASE WHEN priority = 1 THEN 1 END) AS p1, count(CASE WHEN id IN ({HELD}) THEN 1 END) AS blocked, max({AGE}) AS oldest_days FROM issues GROUP BY 1")(lambda s, d: rollups.lane_stats(tables.issues(s, d), tables.dependencies(s, d), "status", now()))
BOARD = " UNION ALL ".join(f"SELECT '{m}' AS mode, {x} AS lane, id, priority, created_at FROM issues" for m, x in LANE.items())
query("e06_board", f"SELECT mode, lane, id, row_number() OVER (PARTITION BY mode, lane ORDER BY priority, created_at DESC, id) AS rank FROM ({BOARD})")(lambda s, d: rollups.board(tables.issues(s, d)).select("mode", "lane", "id", "rank"))
query("e07_lane_visibility", "SELECT lane, n, n > 0 AS visible FROM (SELECT l.lane, coalesce(c.n, 0) AS n FROM (VALUES (0), (1), (2), (3)) l(lane) LEFT JOIN (SELECT " + LANE["type"] + " AS lane, count(*) AS n FROM issues WHERE issue_type <> 'bug' GROUP BY 1) c ON c.lane = l.lane)")(lambda s, d: rollups.visible_lanes(tables.issues(s, d).where("issue_type <> 'bug'"), "type"))


@query("e08_line_counts", "SELECT count(CASE WHEN key % 50 <> 0 THEN 1 END) AS good, count(CASE WHEN key % 50 = 0 THEN 1 END) AS bad, count(CASE WHEN key % 50 = 0 THEN 1 END) <= 0.1 * count(*) AS valid FROM issues")
def e08(spark, sf_dir):
    path = scratch(spark, "validate")
    _lines(spark, sf_dir).write.text(path)
    return jsonl.validate(spark, path)


query("e09_diff_report", SIDES + "SELECT 'a/b' AS pair, count(*) AS differences, max(kind = 'status_mismatch') AS critical FROM diff")(lambda s, d: diff.report(diff.diff_sources(*_sides(s, d)).withColumn("pair", F.lit("a/b"))))
query("e10_diff_summary", SIDES + "SELECT kind, count(*) AS n, kind || ' ' || count(*) || CASE WHEN count(*) <= 5 THEN ': ' || string_agg(id, ', ' ORDER BY id) ELSE '' END AS line FROM diff GROUP BY kind")(lambda s, d: diff.summary(diff.diff_sources(*_sides(s, d))))
query("e11_page_count", "SELECT count(*) AS n, greatest(1, ceil(count(*) / 30.0))::BIGINT AS pages FROM issues")(lambda s, d: tables.issues(s, d).agg(F.count("*").alias("n")).withColumn("pages", rollups.page_count(C("n"), 30)))
query("e12_status_type_pivot", "SELECT issue_type, count(CASE WHEN status = 'open' THEN 1 END) AS open, count(CASE WHEN status = 'closed' THEN 1 END) AS closed FROM issues GROUP BY 1")(lambda s, d: tables.issues(s, d).groupBy("issue_type").pivot("status", ["open", "closed"]).count().na.fill(0))
query("e13_board_totals", f"SELECT mode, lane, count(*) AS n FROM ({BOARD}) GROUP BY 1, 2")(lambda s, d: rollups.lane_totals(tables.issues(s, d)))
query("e14_extremes", "SELECT min(created_at) AS oldest, max(priority) AS highest FROM issues")(lambda s, d: tables.issues(s, d).agg(F.min("created_at").alias("oldest"), F.max("priority").alias("highest")))

# F: orders and limits


def ordered(name: str, order: Callable[[], list[Column]], sql: str, wide: bool = False, n: int = 50) -> None:
    rows = lambda s, d: rollups.page(tables.issues(s, d, wide), order(), 0, n).select("id")
    query(name, f"SELECT id FROM issues ORDER BY {sql} LIMIT {n}")(rows)


ordered("f01_default_order", lambda: rollups.list_order("default"), "created_at DESC NULLS LAST, id")
ordered("f02_created_ascending", lambda: rollups.list_order("created_asc"), "created_at NULLS FIRST, id")
ordered("f02_priority", lambda: rollups.list_order("priority"), "priority, created_at DESC NULLS LAST, id")
ordered("f02_updated", lambda: rollups.list_order("updated"), "updated_at DESC NULLS LAST, id", True)
ordered("f03_tree_status_descending", lambda: rollups.tree_order("status", True), f"{STATUS_RANK} DESC, id DESC")
ordered("f03_tree_title", lambda: rollups.tree_order("title", False), "lower(title), id")
ordered("f04_sibling_order", lambda: [F.asc("priority"), fn.type_rank(C("issue_type")).asc(), F.asc("created_at"), F.asc("id")], f"priority, {TYPE_RANK}, created_at, id")
ordered("f05_lane_order", lambda: [F.asc("priority"), F.desc("created_at"), F.asc("id")], "priority, created_at DESC, id")
query("f07_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: rollups.top_k(tables.read(s, d, "orders"), 20, "o_totalprice", [F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice"))
query("f07_top_k_per_group", "SELECT priority, key, rank FROM (SELECT priority, key, row_number() OVER (PARTITION BY priority ORDER BY key DESC, id) AS rank FROM issues) WHERE rank <= 3")(lambda s, d: rollups.top_k(tables.issues(s, d), 3, "key", [F.asc("id")], ["priority"]).select("priority", "key", "rank"))
query("f09_first", "SELECT id FROM issues ORDER BY key LIMIT 1")(lambda s, d: tables.issues(s, d).orderBy("key").limit(1).select("id"))
query("f10_page", "SELECT id FROM issues ORDER BY created_at DESC, id LIMIT 30 OFFSET 60")(lambda s, d: rollups.page(tables.issues(s, d), rollups.list_order("default"), 2, 30).select("id"))
query("f12_next_match", "SELECT id, coalesce(lead(id) OVER (PARTITION BY priority ORDER BY key), first_value(id) OVER (PARTITION BY priority ORDER BY key)) AS next FROM issues WHERE key % 50 = 0")(lambda s, d: _next_match(s, d))


def _next_match(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("priority").orderBy("key")
    return tables.issues(spark, sf_dir).where("key % 50 = 0").select("id", F.coalesce(F.lead("id").over(w), F.first("id").over(w)).alias("next"))


# G: set operations

query("g01_source_diff", SIDES + "SELECT kind, count(*) AS n FROM diff GROUP BY 1")(lambda s, d: diff.diff_counts(diff.diff_sources(*_sides(s, d))))
query("g01_capped_diff", SIDES + "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS n FROM diff) WHERE n <= 100")(lambda s, d: diff.capped(diff.diff_sources(*_sides(s, d)), 100).select("kind", "id"))
query("g03_union_all", "SELECT priority, count(*) AS n FROM (SELECT priority FROM issues WHERE key % 10 <> 0 UNION ALL SELECT priority FROM issues WHERE key % 10 <> 1) GROUP BY 1")(lambda s, d: _sides(s, d)[0].select("priority").unionByName(_sides(s, d)[1].select("priority")).groupBy("priority").agg(F.count("*").alias("n")))
query("g04_union_paths", "SELECT n_name AS path, CASE WHEN n_nationkey < 10 THEN 'registered' ELSE 'found' END AS name FROM nation")(lambda s, d: diff.union_paths(tables.read(s, d, "nation").where("n_nationkey < 10").select(C("n_name").alias("path"), F.lit("registered").alias("name")), tables.read(s, d, "nation").select(C("n_name").alias("path"), F.lit("found").alias("name"))))
query("g06_new_rows", "SELECT id FROM issues WHERE key % 10 = 0")(lambda s, d: diff.new_rows(tables.issues(s, d).where("key % 10 <> 0"), tables.issues(s, d)).select("id"))


@query("g07_row_badges", f"SELECT id, CASE WHEN key % 10 = 0 THEN 'new' WHEN key % 9 = 0 AND NOT {CLOSED} THEN 'closed' WHEN key % 9 = 0 AND status <> 'closed' THEN 'modified' END AS badge FROM issues")
def g07(spark, sf_dir):
    rows = tables.issues(spark, sf_dir).withColumn("updated_at", C("created_at"))
    after = rows.withColumn("status", F.when(C("key") % 9 == 0, "closed").otherwise(C("status")))
    return diff.row_badges(rows.where("key % 10 <> 0"), after)


query("g08_distinct_labels", "SELECT DISTINCT unnest(labels) AS label FROM issues")(lambda s, d: tables.issues(s, d, True).select(F.explode("labels").alias("label")).distinct())

# H: hierarchy

TREE = """, up AS (SELECT DISTINCT issue_id AS id, depends_on_id AS parent FROM deps WHERE type = 'parent-child'),
tree AS (SELECT id, 0 AS depth, [id] AS path FROM issues WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT up.id, depth + 1, list_append(path, up.id) FROM tree JOIN up ON up.parent = tree.id)
"""
_forest = lambda s, d: hierarchy.forest(tables.issues(s, d), tables.dependencies(s, d))
query("h01_forest", TREE + "SELECT id, depth, array_to_string(path, '/') AS path FROM tree")(lambda s, d: _forest(s, d).select("id", "depth", F.array_join("path", "/").alias("path")))
query("h02_preorder", TREE + "SELECT id, row_number() OVER (PARTITION BY path[1] ORDER BY depth, i.priority, i.created_at, id) AS place FROM tree JOIN issues i USING (id)")(lambda s, d: _preorder(s, d))


def _preorder(spark, sf_dir):
    from pyspark.sql import Window

    rows = _forest(spark, sf_dir)
    w = Window.partitionBy(F.col("path")[0]).orderBy(F.array_join("sort_path", "."))
    return rows.select("id", F.row_number().over(w).alias("place"))


query("h04_ancestors", "SELECT issue_id AS id, depends_on_id AS ancestor FROM deps WHERE type = 'parent-child'")(lambda s, d: hierarchy.ancestors(_forest(s, d)))
query("h05_siblings", """SELECT parent, id, lead(id) OVER w AS next, lag(id) OVER w AS previous, first_value(id) OVER w AS first, last_value(id) OVER (PARTITION BY parent ORDER BY priority, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
FROM (SELECT depends_on_id AS parent, id, priority, created_at FROM deps JOIN issues ON id = issue_id WHERE type = 'parent-child') WINDOW w AS (PARTITION BY parent ORDER BY priority, created_at, id)""")(lambda s, d: hierarchy.siblings(tables.issues(s, d), tables.dependencies(s, d), [F.asc("priority"), F.asc("created_at"), F.asc("id")]))
query("h06_expand_to_level", "SELECT id FROM issues WHERE id NOT IN (SELECT issue_id FROM deps WHERE type = 'parent-child')")(lambda s, d: hierarchy.visible(_forest(s, d), 1).select("id"))
query("h08_dependency_tree", """, walk AS (SELECT id AS root, id, 0 AS depth, [id] AS path, 'root' AS type, status, '' AS marker FROM issues WHERE key % 500 = 0
UNION ALL SELECT root, x.depends_on_id, depth + 1, list_append(path, x.depends_on_id), x.type, coalesce(i.status, '?'), CASE WHEN list_contains(path, x.depends_on_id) THEN '(cycle)' WHEN i.id IS NULL THEN '(not found)' ELSE '' END
FROM walk JOIN deps x ON x.issue_id = walk.id LEFT JOIN issues i ON i.id = x.depends_on_id WHERE depth < 3 AND marker = '')
SELECT root, id, depth, array_to_string(path, '/') AS path, type, status, marker FROM walk""")(lambda s, d: hierarchy.dependency_tree(tables.issues(s, d), tables.dependencies(s, d), tables.issues(s, d).where("key % 500 = 0"), 3).select("root", "id", "depth", F.array_join("path", "/").alias("path"), "type", "status", "marker"))
query("b27_breadcrumb", TREE + "SELECT t.id, CASE WHEN depth = 0 THEN '' ELSE upper(p.issue_type[1]) || p.issue_type[2:] || ': ' || p.title || ' > ' || upper(i.issue_type[1]) || i.issue_type[2:] || ': ' || i.title END AS crumb FROM tree t JOIN issues i ON i.id = t.id JOIN issues p ON p.id = t.path[1]")(lambda s, d: _crumbs(s, d))


def _crumbs(spark, sf_dir):
    names = tables.issues(spark, sf_dir).select(C("id").alias("step"), "issue_type", "title")
    rows = _forest(spark, sf_dir).select("id", "path", F.posexplode("path").alias("k", "step")).join(names, "step")
    steps = rows.groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("k", "issue_type", "title"))).alias("s"))
    return steps.select("id", fn.breadcrumb(F.transform("s", lambda x: x["issue_type"]), F.transform("s", lambda x: x["title"]), 200).alias("crumb"))


# K: graphs


def _dag(spark, sf_dir) -> Graph:
    return Graph.build(*tables.blocks_graph(spark, sf_dir))


def _supplies(spark, sf_dir) -> Graph:
    """The steps of every part from supplier to supplier."""
    return Graph.build(*tables.supply_cycles(spark, sf_dir))


query("k01_build", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")(lambda s, d: _dag(s, d).edges)
query("k02_density", "SELECT n AS nodes, e AS edges, e / (n * (n - 1.0)) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)")(lambda s, d: _dag(s, d).size())
query("k04_degrees", "SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nodes LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON src = id LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON dst = id")(lambda s, d: _dag(s, d).degrees())
query("k05_neighbours", "SELECT dst AS id FROM edges WHERE src = 7")(lambda s, d: _dag(s, d).successors(7))
HEIGHT = """, walk AS (SELECT id, 1 AS h FROM nodes UNION SELECT dst, h + 1 FROM walk JOIN edges ON src = walk.id), back AS (SELECT id, 1 AS b FROM nodes UNION SELECT src, b + 1 FROM back JOIN edges ON dst = back.id),
height AS (SELECT id, max(h) AS h FROM walk GROUP BY 1), depth AS (SELECT id, max(b) AS b FROM back GROUP BY 1)
"""
query("k06_layers", HEIGHT + "SELECT id, h - 1 AS layer FROM height")(lambda s, d: _dag(s, d).layers())
query("k06_topological_order")(lambda s, d: _dag(s, d).topological_order())
query("k07_heights", HEIGHT + "SELECT id, h::DOUBLE AS height FROM height")(lambda s, d: _dag(s, d).heights().select("id", "height"))
query("k08_critical_nodes", HEIGHT + "SELECT id FROM height WHERE h = (SELECT max(h) FROM height)")(lambda s, d: _dag(s, d).critical_nodes().select("id"))
query("k09_slack", HEIGHT + "SELECT id, ((SELECT max(h) FROM height) - (h + b - 1))::DOUBLE AS slack FROM height JOIN depth USING (id)")(lambda s, d: _dag(s, d).heights().select("id", "slack"))
query("k10_longest_paths", HEIGHT + "SELECT id, h::BIGINT AS length FROM height ORDER BY h DESC, id LIMIT 5")(lambda s, d: _dag(s, d).longest_paths(5).select("id", "length"))
#: Rounds that the SQL spells out; on small tables all three converge sooner.
ROUNDS = 30


def _converged(steps: list[str], diff: str, out: str, tolerance: float = 1e-6) -> str:
    """SQL of the first round whose difference from the round before is below the tolerance."""
    diffs = " UNION ALL ".join(f"SELECT {k + 1} AS k, sum({diff}) AS diff FROM r{k} a JOIN r{k + 1} b USING (id)" for k in range(ROUNDS))
    rows = " UNION ALL ".join(f"SELECT {k + 1} AS k, * FROM r{k + 1}" for k in range(ROUNDS))
    steps = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps]
    return ", " + ", ".join(steps) + f", diffs AS ({diffs}), stop AS (SELECT coalesce(min(k), {ROUNDS}) AS k FROM diffs WHERE diff < {tolerance}) SELECT {out} FROM ({rows}) WHERE k = (SELECT k FROM stop)"


def _pagerank_sql() -> str:
    steps = ["n AS (SELECT s_suppkey AS id, o FROM supplier LEFT JOIN (SELECT src, count(*) AS o FROM cycle_edges GROUP BY 1) ON src = s_suppkey)", "r0 AS (SELECT id, o, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(ROUNDS):
        steps.append(f"r{k + 1} AS (SELECT p.id, p.o, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce((SELECT sum(r) FROM r{k} WHERE o IS NULL), 0) / (SELECT count(*) FROM n) + 0.85 * coalesce(g.g, 0) AS r FROM r{k} p LEFT JOIN (SELECT dst, sum(r / o) AS g FROM cycle_edges JOIN r{k} ON id = src GROUP BY 1) g ON g.dst = p.id)")
    return _converged(steps, "abs(b.r - a.r)", "id, round(r, 6) AS score")


query("k11_pagerank", _pagerank_sql())(lambda s, d: _supplies(s, d).pagerank().select("id", F.round("score", 6).alias("score")))


def _hits_sql() -> str:
    steps = ["r0 AS (SELECT s_suppkey AS id, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS h, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS a FROM supplier)"]
    for k in range(ROUNDS):
        steps.append(f"a{k} AS (SELECT dst AS id, sum(h) AS a FROM cycle_edges JOIN r{k} ON id = src GROUP BY 1)")
        steps.append(f"h{k} AS (SELECT src AS id, sum(a) AS h FROM cycle_edges JOIN a{k} ON id = dst GROUP BY 1)")
        steps.append(f"r{k + 1} AS (SELECT r.id, coalesce(h.h, 0) / (SELECT sqrt(sum(h * h)) FROM h{k}) AS h, coalesce(a.a, 0) / (SELECT sqrt(sum(a * a)) FROM a{k}) AS a FROM r{k} r LEFT JOIN a{k} a ON a.id = r.id LEFT JOIN h{k} h ON h.id = r.id)")
    return _converged(steps, "abs(b.a - a.a) + abs(b.h - a.h)", "id, round(h, 6) AS hub, round(a, 6) AS authority")


query("k12_hits", _hits_sql())(lambda s, d: _supplies(s, d).hits().select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority")))


def _eigen_sql() -> str:
    steps = ["r0 AS (SELECT s_suppkey AS id, 1.0::DOUBLE / sqrt((SELECT count(*) FROM supplier)) AS r FROM supplier)"]
    for k in range(ROUNDS):
        steps.append(f"w{k} AS (SELECT dst AS id, sum(r) AS w FROM cycle_edges JOIN r{k} ON id = src GROUP BY 1)")
        steps.append(f"r{k + 1} AS (SELECT r.id, coalesce(w, 0) / (SELECT sqrt(sum(w * w)) FROM w{k}) AS r FROM r{k} r LEFT JOIN w{k} w ON w.id = r.id)")
    return _converged(steps, "abs(b.r - a.r)", "id, round(r, 6) AS score")


query("k13_eigenvector", _eigen_sql())(lambda s, d: _supplies(s, d).eigenvector().select("id", F.round("score", 6).alias("score")))
BETWEEN = """, hop AS (SELECT src AS s, dst AS v, 1 AS d FROM cycle_edges UNION SELECT s, dst, d + 1 FROM hop JOIN cycle_edges ON src = v WHERE d < 8),
dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM hop WHERE s <> v GROUP BY 1, 2 UNION ALL SELECT s_suppkey, s_suppkey, 0 FROM supplier),
paths AS (SELECT s_suppkey AS s, s_suppkey AS v, 0 AS d, 1.0::DOUBLE AS n FROM supplier UNION ALL
  SELECT p.s, e.dst, p.d + 1, sum(p.n) FROM paths p JOIN cycle_edges e ON e.src = p.v JOIN dist t ON t.s = p.s AND t.v = e.dst AND t.d = p.d + 1 GROUP BY p.s, e.dst, p.d)
SELECT s_suppkey AS id, round(coalesce(sum(b.n * c.n / a.n), 0), 6) AS score FROM supplier LEFT JOIN (paths b JOIN paths c ON c.s = b.v JOIN paths a ON a.s = b.s AND a.v = c.v AND a.d = b.d + c.d) ON b.v = s_suppkey AND b.s <> b.v AND c.v <> b.v GROUP BY 1"""
query("k14_betweenness", BETWEEN)(lambda s, d: _supplies(s, d).betweenness().select("id", F.round("score", 6).alias("score")))
query("k15_betweenness_all_pivots", BETWEEN)(lambda s, d: _supplies(s, d).betweenness_sampled(1_000_000).select("id", F.round("score", 6).alias("score")))
query("k15_betweenness_sampled")(lambda s, d: _supplies(s, d).betweenness_sampled(20))


def _core_sql(rounds: int = 25) -> str:
    """Core numbers as the fixed point of each node's h-index over its neighbours, from the degrees on."""
    steps = ["und AS MATERIALIZED (SELECT src AS u, dst AS v FROM cycle_edges UNION SELECT dst, src FROM cycle_edges)", "h0 AS MATERIALIZED (SELECT s_suppkey AS id, (SELECT count(*) FROM und WHERE u = s_suppkey) AS h FROM supplier)"]
    for k in range(rounds):
        steps.append(f"h{k + 1} AS MATERIALIZED (SELECT h.id, coalesce(g.h, 0) AS h FROM h{k} h LEFT JOIN (SELECT u, max(least(place, h)) AS h FROM (SELECT u, h, row_number() OVER (PARTITION BY u ORDER BY h DESC) AS place FROM und JOIN h{k} ON id = v) GROUP BY 1) g ON g.u = h.id)")
    return ", " + ", ".join(steps) + f" SELECT id, h::INTEGER AS core FROM h{rounds}"


query("k16_core_numbers", _core_sql())(lambda s, d: _supplies(s, d).core_numbers().select("id", C("core").cast("int").alias("core")))
UND = ", und AS MATERIALIZED (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges)"
query("k17_articulation_points", UND + """, seen AS (SELECT u AS x, min(v) AS v FROM und GROUP BY 1 UNION SELECT x, e.v FROM seen JOIN und e ON e.u = seen.v WHERE e.v <> x)
SELECT DISTINCT u AS id FROM und WHERE NOT EXISTS (SELECT 1 FROM seen WHERE x = und.u AND seen.v = und.v)""")(lambda s, d: _dag(s, d).articulation_points())
query("k18_bridges", UND + """, seen AS (SELECT u AS a, v AS b, u AS v FROM und WHERE u < v UNION SELECT a, b, e.v FROM seen JOIN und e ON e.u = seen.v WHERE NOT ((e.u = a AND e.v = b) OR (e.u = b AND e.v = a)))
SELECT u AS low, v AS high FROM und WHERE u < v AND NOT EXISTS (SELECT 1 FROM seen WHERE a = und.u AND b = und.v AND seen.v = und.v)""")(lambda s, d: _dag(s, d).bridges())
query("k17_articulation_points_supplies")(lambda s, d: _supplies(s, d).articulation_points())
query("k18_bridges_supplies")(lambda s, d: _supplies(s, d).bridges())
REACH = ", hop AS (SELECT src AS s, dst AS v FROM cycle_edges UNION SELECT s, dst FROM hop JOIN cycle_edges ON src = v)\n"
query("k19_strong_components", REACH + "SELECT s_suppkey AS id, least(s_suppkey, coalesce((SELECT min(a.v) FROM hop a JOIN hop b ON b.s = a.v AND b.v = a.s WHERE a.s = s_suppkey), s_suppkey)) AS scc FROM supplier")(lambda s, d: _supplies(s, d).strong_components().select("id", "scc"))
query("k20_cycles")(lambda s, d: _supplies(s, d).cycles(100))
query("k21_cycle_breaks")(lambda s, d: _supplies(s, d).cycle_breaks(10, 100))
query("k22_quick_cycle_breaks", REACH + """, tangled AS (SELECT DISTINCT a.s AS id FROM hop a WHERE a.s = a.v)
SELECT src, dst, 1::BIGINT AS cycles_broken, (SELECT count(*) FROM cycle_edges x WHERE x.src = e.src) + (SELECT count(*) FROM cycle_edges x WHERE x.dst = e.dst) AS collateral FROM cycle_edges e
WHERE src IN (SELECT id FROM tangled) AND dst IN (SELECT id FROM tangled) ORDER BY collateral, src, dst LIMIT 10""")(lambda s, d: _supplies(s, d).quick_cycle_breaks(10))


def _cover_sql(picks: int) -> str:
    steps = ["e0 AS MATERIALIZED (SELECT src, dst FROM cycle_edges)"]
    for k in range(picks):
        steps.append(f"p{k} AS MATERIALIZED (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e{k} UNION ALL SELECT dst FROM e{k}) GROUP BY 1 ORDER BY n DESC, id LIMIT 1)")
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT src, dst FROM e{k} WHERE src <> (SELECT id FROM p{k}) AND dst <> (SELECT id FROM p{k}))")
    rows = " UNION ALL ".join(f"SELECT {k} AS pick, id, n FROM p{k}" for k in range(picks))
    return ", " + ", ".join(steps) + f" SELECT pick, id, n AS edges_added, round(sum(n) OVER (ORDER BY pick) / (SELECT count(*) FROM e0), 9) AS covered_ratio FROM ({rows})"


query("k23_vertex_cover", _cover_sql(5))(lambda s, d: _supplies(s, d).cover(5).withColumn("covered_ratio", F.round("covered_ratio", 9)))
FROM_7 = ", hop AS (SELECT id FROM nodes WHERE id % 1000 = 7 UNION SELECT dst FROM hop JOIN edges ON src = hop.id)\n"
_start = lambda s, d: tables.issues(s, d).where("key % 1000 = 7").select(C("key").alias("id"))
query("k24_reachable", FROM_7 + "SELECT id FROM hop")(lambda s, d: _dag(s, d).reachable(_start(s, d)).select("id"))
query("g05_cone", ", hop AS (SELECT id FROM nodes WHERE id % 1000 = 7 UNION SELECT dst FROM hop JOIN edges ON src = hop.id), pre AS (SELECT id FROM nodes WHERE id % 1000 = 7 UNION SELECT src FROM pre JOIN edges ON dst = pre.id)\nSELECT id FROM hop UNION SELECT id FROM pre")(lambda s, d: _dag(s, d).cone(_start(s, d)))
query("k25_subgraph", "SELECT src, dst FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0")(lambda s, d: _dag(s, d).induced(tables.issues(s, d).where("key % 3 <> 0").select(C("key").alias("id"))).edges)
query("k26_blockers", "SELECT src AS id FROM edges WHERE dst = 9")(lambda s, d: _dag(s, d).predecessors(9))
OPEN_EDGES = "edges e JOIN nodes a ON a.id = src AND NOT a.closed"
query("k27_actionable", f"SELECT id FROM nodes WHERE NOT closed AND id NOT IN (SELECT dst FROM {OPEN_EDGES})")(lambda s, d: _dag(s, d).actionable())
query("k28_open_blockers", f"SELECT dst AS id, count(*) AS n FROM {OPEN_EDGES} GROUP BY 1")(lambda s, d: _dag(s, d).open_blockers())

# L: simulation

GAIN = f", only_one AS (SELECT dst, min(src) AS src FROM {OPEN_EDGES} JOIN nodes b ON b.id = dst AND NOT b.closed GROUP BY dst HAVING count(*) = 1), gain AS (SELECT id, coalesce(n, 0) AS n FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM only_one GROUP BY 1) ON src = id WHERE NOT closed)\n"
query("l01_what_if_direct", GAIN + "SELECT id, n AS direct, greatest(n - 1, 0) AS parallel_gain FROM gain")(lambda s, d: _dag(s, d).what_if().select("id", "direct", "parallel_gain"))
#: Rounds of a cascade that the SQL spells out; a chain of open issues of one customer is shorter.
CASCADE = 45


def _cascade_sql(start: str, out: str) -> str:
    """Sets of closed nodes (s: the case, v) round by round: an open node joins when all its open blockers are in."""
    steps = [f"oe AS MATERIALIZED (SELECT src, dst FROM {OPEN_EDGES} JOIN nodes b ON b.id = dst AND NOT b.closed)", "need AS MATERIALIZED (SELECT dst, count(*) AS k FROM oe GROUP BY 1)", f"c0 AS MATERIALIZED ({start})"]
    for k in range(CASCADE):
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT s, v FROM c{k} UNION SELECT s, dst FROM (SELECT c.s, e.dst, count(*) AS n FROM c{k} c JOIN oe e ON e.src = c.v GROUP BY 1, 2) JOIN need USING (dst) WHERE n = k)")
    sizes = ", ".join(f"n{k} AS MATERIALIZED (SELECT s, count(*) AS n FROM c{k} GROUP BY 1)" for k in (0, 1, CASCADE))
    return f", {', '.join(steps)}, {sizes}, gains AS (SELECT s, b.n - a.n AS direct, z.n - a.n AS transitive FROM n0 a JOIN n1 b USING (s) JOIN n{CASCADE} z USING (s)) {out}"


TOP_GAINS = "SELECT s AS id, direct, transitive FROM gains WHERE transitive > 0 ORDER BY transitive DESC, s LIMIT 10"
query("l02_what_if_batch", _cascade_sql("SELECT 0 AS s, id AS v FROM nodes WHERE id % 1000 = 7 AND NOT closed", "SELECT sum(direct)::BIGINT AS direct, sum(transitive)::BIGINT AS transitive FROM gains"))(lambda s, d: _dag(s, d).what_if_batch(_start(s, d)).agg(F.sum("direct").alias("direct"), F.sum("transitive").alias("transitive")))
query("l03_top_what_if", _cascade_sql("SELECT id AS s, id AS v FROM nodes WHERE NOT closed AND id NOT IN (SELECT dst FROM oe)", TOP_GAINS))(lambda s, d: _dag(s, d).top_what_if(10).select("id", "direct", "transitive"))
query("l04_all_what_if", _cascade_sql("SELECT id AS s, id AS v FROM nodes WHERE NOT closed", TOP_GAINS))(lambda s, d: _dag(s, d).top_what_if(10, actionable_only=False).select("id", "direct", "transitive"))
query("l05_best_set")(lambda s, d: _dag(s, d).best_set(5))
query("l06_parallel_cuts", GAIN + "SELECT id, n - 1 AS parallel_gain, n AS new_actionable FROM gain WHERE n > 1 ORDER BY n DESC, id LIMIT 10")(lambda s, d: _dag(s, d).parallel_cuts(10))
query("l07_unblock_ranking", GAIN + "SELECT id, n FROM gain ORDER BY n DESC, id LIMIT 10")(lambda s, d: _dag(s, d).unblock_ranking(10))

# M: streams, as their batch equals

query("m02_trailing_debounce", "SELECT user_id, max(ts) + INTERVAL 1 HOUR AS fired_at, count(*) AS events FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, burst")(lambda s, d: snapshots.trailing(tables.read(s, d, "events"), "user_id", "ts", "1 hour"))
query("m03_leading_debounce", ", kept AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1 UNION ALL SELECT k.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.t + INTERVAL 1 HOUR GROUP BY k.user_id, k.t) SELECT user_id, CAST(t AS TIMESTAMP) AS kept_at FROM kept")(lambda s, d: snapshots.leading(tables.read(s, d, "events"), "user_id", "ts", 3600.0))


@query("m06_snapshot_counts", f"SELECT count(CASE WHEN NOT {CLOSED} THEN 1 END) AS open_count, count(CASE WHEN NOT {CLOSED} AND status <> 'blocked' THEN 1 END) AS ready_count, count(CASE WHEN status = 'blocked' THEN 1 END) AS blocked_count, count(CASE WHEN {CLOSED} THEN 1 END) AS closed_count FROM issues")
def m06(spark, sf_dir):
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    snaps.publish(tables.issues(spark, sf_dir))
    return snaps.read("counts")


@query("m07_batch_dedup", "SELECT 2::BIGINT AS version, 1::BIGINT AS passed_over")
def m07(spark, sf_dir):
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    rows = tables.issues(spark, sf_dir)
    for batch in (rows, rows.orderBy("title"), rows.withColumn("priority", F.lit(4))):
        snaps.publish(batch)
    return spark.createDataFrame([(snaps.version, snaps.passed_over)], "version bigint, passed_over bigint")


@query("h03_filtered_preorder", TREE + """, hit AS (SELECT id FROM issues WHERE key % 101 = 0), kept AS (SELECT DISTINCT t.id, t.depth, t.path FROM tree t WHERE t.id IN (SELECT id FROM hit) OR t.id IN (SELECT unnest(path[1:len(path) - 1]) FROM tree WHERE id IN (SELECT id FROM hit)))
SELECT id, row_number() OVER (PARTITION BY path[1] ORDER BY depth, i.priority, i.created_at, id) AS place FROM kept JOIN issues i USING (id)""")
def h03(spark, sf_dir):
    from pyspark.sql import Window

    issues = tables.issues(spark, sf_dir)
    rows = hierarchy.with_context(hierarchy.forest(issues, tables.dependencies(spark, sf_dir)), issues.where("key % 101 = 0"))
    w = Window.partitionBy(F.col("path")[0]).orderBy(F.array_join("sort_path", "."))
    return rows.select("id", F.row_number().over(w).alias("place"))


@query("h06_visible_counts", TREE + "SELECT depth, count(*) AS n FROM tree GROUP BY 1")
def h06(spark, sf_dir):
    return hierarchy.visible(_forest(spark, sf_dir), 9).groupBy("depth").agg(F.count("*").alias("n"))


query("a39_graph_sink", "SELECT count(*) AS edges FROM edges")(lambda s, d: _sink(s, d))


def _sink(spark, sf_dir):
    from tasklattice.sources import graph_json

    g = _dag(spark, sf_dir)
    named = Graph(g.nodes.withColumn("name", F.concat(F.lit("n"), C("id").cast("string"))), g.edges)
    path = scratch(spark, "graph")
    graph_json.write_graph(named, path)
    return graph_json.read_graph(spark, path).edges.agg(F.count("*").alias("edges"))


@query("a24_sprint_round_trip", "SELECT 'sp-' || c_custkey AS id, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a24(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders")
    sprints = orders.groupBy(F.concat(F.lit("sp-"), C("o_custkey").cast("string")).alias("id")).agg(F.lit("sprint").alias("name"), F.collect_list(C("o_orderkey").cast("string")).alias("bead_ids"))
    path = scratch(spark, "sprints")
    jsonl.write_lines(sprints, path)
    return jsonl.read_sprints(spark, path).select("id", F.size("bead_ids").cast("long").alias("n"))
