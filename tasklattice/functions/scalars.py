"""Scalar functions on columns.  Functions of the present time take ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklattice import schema

DAY = 86_400

# Icons by status, dependency type, issue type and priority.
STATUS_ICONS = {"open": "🟢", "in_progress": "🔵", "blocked": "🔴", "closed": "⚫"}
DEPENDENCY_ICONS = {"root": "📍", "blocks": "⛔", "related": "🔗", "parent-child": "📦", "discovered-from": "🔍"}
TYPE_ICONS = {"bug": "●", "feature": "▲", "task": "✔", "epic": "⚡", "chore": "○"}
PRIORITY_ICONS = {"0": "🔥", "1": "⚡", "2": "🔹", "3": "☕", "4": "💤"}
BARS = " ▂▃▄▅▆▇█"


def lookup(key: Column, table: dict, default) -> Column:
    """A closed map with a default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def repo_prefix(item_id: Column) -> Column:
    """What stands before the first '-', else ':', else '_', if it is short and plain."""
    tried = [F.nullif(F.regexp_extract(item_id, f"^([A-Za-z0-9]{{1,10}}){sep}", 1), F.lit("")) for sep in ("-", ":", "_")]
    return F.coalesce(*tried, F.lit(""))


def short_suffix(item_id: Column) -> Column:
    found = F.regexp_extract(item_id, "-([^-]+)$", 1)
    return F.when(found == "", item_id).otherwise(found)


def search_text(title: Column, item_id: Column, status: Column, kind: Column, assignee: Column, labels: Column, prefix: Column) -> Column:
    optional = [F.nullif(x, F.lit("")) for x in (assignee, F.array_join(labels, " "), prefix)]
    return F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (title, item_id, status, kind)], *optional)


def caption(item_id: Column, status: Column, assignee: Column) -> Column:
    return F.format_string("%s %s • %s", item_id, status, assignee)


def _seconds(earlier: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, now)


def relative_time(t: Column, now: Column) -> Column:
    s = _seconds(t, now)
    count = lambda unit, tag: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{tag} ago"))
    return (
        F.when(t.isNull(), "unknown")
        .when(s < 60, "now")
        .when(s < 3600, count(60, "m"))
        .when(s < DAY, count(3600, "h"))
        .when(s < 7 * DAY, count(DAY, "d"))
        .when(s < 30 * DAY, count(7 * DAY, "w"))
        .otherwise(count(30 * DAY, "mo"))
    )


def age_days(t: Column, now: Column) -> Column:
    """Whole days, towards zero; no time counts as 0."""
    s = _seconds(t, now)
    return F.coalesce((F.signum(s) * F.floor(F.abs(s) / DAY)).cast("int"), F.lit(0))


def days_label(days: Column) -> Column:
    by = lambda n, tag: F.concat(F.floor(days / n).cast("string"), F.lit(tag))
    return F.when(days == 0, "<1d").when(days < 7, by(1, "d")).when(days < 30, by(7, "w")).otherwise(by(30, "mo"))


def age_badge(t: Column, now: Column) -> Column:
    return F.when(t.isNull(), "").otherwise(days_label(age_days(t, now)))


def age_bucket(t: Column, now: Column, missing: str = "fresh") -> Column:
    d = age_days(t, now)
    return F.when(t.isNull(), missing).when(d < 7, "fresh").when(d < 30, "aging").otherwise("stale")


def priority_label(p: Column) -> Column:
    return F.when(p.between(0, 4), F.concat(F.lit("P"), p.cast("string"))).otherwise("P?")


def priority_clamped(p: Column) -> Column:
    return F.concat(F.lit("P"), F.greatest(F.lit(0), F.least(F.lit(4), p)).cast("string"))


def priority_icon(p: Column) -> Column:
    return lookup(p.cast("string"), PRIORITY_ICONS, "  ")


def status_icon(s: Column) -> Column:
    return lookup(s, STATUS_ICONS, "⚪")


def dependency_icon(t: Column) -> Column:
    return lookup(t, DEPENDENCY_ICONS, "•")


def type_icon(t: Column) -> Column:
    return lookup(t, TYPE_ICONS, "·")


def type_rank(t: Column) -> Column:
    return lookup(t, schema.TYPE_ORDER, schema.OTHER_ORDER)


def status_rank(s: Column) -> Column:
    return lookup(s, schema.STATUS_ORDER, schema.OTHER_ORDER)


def truncate(s: Column, n: int) -> Column:
    if n <= 0:
        return F.lit("")
    cut = F.left(s, F.lit(n)) if n <= 3 else F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))
    return F.when(F.char_length(s) <= n, s).otherwise(cut)


def display_width(s: Column) -> Column:
    """Columns on a terminal: East Asian wide characters, and emoji, take two; combining marks none."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
    return F.char_length(s) + F.regexp_count(s, F.lit(wide)) - F.regexp_count(s, F.lit(r"[\p{Mn}\p{Me}\x{200B}-\x{200F}]"))


def pad_right(s: Column, width: int) -> Column:
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(width) - display_width(s), F.lit(0)).cast("int")))


def compact_count(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def dataset_tier(n: Column) -> Column:
    return F.when(n <= 0, "unknown").when(n < 1000, "small").when(n < 5000, "medium").when(n < 20000, "large").otherwise("huge")


def fuzzy_score(label: Column, query: str) -> Column:
    """1000 if equal, 500 + length for a prefix, 200 + length if contained, else by the characters found in order.

    Each found character counts 10, 5 more for each step of a run, and 15 more
    at the start of a word; lengths are in bytes.
    """
    q, low = query.lower(), F.lower(label)
    n = len(q.encode())
    start = F.struct(F.lit(0).alias("qi"), F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(-1).alias("last"), F.lit(0).alias("i"), F.lit("").alias("before"))

    def step(a: Column, c: Column) -> Column:
        hit = (a["qi"] < len(q)) & (c == F.substr(F.lit(q), a["qi"] + 1, F.lit(1)))
        run = F.when(a["last"] == a["i"] - 1, a["run"] + 1).otherwise(0)
        edge = F.when((a["i"] == 0) | ~a["before"].rlike(r"\p{L}"), 15).otherwise(0)
        return F.struct(
            F.when(hit, a["qi"] + 1).otherwise(a["qi"]).alias("qi"),
            F.when(hit, a["score"] + 10 + 5 * run + edge).otherwise(a["score"]).alias("score"),
            F.when(hit, run).otherwise(a["run"]).alias("run"),
            F.when(hit, a["i"]).otherwise(a["last"]).alias("last"),
            (a["i"] + 1).alias("i"),
            c.alias("before"),
        )

    parts = F.aggregate(F.split(low, ""), start, step, lambda a: F.when(a["qi"] == len(q), a["score"]).otherwise(0))
    return F.when(low == q, 1000).when(low.startswith(q), 500 + n).when(low.contains(q), 200 + n).otherwise(parts)


def normalised_prefixes(prefixes: Column) -> Column:
    plain = F.transform(prefixes, lambda x: F.lower(F.regexp_replace(F.trim(x), "[-:_]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: x != "")))


def repo_list(repos: Column, most: int) -> Column:
    n = F.size(repos)
    if most <= 0:
        return F.when(n == 0, "").otherwise(F.concat(n.cast("string"), F.lit(" repos")))
    more = F.concat(F.array_join(F.slice(repos, 1, most), ","), F.lit("+"), (n - most).cast("string"))
    return F.when(n <= most, F.array_join(repos, ",")).otherwise(more)


def hash_bucket(prefix: Column, buckets: int) -> Column:
    """Base-31 hash of the characters, reduced at every step; -1 for an empty prefix."""
    h = F.aggregate(F.split(prefix, ""), F.lit(0), lambda a, c: (a * 31 + F.when(c == "", 0).otherwise(F.ascii(c))) % buckets)
    return F.when(prefix == "", -1).otherwise(h)


def sparkline(value: Column, width: int) -> Column:
    if width <= 0:
        return F.lit("")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(value, F.lit(0.0)))) * width
    full = F.floor(v).cast("int")
    rest = v - full
    k = F.least(F.floor(rest * len(BARS)).cast("int"), F.lit(len(BARS) - 1))
    k = F.when((k == 0) & (rest > 0), 1).otherwise(k)
    partial = F.when(full < width, F.substr(F.lit(BARS), k + 1, F.lit(1))).otherwise("")
    return F.concat(F.repeat(F.lit("█"), full), partial, F.repeat(F.lit(" "), F.greatest(F.lit(width - 1) - full, F.lit(0))))


def heat_bucket(score: Column) -> Column:
    return F.when(score > 0.8, "peak").when(score > 0.5, "high").when(score > 0.2, "mid").otherwise("low")


def heat_step(intensity: Column, steps: int) -> Column:
    """Index of a gradient of ``steps`` colours; 0 is kept for no heat."""
    k = F.least(F.floor(intensity * (steps - 1)).cast("int"), F.lit(steps - 2)) + 1
    return F.when(intensity <= 0, 0).when(intensity >= 1, steps - 1).otherwise(k)


def status_valid(s: Column) -> Column:
    return s.isin(*schema.STATUSES)


def closed_like(s: Column) -> Column:
    return s.isin(*schema.CLOSED_LIKE)


def status_open(s: Column) -> Column:
    return s.isin("open", "in_progress")


def type_valid(t: Column) -> Column:
    return t != ""


def type_known(t: Column) -> Column:
    return t.isin(*schema.ISSUE_TYPES)


def dependency_valid(t: Column) -> Column:
    return t.isin(*schema.DEPENDENCY_TYPES)


def blocking(t: Column) -> Column:
    """Dependencies of no type block."""
    return F.coalesce(t, F.lit("")).isin("", "blocks")


def sprint_active(start: Column, end: Column, now: Column) -> Column:
    return start.isNotNull() & end.isNotNull() & (now >= start) & (now <= end)


def sprint_valid(item_id: Column, name: Column, start: Column, end: Column) -> Column:
    return (item_id != "") & (name != "") & ~F.coalesce(end < start, F.lit(False))


def forecast_valid(issue_id: Column, confidence: Column) -> Column:
    return (issue_id != "") & confidence.between(0, 1)


def burndown_valid(date: Column, remaining: Column, completed: Column) -> Column:
    return date.isNotNull() & (remaining >= 0) & (completed >= 0)


def breadcrumb(types: Column, titles: Column, width: int = 80) -> Column:
    """'Type: title > Type: title' from the root on; the tail if too long, nothing for a root."""
    named = F.zip_with(types, titles, lambda t, x: F.concat(F.when(t == "", "Issue").otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))), F.lit(": "), x))
    whole = F.array_join(named, " > ")
    tail = F.concat(F.lit("..."), F.right(whole, F.lit(width - 3)))
    return F.when(F.size(types) <= 1, "").when(F.char_length(whole) > width, tail).otherwise(whole)


def created_id(output: Column) -> Column:
    return F.trim(F.regexp_extract(output, "Created issue:([^\\n]*)", 1))


def lane_header(base: Column, width: int, lane: Column, mode: str, total: Column, p0: Column, p1: Column, blocked: Column, oldest_days: Column) -> Column:
    if width < 100:
        return base
    part = lambda when, text: F.when(when, text)
    parts = [part(p0 > 0, F.concat(F.lit("P0:"), p0.cast("string"))), part(p1 > 0, F.concat(F.lit("P1:"), p1.cast("string")))]
    if width >= 140:
        if mode == "status":
            parts.append(part((lane == 1) & (blocked > 0), F.concat(F.lit("BLK:"), blocked.cast("string"))))
        parts.append(part((total > 0) & oldest_days.isNotNull(), F.concat(F.lit("AGE:"), days_label(oldest_days))))
    return F.concat_ws(" ", base, *parts)


def string_array(s: Column) -> Column:
    """A JSON array of strings, or else the parts between commas without brackets and quotes."""
    plain = F.regexp_replace(F.trim(s), r"^\[|\]$", "")
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")), lambda x: x != "")
    return F.when(s.isNull() | F.trim(s).isin("", "null", "[]"), F.lit(None)).otherwise(F.coalesce(F.from_json(s, "array<string>", {"mode": "PERMISSIVE"}), parts))
