"""URL filters from rules and a path-template tree, in DataFrame expressions only.

Explicit rules (host suffix and path prefix, longest wins) judge the urls they
fit and so label them.  The rest is judged by templates:

1. Each host's distinct paths form a tree, one level for each segment, and the
   tree is walked level by level until the paths end.  A node is variable when it
   has ``variable_children`` children at least and its paths are spread over them
   evenly (entropy of at least ``evenness`` of its greatest value); its children
   become one wildcard ``*``.  A child whose blocked share differs significantly
   from that of the whole node keeps its name.
2. Sibling templates, those below one parent, are merged into three branches:
   blocked share like that of all siblings together, significantly above it, and
   significantly below it.  Templates without labels are merged with none.
3. A branch's purity is its blocked share, with each url that no rule labels, and
   ``smoothing`` more, counted at its host's purity, and in the same way the
   host's at the share of all labels.  So one-sided labels weigh as much as the
   part of the branch that they cover.  A branch that holds labels is rejected
   when its purity reaches ``reject_purity``.

All statistics count distinct urls and are shares, so neither a hot url nor a
larger crawl of the same sites changes a verdict.  Urls are first aggregated to
distinct (host, path) pairs, map-side; each level is an aggregation and a join
with the level's variable nodes, and a path that is alone below its node leaves
the walk at once.  Tables of at most ``broadcast_rows`` rows are broadcast.
Beyond that, joins are by shuffle with the keys dealt over ``salts`` parts, and
urls of more than ``hot_rows`` rows are dealt over parts of that size.  Only
counts and maxima come to the driver.

Defined cases: a null url, or one without ``://``, has empty host and path and is
allowed unless a rule fits; a trailing slash makes no difference to the template;
a segment's own ``*`` is written ``%2A``; repeated rows are judged alike; an empty
table gives an empty result.  Other input columns pass through, those with a
result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import ascii_lower, checkpointed


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[Rule, ...] = field(default=RULES)
    #: A node with at least so many children, evenly used, is variable.
    variable_children: int = 12
    #: Entropy of the paths over the children, as a share of its greatest value.
    evenness: float = 0.6
    #: Labels that a child needs to keep its name below a variable node.
    own_labels: int = 5
    #: Blocked shares within so many standard errors are alike.
    merge_z: float = 1.96
    #: Pseudo-counts of the parent's share in a smoothed share.
    smoothing: float = 8.0
    reject_purity: float = 0.8
    broadcast_rows: int = 50_000
    salts: int = 16
    hot_rows: int = 500_000


PRODUCTION = UrlParams()


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, action) of the longest fitting rule, or null; of equally long ones a blocking rule wins."""
    fits = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.action == "block", r.text)):
        on_host = (host == r.host) | host.endswith("." + r.host)
        fits = F.when(on_host & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(fits)
    return fits


def _held(df: DataFrame, few: bool) -> DataFrame:
    """A table used more than once: checkpointed unless it comes from ``few`` urls."""
    return df if few else checkpointed(df)


def _looked_up(df: DataFrame, table: DataFrame, keys: list[str], p: UrlParams, few: bool) -> DataFrame:
    """``df`` left joined with ``table``, which has one row for each of its keys at most.

    ``few`` says that the urls themselves, and so all tables of nodes, are within
    the bound for broadcasts; otherwise the checkpointed ``table`` is counted.
    """
    if few or table.count() <= p.broadcast_rows:
        return df.join(F.broadcast(table), keys, "left")
    dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    salted = df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(p.salts)).cast("int"))
    return salted.join(dealt, [*keys, "salt"], "left").drop("salt")


def _unlike(part: tuple[Column, Column], whole: tuple[Column, Column], p: UrlParams) -> tuple[Column, Column]:
    """Whether the blocked share of ``part`` (labelled, blocked) lies significantly above, and below, that of ``whole``."""
    (n, b), (all_n, all_b) = part, whole
    share = all_b / all_n
    error = F.lit(p.merge_z) * F.sqrt(share * (F.lit(1.0) - share) * (F.lit(1.0) / n + F.lit(1.0) / all_n))
    return b / n - share > error, share - b / n > error


def _template_step(active: DataFrame, depth: int, p: UrlParams, few: bool) -> DataFrame:
    """``active`` (host, path, segments, template, labelled, blocked) with ``template`` one segment longer, and ``alone``."""
    node = ["host", "template"]
    active = active.withColumn("segment", F.get("segments", F.lit(depth)))
    children = active.groupBy(*node, "segment").agg(F.count("*").alias("c"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    children = _held(children, few)
    sums = [F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.sum("labelled").alias("nl"), F.sum("blocked").alias("nb")]
    spread = F.round((F.log("n") - F.col("s") / F.col("n")) / F.log("k"), 6)
    nodes = children.groupBy(*node).agg(*sums)
    nodes = nodes.select(*node, "nl", "nb", (F.col("n") == 1).alias("alone"), ((F.col("k") >= p.variable_children) & (spread >= p.evenness)).alias("variable"))
    nodes = _held(nodes.where("alone or variable"), few)
    above, below = _unlike((F.col("labelled"), F.col("blocked")), (F.col("nl"), F.col("nb")), p)
    own = _looked_up(children.where(F.col("labelled") >= p.own_labels), nodes.where("variable").select(*node, "nl", "nb"), node, p, few)
    own = _held(own.where((F.col("nl") > 0) & (above | below)).select(*node, "segment", F.lit(True).alias("own")), few)
    step = _looked_up(_looked_up(active, nodes.select(*node, "alone", "variable"), node, p, few), own, [*node, "segment"], p, few)
    wild = F.coalesce("variable", F.lit(False)) & F.col("own").isNull()
    alone = F.coalesce("alone", F.lit(False))
    rest = F.array_join(F.slice("segments", depth + 1, F.size("segments")), "/")
    name = F.when(wild, "*").when(alone, rest).otherwise(F.col("segment"))
    return step.select("host", "path", "segments", "labelled", "blocked", F.concat("template", F.lit("/"), name).alias("template"), alone.alias("alone"))


def templates_of(urls: DataFrame, p: UrlParams = PRODUCTION) -> DataFrame:
    """``urls`` (host, path, labelled, blocked; distinct) with their template."""
    bare = F.replace(F.regexp_replace("path", "^/|/$", ""), F.lit("*"), F.lit("%2A"))
    active = checkpointed(urls.select("host", "path", "labelled", "blocked", F.split(bare, "/").alias("segments"), F.lit("").alias("template")))
    levels, n = active.agg(F.max(F.size("segments")), F.count("*")).first()
    few = n <= p.broadcast_rows
    names = ["host", "path", "labelled", "blocked", "template"]
    done = active.select(*names).limit(0)
    for depth in range(levels or 0):
        step = checkpointed(_template_step(active, depth, p, few))
        ended = F.col("alone") | (F.size("segments") == depth + 1)
        done = done.union(step.where(ended).select(*names))
        active = step.where(~ended).drop("alone")
        if depth + 1 < levels and active.isEmpty():
            break
    return done


def template_purity(urls: DataFrame, p: UrlParams = PRODUCTION) -> DataFrame:
    """(host, template, holds, purity) for ``urls`` (host, template, labelled, blocked); ``holds``: its branch has labels."""
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    parent = F.regexp_replace("template", "/[^/]*$", "")
    templates = checkpointed(urls.withColumn("n", F.lit(1)).groupBy("host", "template").agg(*sums).withColumn("parent", parent))
    total = templates.agg(*sums, F.count("*").alias("rows")).first()
    few = total["rows"] <= p.broadcast_rows
    overall = ((total["blocked"] or 0) + 1.0) / ((total["labelled"] or 0) + 2.0)

    def smoothed(towards: Column) -> Column:
        return (F.col("blocked") + towards * (F.lit(p.smoothing) + F.col("n") - F.col("labelled"))) / (F.col("n") + F.lit(p.smoothing))

    hosts = _held(templates.groupBy("host").agg(*sums).select("host", smoothed(F.lit(overall)).alias("host_purity")), few)
    siblings = _held(templates.where("labelled > 0").groupBy("host", "parent").agg(F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb")), few)
    above, below = _unlike((F.col("labelled"), F.col("blocked")), (F.col("pl"), F.col("pb")), p)
    branch = F.when(F.col("labelled") == 0, "none").when(above, "above").when(below, "below").otherwise("like")
    placed = _looked_up(templates, siblings, ["host", "parent"], p, few).select("host", "template", "parent", "n", "labelled", "blocked", branch.alias("branch"))
    placed = _held(placed, few)
    branches = _looked_up(placed.where("labelled > 0").groupBy("host", "parent", "branch").agg(*sums), hosts, ["host"], p, few)
    branches = _held(branches.select("host", "parent", "branch", smoothed(F.col("host_purity")).alias("purity")), few)
    out = _looked_up(placed.select("host", "template", "parent", "branch"), branches, ["host", "parent", "branch"], p, few)
    out = _looked_up(out, hosts, ["host"], p, few)
    return out.select("host", "template", (F.col("branch") != "none").alias("holds"), F.round(F.coalesce("purity", "host_purity"), 9).alias("purity"))


def judge_urls(rows: DataFrame, p: UrlParams = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """(judged, urls) for ``rows`` (host, path, fit): judged (host, path, template, purity, judged), urls (host, path, n, ...)."""
    action = F.first("fit.action")
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), action.alias("action"))
    urls = checkpointed(urls.select("host", "path", "n", F.col("action").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("action") == "block", F.lit(False)).cast("int").alias("blocked")))
    placed = templates_of(urls, p)
    purity = checkpointed(template_purity(placed, p))
    judged = _looked_up(placed.select("host", "path", "template"), purity, ["host", "template"], p, few=False)
    verdict = F.when(F.col("holds") & (F.col("purity") >= p.reject_purity), "block").otherwise("allow")
    return checkpointed(judged.select("host", "path", "template", "purity", verdict.alias("judged"))), urls


def _with_url(rows: DataFrame, judged: DataFrame, urls: DataFrame, p: UrlParams) -> DataFrame:
    """``rows`` joined with their urls; a url of many rows is dealt over several parts."""
    if judged.count() <= p.broadcast_rows:
        return rows.join(F.broadcast(judged), ["host", "path"], "left")
    # At most one hot url for each ``hot_rows`` rows, so this table is broadcast whatever it holds.
    hot = F.broadcast(checkpointed(urls.where(F.col("n") > p.hot_rows).select("host", "path", F.ceil(F.col("n") / p.hot_rows).cast("int").alias("parts"))))
    one = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), one).cast("int")
    dealt = judged.join(hot, ["host", "path"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return rows.join(hot, ["host", "path"], "left").withColumn("part", part).drop("parts").join(dealt, ["host", "path", "part"], "left").drop("part")


def filter_urls(pages: DataFrame, url_col: str = "url", params: UrlParams = PRODUCTION) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict (allow or block)."""
    p = params
    added = ["host", "path", "rule", "template", "purity", "verdict"]
    names = [c for c in pages.columns if c.lower() not in added]
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    fit = matching_rule(F.col("host"), F.col("path"), p.rules).alias("fit")
    plain = pages.select(host.alias("host"), path.alias("path")).select("host", "path", fit)
    judged, urls = judge_urls(plain, p)
    rows = pages.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"), path.alias("path"))
    rows = _with_url(rows, judged, urls, p).select("row", "host", "path", "template", "purity", "judged", fit)
    verdict = F.coalesce(F.col("fit.action"), F.col("judged"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], "host", "path", F.col("fit.rule").alias("rule"), "template", "purity", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
