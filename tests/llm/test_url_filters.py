import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tasklattice.llm import url_filters as u

SCHEMA = "page_id long, url string"


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), r.action == "block", r.text)) if fit else None


def parts_of(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def unlike(part, whole, p):
    (n, b), (all_n, all_b) = part, whole
    q = all_b / all_n
    error = p.merge_z * math.sqrt(q * (1.0 - q) * (1.0 / n + 1.0 / all_n))
    return (b / n - q > error) - (q - b / n > error)


def brute(urls, p):
    """page by page: (host, path, rule, template, purity, verdict), by a recursive walk over each host's tree."""
    label = {}
    for url in urls:
        host, path = parts_of(url)
        r = rule_of(host, path, p.rules)
        label[host, path] = r and r.action
    trees, template = defaultdict(list), {}
    for host, path in label:
        trees[host].append((re.sub("^/|/$", "", path).replace("*", "%2A").split("/"), path))

    def counts(host, rows):
        own = [label[host, path] for _, path in rows]
        return sum(x is not None for x in own), own.count("block")

    def walk(host, rows, prefix, depth):
        children = defaultdict(list)
        for segments, path in rows:
            children[segments[depth]].append((segments, path))
        n, k = len(rows), len(children)
        entropy = -sum(len(c) / n * math.log(len(c) / n) for c in children.values())
        variable = k >= p.variable_children and round(entropy / math.log(k), 6) >= p.evenness
        whole = counts(host, rows)
        below = defaultdict(list)
        for name, c in children.items():
            own = counts(host, c)
            wild = variable and not (own[0] >= p.own_labels and unlike(own, whole, p))
            below["*" if wild else name] += c
        for name, c in below.items():
            for segments, path in c:
                if len(segments) == depth + 1:
                    template[host, path] = f"{prefix}/{name}"
            deeper = [x for x in c if len(x[0]) > depth + 1]
            if deeper:
                walk(host, deeper, f"{prefix}/{name}", depth + 1)

    for host, rows in trees.items():
        walk(host, rows, "", 0)
    stats = defaultdict(lambda: [0, 0, 0])
    for (host, path), t in template.items():
        s = stats[host, t]
        s[0] += 1
        s[1] += label[host, path] is not None
        s[2] += label[host, path] == "block"

    def add(keyed):
        out = defaultdict(lambda: [0, 0, 0])
        for key, s in keyed:
            out[key] = [x + y for x, y in zip(out[key], s, strict=True)]
        return out

    def smooth(s, towards):
        return (s[2] + towards * (p.smoothing + s[0] - s[1])) / (s[0] + p.smoothing)

    total = add((0, s) for s in stats.values())[0]
    overall = (total[2] + 1.0) / (total[1] + 2.0)
    host_purity = {h: smooth(s, overall) for h, s in add((h, s) for (h, _), s in stats.items()).items()}
    up = lambda t: re.sub("/[^/]*$", "", t)
    siblings = add(((h, up(t)), s) for (h, t), s in stats.items() if s[1])
    branch = {(h, t): unlike(s[1:], siblings[h, up(t)][1:], p) if s[1] else None for (h, t), s in stats.items()}
    merged = add(((h, up(t), branch[h, t]), s) for (h, t), s in stats.items() if s[1])
    out = []
    for url in urls:
        host, path = parts_of(url)
        t = template[host, path]
        b = branch[host, t]
        purity = host_purity[host] if b is None else smooth(merged[host, up(t), b], host_purity[host])
        r = rule_of(host, path, p.rules)
        out.append((host, path, r and r.text, t, round(purity, 6), r.action if r else "block" if b is not None and purity >= p.reject_purity else "allow"))
    return out


def run(spark, urls, p=u.PRODUCTION):
    rows = u.filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA).repartition(3), params=p).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.template, round(r.purity, 6), r.verdict) for r in rows]


def made():
    """A shop whose articles vary and are mostly blocked, a blog below sections, odd and repeated urls."""
    rng = random.Random(3)
    urls = [f"https://shop.org/item/{'a' if k % 10 < 8 else 'b'}{k}x" for k in range(80)]
    urls += [f"https://shop.org/news/{k}" for k in range(30)]
    urls += [f"https://blog.org/{s}/{rng.randrange(9)}/{k}.html" for s in ("good", "bad", "new") for k in range(40)]
    urls += [f"https://blog.org/users/u{k}/{what}" for k in range(25) for what in ("photos", "posts")]
    urls += [f"https://blog.org/users/spam/{k}" for k in range(40)]
    urls += [None, "", "no scheme/x", "http://", "http://Shop.ORG/item/a1x?x#y", "https://shop.org/a*b/*", "https://deep.org/" + "/".join("abc" * 5), "https://deep.org/" + "/".join("abc" * 2), "x://h.org//", "https://www.example.com/en/1"]
    return urls + ["https://shop.org/item/b8x"] * 300


RULES = (u.Rule("block", "shop.org", "/item/a"), u.Rule("allow", "shop.org", "/news/1"), u.Rule("block", "blog.org", "/bad/"), u.Rule("allow", "blog.org", "/good/"), u.Rule("allow", "blog.org", "/users/u1"), u.Rule("block", "blog.org", "/users/spam"), *u.RULES)


@pytest.mark.parametrize("small", [50_000, 0])
def test_made_hosts_equal_a_recursive_walk(spark, small):
    urls = made()
    p = u.UrlParams(rules=RULES, broadcast_rows=small, salts=3, hot_rows=50)
    rows = run(spark, urls, p)
    expected = brute(urls, p)
    assert [r[:4] + r[5:] for r in rows] == [r[:4] + r[5:] for r in expected]
    assert all(abs(r[4] - e[4]) < 2e-6 for r, e in zip(rows, expected, strict=True))
    by_url = dict(zip(urls, rows, strict=True))
    assert by_url["https://shop.org/item/b8x"][2:4] == (None, "/item/*") and by_url["https://shop.org/item/b8x"][5] == "block"
    assert by_url["https://shop.org/news/7"][5] == "allow"
    assert by_url["https://blog.org/users/spam/3"][3] == "/users/spam/*" and by_url["https://blog.org/users/u3/posts"][3] == "/users/*/posts"
    assert by_url[None][:4] == ("", "", None, "/")


def test_copies_of_a_url_change_no_verdict(spark):
    urls = made()
    p = u.UrlParams(rules=RULES)
    once = dict(zip(urls, run(spark, urls, p), strict=True))
    assert dict(zip(urls * 3, run(spark, urls * 3, p), strict=True)) == once


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_unruled_pages_of_the_tables(spark, sf):
    rows = u.query(spark, f"/root/testdata/{sf}").collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()}
    expected = dict(zip(pages, brute(list(pages.values()), u.PRODUCTION), strict=True))
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path, r.rule, r.template, r.verdict) == (*expected[r.page_id][:4], expected[r.page_id][5])
    unruled = [r.verdict for r in rows if r.rule is None]
    assert Counter(unruled)["block"] <= 0.02 * len(unruled)
    assert sf == "sf0.001" or any("*" in r.template for r in rows)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "https://a.net/es/1", "x", "y", 5, 6)], "page_id long, url string, HOST string, verdict string, row int, n int")
    row = u.filter_urls(df).collect()[0]
    assert row.host == "a.net" and row.verdict == "block" and row["row"] == 5 and row.n == 6
    assert u.filter_urls(df.limit(0)).count() == 0
