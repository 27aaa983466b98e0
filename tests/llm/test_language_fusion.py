"""The fusion of evidence against a plain Python version."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tasklattice.llm import language_id as lid

P = lid.PRODUCTION


def fused(rows, model):
    """(language, posterior) of rows (text scores, declared, suffix, host)."""
    langs = model.languages
    n = len(langs)
    best = [None if s is None else int(max(range(n), key=lambda k: (s[k], -k))) for s, *_ in rows]
    total = [float(best.count(k)) for k in range(n)]
    flat = [(x + 1.0) / (sum(total) + n) for x in total]

    def table(keys):
        out = defaultdict(lambda: [0.0] * n)
        for b, key in zip(best, keys, strict=True):
            if b is not None and key is not None:
                out[key][b] += 1
        return out

    def smooth(counts, weight, parent):
        return [(c + weight * q) / (sum(counts) + weight) for c, q in zip(counts, parent, strict=True)]

    domain = lambda h: ".".join(h.split(".")[-2:]) if h is not None else None
    domains = {k: smooth(v, P.host_weight, flat) for k, v in table([domain(r[3]) for r in rows]).items()}
    hosts = {k: smooth(v, P.host_weight, domains[domain(k)]) for k, v in table([r[3] for r in rows]).items()}
    declared = {k: smooth(v, P.evidence_weight, flat) for k, v in table([r[1] for r in rows]).items()}
    suffixes = {k: smooth(v, P.evidence_weight, flat) for k, v in table([r[2] for r in rows]).items()}
    out = []
    for s, d, x, h in rows:
        if s is None:
            out.append(("und", 0.0))
            continue
        post = [float(s[k]) + math.log(hosts.get(h, flat)[k]) + math.log(declared.get(d, flat)[k] / flat[k]) + math.log(suffixes.get(x, flat)[k] / flat[k]) for k in range(n)]
        top = max(range(n), key=lambda k: (post[k], -k))
        out.append((langs[top], 1.0 / sum(math.exp(v - post[top]) for v in post)))
    return out


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_posteriors_equal_a_plain_fusion(spark, sf, table):
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    if table == "documents":
        evidence = df.select(F.col("doc_id").alias("key"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lower("source").alias("host"))
        found = lid.identify_documents(df.select("doc_id", "text", "lang", "source")).withColumnRenamed("doc_id", "key")
    else:
        host = F.regexp_extract("url", "://([^/?#:]*)", 1)
        evidence = df.select(F.col("page_id").alias("key"), lid.text_in(F.col("html")).alias("text"), lid.declared_in(F.col("html")).alias("declared"), lid.suffix_of(F.col("url")).alias("suffix"), F.lower(F.nullif(host, F.lit(""))).alias("host"))
        found = lid.identify_pages(df).withColumnRenamed("page_id", "key")
    rows = evidence.collect()
    model = lid.fit(evidence.select("text", "declared"))
    expected = fused([(model.score(r.text, P), r.declared, r.suffix, r.host) for r in rows], model)
    found = {r["key"]: (r.language, r.posterior) for r in found.collect()}
    assert len(found) == len(rows)
    for r, (language, posterior) in zip(rows, expected, strict=True):
        said = found[r["key"]]
        assert abs(said[1] - posterior) < 1e-3
        assert said[0] == language or abs(posterior - 0.5) < 1e-3


def test_languages_are_bounded_and_dirty_values_rank_last(spark):
    rows = [(f"hello there number {k} and so on", "en") for k in range(20)] + [(f"guten tag nummer {k} und so weiter", "de") for k in range(20)]
    rows += [(f"junk text {k}", f"x{k}") for k in range(30)]
    model = lid.fit(spark.createDataFrame(rows, "text string, declared string"), lid.LanguageParams(max_languages=2, sample_total=10))
    assert model.languages == ("de", "en")


def test_unclosed_markup_is_read_in_linear_time(spark):
    html = '<html lang="en"><body>words of the page ' + "<" * 300_000 + "<!-- " * 50_000
    row = lid.identify_pages(spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")).collect()[0]
    assert row.language == "en"
