"""Language ID by Bayesian evidence fusion.

The posterior of a row's language is the product of
  * the text's likelihood under hashed byte-trigram models, tempered because
    neighbouring trigrams depend on each other,
  * the likelihood of the declared markup language, and of the address suffix,
    given the language, from grouped counts smoothed towards all rows,
  * the host's prior, smoothed towards its domain and the domain towards all
    rows.

Counts come from a first pass that judges each row by its text alone and
aggregates by host, domain, declared language and suffix (map-side first, so a
hot host is a few partial counts).  Tables of at most ``broadcast_rows`` rows
are broadcast, larger ones joined by shuffle.

The trigram models are fitted on a bounded sample: the ``max_languages`` declared
values with most distinct texts (ties by name) are the languages, and of each at
most ``sample_rows`` distinct texts, ``sample_total`` over all, the ones with the
smallest hashes, and the first ``sample_bytes`` of each.  A text of c copies weighs
1 + log2(c).  Scoring reads whole texts.

A row is rejected when its text has letters too few to judge, or when the best
language's posterior is below ``min_posterior``.

Defined cases: null, empty and letterless texts have language ``und``, posterior
0 and are rejected; missing declarations, addresses and hosts count as no
evidence; ties go to the first language by name; repeated rows are judged alike;
a table without any declared language gives ``und`` everywhere; an empty table
gives an empty result.  Other columns pass through, those with a result's name
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, fresh_name, sealed, small_batches


@dataclass(frozen=True)
class LanguageParams:
    max_languages: int = 100
    sample_rows: int = 400
    sample_total: int = 20_000
    sample_bytes: int = 4000
    #: Bits of the trigram hash.
    bits: int = 15
    smoothing: float = 0.2
    #: Exponent of the text's likelihood, and the most bytes that count.
    temper: float = 0.1
    effective_bytes: int = 400
    #: Pseudo-counts of the parent's distribution for hosts and declarations.
    host_weight: float = 20.0
    evidence_weight: float = 20.0
    min_letters: int = 4
    min_posterior: float = 0.5
    broadcast_rows: int = 100_000


PRODUCTION = LanguageParams()

#: ASCII letters fold to lower case; other ASCII signs and digits become a space; bytes of longer characters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_cells(data: bytes, bits: int) -> np.ndarray:
    """Hashed trigrams of UTF-8 bytes, those across several spaces left out."""
    b = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    gram = gram[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: Log-likelihoods, a row for each cell and a column for each language.
    table: np.ndarray

    def score(self, text: str | None, p: LanguageParams) -> np.ndarray | None:
        """Tempered log-likelihoods, or None if there is nothing to judge."""
        cells = trigram_cells((text or "").encode("utf-8", "surrogatepass"), p.bits)
        if len(cells) < p.min_letters:
            return None
        mean = np.bincount(cells, minlength=len(self.table)) @ self.table / len(cells) if len(cells) > 2000 else self.table[cells].mean(0)
        return mean * min(len(cells), p.effective_bytes) * p.temper


def fit(rows: DataFrame, p: LanguageParams = PRODUCTION) -> TextModel:
    """Model from ``rows`` (text, declared); collects the bounded sample."""
    known = rows.where("declared is not null and declared <> '' and text is not null").withColumn("h", F.xxhash64("text"))
    # Copies share one place, however many there are, so they neither crowd out other texts nor thin a language's share.
    texts = checkpointed(known.groupBy("declared", "h").agg((1.0 + F.log2(F.count("*"))).alias("weight")))
    most = texts.groupBy("declared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "declared").limit(p.max_languages).collect()
    rows_each = min(p.sample_rows, p.sample_total // max(len(most), 1))
    # Only texts whose hash is small enough for some four times the sample are ranked, so ranking does not grow with the table.
    shares = [(r["declared"], min(1.0, 4.0 * rows_each / r["n"])) for r in most]
    shares = F.broadcast(rows.sparkSession.createDataFrame(shares, "declared string, share double"))
    small = texts.join(shares, "declared").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    first = Window.partitionBy("declared").orderBy("h")
    # At most ``sample_total`` rows of three numbers and a name, so it is broadcast whatever the table's size.
    chosen = F.broadcast(checkpointed(small.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows_each).select("declared", "h", "weight")))
    sample = known.join(chosen, ["declared", "h"]).select("declared", "h", "weight", F.substring("text", 1, p.sample_bytes).alias("text")).distinct().collect()
    languages = tuple(sorted({r["declared"] for r in sample}))
    counts = np.full((1 << p.bits, len(languages)), p.smoothing)
    for r in sample:
        counts[:, languages.index(r["declared"])] += r["weight"] * np.bincount(trigram_cells(r["text"].encode("utf-8", "surrogatepass"), p.bits), minlength=1 << p.bits)
    return TextModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def suffix_of(address: Column) -> Column:
    """Last label of a host name, or of the host of a url."""
    host = F.when(F.contains(address, F.lit("://")), F.regexp_extract(address, "://([^/?#:]*)", 1)).otherwise(address)
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def declared_in(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def text_in(html: Column) -> Column:
    """What stands between tags, without scripts, styles and comments; unclosed ones end with the page."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " "), r"<[^<>]*>", " ")


def _small(df: DataFrame, p: LanguageParams) -> DataFrame:
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def identify(
    df: DataFrame,
    text: Column,
    declared: Column | None = None,
    address: Column | None = None,
    host: Column | None = None,
    params: LanguageParams = PRODUCTION,
) -> DataFrame:
    """``df`` with language, posterior, text_language and accepted."""
    p = params
    added = ("language", "posterior", "text_language", "accepted")
    null = F.lit(None).cast("string")
    name = {x: fresh_name(df, f"_l_{x}") for x in ("text", "declared", "suffix", "host", "domain", "text_scores", "best", "hp", "dp", "sp", "post", "top")}
    evidence = {
        name["text"]: text,
        name["declared"]: F.nullif(F.lower(declared), F.lit("")) if declared is not None else null,
        name["suffix"]: suffix_of(address) if address is not None else null,
        name["host"]: F.nullif(F.lower(host), F.lit("")) if host is not None else null,
    }
    rows = df.withColumns(evidence)
    model = fit(rows.select(F.col(name["text"]).alias("text"), F.col(name["declared"]).alias("declared")), p)
    langs = model.languages
    names = [c for c in df.columns if c.lower() not in added]
    kept = [F.col(f"`{c}`") for c in names]
    if not langs:
        return df.select(*kept, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), F.lit(False).alias("accepted"))
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for part in parts:
            yield pd.Series([own.score(t, p) for t in part], dtype=object)

    n = len(langs)
    rows = rows.withColumn(name["text_scores"], scores(name["text"])).withColumn(name["domain"], domain_of(F.col(name["host"])))
    s = F.col(name["text_scores"])
    best_of = lambda a: F.get(F.array(*[F.lit(x) for x in langs]), F.array_position(a, F.array_max(a)).cast("int") - 1)
    rows = rows.withColumn(name["best"], F.coalesce(best_of(s), F.lit("und")))

    # One pass over the texts gives all counts.
    counted = rows.where(F.col(name["best"]) != "und").groupBy(*[F.col(name[x]).alias(x) for x in ("host", "domain", "declared", "suffix", "best")]).count()
    counted = checkpointed(counted)
    per = lambda c: [F.sum(F.when(F.col("best") == x, F.col("count")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]
    total = counted.agg(*per("")).first()
    total = [float(v or 0) for v in total]
    overall = [(v + 1.0) / (sum(total) + n) for v in total]
    arrays = F.array(*[F.col(f"n{k}").cast("double") for k in range(n)])

    def smoothed(keys: list[str], weight: float, parent: Column) -> DataFrame:
        t = counted.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*per("")).withColumn("c", arrays)
        size = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        return t.withColumn("p", F.zip_with("c", parent, lambda x, q: (x + weight * q) / (size + weight))).select(*keys, "p")

    flat = F.array(*[F.lit(v) for v in overall])
    domains = smoothed(["domain"], p.host_weight, flat)
    hosts = counted.where("host is not null").groupBy("host", "domain").agg(*per("")).withColumn("c", arrays).join(_small(domains, p), "domain")
    size = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    hosts = hosts.withColumn("p", F.zip_with("c", "p", lambda x, q: (x + p.host_weight * q) / (size + p.host_weight))).select("host", "p")

    # P(declaration | language) up to the declaration's own share, which cancels: P(language | declaration) / P(language).
    out = rows
    for table, key, column in ((hosts, "host", "hp"), (smoothed(["declared"], p.evidence_weight, flat), "declared", "dp"), (smoothed(["suffix"], p.evidence_weight, flat), "suffix", "sp")):
        out = out.join(_small(table.select(F.col(key).alias(name[key]), F.col("p").alias(name[column])), p), name[key], "left")
    prior = F.coalesce(F.col(name["hp"]), flat)
    ratio = lambda c: F.coalesce(F.zip_with(F.col(name[c]), flat, lambda x, q: F.log(x / q)), F.array_repeat(F.lit(0.0), n))
    logs = F.zip_with(F.zip_with(s.cast("array<double>"), prior, lambda a, q: a + F.log(q)), F.zip_with(ratio("dp"), ratio("sp"), lambda a, b: a + b), lambda a, b: a + b)
    out = out.withColumn(name["post"], logs).withColumn(name["top"], F.array_max(name["post"]))
    share = F.aggregate(name["post"], F.lit(0.0), lambda a, x: a + F.exp(x - F.col(name["top"])))
    found = F.coalesce(best_of(F.col(name["post"])), F.lit("und"))
    posterior = F.coalesce(F.round(1.0 / share, 6), F.lit(0.0))
    judged = out.select(*kept, found.alias("language"), posterior.alias("posterior"), F.col(name["best"]).alias("text_language"), ((found != "und") & (posterior >= p.min_posterior)).alias("accepted"))
    return sealed(judged, names, list(added))


def identify_documents(docs: DataFrame, params: LanguageParams = PRODUCTION) -> DataFrame:
    """Of documents: the declared language is ``lang``, the host ``source``; they have no address."""
    return identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source"), params=params)


def identify_pages(pages: DataFrame, params: LanguageParams = PRODUCTION) -> DataFrame:
    """Of pages (url, html): the text between tags, the html element's language, the address and its host."""
    text = text_in(F.col("html"))
    host = F.regexp_extract("url", "://([^/?#:]*)", 1)
    return identify(pages, text, declared=declared_in(F.col("html")), address=F.col("url"), host=host, params=params)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select("doc_id", "language", "posterior", "text_language", F.col("accepted").alias("kept"))


def page_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify_pages(pages).select("page_id", "language", "posterior", "text_language", F.col("accepted").alias("kept"))
