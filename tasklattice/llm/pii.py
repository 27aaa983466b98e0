"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are the spans of four base detectors (email, ip, card, phone) and words that
look like random keys.  Candidates are words with digits, runs of such words,
and words after a label (``:`` or ``=``), without the marks around them and where
no base span touches them.  Each seed and candidate is an instance in lexical
patterns: its one or two words to the left together with the coarse class of
the value, which is what it is made of (letters, digits, @) and its length to a
power of two.  Patterns and instances form a bipartite graph that is scored in
rounds: a pattern by the mean confidence of its instances (smoothed), an instance
by the noisy-or of its patterns.  Instances that become confident support further
patterns in the next round.  Candidates on patterns with a high final score
become spans of kind ``id``; base spans stay whatever their score.

The text is scanned twice; only seeds and candidates leave their row, as distinct
(pattern, value) pairs.  In each round the small side of a join (confident
instances, or scored patterns) is broadcast within ``broadcast_rows`` rows and
``broadcast_bytes`` bytes.  Beyond that each of its rows is sent to ``salts``
parts and the pairs are dealt over these, so that no value, pattern or copied text
makes a large group.

The patterns below match what the plain ones would, but take each run of
characters whole (possessive, from its beginning or from the last match on), so
the time is linear even in texts that are one long word.  Overlaps are found and
texts are masked over sorted spans, with running maxima by blocks and the text
cut into small parts, so that many spans in a long text cost what they are many.

Defined cases: null text is empty and has no spans; positions are code points;
spans of different kinds may overlap, and ``mask`` merges those; equal texts get
equal spans, whatever their ids, null ids included; an empty table gives an
empty result.  Other columns pass through, and one with a result's name is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, fresh_name, sealed, words_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+(?:\x20[+(]*+[0-9][^\x20\x09-\x0D]*+)*+|(?<=[:=]\x20)[^\x20\x09-\x0D]++)",
}
#: A text without a match of this has no span of the kind.
_QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "word": r"[0-9]|[:=]\x20"}
_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_BLOCK = 128
#: Code points in one part of a text that is masked.
_PART = 256
#: Marks before and after a value.
_LEAD = r"^[^\p{L}\p{N}+]+"
_TRAIL = r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: Longer patterns are kept as their digest.
_PATTERN_CHARS = 200


@dataclass(frozen=True)
class PiiParams:
    rounds: int = 3
    #: Confident values that a pattern needs.
    min_support: int = 3
    min_score: float = 0.6
    #: Confidence from which a value found in an earlier round supports patterns.
    min_confidence: float = 0.8
    #: Pseudo-count of instances that are not personal data.
    smoothing: float = 2.0
    #: What one certain pattern gives to an instance.
    trust: float = 0.9
    #: Letters and digits, and at least so many of each, of a word that looks like a key.
    key_chars: int = 32
    key_each: int = 6
    broadcast_rows: int = 100_000
    broadcast_bytes: int = 32_000_000
    salts: int = 16


PRODUCTION = PiiParams()


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _last_words(text: Column) -> Column:
    """The last two words of a text and the gaps after them."""
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return F.reverse(F.regexp_extract(F.reverse(text), f"^{gap}*+{word}*+(?:{gap}++{word}*+)?", 0))


def _next(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` and ``columns``, computed once for a row even if lambdas of later steps read them."""
    return sealed(df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[c.alias(n) for n, c in columns.items()]), [c for c in df.columns if c not in columns], list(columns))


def _with_running_max(df: DataFrame, values: str, out: str) -> DataFrame:
    """Add ``out``: for each place of the array ``values`` (ints, 0 at least) the largest so far, by blocks."""
    blocks, tops = fresh_name(df, "_w_b"), fresh_name(df, "_w_t")
    v = F.col(values)
    last = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
    df = _next(df, {blocks: F.when(F.size(v) > 0, cut).otherwise(F.array().cast("array<array<int>>"))})
    carried = F.aggregate(F.col(blocks), F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.greatest(F.element_at(s, -1), F.array_max(b)))))
    df = _next(df, {tops: F.slice(carried, F.lit(1), F.size(blocks))})
    within = lambda b, o: F.transform(b, lambda _, i: F.greatest(o, F.array_max(F.slice(b, F.lit(1), i + 1))))
    return _next(df, {out: F.flatten(F.zip_with(F.col(blocks), F.col(tops), within))}).drop(blocks, tops)


def _with_spans(df: DataFrame, text: str, kinds: tuple[str, ...], outs: dict[str, str], context: bool = False) -> DataFrame:
    """Add for each kind an array of struct(start, end, value), in order of start; with ``context`` also the text to the left."""
    none = F.array().cast("array<string>")
    found = {k: fresh_name(df, f"_m_{k}") for k in kinds}
    apart = {k: fresh_name(df, f"_p_{k}") for k in kinds}
    gaps = {k: fresh_name(df, f"_g_{k}") for k in kinds}
    blocks = {k: fresh_name(df, f"_b_{k}") for k in kinds}
    offs = {k: fresh_name(df, f"_o_{k}") for k in kinds}
    starts = {k: fresh_name(df, f"_a_{k}") for k in kinds}
    t = F.col(text)
    step = {}
    for k in kinds:
        maybe = F.contains(t, F.lit("@")) if k == "email" else t.rlike(_QUICK[k])
        step[found[k]] = F.when(maybe, F.regexp_extract_all(t, F.lit(_PATTERNS[k]), 0)).otherwise(none)
    df = df.withColumns(step)
    df = df.withColumns({apart[k]: F.when(F.size(found[k]) > 0, F.split(t, _PATTERNS[k])).otherwise(F.array(F.lit(""))) for k in kinds})

    # A column that is read once, within a lambda, would be computed anew for each element; so the arrays are zipped.
    before = lambda k: F.concat(F.array(F.lit("")), F.col(found[k]))
    gap = lambda k: F.slice(F.zip_with(before(k), F.col(apart[k]), lambda m, x: F.length(m) + F.length(x)), F.lit(1), F.size(found[k]))
    df = df.withColumns({gaps[k]: gap(k) for k in kinds})

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    # Starts are sums of all gaps so far: first cut into blocks, so that no step looks at a whole long array.
    last = lambda k: F.floor((F.size(gaps[k]) - 1) / _BLOCK).cast("int")
    cut = lambda k: F.transform(F.sequence(F.lit(0), last(k)), lambda b: F.slice(F.col(gaps[k]), b * _BLOCK + 1, F.lit(_BLOCK)))
    df = df.withColumns({blocks[k]: F.when(F.size(gaps[k]) > 0, cut(k)).otherwise(F.array().cast("array<array<int>>")) for k in kinds})
    sums = lambda k: F.aggregate(F.transform(F.col(blocks[k]), total), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    df = df.withColumns({offs[k]: F.slice(sums(k), F.lit(1), F.size(blocks[k])) for k in kinds})
    within = lambda g, o: F.transform(g, lambda _, i: o + total(F.slice(g, F.lit(1), i + 1)))
    df = df.withColumns({starts[k]: F.flatten(F.zip_with(F.col(blocks[k]), F.col(offs[k]), within)) for k in kinds})

    def spans(k: str) -> Column:
        parts = [F.col(found[k]).alias("m"), F.col(starts[k]).alias("a")]
        if context:
            lefts = F.zip_with(before(k), F.col(apart[k]), lambda m, x: _last_words(F.concat(m, x)))
            parts.append(F.slice(lefts, F.lit(1), F.size(found[k])).alias("l"))

        def span(z: Column) -> Column:
            cells = [z["a"].alias("start"), (z["a"] + F.length(z["m"])).alias("end"), z["m"].alias("value")]
            return F.struct(*cells, *([z["l"].alias("left")] if context else []))

        all_spans = F.transform(F.arrays_zip(*parts), span)
        return all_spans if k in ("email", "word") else F.filter(all_spans, lambda s: _valid(k, s["value"]))

    df = df.withColumns({outs[k]: spans(k) for k in kinds})
    return df.drop(*found.values(), *apart.values(), *gaps.values(), *blocks.values(), *offs.values(), *starts.values())


def _with_patterns(rows: DataFrame) -> DataFrame:
    """``rows`` (left, value, ...) with the patterns of their last word, and last two words, to the left, and the value's plain form."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("left"), r"[^\p{L}\p{N}=:\x20\x09-\x0D]+", ""), "[0-9]", "0")
    count = lambda what: F.length(F.regexp_replace("value", f"[^{what}]+", ""))
    made_of = F.concat(F.when(F.contains("value", F.lit("@")), "@").otherwise(""), F.when(count(r"\p{L}") > 0, "a").otherwise(""), F.when(count("0-9") > 0, "9").otherwise(""))
    kind = F.concat(made_of, F.floor(F.log2(F.greatest(count(r"\p{L}\p{N}"), F.lit(1)))).cast("string"))
    rows = rows.withColumns({"words": words_of(plain), "class": kind, "value": F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}@+]+", "")})
    pattern = lambda n: F.when(F.size("words") >= n, F.concat(F.lit(f"{n} "), F.array_join(F.slice("words", F.greatest(F.size("words") - n, F.lit(0)) + 1, F.lit(n)), " "), F.lit("\t"), F.col("class")))
    short = lambda x: F.when(F.length(x) > _PATTERN_CHARS, F.md5(x.cast("binary"))).otherwise(x)
    return rows.withColumn("patterns", F.transform(F.array_compact(F.array(pattern(1), pattern(2))), short)).drop("left", "words", "class")


def _occurrences(docs: DataFrame, p: PiiParams = PRODUCTION) -> DataFrame:
    """Seeds and candidates of (text): text_key, start, end, raw, value, patterns, seed, base.

    ``seed`` is 1 for base spans and words that look like keys, else 0.
    """
    outs = {k: f"s_{k}" for k in (*KINDS, "word")}
    df = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(r"[0-9@]|[:=]\x20"))
    df = _with_spans(df, "text", (*KINDS, "word"), outs, context=True).withColumn("text_key", _text_key(F.col("text"))).drop("text")

    def bare(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], _LEAD, 0))
        core = F.regexp_replace(F.regexp_replace(s["value"], _LEAD, ""), _TRAIL, "")
        return F.struct((s["start"] + lead).alias("start"), F.lit(1).alias("free"), (s["start"] + lead + F.length(core)).alias("end"), core.alias("value"), s["left"].alias("left"))

    base = lambda k: F.transform(F.col(outs[k]), lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("free"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left")))
    words = F.filter(F.transform(F.col(outs["word"]), bare), lambda s: F.length(s["value"]) > 0)
    df = _next(df, {"spans": F.sort_array(F.concat(*[base(k) for k in KINDS], words))}).select("text_key", "spans")
    df = _next(df, {"ends": F.transform("spans", lambda s: F.when(s["free"] == 0, s["end"]).otherwise(0))})
    df = _with_running_max(df, "ends", "held")
    # A candidate is free if no base span before it reaches into it and the next span, if a base span, begins after it.
    marked = F.zip_with(F.arrays_zip(F.col("spans").alias("s"), F.concat(F.array(F.lit(0)), F.col("held")).alias("h")), F.slice("spans", 2, F.greatest(F.size("spans"), F.lit(1))), lambda x, y: F.struct(x["s"].alias("s"), x["h"].alias("h"), F.when(y["free"] == 0, y["start"]).alias("next")))
    marked = F.filter(marked, lambda x: x["s"].isNotNull() & ((x["s"]["free"] == 0) | ((x["h"] <= x["s"]["start"]) & (x["next"].isNull() | (x["next"] >= x["s"]["end"])))))
    rows = _next(df, {"marked": marked}).select("text_key", F.explode("marked").alias("m")).select("text_key", "m.s.*")
    rows = rows.select("text_key", "start", "end", F.col("value").alias("raw"), "value", "left", (F.col("free") == 0).alias("base"))
    digits, letters = F.length(F.regexp_replace("raw", "[^0-9]+", "")), F.length(F.regexp_replace("raw", "[^A-Za-z]+", ""))
    key = F.col("raw").rlike(f"^[A-Za-z0-9+/_-]{{{p.key_chars},}}$") & (digits >= p.key_each) & (letters >= p.key_each)
    return _with_patterns(rows.withColumn("seed", F.when(F.col("base") | key, 1.0).otherwise(0.0)))


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _matched(df: DataFrame, table: DataFrame, key: str, p: PiiParams, how: str = "inner") -> DataFrame:
    """``df`` joined with the checkpointed ``table`` (key and numbers, or an array of spans) by ``key``."""
    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    rows, held = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= p.broadcast_rows and held <= p.broadcast_bytes:
        return df.join(F.broadcast(table), key, how)
    salt = fresh_name(df, "_salt")
    dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return df.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(p.salts)).cast("int")).join(dealt, [key, salt], how).drop(salt)


def pattern_scores(occurrences: DataFrame, p: PiiParams = PRODUCTION) -> DataFrame:
    """(pattern, score) of the patterns with enough confident values; ``occurrences`` is checkpointed."""
    edges = checkpointed(occurrences.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    seeds = checkpointed(edges.where("seed = 1").groupBy("value").agg(F.lit(1.0).alias("confidence")))
    known = seeds
    for k in range(p.rounds):
        held = _matched(edges, known, "value", p).groupBy("pattern").agg(F.sum("confidence").alias("sure"), F.count_if(F.col("confidence") >= p.min_confidence).alias("support"))
        held = checkpointed(held.where(F.col("support") >= p.min_support).select("pattern", "sure"))
        scored = _matched(edges, held, "pattern", p).groupBy("pattern").agg((F.first("sure") / (F.count("*") + p.smoothing)).alias("score"))
        scored = checkpointed(scored.select("pattern", F.round("score", 9).alias("score")))
        if k + 1 < p.rounds:
            doubt = F.sum(F.log(1 - p.trust * F.col("score")))
            belief = _matched(edges, scored, "pattern", p).groupBy("value").agg(F.round(1 - F.exp(doubt), 9).alias("confidence"))
            known = checkpointed(seeds.union(belief).groupBy("value").agg(F.max("confidence").alias("confidence")))
    return scored


def discovered(docs: DataFrame, p: PiiParams = PRODUCTION) -> DataFrame:
    """(text_key, found: array of start, end, value) for the texts of (text) to which patterns add spans."""
    rows = checkpointed(_occurrences(docs, p))
    good = checkpointed(pattern_scores(rows, p).where(F.col("score") >= p.min_score).select("pattern"))
    unseen = rows.where("not base").select("text_key", "start", "end", F.col("raw").alias("value"), F.explode("patterns").alias("pattern"))
    hits = _matched(unseen, good, "pattern", p, "left_semi").select("text_key", F.struct("start", "end", "value").alias("s")).distinct()
    return hits.groupBy("text_key").agg(F.sort_array(F.collect_list("s")).alias("found"))


def find_personal_data(docs: DataFrame, text_col: str = "text", params: PiiParams = PRODUCTION) -> DataFrame:
    """``docs`` with pii: array of struct(kind, start, end, value), by kind (email, ip, card, phone, id), then start."""
    p = params
    text = F.col(f"`{text_col}`")
    t_key, f = fresh_name(docs, "_k"), fresh_name(docs, "_f")
    more = checkpointed(discovered(docs.select(text.alias("text")), p).select(F.col("text_key").alias(t_key), F.col("found").alias(f)))
    keep = [c for c in docs.columns if c.lower() != "pii"]
    whole = fresh_name(docs, "_t")
    outs = {k: fresh_name(docs, f"_s_{k}") for k in KINDS}
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(text, F.lit("")).alias(whole))
    df = _with_spans(df, whole, KINDS, outs)
    df = df.withColumn(t_key, F.when(F.col(whole).rlike(r"[0-9]|[:=]\x20"), _text_key(F.col(whole))))
    df = _matched(df, more, t_key, p, "left")
    named = lambda c, kind: F.transform(c, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"]))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.concat(*[named(F.col(outs[kind]), kind) for kind in KINDS], named(F.coalesce(F.col(f), none), "id"))
    return sealed(df.select(*[F.col(f"`{c}`") for c in keep], found.alias("pii")), keep, ["pii"])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``df`` with each span, or run of overlapping spans, of its text replaced by its first kind in brackets."""
    names = df.columns
    s, e, m, r, c = (fresh_name(df, f"_m_{x}") for x in "semrc")
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))))
    out = _next(df, {s: F.coalesce(by_start, F.array().cast("array<struct<start:int,less:int,kind:string>>"))})
    out = _next(out, {e: F.transform(F.col(s), lambda x: -x["less"])})
    out = _with_running_max(out, e, m)
    # A span that begins where all before it have ended opens a run, which ends where its last span's running maximum says.
    firsts = F.filter(F.col(s), lambda x, i: (i == 0) | (x["start"] >= F.get(F.col(m), i - 1)))
    lasts = F.filter(F.col(m), lambda x, i: F.coalesce(F.get(F.col(s), i + 1)["start"] >= x, F.lit(True)))
    runs = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b.alias("end"), a["kind"].alias("kind")))
    parts = F.when(F.size(s) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), 0)).otherwise(F.array().cast("array<string>"))
    out = _next(out, {r: runs, c: parts})

    def between(a: Column, b: Column) -> Column:
        """The text from code point ``a`` to ``b``."""
        i, j = F.floor(a / _PART).cast("int"), F.floor((b - 1) / _PART).cast("int")
        head = F.substr(F.get(F.col(c), i), a % _PART + 1, F.least(b - i * _PART, F.lit(_PART)) - a % _PART)
        middle = F.array_join(F.slice(F.col(c), i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        tail = F.when(j > i, F.substr(F.get(F.col(c), j), F.lit(1), b - j * _PART)).otherwise("")
        return F.when(b > a, F.concat(head, middle, tail)).otherwise("")

    gap = lambda x, i: F.concat(between(F.when(i == 0, 0).otherwise(F.get(F.col(r), i - 1)["end"]), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    end = F.element_at(F.col(r), -1)["end"]
    whole = F.concat(F.array_join(F.transform(F.col(r), gap), ""), between(end, F.greatest(F.length(text), end)))
    out = _next(out, {text_col: F.when(F.size(r) > 0, whole).otherwise(text)})
    return out.select(*[F.col(f"`{n}`") for n in names])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_personal_data(docs).withColumn("base", F.filter("pii", lambda s: s["kind"] != "id"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"), count("id"))
