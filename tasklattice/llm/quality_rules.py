"""Line-first quality rules, in DataFrame expressions only.

Every line of a document is judged on its own: a *navigation* line is a list of
items between separators, a *boilerplate* line carries legal or site phrases,
and a *punctuation* failure is a line cluttered with doubled marks and symbols
or a short line that ends without a closing mark.  The first three are shares of
the line's words, so a long paragraph with a few bullets or one such phrase stays.
Failing lines are removed.  A document is rejected when its base statistics fail
or when the removed lines hold too large a share of its characters.

Everything is computed within the row: no shuffle, so a hot source, a group of
copies or a very long text costs what its own characters cost.

Defined cases: null or blank text has no words and no lines, fails the base
rule (fewer than ``min_words`` words) and is rejected; blank lines are neither
kept nor counted as lost; repeated rows are judged alike, one output row each;
an empty table gives an empty result.  Other columns pass through; a column of
the input that has the name of a result column is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import GAP_CHARS, WORD_CLASS, fresh_name, sealed, words_of

SYMBOLS = "[#*$%&|<>]"
#: Marks that may close a line.
CLOSERS = r"""[.!?…:;,"'”’»)\]。！？]"""
#: Separators of navigation items.
SEPARATORS = "[|»›•·]"
#: A run of doubled marks, or a symbol run glued to a word.
CLUTTER = r"[!?]{2,}|[#*$%&<>]{2,}"
#: Fixed phrases of site furniture.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "click here to",
    "sign up for our newsletter",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
)


#: Letters of phrases match whatever their case, A-Z only.
_COUNTED = {"separators": SEPARATORS, "phrases": "(?i)" + "|".join(BOILERPLATE), "clutter": CLUTTER}


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Percent of a document's non-blank characters that removed lines may hold.
    max_lost_percent: int = 30
    #: Lines of fewer words must end with a closing mark.
    short_line_words: int = 4
    #: A line fails when marks of clutter reach this percent of its words.
    max_clutter_percent: int = 30
    #: A navigation line has so many separators, and one for each so many percent of its words.
    min_separators: int = 3
    min_separator_percent: int = 10
    #: A line is boilerplate up to so many words for each phrase in it.
    phrase_words: int = 12


PRODUCTION = QualityParams()


def line_verdict(line: Column, p: QualityParams = PRODUCTION, may: dict[str, Column] | None = None) -> Column:
    """The rule that a non-blank line fails, or null; ``may`` says whether a line of the text can match at all."""
    n_words = F.regexp_count(line, F.lit(WORD_CLASS + "+"))

    def count(what: str) -> Column:
        found = F.regexp_count(line, F.lit(_COUNTED[what]))
        return found if may is None else F.when(may[what], found).otherwise(0)

    separators, phrases = count("separators"), count("phrases")
    return (
        F.when((separators >= p.min_separators) & (separators * 100 >= n_words * p.min_separator_percent), "navigation")
        .when((phrases > 0) & (n_words <= phrases * p.phrase_words), "boilerplate")
        .when(count("clutter") * 100 >= n_words * p.max_clutter_percent, "punctuation")
        .when((n_words < p.short_line_words) & ~line.rlike(CLOSERS + r"[\x20\x09-\x0D]*$"), "punctuation")
    )


def _covered_words(starts: Column) -> Column:
    """Words covered by three-word windows that begin at the sorted ``starts``."""
    steps = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def apply_quality_rules(docs: DataFrame, text_col: str = "text", params: QualityParams = PRODUCTION) -> DataFrame:
    """``docs`` with base statistics, line verdicts, cleaned text and ``kept``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_removed_lines, line_chars, lost_chars (long),
    removed (array of line and rule), clean_text and kept.
    """
    p = params
    out = docs.columns
    words, lines, low, judged, grams, twice, starts = (fresh_name(docs, f"_q_{x}") for x in ("words", "lines", "low", "judged", "grams", "twice", "starts"))
    text = F.col(f"`{text_col}`")
    df = docs.withColumns(
        {
            words: words_of(text),
            lines: F.filter(F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")), lambda x: F.length(F.btrim(x, F.lit(GAP_CHARS))) > 0),
            low: F.lower(text),
        }
    )
    phrase = F.contains(low, F.lit(BOILERPLATE[0]))
    for x in BOILERPLATE[1:]:
        phrase = phrase | F.contains(low, F.lit(x))
    may = {x: fresh_name(docs, f"_q_may_{x}") for x in _COUNTED}
    df = df.withColumns({may["phrases"]: phrase, may["separators"]: text.rlike(SEPARATORS), may["clutter"]: text.rlike(CLUTTER)})
    w, n = F.col(words), F.size(words)
    # Windows are sorted by hash and place; the words are compared only where hashes are equal.
    at = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    gram = lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), i.alias("i"))
    gram_type = "array<struct<h:bigint,i:int>>"
    df = df.withColumns(
        {
            judged: F.transform(F.col(lines), lambda x: F.struct(x.alias("line"), line_verdict(x, p, {k: F.col(c) for k, c in may.items()}).alias("rule"))),
            grams: F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), gram))).otherwise(F.array().cast(gram_type)),
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    g = F.col(grams)

    def same(x: Column, y: Column) -> Column:
        """Whether the neighbours in hash order are one window; hashes come first, so words are seldom read."""
        equal = F.when(x["h"] == y["h"], F.struct(*at(x["i"])) == F.struct(*at(y["i"])))
        return F.coalesce(equal, F.lit(False))

    df = df.withColumn(twice, F.filter(g, lambda x, i: same(x, F.get(g, i - 1)) | same(x, F.get(g, i + 1))))
    df = df.withColumn(starts, F.sort_array(F.transform(twice, lambda x: x["i"])))
    df = df.withColumn("n_repeat_words", _covered_words(F.col(starts)))
    good = F.filter(judged, lambda x: x["rule"].isNull())
    bad = F.filter(judged, lambda x: x["rule"].isNotNull())
    total = F.aggregate(F.col(judged), F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    lost = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < p.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.max_repeat_percent),
            "n_lines": F.size(lines).cast("long"),
            "n_removed_lines": F.size(bad).cast("long"),
            "line_chars": total,
            "lost_chars": lost,
            "removed": bad,
            "clean_text": F.array_join(F.transform(good, lambda x: x["line"]), "\n"),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * p.max_lost_percent))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_removed_lines", "line_chars", "lost_chars", "removed", "clean_text", "kept"]
    return sealed(df, [c for c in out if c.lower() not in added], added)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = apply_quality_rules(docs)
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "line_chars", "lost_chars"
    )
