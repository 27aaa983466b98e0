import re
from collections import Counter

import pytest

from tasklattice.llm import quality_rules as q
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("source", ["table", "edge"])
def test_base_statistics_match_brute_force(spark, sf, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "table" else edge.documents(spark)
    rows = q.apply_quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)


def test_lines_are_judged_and_removed(spark):
    body = "\n".join("Sentence " + " ".join(f"w{k}x{j}" for j in range(9)) + " ends." for k in range(8))
    cases = {
        1: body,
        2: body + "\nhome | news | sport | contact | about",
        3: "\n".join(["a | b | c | d | e | f | g"] * 3 + ["All rights reserved by the owner of this fine site."] * 2 + [body[:120] + "."]),
        4: " ".join(f"WORD{k}!!" for k in range(60)),
        5: body + "\nMenu",
        6: " ".join(f"clean{k} prose" for k in range(300)) + " • and a | list › of · three, our privacy policy and all rights reserved.",
    }
    rows = {r.doc_id: r for r in q.apply_quality_rules(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert rows[1].kept and rows[1].clean_text == body
    assert rows[2].kept and rows[2].clean_text == body and rows[2].removed[0].rule == "navigation"
    assert not rows[3].kept and {x.rule for x in rows[3].removed} == {"navigation", "boilerplate"}
    assert not rows[4].kept and rows[4].removed[0].rule == "punctuation"
    assert rows[5].kept and rows[5].lost_chars == 4
    assert rows[6].kept and rows[6].n_removed_lines == 0


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, True)], "doc_id long, text string, KEPT string, n_words int, _q_words boolean")
    row = q.apply_quality_rules(docs).collect()[0]
    assert row.kept is False and row.n_words == 2 and row["_q_words"] is True
    assert q.apply_quality_rules(edge.empty(spark)).count() == 0
