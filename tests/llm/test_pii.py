import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tasklattice.llm import pii
from tests.llm import edge

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                ok = 16 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                ok = 8 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y z@q.w. .@-.-",
    "a@b@c.de %+@x.y-z.w--.q",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.0255 1.2.3 1.2.3.4",
    "4012429011158754 4012-4290 1115-8754 401242901115875 4012429011158755 40124290111587541234 4 0 1 2",
    "+1 (383) 555-6083 ++49 30 1234567 +1 2 +12345678901234567 +1-..-9 +4 4)",
    "Grüße 😀 kontakt@köln.example.org 😀 +49 (30) 123-4567. 10.0.0.1",
    "ip 1.1.1.1@x.y 12 34 56 78 90 12 34 56 7+15551234567",
    "é" * 100 + "0" * 200 + " 1.1.1." + "9" * 30,
    " ".join(f"10.0.{k % 256}.{k // 256} m{k}@h.org" for k in range(300)),
]


@pytest.mark.parametrize("source", ["sf0.001", "edge", "tricky"])
def test_base_spans_equal_plain_patterns(spark, source):
    if source == "edge":
        docs = edge.documents(spark)
    elif source == "tricky":
        docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    else:
        docs = spark.read.parquet(f"/root/testdata/{source}/documents.parquet")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = [(s.kind, s.start, s.end) for s in r.pii if s.kind != "id"]
        assert base == brute(r.text)
        assert all((r.text or "")[s.start : s.end] == s.value for s in r.pii)


def test_query_digest(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.query(spark, sf).collect():
        base = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
        assert r.n_email == sum(k == "email" for k, _, _ in base)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"please send your question to agent {k}x or call the desk at number +1 (555) 555-{1000 + k} today") for k in range(8)]
    rows += [(100, "call the desk at number +9 (9) 9-9 today"), (101, "we counted to number 17 and then to 19 today")]
    rows += [(200 + k, f"charged to card {c} ok") for k, c in enumerate(["4012429011158754", "4712808554861838", "4272683025356771", "4727926364394221", "4018709761430345"])]
    rows += [(300, "charged to card 4012429011158755 ok"), (301, "a prize of 4012429011158755 coins")]
    found = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == [("phone", "+1 (555) 555-1000")]
    assert found[300] == [("id", "4012429011158755")]
    assert found[101] == [] and found[301] == []


def plain_scores(rows, p):
    """Pattern scores over (pattern, value, seed) triples, in plain Python."""
    edges = {(a, v) for a, v, _ in rows}
    seeds = {v for _, v, s in rows if s}
    known = dict.fromkeys(seeds, 1.0)
    for k in range(p.rounds):
        scored = {}
        for a in {a for a, _ in edges}:
            own = [known.get(v, 0.0) for b, v in edges if b == a]
            if sum(c >= p.min_confidence for c in own) >= p.min_support:
                scored[a] = round(sum(own) / (len(own) + p.smoothing), 9)
        if k + 1 < p.rounds:
            known = dict.fromkeys(seeds, 1.0)
            for v in {v for a, v in edges if a in scored} - seeds:
                doubt = 1.0
                for a, w in edges:
                    if w == v and a in scored:
                        doubt *= 1 - p.trust * scored[a]
                known[v] = round(1 - doubt, 9)
    return scored


@pytest.mark.parametrize("small", [100_000, 0])
def test_scores_equal_a_plain_walk_and_new_patterns_are_induced(spark, small):
    p = pii.PiiParams(broadcast_rows=small, salts=3)
    rows = [(f"card {k}", f"c{k}", 1.0) for k in range(3)]
    rows += [("pay", f"c{k}", 1.0) for k in range(30)] + [("pay", f"u{k}", 0.0) for k in range(4)]
    rows += [("due", f"u{k}", 0.0) for k in range(4)] + [("due", "w", 0.0), ("the", "w", 0.0), ("the", "7", 0.0)]
    df = spark.createDataFrame([([a], v, s) for a, v, s in rows], "patterns array<string>, value string, seed double")
    found = {r.pattern: r.score for r in pii.pattern_scores(df, p).collect()}
    expected = plain_scores(rows, p)
    assert found.keys() == expected.keys() == {"pay", "due"}
    assert all(abs(found[a] - expected[a]) < 1e-8 for a in expected)


def test_marks_forms_and_labels(spark):
    good = ["4012429011158754", "4712808554861838", "4272683025356771", "4727926364394221", "4018709761430345"]
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(6)]
    rows = [(k, f"charged to card {c}, thanks") for k, c in enumerate(good)] + [(10 + k, f'api token = "{x}" here') for k, x in enumerate(keys)]
    rows += [(30, "charged to card (4012429011158755)."), (31, 'charged to card "4012 4290 1115 8755"!'), (32, "api token = zZ" + "9a" * 20 + ";"), (33, "note: nothing here = fine"), (None, "charged to card 4012429011158755?")]
    found = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[30] == [("id", "4012429011158755")] and found[31] == [("id", "4012 4290 1115 8755")] and found[None] == found[30]
    assert found[10] == [("id", keys[0])] and found[32] == [("id", "zZ" + "9a" * 20)] and found[33] == []
    assert found[0] == [("card", good[0])]


def test_many_spans_in_one_text(spark):
    """Masking and finding take time in proportion to the spans."""
    import time

    text = "é " + " ".join(f"m{k}@h.org 10.0.{k % 256}.{k % 9} 😀 +1 (555) 555-{k % 9000 + 1000} n{k}" for k in range(20_000))
    took = []
    for n in (4, 1):
        docs = spark.createDataFrame([(1, text[: len(text) // n])], "doc_id long, text string")
        start = time.perf_counter()
        row = pii.mask(pii.find_personal_data(docs).withColumn("old", F.col("text"))).collect()[0]
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 10
    out, at = [], 0
    for a, b, kind in sorted((s.start, -s.end, s.kind) for s in row.pii):
        if a >= at:
            out += [row.old[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    assert row.text == "".join(out) + row.old[at:]


def test_masking(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org or 1.2.3.4, +1 (383) 555-6083!"), (2, "nothing"), (3, "4012429011158754"), (4, "a@b.org@c.de")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.mask(pii.find_personal_data(docs)).collect()}
    assert out == {1: "mail [EMAIL] or [IP], [PHONE]!", 2: "nothing", 3: "[CARD]", 4: "[EMAIL]@c.de"}


def test_edge_cases(spark):
    assert pii.find_personal_data(edge.empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "a@b.org", 5, 6, 7)], "doc_id long, text string, PII int, _t int, text_key int")
    row = pii.find_personal_data(docs).collect()[0]
    assert row["_t"] == 6 and row["text_key"] == 7 and row["pii"][0].kind == "email"
