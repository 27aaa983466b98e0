import random

import numpy as np
import pytest

from tasklattice.llm import near_dedup as nd
from tests.llm import edge


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(k, frozenset(shingles(t))) for k, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        sa, sb = sets[a][1], sets[b][1]
        if 100 * len(sa & sb) >= 75 * len(sa | sb):
            parent[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)], k == least[find(i)]) for i, (k, s) in enumerate(sets))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("sf_dir", ["sf0.001", "sf0.01"])
def test_groups_equal_brute_force_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"/root/testdata/{sf_dir}/documents.parquet")
    assert got(nd.link_near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_groups_of_near_copies_and_chains(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = rng.choices(vocabulary, k=160)
    rows = []
    for k in range(240):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + k, " ".join(w)))
    passage = rng.choices(vocabulary, k=60)  # a passage that many else unlike texts share
    rows += [(2000 + k, " ".join(passage + rng.choices(vocabulary, k=60))) for k in range(200)]
    chain = rng.choices(vocabulary, k=100)  # links only from one to the next
    for k in range(12):
        rows.append((3000 + k, " ".join(chain)))
        chain = chain[10:] + rng.choices(vocabulary, k=10)
    rows += [(4000 + k, "the same words for all of these") for k in range(50)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert got(nd.link_near_duplicates(docs)) == expected
    small = nd.DedupParams(small_bucket=4, block=20)
    assert got(nd.link_near_duplicates(docs, small)) == expected


def test_edge_cases(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.link_near_duplicates(edge.documents(spark)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (6, 12, 5, False), (9, 1, 9, True)} <= rows
    assert {r[2] for r in rows if r[0] in (7, 8)} == {7}
    assert nd.link_near_duplicates(edge.documents(spark)).count() == len(edge.ROWS)
    assert nd.link_near_duplicates(edge.empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in nd.link_near_duplicates(nulls).collect()} == {(None, None, True), (3, 3, True)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for n in (30, 300, 3000):
        errors = []
        for _ in range(60):
            a = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
            b = np.concatenate([a[: n * 6 // 7], rng.integers(0, 2**63, n - n * 6 // 7, dtype=np.int64).view(np.uint64)])
            truth = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
            errors.append((nd.super_min_hash(a, 128) == nd.super_min_hash(b, 128)).mean() - truth)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
