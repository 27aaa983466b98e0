import pytest

import corpus_pipeline
from tests.llm import edge
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_quality_rules import brute as brute_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_the_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == COLUMNS and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
    judged = {r.doc_id: r for r in seen["language_id"]}
    assert len(judged) >= 0.95 * len(before) and all(r.text == before[k].text for k, r in judged.items())
    good = {r.doc_id: r for r in seen["quality_rules"]}
    for k, r in judged.items():
        n_words, _, _, _, repeats = brute_quality(r.text)
        if n_words < 50 or 100 * repeats > 50 * n_words:
            assert k not in good
    assert all(good[k].n_chars == len(good[k].text) for k in good)
    expected = {k for k, _, _, kept in brute_groups([(k, r.text) for k, r in good.items()]) if kept}
    single = {r.doc_id: r for r in seen["minhash_dedup"]}
    assert set(single) == expected
    for r in seen["pii"]:
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == single[r.doc_id].text) == (not brute_spans(single[r.doc_id].text)) or "[ID]" in r.text
    pieces = {}
    for r in seen["best_fit_packing"]:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in pieces.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 1024
    assert {r.doc_id for r in seen["best_fit_packing"]} == set(single)


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id", "left_semi")
    spoken = stage("language_id")(spark, docs, sf)
    assert spoken.count() == docs.count()
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 50}
    kept = {r.doc_id for r in stage("quality_rules")(spark, spoken, sf).collect()}
    assert long <= kept


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_cases_and_empty_tables(spark, sf, name):
    for docs in (edge.documents(spark), edge.empty(spark)):
        out = stage(name)(spark, docs, sf)
        rows = out.collect()
        assert len(rows) <= len(edge.ROWS) + 400 and (docs.count() or not rows)
        if name != "best_fit_packing":
            assert out.columns == COLUMNS


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("length > 1024").count() == 0


def test_of_repeated_rows_one_stays(spark, sf):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", "s", 1)] * 3 + [(2, text, "en", "s", 1), (None, "a b", "en", "s", 1), (None, "a b", "en", "s", 1), (3, None, None, None, None), (3, None, None, None, None)]
    out = stage("minhash_dedup")(spark, spark.createDataFrame(rows, edge.SCHEMA), sf).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == [(False, 1), (False, 3), (True, None), (True, None)]
