import pytest
from pyspark.sql import functions as F

from tasklattice.llm import language_id as li
from tests.llm import edge


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang_true", F.col("lang"))
    held = docs.withColumn("lang", F.when(F.xxhash64("doc_id") % 2 == 0, F.col("lang")))
    rows = li.identify_documents(held).where("lang is null and n_chars > 200").collect()
    assert len(rows) > 200
    assert sum(r.language == r.lang_true for r in rows) / len(rows) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.97


def test_pages_use_markup_suffix_and_host(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = li.identify_pages(pages).select("language", "accepted", li.declared_in(F.col("html")).alias("declared")).collect()
    assert len(rows) == 250 and sum(r.language == r.declared for r in rows) / 250 > 0.95
    one = spark.createDataFrame([("https://a.b.fr:80/x", '<!DOCTYPE html><HTML class=x LANG="pt-BR">', "news.example.org")], "u string, h string, host string")
    got = one.select(li.suffix_of(F.col("u")), li.declared_in(F.col("h")), li.domain_of(F.col("host")), li.suffix_of(F.col("host"))).first()
    assert list(got) == ["fr", "pt", "example.org", "org"]


def test_host_and_declaration_decide_where_the_text_cannot(spark):
    en, de = "the house is on the hill and the dog runs after the ball ", "das haus steht auf dem huegel und der hund rennt nach dem ball "
    rows = [(k, en * 3, "en", "uk") for k in range(40)] + [(100 + k, de * 3, "de", "at") for k in range(40)]
    rows += [(200, "12 xq zk", None, "uk"), (201, "12 xq zk", None, "at"), (202, "xq zk wv", "de", None), (203, de * 3, "en", "at")]
    out = {r.doc_id: r for r in li.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[200].language == "en" and out[201].language == "de" and out[202].language == "de" and out[203].language == "de"


def test_edge_cases(spark):
    out = {r.doc_id: r for r in li.identify_documents(edge.documents(spark)).collect()}
    for k in (1, 2, 3):
        assert out[k].language == "und" and not out[k].accepted and out[k].posterior == 0
    assert li.identify_documents(edge.documents(spark)).count() == len(edge.ROWS)
    assert li.identify_documents(edge.empty(spark)).count() == 0
    clash = edge.documents(spark).withColumn("Language", F.lit(1)).withColumn("_l_text", F.lit(2))
    row = li.identify_documents(clash).where("doc_id = 10").first()
    assert row["_l_text"] == 2 and row["language"] in ("de", "en")


@pytest.mark.parametrize("bits", [10, 15])
def test_cells_lie_in_the_table(bits):
    cells = li.trigram_cells("Grüße, world 123".encode(), bits)
    assert len(cells) and cells.max() < 1 << bits
