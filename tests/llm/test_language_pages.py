"""op9 over the table of pages."""

from pyspark.sql import functions as F

from tasklattice.llm import language_id as li
from tasklattice.llm import registry


def test_registered_query_reads_markup_suffix_and_host_of_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = registry.QUERIES["op9_language_id_pages"](spark, sf).join(pages.select("page_id", li.declared_in(F.col("html")).alias("declared")), "page_id").collect()
    assert len(rows) == pages.count()
    assert sum(r.language == r.declared for r in rows) / len(rows) > 0.9


def test_suffix_and_domain_decide_where_text_and_markup_cannot(spark, tmp_path):
    en, fr = "the house is on the hill and the dog runs after the ball ", "la maison est sur la colline et le chien court apres la balle "
    page = lambda k, host, text, lang="": (k, f"https://{host}/{k}", f"<html{lang}><body>{text}</body></html>")
    rows = [page(k, f"h{k}.example.uk", en * 3, ' lang="en"') for k in range(30)] + [page(100 + k, f"h{k}.exemple.fr", fr * 3, ' lang="fr"') for k in range(30)]
    rows += [page(200, "new.other.uk", "12 xq zk"), page(201, "new.other.fr", "12 xq zk"), page(202, "unseen.exemple.fr:8080", "12 xq zk")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.language for r in registry.QUERIES["op9_language_id_pages"](spark, str(tmp_path)).collect()}
    assert (got[200], got[201], got[202]) == ("en", "fr", "fr") and len(got) == 63
