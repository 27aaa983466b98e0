import zlib
from collections import Counter

import pytest

from tasklattice.llm import sharding
from tests.llm import edge


def check(docs, rows, p):
    assert len(rows) == docs.count()
    size = lambda t: 16 + len((t or "").encode())
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == Counter((t.doc_id, size(t.text), zlib.crc32((t.text or "").encode())) for t in docs.collect())
    slots, total = {}, [0] * p.shards
    for r in rows:
        slots.setdefault(r.shard, []).append((r.slot, r.sort_key))
        total[r.shard] += r["size"]
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        assert [k for _, k in own] == sorted(k for _, k in own)
    keys = [(min(k for _, k in slots[s]), max(k for _, k in slots[s])) for s in sorted(slots)]
    assert all(a[1] < b[0] for a, b in zip(keys, keys[1:], strict=False))
    return total


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = check(docs, sharding.shard_rows(docs).collect(), sharding.PRODUCTION)
    largest = docs.selectExpr("max(octet_length(text)) AS n").first().n + 16
    assert max(total) - min(total) <= largest + 2 * 0.001 * sum(total) / 40


def test_one_text_holding_most_rows_is_spread(spark):
    rows = [(k, "the one text" if k % 3 else f"text {k}") for k in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    p = sharding.ShardParams(range_rows=500)
    total = check(docs, sharding.shard_rows(docs, params=p).collect(), p)
    assert max(total) - min(total) <= 0.002 * sum(total) / 40 + 2 * 30


def test_edge_cases(spark):
    p = sharding.PRODUCTION
    check(edge.documents(spark), sharding.shard_rows(edge.documents(spark)).collect(), p)
    assert sharding.shard_rows(edge.empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "a", 9, 8, 7)], "doc_id long, text string, _leaf int, shard int, Size int")
    row = sharding.shard_rows(docs).collect()[0]
    assert row["_leaf"] == 9 and row["size"] == 17


@pytest.mark.parametrize("shards", [1, 2])
def test_few_shards(spark, shards):
    p = sharding.ShardParams(shards=shards)
    check(edge.documents(spark), sharding.shard_rows(edge.documents(spark), params=p).collect(), p)
