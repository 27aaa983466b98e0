import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tasklattice.llm import packing
from tests.llm import edge


def brute_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_equals_document_by_document_best_fit():
    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([1, 10, 64, 300])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, max(1, capacity // 6)) for _ in range(rng.randint(0, 200))]
        plan = packing.best_fit_plan(Counter(lengths), capacity)
        left, spans = [capacity] * plan.n_bins, {}
        counts = Counter(lengths)
        for n, r, first, each, offset in zip(plan.length, plan.rank, plan.bin, plan.each, plan.offset, strict=True):
            later = [x for m, x in zip(plan.length, plan.rank, strict=True) if m == n and x > r]
            for k in range(min([counts[n], *later]) - r):
                b, at = first + k // each, offset + k % each * n
                left[b] -= n
                spans.setdefault(b, []).append((at, n))
        assert sorted(left) == brute_bins(lengths, capacity)
        for own in spans.values():
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n


@pytest.mark.parametrize("source", ["table", "edge"])
def test_pieces_cover_documents_and_ids_equal_the_tokenizer_library(spark, sf, source):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "table" else edge.documents(spark)
    rows = packing.pack_documents(docs).collect()
    texts = docs.collect()
    copies = Counter(t.doc_id for t in texts)
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for t in texts:
        ids = np.array([*tokenizer.encode(t.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[t.doc_id]})
        assert [p[0] for p in own] == list(range(len(own)))
        assert len(pieces[t.doc_id]) == copies[t.doc_id] * len(own)
        at = 0
        for k, start, n, crc in own:
            assert start == at and (n == 1024 or k == 0) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    for spans in bins.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 1024
    lengths = [r.length for r in rows]
    assert len(bins) == len(brute_bins(lengths, 1024))


def test_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(edge.documents(spark), with_ids=True)
    for r in packing.sequences(packed).collect():
        assert r.length == len(r.ids) <= 1024 and r.ids[-1] is not None
    assert packing.pack_documents(edge.empty(spark)).count() == 0


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("run", "n"), [(" ", 5_000_000), ("x", 5_000_000), ("\n", 1_000_000), ("!", 1_000_000), ("\u3000", 1_000_000), ("7", 1_000_000)])
def test_runs_of_any_length_are_encoded(spark, run, n):
    texts = {1: "so " + run * n + " it goes", 2: "a" + run * 49_999 + "b"}
    rows = {}
    for r in packing.token_pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for key, text in texts.items():
        ids = np.array([*library_ids(text), 2], "<u4")
        assert sum(r.length for r in rows[key]) == len(ids)
        for r in rows[key]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_a_length_that_many_rows_share_is_ranked_in_many_groups(spark):
    rows = [(7 if k % 3 else k, 0, 0, 400 if k % 3 else 1 + k % 600, 5) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    from tasklattice.llm.common import checkpointed

    out = packing.place(checkpointed(pieces), packing.PackParams(bucket_rows=50)).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(rows)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 1024
    assert len(bins) == len(brute_bins([r[3] for r in rows], 1024))


def test_other_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 4, "x", None)], "doc_id long, text string, length int, sequence_id string, place int")
    assert packing.pack_documents(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
