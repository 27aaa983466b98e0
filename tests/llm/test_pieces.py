import random

import pandas as pd
import pytest

from tasklattice.llm import pieces as pc
from tests.llm import edge

TEXTS = ["", " ", "  a  b\n\tＡ ﬁ ", "▁x ▁ y▁", "\U0001f600 naïve café \x00\x01", "x" * 3000, " leading and trailing  ", "日本語のテキスト", " nbsp"]


def plain_viterbi(p, text):
    """Position by position over the whole marked text, without words, hashes or numpy."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(k): (k, sp.get_score(k)) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
    if not text:
        return []
    s = pc.MARK + text.replace(pc.MARK, pc.LITERAL).replace(" ", pc.MARK)
    best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - p.longest), end):
            k, score = known.get(s[start:end], (None, p.unknown if end - start == 1 else None))
            if score is not None and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, k)
    out, end = [], len(s)
    while end:
        start, k = back[end]
        out += [k] if k is not None else [int(p.byte_id[b]) for b in reversed(s[start].replace(pc.LITERAL, pc.MARK).encode())]
        end = start
    return out[::-1]


@pytest.fixture(scope="module")
def pieces():
    return pc.pieces_of(None)


def test_segmentation_equals_plain_viterbi_and_round_trips(pieces):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    texts = TEXTS + [t[:400] for t in docs[:60]]
    for t, ids in zip(texts, pieces.encode(texts, pc.PieceParams(group_cells=5000)), strict=True):
        assert ids.tolist() == plain_viterbi(pieces, t)
        assert pieces.decode(ids.astype("int64")) == t
    for t, ids in zip(docs, pieces.encode(docs), strict=True):
        assert pieces.decode(ids.astype("int64")) == t


def test_frames(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = pc.decode_documents(pc.encode_documents(docs)).withColumnRenamed("text", "back").join(docs, "doc_id").collect()
    assert len(back) == docs.count() and all(r.back == r.text for r in back)
    rows = pc.encode_and_verify(edge.documents(spark)).collect()
    assert len(rows) == len(edge.ROWS) and all(r.exact for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (1, 2)} == {0}
    assert pc.encode_and_verify(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("params", [pc.PRODUCTION, pc.PieceParams(group_cells=500, long_word=20, segment_chars=17)])
def test_long_words_equal_plain_viterbi(pieces, params):
    draw = random.Random(5)
    alphabets = ("ab", "theofing", "日本語中文的一是", "x", "▁a", "\U0001f600é中a")
    texts = ["".join(draw.choice(a) for _ in range(n)) for n in (255, 256, 257, 319, 320, 641, 1200) for a in alphabets]
    texts += [" " * 700, "a" * 300 + " " * 300, "ab " * 200 + "q" * 700]
    for t, ids in zip(texts, pieces.encode(texts, params), strict=True):
        assert ids.tolist() == plain_viterbi(pieces, t)
        assert pieces.decode(ids.astype("int64")) == t
    assert [x.tolist() for x in pieces.encode(texts[::-1], params)][::-1] == [x.tolist() for x in pieces.encode(texts, params)]


def test_text_without_spaces_is_linear_work(pieces):
    draw = random.Random(6)
    text = "".join(draw.choice("日本語中文的一是在不了有和人这") for _ in range(1_000_000))
    ids = pieces.encode([text, None, "", text])
    assert [len(x) for x in ids[1:3]] == [0, 0] and ids[0].tolist() == ids[3].tolist()
    assert pieces.decode(ids[0].astype("int64")) == text
