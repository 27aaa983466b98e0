"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The pieces and scores come from a SentencePiece model file.  A text's spaces
become piece marks, one mark is put before it, and it falls into words that no
piece crosses.  The distinct words of a batch are grouped by length, and all
words of one length advance together: prefix hashes give the hash of every
substring of a given length at once, ``searchsorted`` probes the sorted piece
keys with them, and maxima over the pieces that end at a position store the
backpointers.  A word above ``long_word`` characters falls into segments of
``segment_chars`` which advance together as rows of one length: once from each
place at which a path may enter a segment, which gives a matrix of best scores
from entry to entry; these, applied one after the other, give each segment's
entry scores, from which all segments advance once more for their backpointers.
Characters without a piece cost ten more than the worst piece and
become byte pieces.

The result is the segmentation of greatest total score (of equal ones, that
whose last differing piece is longest), which is what a unigram model with these
pieces gives; the merges of the model's own BPE mode are not replayed.  Decoding
is exact: byte pieces give their bytes and only the marks of other pieces become
spaces, so also a mark that stands in the text itself comes back.

Memory is bounded by a batch of ``batch_chars`` characters (or one text; of a
long word, segments are taken in blocks and only a backpointer and a piece are
kept for each character).  Time is in proportion to the characters.

Defined cases: null and empty texts have no pieces and decode to an empty text;
repeated rows give equal rows; an empty table gives an empty result.  Only the
id and text columns are read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tasklattice.llm.common import small_batches

U64 = np.uint64
MARK = "▁"
#: Stands for a mark in the text itself; UTF-8 text cannot hold it.
LITERAL = "\ud800"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE = 0xC6A4A7935BD1E995
UNKNOWN_PENALTY = 10.0
_MAYBE = 1 << 20
#: Stands beyond the end of a word; no code point.
_NO_CHARACTER = 0xFFFFFFFF


@dataclass(frozen=True)
class PieceParams:
    #: Path of the model; None stands for the public BPE of 32k pieces.
    model: str | None = None
    batch_chars: int = 2_000_000
    group_cells: int = 400_000
    #: Longer words advance as segments of so many characters (more than the longest piece).
    long_word: int = 256
    segment_chars: int = 64


PRODUCTION = PieceParams()


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (n, length + 1) of rows of code points (n, length)."""
    out = np.zeros((len(codes), codes.shape[1] + 1), U64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * U64(_BASE) + codes[:, k].astype(U64) + U64(1)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _key(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0x9FB21C651E98DF25) + U64(length * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return h ^ (h >> U64(29))


class Pieces:
    """Sorted keys, ids and scores of a model's pieces, and the bytes that each id decodes to."""

    def __init__(self, path: str | None) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.byte_id = np.full(256, -1, np.int64)
        keys, ids, scores, data = [], [], [], []
        self.longest = 1
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value] = k
                data.append(bytes((value,)))
                continue
            if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                data.append(b"")
                continue
            data.append(piece.replace(MARK, " ").encode())
            codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)[None, :]
            keys.append(int(_key(_hash(codes)[:, -1], len(piece))[0]))
            ids.append(k)
            scores.append(model.get_score(k))
            self.longest = max(self.longest, len(piece))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        order = np.argsort(np.array(keys, U64), kind="stable")
        self.keys, self.ids, self.scores = np.array(keys, U64)[order], np.array(ids)[order], np.array(scores, np.float64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.unknown = self.scores.min() - UNKNOWN_PENALTY
        #: Whether any key ends in these bits: spares most probes.
        self.maybe = np.zeros(_MAYBE, bool)
        self.maybe[(self.keys & U64(_MAYBE - 1)).astype(np.int64)] = True
        self.data = data
        self.powers = [U64(pow(_BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        self.sizes = np.array([len(x) for x in data], np.int64)
        self.blob = np.frombuffer(b"".join(data), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """The slot of the piece of length k that ends at a place of a row, or -1: (k, row, end)."""
        n, length = codes.shape
        prefix = _hash(codes)
        most = min(self.longest, length)
        found = np.full((most + 1, n, length + 1), -1, np.int32)
        for k in range(1, most + 1):
            key = _key(prefix[:, k:] - prefix[:, :-k] * self.powers[k], k)
            flat, slot = key.ravel(), np.full(key.size, -1, np.int32)
            likely = np.flatnonzero(self.maybe[(flat & U64(_MAYBE - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, flat[likely]), len(self.keys) - 1)
            slot[likely] = np.where(self.keys[at] == flat[likely], at, -1)
            found[k, :, k:] = slot.reshape(key.shape)
        return found

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one word after the other, and how many each has."""
        n, length = len(words), len(words[0])
        found = self.probe(_codes("".join(words)).reshape(n, length))
        most = len(found) - 1
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), np.int8 if most < 127 else np.int32)
        for end in range(1, length + 1):
            tops, back_here = np.full(n, -np.inf), np.zeros(n, back.dtype)
            for k in range(min(most, end), 0, -1):
                slot = found[k, :, end]
                total = best[:, end - k] + np.where(slot >= 0, self.scores[slot], self.unknown if k == 1 else -np.inf)
                more = total > tops
                tops[more], back_here[more] = total[more], k
            best[:, end], back[:, end] = tops, back_here
        # All words follow their backpointers together; unknown characters keep their place, as -2 and below.
        rows, end = np.arange(n), np.full(n, length)
        steps = np.full((n, length), -1, np.int64)
        for t in range(length):
            k = back[rows, end]
            slot = found[k, rows, end]
            steps[rows, t] = np.where(slot >= 0, self.ids[slot], -1 - end)
            end = end - k
            rows, end = rows[end > 0], end[end > 0]
            if not len(rows):
                break
        steps = steps[:, ::-1]
        used = steps != -1
        sizes, flat = used.sum(1), steps[used]
        if (flat >= 0).all():
            return flat.astype(np.int32), sizes
        out, at = [], 0
        for r, size in enumerate(sizes.tolist()):
            own = []
            for x in flat[at : at + size].tolist():
                own += [x] if x >= 0 else self.byte_id[list(words[r][-2 - x].replace(LITERAL, MARK).encode("utf-8", "surrogatepass"))].tolist()
            at += size
            out.append(own)
        return np.array([x for own in out for x in own], np.int32), np.array([len(x) for x in out])

    def _advance(self, found: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores and backpointers of rows of ``size`` characters, by (row, entry set, place).

        ``entry`` (rows, sets, places) scores the first places of a row; a place
        reached best by an entry has backpointer 0.  Pieces begin within ``size``.
        """
        rows, sets, reach = entry.shape
        best = np.full((rows, sets, size + reach), -np.inf)
        best[:, :, :reach] = entry
        back = np.zeros((rows, sets, size + reach), np.int32)
        for end in range(1, size + reach):
            tops, here = best[:, :, end], back[:, :, end]
            for k in range(min(reach, end), max(0, end - size), -1):
                slot = found[k, :, end]
                score = np.where(slot >= 0, self.scores[slot], self.unknown if k == 1 else -np.inf)
                total = best[:, :, end - k] + score[:, None]
                more = total > tops
                tops[more], here[more] = total[more], k
        return best, back

    def long_words(self, words: list[str], p: PieceParams = PRODUCTION) -> list[np.ndarray]:
        """Ids of long words.  A word has a segment more than it needs, so its end is a place of its own segments."""
        reach, size = self.longest, max(p.segment_chars, self.longest)
        spans = [(len(w) // size + 1) * size for w in words]
        first = np.zeros(sum(spans) // size, bool)
        begins = np.cumsum(spans) - spans
        first[begins // size] = True
        codes = np.full(sum(spans) + reach, _NO_CHARACTER, np.uint32)
        for at, w in zip(begins.tolist(), words, strict=True):
            codes[at : at + len(w)] = _codes(w)
        back, slots = np.zeros(sum(spans), np.int32), np.empty(sum(spans), np.int32)
        start = np.full(reach, -np.inf)
        start[0] = 0.0
        every = np.where(np.eye(reach, dtype=bool), 0.0, -np.inf)
        block = max(1, p.group_cells // (size + reach))
        carried, last = start, None
        for at in range(0, len(first), block):
            rows = np.arange(at, min(at + block, len(first)))
            found = self.probe(codes[(rows * size)[:, None] + np.arange(size + reach - 1)])
            leaps = self._advance(found, np.broadcast_to(every, (len(rows), reach, reach)), size)[0][:, :, size:]
            entry = np.empty((len(rows), 1, reach))
            for r, leap in zip(rows.tolist(), leaps, strict=True):
                entry[r - at, 0] = start if first[r] else carried
                carried = (entry[r - at, 0][:, None] + leap).max(0)
            steps = self._advance(found, entry, size)[1][:, 0]
            used = found[steps, np.arange(len(rows))[:, None], np.arange(size + reach)]
            both = np.stack([steps, used])
            # Places that an earlier segment's piece reaches take that segment's backpointers.
            before = np.concatenate([np.zeros((2, 1, reach), both.dtype) if last is None else last, both[:, :-1, size:]], axis=1)
            own = both[:, :, :size].copy()
            own[:, :, :reach] = np.where(steps[:, :reach] == 0, before, own[:, :, :reach])
            last = both[:, -1:, size:]
            back[rows[0] * size : (rows[-1] + 1) * size], slots[rows[0] * size : (rows[-1] + 1) * size] = own.reshape(2, -1)
        view = memoryview(back)
        out = []
        for at, w in zip(begins.tolist(), words, strict=True):
            ends, end = array("q"), at + len(w)
            while end > at:
                ends.append(end)
                end -= view[end]
            ends = np.frombuffer(ends, np.int64)[::-1]
            own = slots[ends]
            ids = self.ids[own].astype(np.int32)
            bare = np.flatnonzero(own < 0)
            if len(bare):
                parts, done = [], 0
                for k in bare.tolist():
                    parts.append(ids[done:k])
                    character = w[int(ends[k]) - at - 1].replace(LITERAL, MARK)
                    parts.append(self.byte_id[list(character.encode("utf-8", "surrogatepass"))].astype(np.int32))
                    done = k + 1
                ids = np.concatenate([*parts, ids[done:]])
            out.append(ids)
        return out

    def encode(self, texts: list[str | None], p: PieceParams = PRODUCTION) -> list[np.ndarray]:
        number: dict[str, int] = {}
        rows = []
        for t in texts:
            if not t:
                rows.append(np.empty(0, np.int64))
                continue
            words = _WORD.findall(MARK + (t.replace(MARK, LITERAL) if MARK in t else t).replace(" ", MARK))
            rows.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        by_length: dict[int, list[str]] = {}
        for w in number:
            by_length.setdefault(len(w), []).append(w)
        starts, sizes = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        parts, at_all = [], 0
        long = [w for length, words in by_length.items() if length > p.long_word for w in words]
        for w, own in zip(long, self.long_words(long, p) if long else [], strict=True):
            sizes[number[w]], starts[number[w]] = len(own), at_all
            parts.append(own)
            at_all += len(own)
        for length, words in by_length.items():
            if length > p.long_word:
                continue
            step = max(1, p.group_cells // (length + 1))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                own, n = self.segment(part)
                place = np.array([number[w] for w in part])
                sizes[place], starts[place] = n, at_all + np.cumsum(n) - n
                parts.append(own)
                at_all += len(own)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return [_gather(flat, starts[r], sizes[r]) for r in rows]

    def decode(self, ids: np.ndarray) -> str:
        data = _gather(self.blob, self.starts[ids], self.sizes[ids]).tobytes()
        return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "replace")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` one after the other."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


@functools.lru_cache(maxsize=2)
def pieces_of(path: str | None) -> Pieces:
    return Pieces(path)


def _parts(rows: list[tuple], batch_chars: int) -> Iterator[list[tuple]]:
    part, held = [], 0
    for r in rows:
        n = len(r[1]) if r[1] is not None else 0
        if part and held + n > batch_chars:
            yield part
            part, held = [], 0
        part.append(r)
        held += n
    if part:
        yield part


def encode_documents(docs: DataFrame, params: PieceParams = PRODUCTION) -> DataFrame:
    """doc_id and ids of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(params.model)
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            for part in _parts(rows, params.batch_chars):
                ids = pieces.encode([t for _, t in part], params)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, params: PieceParams = PRODUCTION) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(params.model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [pieces.decode(np.array(x.values if x.is_valid else [], np.int64)) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_verify(docs: DataFrame, params: PieceParams = PRODUCTION) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), decoded_crc32 (UTF-8 of the decoded ids) and exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(params.model)
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            for part in _parts(rows, params.batch_chars):
                ids = pieces.encode([t for _, t in part], params)
                back = [pieces.decode(x.astype(np.int64)) for x in ids]
                columns = [
                    pa.array([k for k, _ in part], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in back], pa.int64()),
                    pa.array([b == (t or "") for b, (_, t) in zip(back, part, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "exact"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_and_verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
