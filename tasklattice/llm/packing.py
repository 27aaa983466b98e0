"""Best-fit-decreasing packing of tokenised documents into sequences.

Lengths are small integers, so the whole corpus is packed exactly from its
length histogram.  The plan goes through the lengths from long to short and puts
each document into the open bin of least remaining capacity that still holds
it; a segment tree over the capacities finds that bin in logarithmic time.  Bins
of equal remaining capacity are interchangeable and kept as runs, and all
documents of one length that go to one run are placed at once, so the plan's
size depends on the sequence length alone, not on the corpus.

Documents get their place from their rank among those of the same length.
Ranks are counted within (length, bucket) groups.  Each length is cut into as many
buckets as its count needs for some ``bucket_rows`` rows in each, and rows are
dealt to them by their place in the checkpointed table, so neither a common length
nor a common id makes a large group.  Only pieces (a few numbers each) are
shuffled; the (length, bucket) counts that come to the driver number at most
``capacity`` and one for each ``bucket_rows`` rows.

Defined cases: null text is empty and gives the end token alone; documents
longer than the capacity are cut into pieces of full capacity, the first piece
taking the remainder; repeated rows are packed each; runs of white space, letters
or signs may have any length; an empty table gives an empty result.  Only the id
and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, small_batches


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    end_id: int = 2
    #: Rows of one length that are ranked in one group, on average at most.
    bucket_rows: int = 250_000
    #: Path of the tokenizer file; None stands for the public byte-level BPE of 50k ids.
    tokenizer: str | None = None


PRODUCTION = PackParams()


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE files: printable bytes stand for themselves, the rest for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: The rank encoder's pattern keeps a stack as deep as a run of white space; longer runs go to the tokenizers library.
_DEEP = re.compile(r"(?<!\s)\s{50000}")


@functools.lru_cache(maxsize=2)
def encoder(path: str | None) -> Callable[[str], list[int]]:
    """Text to ids of a byte-level BPE file, by the ranks of its vocabulary.

    The ids equal those of the tokenizers library with special strings taken as
    ordinary text, at a fifth of its time.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    by_rank = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= 50_000 and _DEEP.search(text):
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            return whole.encode(text, add_special_tokens=False).ids
        return by_rank.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, p: PackParams = PRODUCTION, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for the pieces of (doc_id, text)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = np.array([*encode(text or ""), p.end_id], "<u4")
                    edges = [0, *range(len(tokens) % p.capacity or p.capacity, len(tokens) + 1, p.capacity)]
                    for k in range(len(edges) - 1):
                        own = tokens[edges[k] : edges[k + 1]]
                        doc.append(key)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..n; finds the least capacity of at least x with an open bin."""

    def __init__(self, n: int) -> None:
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.bins = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, count: int) -> None:
        k = capacity + self.size
        while k:
            self.bins[k] += count
            k //= 2

    def tightest(self, least: int) -> int | None:
        k = least + self.size
        if self.bins[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.bins[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.bins[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


@dataclass
class Placements:
    """Runs of documents of one length: ranks from ``rank`` on go to bins from ``bin`` on, ``each`` to a bin, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_bins: int


def best_fit_plan(histogram: dict[int, int], capacity: int) -> Placements:
    """Best-fit decreasing over ``histogram`` (length to count, lengths 1 to capacity)."""
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    n_bins = 0

    def open_run(left: int, first: int, count: int) -> None:
        if left and count:
            runs.setdefault(left, []).append((first, count))
            tree.add(left, count)

    for length in sorted(histogram, reverse=True):
        todo, rank = int(histogram[length]), 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                each = capacity // length
                left, first, count = capacity, n_bins, -(-todo // each)
                n_bins += count
            else:
                first, count = runs[left].pop()
                tree.add(left, -count)
                each = left // length
            full, rest = divmod(todo, each)
            used = min(count, full)
            if used:
                placed.append((length, rank, first, each, capacity - left))
                open_run(left - each * length, first, used)
                rank, todo, first, count = rank + used * each, todo - used * each, first + used, count - used
            if count and 0 < todo < each:
                placed.append((length, rank, first, each, capacity - left))
                open_run(left - todo * length, first, 1)
                rank, todo, first, count = rank + todo, 0, first + 1, count - 1
            open_run(left, first, count)
    columns = np.array(placed, np.int64).reshape(-1, 5).T
    return Placements(*columns, n_bins)


def place(pieces: DataFrame, p: PackParams = PRODUCTION) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.  Call it on a checkpointed table."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    widths = np.zeros(p.capacity + 1, np.int64)
    for n, count in total.items():
        widths[n] = -(-count // p.bucket_rows)
    first_bucket = np.cumsum(widths) - widths
    width_of = F.get(F.lit(widths.tolist()), F.col("length").cast("int"))
    first_of = F.get(F.lit(first_bucket.tolist()), F.col("length").cast("int"))
    dealt = pieces.select(*names, F.monotonically_increasing_id().alias("place"))
    dealt = dealt.withColumn("bucket", first_of + F.pmod(F.xxhash64("place"), width_of))
    counts = np.zeros(int(widths.sum()) + 1, np.int64)
    for r in dealt.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    before = np.cumsum(counts) - counts
    base = before - before[np.repeat(first_bucket, widths).tolist() + [0]]
    plan = best_fit_plan(total, p.capacity)
    order = np.lexsort((plan.rank, plan.length))
    sent = spark.sparkContext.broadcast((base, [x[order] for x in (plan.length, plan.rank, plan.bin, plan.each, plan.offset)]))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "piece", "place")) - 1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, (length, rank, first, each, offset) = sent.value
        most = np.int64(1) << 40
        keys = length * most + rank
        for f in frames:
            n = f["length"].to_numpy()
            r = base[f["bucket"].to_numpy()] + f["rank"].to_numpy()
            k = np.searchsorted(keys, n * most + r, side="right") - 1
            into = r - rank[k]
            f["sequence_id"] = first[k] + into // each[k]
            f["offset"] = offset[k] + into % each[k] * n
            yield f[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in dealt.select(*names).schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(assign, schema)


def pack_documents(docs: DataFrame, params: PackParams = PRODUCTION, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and offset, and with their token ids if asked."""
    return place(checkpointed(token_pieces(docs, params, with_ids)), params)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each packed sequence; ``packed`` has ids.  A sequence holds one capacity at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return rows.select("sequence_id", "length", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
