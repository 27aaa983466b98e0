"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. ``signatures``: each text's distinct shingles (hashed to 64 bits) give a
   SuperMinHash signature.  For step j = 0, 1, ... every shingle draws a value
   in [j, j + 1) and the next entry of its own random permutation of the slots,
   so ranks within one shingle are correlated.  A text stops as soon as the next
   step cannot lower any slot, which for long texts is after one or two steps.
2. Texts with the same shingle set fall together (map-side minimum of doc_id),
   so copies never meet pairwise.
3. ``band`` keys of four slots each gather candidate texts.  Each member is
   paired with the smallest leader of its buckets (linear in the members); the
   pairs are verified on the full shingle sets and joined by union-find.
4. Buckets whose members are still in different groups are searched in full:
   small ones by a join across groups, large ones in blocks spread over tasks
   that verify on the full sets and give a forest of the links.  No bucket is
   cut short.

Two texts of similarity s share none of the 32 bands with probability
(1 - s^4)^32: 5e-6 at 0.75 and below 1e-9 at 0.83.

Shuffles carry band keys and ids; shingle sets move only for members of
candidate pairs.  Each stage's result is checkpointed in the shared folder.

Defined cases: null or empty text, or text without words: no shingles, alone in
its group.  Fewer words than ``shingle_words``: the whole sequence is the one
shingle.  Rows with equal doc_id and equal texts get equal results, one output
row each; rows that share a doc_id and differ in text are one node of the graph,
linked with all that any of their texts is linked with.  A null doc_id is linked with nothing and kept, its component null.
An empty table gives an empty result.  Only doc_id and text are read, so other
columns of the input cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, small_batches

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class DedupParams:
    shingle_words: int = 5
    #: Linked if 100 * intersection >= min_percent * union.
    min_percent: int = 75
    bands: int = 32
    rows: int = 4
    #: Buckets of more members are searched in blocks.
    small_bucket: int = 32
    block: int = 1000
    #: The table of large buckets (four numbers each) is broadcast up to so many.
    broadcast_buckets: int = 200_000
    #: Bits, as a power of 2, of the bitmap by which the second scan passes over documents in no candidate pair.
    filter_bits: int = 25

    @property
    def slots(self) -> int:
        return self.bands * self.rows


PRODUCTION = DedupParams()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and multiplications by odd numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random number for each byte value, ASCII upper case folded to lower case, 0 for gaps.
_BYTE = mix64(np.arange(1, 257, dtype=U64) * GOLDEN)
_BYTE[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, grown when a longer chunk comes."""

    up = _powers(_BASE, _CHUNK)
    down = _powers(_BASE_INVERSE, _CHUNK)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text, A-Z folded, and the byte at which each begins."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, U64), np.empty(0, np.int64)
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(b))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[b] * up, dtype=U64)))
    h = (sums[ends] - sums[starts]) * down[starts] if len(starts) else np.empty(0, U64)
    return mix64(h + (ends - starts).astype(U64) * GOLDEN), starts


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if chunk and size + len(data) + 1 > _CHUNK:
            yield from _chunk_sets(chunk, k)
            chunk, size = [], 0
        chunk.append(data)
        size += len(data) + 1
    if chunk:
        yield from _chunk_sets(chunk, k)


def _chunk_sets(chunk: list[bytes], k: int) -> Iterator[np.ndarray]:
    w, starts = word_hashes(b"\n".join(chunk))
    ends = np.cumsum([len(x) + 1 for x in chunk])
    cut = np.searchsorted(starts, ends)
    n = len(w)
    grams = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        grams = (grams ^ w[j : j + len(grams)]) * GOLDEN
        grams ^= grams >> U64(29)
    grams = mix64(grams)
    at = 0
    for end in cut:
        m = end - at
        if m >= k:
            yield np.unique(grams[at : end - k + 1])
        elif m:
            h = U64(m)
            with np.errstate(over="ignore"):
                for x in w[at:end]:
                    h = (h ^ x) * GOLDEN
                    h ^= h >> U64(29)
            yield mix64(np.array([h], U64))
        else:
            yield np.empty(0, U64)
        at = end


def super_min_hash(shingles: np.ndarray, slots: int) -> np.ndarray:
    """Signature of a non-empty set of 64-bit hashes, one double for each slot."""
    h = np.full(slots, np.inf)
    n = len(shingles)
    perm = None
    for j in range(slots):
        x = mix64(shingles + U64((2 * j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        value = (x >> U64(11)).astype(np.float64) * 2.0**-53 + j
        pick = (mix64(x + GOLDEN) >> U64(33)).astype(np.int64) % (slots - j) + j
        if perm is None:
            slot = pick
        else:
            slot = perm[rows, pick]  # noqa: F821
        np.minimum.at(h, slot, value)
        if h.max() < j + 1:
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
            rows = np.arange(n)
        perm[rows, pick] = perm[:, j]
    return h


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(U64).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=U64) * GOLDEN
    for r in range(rows):
        h = mix64(h ^ bits[:, r]) * GOLDEN
    return mix64(h).view(np.int64)


def signatures(docs: DataFrame, p: DedupParams) -> DataFrame:
    """n_shingles, set_key and bands of every row of (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, keys, bands = [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), p.shingle_words):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        bands.append(None)
                        continue
                    low = np.bitwise_xor.reduce(mix64(s)), np.add.reduce(mix64(s ^ GOLDEN))
                    keys.append(np.array([*low, len(s)], U64).tobytes())
                    bands.append(band_hashes(super_min_hash(s, p.slots), p.bands, p.rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _among(ids: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2 ** bits bits, at most, with those of the hashed ``ids`` (rep) set; its size doesn't depend on them."""
    at = _bit_of(F.col("rep"), bits)
    parts = ids.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bitmap"))
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for part, bitmap in parts.collect():
        out[part] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def _bit_of(rep: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(rep), 64 - bits)


def member_sets(members: DataFrame, docs: DataFrame, p: DedupParams) -> DataFrame:
    """rep and shingles of the ``members`` (rep) of candidate pairs; ``docs`` has (doc_id, text).

    A bitmap of fixed size lets the scan pass over nearly all other documents
    while it is far from full; the exact semi join decides in any case.
    """
    bitmap = members.sparkSession.sparkContext.broadcast(_among(members, p.filter_bits))

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        at = bit.fillna(0).to_numpy(np.int64)
        return pd.Series((bitmap.value[at >> 3] >> (at & 7)) & 1 == 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = list(shingle_sets(part.column("text").to_pylist(), p.shingle_words))
                columns = [part.column("doc_id"), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "shingles"])

    likely = docs.select("doc_id", "text").where(maybe(_bit_of(F.col("doc_id"), p.filter_bits)))
    found = likely.mapInArrow(sets, "rep long, shingles array<long>")
    return found.where("size(shingles) > 0").join(members, "rep", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, p: DedupParams) -> DataFrame:
    """The pairs (a, b) that are near enough on their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(left, "a").join(right, "b").where(common * 100 >= union * p.min_percent).select("a", "b")


def union_find(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b).

    Each task first reduces its edges to a spanning forest by union-find; then
    alternating large-star and small-star rounds until nothing changes.
    """

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for f in frames:
            for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        nodes = list(parent)
        if nodes:
            yield pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}).query("u != v")

    e = checkpointed(edges.select("a", "b").mapInPandas(forest, "u long, v long").distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = checkpointed(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _small_bucket_pairs(open_rows: DataFrame, p: DedupParams) -> DataFrame:
    """All pairs across groups in buckets of ``small_bucket`` members at most: linear in the members."""
    small = open_rows.where(F.col("members") <= p.small_bucket)
    x = small.select("bucket", F.col("rep").alias("a"), F.col("root").alias("ra"))
    y = small.select("bucket", F.col("rep").alias("b"), F.col("root").alias("rb"))
    return x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b").distinct()


def _large_bucket_links(open_rows: DataFrame, sets: DataFrame, p: DedupParams) -> DataFrame:
    """Links across groups in larger buckets, verified on the full sets block by block.

    Of a bucket's members, those of its largest group need no comparison with
    one another.  They are dealt to blocks, the rest to blocks of their own, and
    a task compares a block of either kind with one of the rest.  A member of the
    largest group thus moves once for each block of the rest (once, if the rest is
    small), whatever the size of its group.  A task gives a forest of the links
    that it finds, so at most one link for each member.
    """
    large = open_rows.where(F.col("members") > p.small_bucket)
    sizes = large.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max("members").alias("members"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.max("members").alias("all"))
    main = main.select("bucket", F.col("main.root").alias("main"), F.col("main.n").alias("held"), (F.col("all") - F.col("main.n")).alias("rest"))
    # Joined where the members are: a hot bucket stays dealt over tasks.
    main = checkpointed(main)
    if main.count() <= p.broadcast_buckets:
        main = F.broadcast(main)
    rows = large.join(main, "bucket").join(sets.select("rep", "shingles"), "rep")
    inside = F.col("root") == F.col("main")
    count = lambda c: F.ceil(F.col(c) / p.block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(inside, count("held")).otherwise(count("rest"))).cast("int"))
    block = F.col("block")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("mine"))
    upto = lambda c: F.sequence(F.lit(0), count(c) - 1)
    from_main = F.transform(upto("rest"), lambda j: cell(0, block, j, F.lit(-1)))
    to_main = F.transform(upto("held"), lambda i: cell(0, i, block, F.lit(-2)))
    to_rest = F.transform(upto("rest"), lambda j: cell(1, F.least(block, j), F.greatest(block, j), block))
    cells = F.explode(F.when(inside, from_main).otherwise(F.concat(to_main, to_rest)))
    large = rows.withColumn("cell", cells).select("bucket", "cell.*", "rep", "root", "shingles")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(n=f["shingles"].map(len)).sort_values(["n", "rep"])
        rep, group, n, mine = (f[c].to_numpy(copy=True) for c in ("rep", "root", "n", "mine"))
        whole = f["kind"].iat[0] == 1 and f["i"].iat[0] == f["j"].iat[0]
        _, ids = np.unique(np.concatenate(f["shingles"].to_list()), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(n)))
        held = np.zeros(ids.max() + 1, np.int32)
        a, b = [], []
        for k in range(len(f) - 1):
            end = np.searchsorted(n, n[k] * 100 // p.min_percent, side="right")
            apart = group[k + 1 : end] != group[k]
            if not whole:
                apart &= mine[k + 1 : end] != mine[k]
            if not apart.any():
                continue
            own = ids[starts[k] : starts[k + 1]]
            held[own] = 1
            common = np.add.reduceat(held[ids[starts[k + 1] : starts[end]]], starts[k + 1 : end] - starts[k + 1])
            held[own] = 0
            linked = apart & (common * 100 >= (n[k] + n[k + 1 : end] - common) * p.min_percent)
            at = np.flatnonzero(linked) + k + 1
            if len(at):
                groups, first = np.unique(group[at], return_index=True)
                a += [rep[k]] * len(first)
                b += rep[at[first]].tolist()
                group[np.isin(group, groups)] = group[k]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return large.groupBy("bucket", "kind", "i", "j").applyInPandas(compare, "a long, b long")


def _open_buckets(in_buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, rep, root, members) of the buckets whose members are in more than one group."""
    grouped = in_buckets.select("bucket", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    return checkpointed(grouped.join(split.where("low < high").select("bucket", "members"), "bucket"))


def components(docs: DataFrame, params: DedupParams = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of (doc_id, text): rows (doc_id, n_shingles, set_key), groups (set_key, component_id)."""
    p = params
    small_batches(docs.sparkSession)
    rows = signatures(docs, p)
    rows = checkpointed(rows.withColumn("set_key", F.when(F.col("doc_id").isNotNull(), F.col("set_key"))))
    classes = checkpointed(rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    firsts = rows.select("set_key", F.col("doc_id").alias("rep"), "bands").join(classes, ["set_key", "rep"])
    banded = firsts.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("bucket", "lead")
    in_buckets = checkpointed(banded.join(buckets, "bucket").select("bucket", "rep", "lead"))

    members = checkpointed(in_buckets.select("rep").distinct())
    sets = checkpointed(member_sets(members, docs, p))
    first = in_buckets.where("rep <> lead").groupBy("rep").agg(F.min("lead").alias("lead")).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    edges = checkpointed(verified(first, sets, p))
    roots = union_find(edges)

    still_open = _open_buckets(in_buckets, roots)
    few = _small_bucket_pairs(still_open, p).join(first, ["a", "b"], "left_anti")
    more = checkpointed(verified(checkpointed(few), sets, p).union(_large_bucket_links(still_open, sets, p)))
    if not more.isEmpty():
        roots = union_find(edges.union(more))
    groups = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    return rows, groups


def link_near_duplicates(docs: DataFrame, params: DedupParams = PRODUCTION) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row for each row of ``docs`` (doc_id, text)."""
    rows, groups = components(docs.select("doc_id", "text"), params)
    out = rows.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
