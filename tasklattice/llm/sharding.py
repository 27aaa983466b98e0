"""Sharding by histogram sort, in DataFrame expressions only.

Rows are ordered by a 60-bit key: 36 bits of the text's hash, then 24 bits of
the id's hash, so equal texts stand together and a large group of copies can
still be cut between ids.  The splitters between shards come from exact
histograms: each round counts bytes and rows in the cells of 12 more key bits
inside the cells that still hold a splitter, moves every splitter to the cell
edge nearest its target, and stops when all lie within the tolerance or the
bits are used up.  Then the rows are exchanged once, by ranges of the key.

A round's histogram has at most 4096 cells for each splitter.  Places within a
shard come from ranges of the key: at most ``2 ** max_range_bits`` even ones, of
which those with far more rows than the mean are divided again by their next
bits, so no task sorts a whole shard or a hot group.  The table of range offsets
is broadcast if it has at most ``broadcast_ranges`` rows, else joined.

Defined cases: null text has size ``row_bytes``; empty and null texts share a
key prefix; rows with equal text and equal id have one key, stay in one shard
and are placed in any order among themselves; an empty table gives an empty
result; fewer rows than shards leave shards empty.  Other input columns pass
through, and one with a result's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, fresh_name

KEY_BITS = 60
STEP_BITS = 12
TEXT_BITS = 36


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    row_bytes: int = 16
    #: Splitters may miss their targets by this share of a shard.
    tolerance: float = 0.001
    #: Rows that a task sorts at once, about; more when even 2 ** max_range_bits ranges have more.
    range_rows: int = 20_000
    max_range_bits: int = 16
    broadcast_ranges: int = 500_000


PRODUCTION = ShardParams()


def _top_bits(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def sort_key(text: Column, key: Column) -> Column:
    """Order of rows: hash of the text, then hash of the id; from 0 to 2 ** 60 - 1."""
    return F.shiftleft(_top_bits(F.xxhash64(F.coalesce(text, F.lit(""))), TEXT_BITS), KEY_BITS - TEXT_BITS).bitwiseOR(_top_bits(F.xxhash64(key, F.lit(1)), KEY_BITS - TEXT_BITS))


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", params: ShardParams = PRODUCTION) -> DataFrame:
    """``docs`` with size, text_crc32 and sort_key."""
    text, added = F.col(f"`{text_col}`"), ("size", "text_crc32", "sort_key")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + params.row_bytes
    return docs.select(*kept, size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), sort_key(text, F.col(f"`{id_col}`")).alias("sort_key"))


def find_splitters(rows: DataFrame, p: ShardParams = PRODUCTION) -> list[int]:
    """Keys at which shards 1, 2, ... begin; ``rows`` (sort_key, size) should be checkpointed."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / p.shards for k in range(1, p.shards)]
    best = [(abs(t), 0) for t in targets]  # distance to the target, key
    open_cells = {0: 0}  # first key of a cell that holds splitters: bytes below it
    holds = {0: list(range(len(targets)))}
    shift = KEY_BITS
    while holds and shift > 0 and total:
        shift -= STEP_BITS
        parents = sorted(holds)
        parent = F.shiftright("sort_key", shift + STEP_BITS)
        inside = rows if shift + STEP_BITS >= KEY_BITS else rows.where(parent.isin([c >> (shift + STEP_BITS) for c in parents]))
        cells = inside.groupBy(F.shiftright("sort_key", shift).alias("cell")).agg(F.sum("size").alias("size")).collect()
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for cell, size in cells:
            by_parent.setdefault((cell >> STEP_BITS) << (shift + STEP_BITS), []).append((cell << shift, size))
        next_cells, next_holds = {}, {}
        for start in parents:
            below, edges = open_cells[start], []
            for key, size in sorted(by_parent.get(start, ())):
                edges.append((key, below, below + size))
                below += size
            at = 0
            for k in holds[start]:
                t = targets[k]
                while at < len(edges) - 1 and edges[at][2] <= t:
                    at += 1
                key, low, high = edges[at]
                best[k] = min(best[k], (t - low, key), (abs(high - t), key + (1 << shift)))
                if best[k][0] > p.tolerance * total / p.shards:
                    next_cells[key] = low
                    next_holds.setdefault(key, []).append(k)
        open_cells, holds = next_cells, next_holds
    return [key for _, key in best]


def shard_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters lie at or below the key: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(splitters[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(splitters)) if splitters else F.lit(0)


def _leaf(key: Column, depths: list[list[int]], first: int) -> Column:
    """Start of the key's range: its cell of ``first`` bits, or of STEP_BITS more for each level where that cell is hot."""
    shift = KEY_BITS - first
    cells = F.shiftright(key, shift)
    if not depths or not depths[0] or shift <= 0:
        return F.shiftleft(cells, max(shift, 0))
    return F.when(cells.isin(depths[0]), _leaf(key, depths[1:], min(first + STEP_BITS, KEY_BITS))).otherwise(F.shiftleft(cells, shift))


def _ranges(rows: DataFrame, p: ShardParams) -> tuple[int, list[list[int]]]:
    """Bits of the even ranges, and level by level the cells with too many rows (at most 2 ** max_range_bits / 4 a level)."""
    n = rows.count()
    first = min(max(n // p.range_rows, 1).bit_length(), p.max_range_bits)
    most = max(p.range_rows, 4 * n >> first)
    depths: list[list[int]] = []
    inside, bits = rows, first
    while bits < KEY_BITS:
        cell = F.shiftright("sort_key", KEY_BITS - bits)
        hot = [r["cell"] for r in inside.groupBy(cell.alias("cell")).count().where(F.col("count") > most).collect()]
        if not hot:
            break
        depths.append(sorted(hot))
        inside, bits = rows.where(cell.isin(hot)), min(bits + STEP_BITS, KEY_BITS)
    return first, depths


def shard_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", params: ShardParams = PRODUCTION) -> DataFrame:
    """``docs`` with size, text_crc32, sort_key, shard and slot (place in its shard, gapless from 0, in key order)."""
    p = params
    rows = keyed(docs, text_col, id_col, p)
    plan = checkpointed(rows.select("sort_key", "size"))
    splitters = find_splitters(plan, p)
    first, depths = _ranges(plan, p)
    leaf, base, at = (fresh_name(rows, f"_{x}") for x in ("leaf", "base", "place"))

    def dealt(df: DataFrame) -> DataFrame:
        key = F.col("sort_key")
        return df.withColumns({"shard": shard_of(key, splitters), leaf: _leaf(key, depths, first)})

    counts = dealt(plan).groupBy("shard", leaf).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(leaf).rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(counts.select("shard", leaf, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(base)))
    if bases.count() <= p.broadcast_ranges:
        bases = F.broadcast(bases)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    place = F.row_number().over(Window.partitionBy("shard", leaf).orderBy("sort_key", F.col(f"`{id_col}`"))).cast("long") - 1
    out = dealt(rows.select(*kept)).withColumn(at, place).join(bases, ["shard", leaf])
    return out.select(*kept, "shard", (F.col(base) + F.col(at)).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = shard_rows(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
