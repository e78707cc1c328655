"""Minimax contiguous partition of documents into shards of near equal bytes.

Documents with equal texts form one atomic group. Groups stand in the order of a 64-bit hash
of their text; a group as large as a fair share of what is left gets a shard of its own, and
the rest is cut into contiguous runs under the smallest capacity that a greedy check accepts.
The check works on sums by range of the hash: each round sums again, more finely, the few
ranges in which a cut can still fall, until only whole groups are left there. The driver
holds at most ``MAX_BLOCKS`` sums at a time, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import clean_text, gapless, small_table, stored

MAX_BLOCKS = 1 << 17
FIRST_BITS = 14
LOWEST, TOP = -(1 << 63), 1 << 63
OVERHEAD = 16


@dataclass(frozen=True)
class ShardPlan:
    """alone: group key to its own shard; cuts: first keys of the runs after the first."""

    alone: dict[int, int]
    cuts: tuple[int, ...]
    capacity: int
    shards: int

    def shard(self, key: Column) -> Column:
        first = len(self.alone)
        run = reduce(lambda s, cut: s + (key >= F.lit(cut)).cast("int"), self.cuts, F.lit(first))
        picked = reduce(lambda w, kv: w.when(key == F.lit(kv[0]), F.lit(kv[1])), self.alone.items(), F)
        return (picked.otherwise(run) if self.alone else run).cast("int")


def group_key(text: Column) -> Column:
    """Equal texts have equal keys, and null counts as empty. Two texts with one key by chance
    only share a shard."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("bigint")


class _Sums:
    """Known prefix sums: block i covers the keys of one range; whole if it can't be cut."""

    def __init__(self, blocks: list[tuple[int, int, int, int]]):
        self.blocks = blocks  # (first key, bits, bytes, groups), by first key
        self.edges = [0, *accumulate(b[2] for b in blocks)]
        self.whole = [b[3] == 1 or b[1] == 64 for b in blocks]

    def lower(self, capacity: int, shards: int) -> list[int]:
        """Ends that a greedy cut reaches for certain, as sums."""
        ends, start = [], 0
        for _ in range(shards):
            start = self.edges[bisect_right(self.edges, start + capacity) - 1]
            ends.append(start)
        return ends

    def upper(self, capacity: int, shards: int) -> list[int]:
        """Ends that a greedy cut can't pass, as sums."""
        ends, start = [], 0
        for _ in range(shards):
            reach = min(start + capacity, self.edges[-1])
            place = bisect_right(self.edges, reach) - 1
            inside = place < len(self.blocks) and not self.whole[place]
            start = reach if inside else self.edges[place]
            ends.append(start)
        return ends

    def smallest(self, ends, shards: int, least: int) -> int:
        low, high, total = least, max(least, self.edges[-1]), self.edges[-1]
        while low < high:
            middle = (low + high) // 2
            if ends(middle, shards)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Blocks in which a cut can fall for some capacity from low to high."""
        found = set()
        for a, b in zip(self.lower(low, shards), self.upper(high, shards), strict=True):
            first = max(0, bisect_right(self.edges, a) - 1)
            last = min(len(self.blocks) - 1, bisect_left(self.edges, b))
            found.update(i for i in range(first, last + 1) if not self.whole[i])
        return sorted(found)


def _block_sums(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    block = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits) if bits < 64 else F.col("key")
    rows = (
        groups.groupBy(block.alias("block"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))
        .collect()
    )
    return sorted((r["block"], bits, r["bytes"], r["groups"]) for r in rows)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, tuple[int, ...]]:
    """The smallest capacity for which greedy runs of whole groups need at most ``shards`` runs,
    and the first keys of the runs after the first. groups: key bigint (unique), bytes bigint."""
    spark, bits = groups.sparkSession, FIRST_BITS
    blocks = _block_sums(groups, bits)
    if not blocks:
        return 0, ()
    while True:
        sums = _Sums(blocks)
        least = -(-sums.edges[-1] // shards)
        low = sums.smallest(sums.upper, shards, least)
        high = sums.smallest(sums.lower, shards, least)
        unsure = sums.unsure(low, high, shards)
        if not unsure:
            break
        step = max(1, min(64 - bits, (MAX_BLOCKS // len(unsure)).bit_length() - 1))
        wanted = small_table(spark, [(blocks[i][0],) for i in unsure], "block bigint")
        here = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits)
        inside = groups.join(F.broadcast(wanted), here == F.col("block"), "left_semi")
        finer = _block_sums(inside, bits := bits + step)
        chosen = set(unsure)
        blocks = sorted([b for i, b in enumerate(blocks) if i not in chosen] + finer)
    ends = sums.lower(high, shards)
    total, firsts = sums.edges[-1], []
    for end in ends:
        if end >= total:
            break
        firsts.append(blocks[bisect_left(sums.edges, end)][0])
    return high, tuple(firsts)


def plan_shards(groups: DataFrame, shards: int) -> ShardPlan:
    """groups: key bigint, bytes bigint, one row for each key; stored, as it is read several times.

    An empty table gives a plan without cuts. ``shards`` is at least 1.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()  # at most one for each shard
    alone: dict[int, int] = {}
    for row in largest:
        left = shards - len(alone)
        if left == 1 or row["bytes"] * left < total:
            break
        alone[row["key"]] = len(alone)
        total -= row["bytes"]
    rest = groups.where(~F.col("key").isin(*alone)) if alone else groups
    capacity, cuts = minimax_cuts(rest, shards - len(alone))
    return ShardPlan(alone, cuts, capacity, shards)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with size, text_crc32 and key; columns of these names are replaced."""
    t = clean_text(text)
    rest = [c for c in docs.columns if c not in (text, "size", "text_crc32", "key")]
    return docs.select(
        *[F.col(f"`{c}`") for c in rest],
        size_of(F.col(text)).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        group_key(F.col(text)).alias("key"),
    )


def shard_documents(docs: DataFrame, shards: int, text: str = "text", order: str = "doc_id"):
    """(rows, plan): rows are docs without the text plus size, text_crc32, shard and slot.

    Every row gets a shard: a null text counts as empty, and null or repeated ids are rows like
    others. Equal texts share a shard. slot counts the rows of a shard from 0 without gaps;
    rows equal in id, size and text are interchangeable. Columns named size, text_crc32, key,
    shard or slot are replaced. An empty table gives no rows.
    """
    rows = stored(sized(docs, text), "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    plan = plan_shards(groups, shards)
    dealt = rows.withColumn("shard", plan.shard(F.col("key")))
    return gapless(dealt, ["shard"], [order, "key", "size"], "slot").drop("key"), plan


def write_shards(docs: DataFrame, plan: ShardPlan, path: str, text: str = "text", files: int = 8) -> None:
    """Write whole documents below ``path/shard=N``, each shard in up to ``files`` files."""
    dealt = docs.withColumn("shard", plan.shard(group_key(F.col(text))))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    dealt.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
