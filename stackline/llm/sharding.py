"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are a group and stay together. Groups of at least a thousandth of
a shard are units of their own (so there are at most a thousand a shard); all others are
added up in hashed chunks of whole groups. Only these units' sizes, a bounded number, reach the
driver. There they are sorted by size and each enters the shard with the least remaining
room that still holds it, found in a balanced tree; the smallest capacity that needs no
further shard is searched for, and what that leaves uneven is spread. A group larger than a fair share can't stay whole under the
law of equal bytes, so it alone is dealt into hashed parts of about a chunk's size first.

Defined cases: a null text has 8 bytes and is a group with other null texts, apart from
empty texts; ties are broken by key; repeated rows are of one group; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackline.llm.ranking import ranked
from stackline.llm.staging import staged

SHARDS = 24
#: Units of their own, and chunks, for each shard.
LARGE, CHUNKS = 1000, 250
ROW_BYTES = 8


class RoomTree:
    """Shards by remaining room in a treap: the tightest that holds a size is found in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) % (1 << 64) * 0xD6E8FEB86659FD93 % (1 << 64)

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return (low[0], low[1], low[2], self._merge(low[3], high))
        return (high[0], high[1], self._merge(low, high[2]), high[3])

    def add(self, room: int, shard: int) -> None:
        key = (room, shard)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, (key, self._weight(key), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, shard) with the least room of at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        found = high
        while found[2] is not None:
            found = found[2]
        _, rest = self._split(high, (found[0][0], found[0][1] + 1))
        self.root = self._merge(low, rest)
        return found[0]


def best_fit(sizes: list[tuple[str, int]], capacity: int) -> dict[str, int]:
    """Shard of each unit, larger ones first, opening a shard where no open one has room."""
    tree, out, opened = RoomTree(), {}, 0
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        found = tree.take(size)
        if found is None:
            found, opened = (max(capacity, size), opened), opened + 1
        out[key] = found[1]
        tree.add(found[0] - size, found[1])
    return out


def smallest_capacity(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """The packing of the least capacity found, between a fair share and twice as much, that opens ``shards`` at most."""
    low = max(max((s for _, s in sizes), default=0), math.ceil(sum(s for _, s in sizes) / shards)) - 1
    high, best = 2 * low + 2, None
    while best is None or high - low > max(1, low // 1_000_000):
        middle = (low + high) // 2 if best else high
        packed = best_fit(sizes, middle)
        if len(set(packed.values())) <= shards:
            high, best = middle, packed
        elif best is None:
            high *= 2
        else:
            low = middle
    return best


def evened(sizes: dict[str, int], packed: dict[str, int], shards: int) -> dict[str, int]:
    """The packing after units moved from the fullest shard to the emptiest while that brings the two closer.

    The unit whose size is nearest to half the gap moves; each move lowers the sum of squared loads, so they end.
    """
    loads, held = [0] * shards, [[] for _ in range(shards)]
    for key, at in packed.items():
        loads[at] += sizes[key]
        insort(held[at], (sizes[key], key))
    while True:
        full, empty = max(range(shards), key=lambda k: (loads[k], k)), min(range(shards), key=lambda k: (loads[k], k))
        gap, units = loads[full] - loads[empty], held[full]
        after = bisect_left(units, (gap // 2 + 1, ""))
        near = [units[k] for k in (after - 1, after) if 0 <= k < len(units) and 0 < units[k][0] < gap]
        if not near:
            return {key: at for at, own in enumerate(held) for _, key in own}
        moved = min(near, key=lambda u: (abs(2 * u[0] - gap), u))
        units.remove(moved)
        insort(held[empty], moved)
        loads[full] -= moved[0]
        loads[empty] += moved[0]


def shard(documents: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    text = F.col(text_col)
    base = staged(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group"),
        ),
        "shards",
    )
    total = base.agg(F.sum("size")).first()[0]
    if total is None:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    chunks = shards * CHUNKS
    chunk = F.concat(F.lit("c"), F.pmod(F.xxhash64("group"), F.lit(chunks)).cast("string"))
    groups = staged(base.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    own = F.col("bytes") >= total / (shards * LARGE)
    # At most ``shards * LARGE`` groups are as large as that.
    large = {r["group"]: r["bytes"] for r in groups.where(own).collect()}
    halves = {g: math.ceil(b * chunks / total) for g, b in large.items() if b > total / shards}
    spark = base.sparkSession
    known = spark.createDataFrame([(g, halves.get(g, 1)) for g in large], "group string, parts int")
    part = F.pmod(F.xxhash64("doc_id", "group"), F.col("parts")).cast("string")
    unit = F.when(F.col("parts").isNull(), chunk).when(F.col("parts") == 1, F.concat(F.lit("g"), "group")).otherwise(F.concat(F.lit("p"), "group", F.lit(":"), part))
    units = base.join(F.broadcast(known), "group", "left").withColumn("unit", unit)
    sizes = [(r["unit"], r["bytes"]) for r in units.groupBy("unit").agg(F.sum("size").alias("bytes")).collect()]  # large groups, their parts and chunks
    packed = evened(dict(sizes), smallest_capacity(sizes, shards), shards)
    to = spark.createDataFrame(list(packed.items()), "unit string, shard int")
    placed = units.join(F.broadcast(to), "unit").select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").withColumn("slot", F.col("slot").cast("long"))
