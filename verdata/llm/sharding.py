"""Minimax contiguous sharding of ordered atomic groups. DataFrame functions only.

Groups are rows of equal text (null counts as empty), ordered by their smallest doc_id. The smallest capacity is
searched for which a greedy walk over the groups needs no more than ``n_shards`` shards; the cuts are where that walk
puts them. The walk looks at running sums, and never at all groups at once: the driver gets sums of blocks of consecutive
groups, bounds the capacity with them, and asks for finer blocks only where a cut can still lie.

An empty table gives an empty result. A group is never split, so one larger than the ideal share makes a large shard.
Repeated rows belong to one group and each get a slot; rows of equal doc_id are told apart by nothing and get any of their slots.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdata.operators.numbering import number_rows
from verdata.plans.storage import materialize

#: At most so many blocks come to the driver in a round.
MAX_BLOCKS = 1 << 14


class _Prefix:
    """Known points of the running sum: ``sums[i]`` is the sum of all groups before group ``at[i]``."""

    def __init__(self, at: list[int], sums: list[int]):
        self.at, self.sums = at, sums

    def reach(self, total: int) -> tuple[int, int]:
        """Between these group numbers lies the largest k whose sum before k is at most ``total`` (low known to fit)."""
        i = bisect_right(self.sums, total) - 1
        return i, i if i + 1 == len(self.at) or self.at[i + 1] == self.at[i] + 1 else i + 1


def _greedy(p: _Prefix, capacity: int, n: int, high: bool) -> tuple[bool, list[int]]:
    """Indices of the cuts of a greedy walk of n shards; ``high``: with each cut as far as it may lie."""
    cuts, i = [], 0
    for _ in range(n):
        low, up = p.reach(p.sums[i] + capacity)
        # The sum at an uncertain cut is at most start + capacity; a walk from the block's end reaches at least as far.
        i = up if high else low
        cuts.append(i)
        if i == len(p.at) - 1:
            return True, cuts
    return False, cuts


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """First group numbers of shards 1, 2, ... and the capacity. ``groups``: ``g`` (0, 1, ...) and ``bytes``."""
    n, total, largest = groups.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    if not n:
        return [], 0
    shift = max(0, (n - 1).bit_length() - (MAX_BLOCKS.bit_length() - 1))
    rows = groups.groupBy((F.shiftright("g", shift) if shift else F.col("g")).alias("b")).agg(F.sum("bytes").alias("s")).orderBy("b").collect()
    at, sums = [0], [0]
    for r in rows:
        at.append(min(n, (r["b"] + 1) << shift))
        sums.append(sums[-1] + r["s"])
    while True:
        p = _Prefix(at, sums)
        low, high = max(largest, -(-total // n_shards)), total
        # Certainly too small below `low`: even with far cuts it fails. Certainly enough from `high` on: near cuts do.
        a, b = low, high
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if _greedy(p, m, n_shards, True)[0] else (m + 1, b)
        low = a
        a, b = low, high
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if _greedy(p, m, n_shards, False)[0] else (m + 1, b)
        high = a
        near, far = _greedy(p, low, n_shards, False)[1], _greedy(p, high, n_shards, True)[1]
        if shift == 0 or low == high and all(p.at[i + 1] - p.at[i] <= 1 for i in near if i + 1 < len(p.at)):
            return [at[i] for i in near if at[i] < n][: n_shards - 1], low
        # Refine the blocks between the nearest and the farthest place of each cut.
        wanted = sorted({i for x, y in zip(near, far + [len(at) - 1] * (len(near) - len(far))) for i in range(x, min(y + 1, len(at) - 1)) if at[i + 1] - at[i] > 1})
        width = sum(at[i + 1] - at[i] for i in wanted)
        shift = max(0, min(shift - 1, (width // MAX_BLOCKS).bit_length()))
        spans: list[list[int]] = []
        for i in wanted:
            if spans and spans[-1][1] == at[i]:
                spans[-1][1] = at[i + 1]
            else:
                spans.append([at[i], at[i + 1]])
        inside = F.lit(False)
        for x, y in spans:
            inside = inside | ((F.col("g") >= x) & (F.col("g") < y))
        fine = {r["b"]: r["s"] for r in groups.where(inside).groupBy((F.shiftright("g", shift) if shift else F.col("g")).alias("b")).agg(F.sum("bytes").alias("s")).collect()}
        new_at, new_sums = [0], [0]
        split = set(wanted)
        for i in range(len(at) - 1):
            if i in split:
                for b in range(at[i] >> shift, ((at[i + 1] - 1) >> shift) + 1):
                    new_at.append(min(at[i + 1], (b + 1) << shift))
                    new_sums.append(new_sums[-1] + fine[b])
            else:
                new_at.append(at[i + 1])
                new_sums.append(sums[i + 1])
        at, sums = new_at, new_sums


def shard(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``group_id`` (smallest doc_id of equal texts), ``shard`` and ``slot`` of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.unhex(F.sha2(text, 256)).alias("_key"))
    rows = materialize(rows)
    sums = rows.groupBy("_key").agg(F.min("doc_id").alias("group_id"), F.sum("size").alias("bytes"))
    # Groups of rows that all lack a doc_id are told apart, and ordered, by their key.
    groups = number_rows(materialize(sums), [], [F.col("group_id"), F.col("_key")], "g")
    groups = materialize(groups)
    cuts, _ = minimax_cuts(groups, n_shards)
    number = sum([(F.col("g") >= c).cast("int") for c in cuts], F.lit(0)).cast("int")
    out = rows.join(groups.select("_key", "group_id", number.alias("shard")), "_key").drop("_key")
    return number_rows(materialize(out), ["shard"], [F.col("doc_id")], "slot")
