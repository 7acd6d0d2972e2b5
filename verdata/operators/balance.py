"""Balancing of sequence lengths within batches. Only (batch, id, length) is shuffled; a batch has up to some ten thousand rows.

A task takes many batches at once: those with as many rows are solved together, as rows of a matrix, with the same steps and ties as one alone. Batches of odd shape or size are solved one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task solves at once, numbers in one matrix of states, and states beyond which a heap is faster than a search of all.
TASK_ROWS, STATE_NUMBERS, MOST_STATES = 400_000, 4_000_000, 512


def _differencing(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Largest differencing: partial partitions of widest spread are merged, the heaviest part of one with the lightest of the other."""
    order = sorted((n, i) for i, n in enumerate(lengths))
    step = k if equal_size else 1
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows don't make {k} parts of equal size")
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} rows for {k} parts")
    # A part is (sum, count, first id, members); parts are disjoint, so the first three tell any two parts with rows apart. A state keeps them descending.
    # Members are linked pairs until the end: a merge costs k steps, however many rows its parts hold.
    queue = []
    for at in range(0, len(order), step):
        own = [(n, 1, i, i) for n, i in order[at:at + step]]
        queue.append(_State(sorted(own, reverse=True) + [_EMPTY] * (k - len(own))))
    heapq.heapify(queue)
    while len(queue) > 1:
        a, b = heapq.heappop(queue).parts, heapq.heappop(queue).parts
        both = [_join(x, y) for x, y in zip(a, reversed(b))]
        heapq.heappush(queue, _State(sorted(both, key=_by_weight, reverse=True)))
    return [_members(p) for p in queue[0].parts]


_EMPTY = (0, 0, -1, None)


def _by_weight(part: tuple) -> tuple:
    return part[:3]


def _join(x: tuple, y: tuple) -> tuple:
    if not x[1] or not y[1]:
        return x if x[1] else y
    return (x[0] + y[0], x[1] + y[1], x[2], (x[3], y[3]))


def _members(part: tuple) -> list[int]:
    out, todo = [], [part[3]] if part[1] else []
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):
            todo.extend(at)
        else:
            out.append(at)
    return sorted(out)


class _State:
    """Orders partial partitions: the widest spread first, then the heaviest largest part."""

    def __init__(self, parts):
        self.parts = parts

    def __lt__(self, other):
        mine, theirs = (s.parts[0][0] - s.parts[-1][0] for s in (self, other))
        return mine > theirs if mine != theirs else _by_weight(self.parts[0]) > _by_weight(other.parts[0])


def _greedy(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Each item in turn to the lightest part, the first of equals. ``equal_size``: parts with fewer items come first."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        weight, p = heap[0]
        parts[p].append(i)
        heapq.heapreplace(heap, (weight + n + bias, p))
    if equal_size and any(len(p) * k != len(lengths) for p in parts):
        raise ValueError(f"{len(lengths)} rows don't make {k} parts of equal size")
    return parts


def _labels(parts: list[list[int]], n: int) -> np.ndarray:
    out = np.full(n, -1)
    for p, rows in enumerate(parts):
        out[rows] = p
    return out


def _differencing_all(lengths: np.ndarray, k: int, equal_size: bool) -> np.ndarray:
    """Part of each row for many batches of equal size (one a matrix row), each as :func:`_differencing` has it."""
    count, n = lengths.shape
    m, most = n + 1, int(lengths.sum(axis=1).max(initial=0))
    n_states = n // k if equal_size else n
    if count < 4 or n < k or (equal_size and n % k) or not 1 < n_states <= MOST_STATES or lengths.min() < 0 or ((most + 1) * m) ** 2 >= 2 ** 62:
        return np.array([_labels(_differencing(x, k, equal_size), n) for x in lengths.tolist()])
    step = max(4, STATE_NUMBERS // (n_states * k))
    if count > step:
        return np.concatenate([_differencing_all(lengths[i:i + step], k, equal_size) for i in range(0, count, step)])
    # A part is one number: its sum, count and first id (from 1), in this order; 0 is an empty part. The first id names the part: joined ones point to the other's.
    each = np.arange(count)
    order = np.argsort(lengths, axis=1, kind="stable")
    own = (np.take_along_axis(lengths, order, 1) * m + 1) * m + order + 1
    states = np.zeros((count, n_states, k), np.int64)
    states[:, :, :own.shape[1] // n_states] = own.reshape(count, n_states, -1)
    states = -np.sort(-states, axis=2)
    weigh = lambda x: (x[..., 0] // (m * m) - x[..., -1] // (m * m)) * ((most + 1) * m * m) + x[..., 0]
    weight, above = weigh(states), np.tile(np.arange(n), (count, 1))
    for _ in range(n_states - 1):
        first = weight.argmax(axis=1)
        weight[each, first] = -1
        second = weight.argmax(axis=1)
        weight[each, second] = -1
        x, y = states[each, first], states[each, second][:, ::-1]
        both = (x > 0) & (y > 0)
        at, _ = np.nonzero(both)
        above[at, y[both] % m - 1] = x[both] % m - 1
        joined = -np.sort(-(x + y - np.where(both, y % m, 0)), axis=1)
        states[each, first], weight[each, first] = joined, weigh(joined)
    last = states[each, first]
    place = np.zeros((count, m), np.int64)
    np.put_along_axis(place, last % m, np.arange(k)[None, :], 1)
    while True:
        further = np.take_along_axis(above, above, 1)
        if (further == above).all():
            return np.take_along_axis(place, above + 1, 1)
        above = further


def _greedy_all(lengths: np.ndarray, k: int, equal_size: bool) -> np.ndarray:
    """Part of each row for many batches of equal size, each as :func:`_greedy` has it."""
    count, n = lengths.shape
    if count < 4 or (equal_size and n % k) or np.abs(lengths).sum(axis=1).max(initial=0) >= 2 ** 62 // (n + 2):
        return np.array([_labels(_greedy(x, k, equal_size), n) for x in lengths.tolist()])
    each, out = np.arange(count), np.empty((count, n), np.int64)
    cost = lengths + (lengths.sum(axis=1, keepdims=True) + 1 if equal_size else 0)
    weight = np.zeros((count, k), np.int64)
    for i in range(n):
        out[:, i] = p = weight.argmin(axis=1)
        weight[each, p] += cost[:, i]
    return out


def _micro_all(lengths: np.ndarray, max_tokens: int) -> np.ndarray:
    """Micro-batch of each row for many batches of equal size: as many balanced parts as the tokens need, heaviest (sum of squares) first."""
    count, n = lengths.shape
    ks = np.minimum(n, np.maximum(1, -(-lengths.sum(axis=1) // max_tokens)))
    out = np.empty((count, n), np.int64)
    for k in np.unique(ks).tolist():
        at = np.flatnonzero(ks == k)
        some = lengths[at]
        part = _differencing_all(some, k, False)
        cell = part + k * np.arange(len(at))[:, None]
        squares, lowest = np.zeros(len(at) * k, np.int64), np.full(len(at) * k, n)
        np.add.at(squares, cell.ravel(), (some * some).ravel())
        np.minimum.at(lowest, cell.ravel(), np.tile(np.arange(n), len(at)))
        lowest[lowest == n] = 0
        order = np.lexsort((-lowest.reshape(-1, k), -squares.reshape(-1, k)), axis=-1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(k)[None, :], 1)
        out[at] = np.take_along_axis(place, part, 1)
    return out


def _by_batch(df: DataFrame, by: str, id_col: str, length: str, solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def solved(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        if rows.column(2).null_count:
            raise ValueError(f"null {length}")
        n = rows.column(2).cast(pa.int64(), safe=False).to_numpy()
        part, sizes = np.empty(len(n), np.int64), np.diff(starts, append=len(n))
        for size in np.unique(sizes):
            at = starts[sizes == size][:, None] + np.arange(size)
            part[at] = solve(n[at])
        return rows.append_column("part", pa.array(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        limit = TASK_ROWS

        def starts(rows: pa.Table) -> np.ndarray:
            key = rows.column(0).dictionary_encode("encode").combine_chunks()
            key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy()
            return np.flatnonzero(np.diff(key, prepend=-1))
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= limit:
                rows = pa.Table.from_batches(held)
                first = starts(rows)
                # The last batch may go on in what comes next.
                if first[-1]:
                    yield from solved(rows.slice(0, first[-1]), first[:-1]).to_batches()
                held = rows.slice(first[-1]).to_batches()
                limit = max(TASK_ROWS, 2 * (rows.num_rows - int(first[-1])))
        if held:
            rows = pa.Table.from_batches(held)
            yield from solved(rows, starts(rows)).to_batches()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{by}` {kinds[by]}, `{id_col}` {kinds[id_col]}, `{length}` {kinds[length]}, part long"
    rows = df.select(by, id_col, length).repartition(F.col(by)).sortWithinPartitions(by, F.col(id_col).asc_nulls_last())
    return rows.mapInArrow(run, schema)


def balance_partitions(df: DataFrame, k: int, equal_size: bool = False, by: str = "batch", id_col: str = "row", length: str = "tokens") -> DataFrame:
    """``part`` of each row: k parts of nearly equal token sums within each batch."""
    return _by_batch(df, by, id_col, length, lambda n: _differencing_all(n, k, equal_size))


def greedy_partitions(df: DataFrame, k: int, equal_size: bool = False, by: str = "batch", id_col: str = "row", length: str = "tokens") -> DataFrame:
    """``part`` of each row: given in order of id to the lightest part."""
    return _by_batch(df, by, id_col, length, lambda n: _greedy_all(n, k, equal_size))


def serpentine_partitions(df: DataFrame, k: int, by: str = "batch", id_col: str = "row", length: str = "tokens") -> DataFrame:
    """Approximation with built-ins for batches of any size: rank by length, dealt out to and fro."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(length), id_col)) - 1
    turn = F.col("_r") % (2 * k)
    return df.withColumn("_r", rank).withColumn("part", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("long")).drop("_r")


def imbalance(parts: DataFrame, k: int, by: str = "batch", id_col: str = "row", length: str = "tokens") -> DataFrame:
    """Largest and smallest token sums of consecutive slices (before) and of the parts (after), by batch."""
    w = Window.partitionBy(by)
    rows = parts.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(id_col)) - 1)
    rows = rows.withColumn("_slice", F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / k)), F.lit(k - 1)))
    before = rows.groupBy(by, "_slice").agg(F.sum(length).alias("s")).groupBy(by).agg(F.min("s").alias("min"), F.max("s").alias("max"))
    after = rows.groupBy(by, "part").agg(F.sum(length).alias("s")).groupBy(by).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"), (F.sum("s") / k).alias("mean"))
    return before.join(after, by).select(by, "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max", "mean")


def micro_batches(df: DataFrame, max_tokens: int, by: str = "batch", id_col: str = "row", length: str = "tokens") -> DataFrame:
    """``part`` and ``micro`` of each row: as many balanced parts as the tokens need, heaviest (sum of squares) first. Balanced, not capped."""
    return _by_batch(df, by, id_col, length, lambda n: _micro_all(n, max_tokens)).withColumnRenamed("part", "micro")


def restore_order(df: DataFrame, by: str = "batch", id_col: str = "row") -> DataFrame:
    return df.orderBy(by, id_col)
