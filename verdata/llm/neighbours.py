"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample (``max_sample`` rows of smallest id hash); all rows are indexed. An inner node splits its part of the sample at
the median of a random projection; leaves hold about ``leaf_rows`` rows, as far as the ``max_depth`` that keeps the forest small (2 ** max_depth
nodes a tree) allows. Vectors get one more component that makes all lengths equal, so that the largest inner product is the nearest point.
A query searches all trees through one priority queue, the branch with the smallest margin to its side first, and stops when the leaves it has visited
hold ``visit`` times as many rows as there are. For each leaf and the queries that visit it, exact inner products (double precision, original
vectors) give the nearest, and those of all leaves are merged.

``visit`` sets recall. Vectors without structure, like random directions in 64 dimensions, need most of the rows for a recall of 0.9; clustered ones far fewer.

Vectors that are null, zero, hold null or non-finite components, or aren't of the commonest length (the larger of equally common ones) take no
part; rows without id neither. Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a result of k can need. Repeated rows (equal id and vector)
are one row. A leaf's rows and queries are dealt out in blocks of bounded size, and leaves after a query's ``first`` ones only report what may still be among its nearest. An empty table gives an empty result.

A query is written once for each leaf that it visits, which may be a thousand. Queries are therefore taken in rounds of at most ``ROUND_VISITS`` visits, and a task hands visits on
in small batches and multiplies a few queries at a time, so memory and the visits on disk don't grow with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdata.plans.storage import drop, materialize

#: Rows and queries of a leaf that one task takes at once, and how many of these queries it multiplies at a time.
BLOCK_ROWS, BLOCK_QUERIES, SLICE_QUERIES = 8192, 4096, 256
#: Visits (a query's vector each) in one Arrow batch, but for the last query's, and those of one round.
BATCH_VISITS, ROUND_VISITS = 8192, 16_000_000


class Forest:
    """Complete binary trees; node n's children are 2n+1 and 2n+2."""

    def __init__(self, sample: np.ndarray, longest: float, n_trees: int, depth: int, seed: int):
        self.longest, self.depth = longest, depth
        x = self.lift(sample)
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(n_trees):
            d = rng.standard_normal((max(1, 2 ** depth - 1), x.shape[1]))
            d /= np.linalg.norm(d, axis=1)[:, None]
            cut = np.zeros(len(d))
            at = np.zeros(len(x), np.int64)
            for level in range(depth):
                first = 2 ** level - 1
                for node in range(first, 2 * first + 1):
                    own = np.flatnonzero(at == node)
                    if len(own):
                        cut[node] = np.median(x[own] @ d[node])
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, d[at]) > cut[at])
            self.trees.append((d, cut))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest ** 2 - np.einsum("ij,ij->i", x, x), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector in each tree."""
        x = self.lift(x)
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (d, cut) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, d[at]) > cut[at])
            out[:, t] = at - (2 ** self.depth - 1)
        return out

    def search(self, q: np.ndarray, held: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) that the query visits, best first over all trees at once. ``held``: rows of each leaf."""
        q = np.append(q, 0.0)
        margins = [d @ q - cut for d, cut in self.trees]
        queue = [(0.0, t, 0, 0) for t in range(len(self.trees))]
        out, rows = [], 0
        while queue and rows < enough:
            worst, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                m = margins[t][node]
                heapq.heappush(queue, (max(worst, abs(m)), t, level + 1, 2 * node + (1 if m > 0 else 2)))
                node, level = 2 * node + (2 if m > 0 else 1), level + 1
            leaf = (t, node - (2 ** self.depth - 1))
            if n := held.get(leaf, 0):
                out.append(leaf)
                rows += n
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index(forest: Forest, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.leaves(_matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("v"), pa.array(leaves.tolist(), pa.list_(pa.int32()))], ["ids", "v", "leaves"])
    return run


def _visits(forest: Forest, dim: int, held: dict, enough: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, turn, tree, leaf = [], [], [], []
            for i, q in enumerate(_matrix(batch.column("v"), dim) if batch.num_rows else ()):
                for j, (t, n) in enumerate(forest.search(q, held, enough)):
                    at.append(i), turn.append(j), tree.append(t), leaf.append(n)
                if len(at) >= BATCH_VISITS or i == batch.num_rows - 1:
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(turn, pa.int32()), batch.column("query_id").take(take), batch.column("v").take(take)], ["tree", "leaf", "turn", "query_id", "v"])
                    at, turn, tree, leaf = [], [], [], []
    return run


def _rank(dim: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = (_matrix(t.column("v").combine_chunks(), dim) for t in (rows, queries))
        ids = rows.column("ids").to_pylist()
        asked, floor = queries.column("query_id").to_numpy(), queries.column("floor").to_numpy()
        m = min(k + 1, len(x))
        out: tuple[list, list, list] = ([], [], [])
        for i, who in enumerate(asked):
            at = i % SLICE_QUERIES
            if not at:
                s = q[i:i + SLICE_QUERIES] @ x.T
                # Everything as near as the last of the k + 1 nearest entries comes along, so that ties are settled by id; nothing farther than what the query has already.
                bound = np.partition(s, len(x) - m, axis=1)[:, len(x) - m]
            limit = max(bound[at], floor[i])
            best = np.flatnonzero(s[at] >= limit - 1e-12 * abs(limit))
            score = np.einsum("ij,j->i", x[best], q[i])
            near = sorted((-a, v) for a, b in zip(score.tolist(), best.tolist()) for v in ids[b] if v != who)[:k]
            out[0].extend([who] * len(near)), out[1].extend(v for _, v in near), out[2].extend(-a for a, _ in near)
        return pa.table([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", n_trees: int = 4,
            leaf_rows: int = 800, max_depth: int = 10, max_sample: int = 50_000, visit: float = 1.3, first: int = 8, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` (a part of ``vectors``), the ``k`` nearest other rows found."""
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return empty
    dim = sizes["d"]
    rows = rows.where(F.size("v") == dim)
    # Equal vectors are one entry; the window keeps the k + 1 smallest ids of each, already before the shuffle.
    w = Window.partitionBy("_key").orderBy("id")
    keyed = rows.withColumn("_key", F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), 256)))
    keyed = keyed.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= k + 1)
    entries = materialize(keyed.groupBy("_key").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v")).drop("_key"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = entries.agg(F.count("*"), F.max(length)).first()
    if not n:
        return empty
    sample = entries.select("v").orderBy(F.xxhash64(F.col("ids")[0])).limit(max_sample).toArrow()
    depth = min(max_depth, max(0, round(math.log2(n / leaf_rows)))) if n > leaf_rows else 0
    forest = Forest(_matrix(sample.column("v").combine_chunks(), dim), longest, n_trees, depth, seed)
    indexed = materialize(entries.mapInArrow(_index(forest, dim), "ids array<long>, v array<double>, leaves array<int>"))
    cells = indexed.select("ids", "v", F.posexplode("leaves").alias("tree", "leaf"))
    # One row for each leaf: bounded by the forest.
    held = {(r["tree"], r["leaf"]): r["n"] for r in cells.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()}
    asked = materialize(valid(queries).where(F.size("v") == dim).select(F.col("id").alias("query_id"), "v").distinct())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = lambda df: df.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    key = ["tree", "leaf", "r", "q"]

    def search(some: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The nearest of some queries, and the tables written for them."""
        visits = written = materialize(some.mapInArrow(_visits(forest, dim, held, math.ceil(visit * n)), "tree int, leaf int, turn int, query_id long, v array<double>"))
        come = {(r["tree"], r["leaf"]): r["n"] for r in visits.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()}
        blocks = spark.createDataFrame([(t, m, -(-n // BLOCK_ROWS), -(-come.get((t, m), 1) // BLOCK_QUERIES)) for (t, m), n in held.items()], "tree int, leaf int, n_r int, n_q int")
        dealt = cells.join(F.broadcast(blocks), ["tree", "leaf"]).withColumn("r", F.pmod(F.xxhash64(F.col("ids")[0]), "n_r").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
        visits = visits.join(F.broadcast(blocks), ["tree", "leaf"]).withColumn("q", F.pmod(F.xxhash64("query_id"), "n_q").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)))

        def rank(some: DataFrame) -> DataFrame:
            rows = dealt.select(*key, "ids", "v").groupBy(*key)
            found = rows.cogroup(some.select(*key, "query_id", "v", "floor").groupBy(*key)).applyInArrow(_rank(dim, k), "query_id long, vec_id long, score double")
            return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

        # The first leaves set a floor: from the others, only what is at least as near as a query's k-th so far is of use.
        near = materialize(top(rank(visits.where(F.col("turn") < first).withColumn("floor", F.lit(float("-inf"))))))
        floors = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        others = visits.where(F.col("turn") >= first).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        best = near.drop("rank").unionByName(rank(others)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return top(best).select("query_id", "rank", "vec_id", "score"), [written, near]

    # A query visits about as many leaves as hold ``visit`` times the rows.
    rounds = math.ceil(asked.count() * visit * len(held) / n_trees / ROUND_VISITS)
    if rounds <= 1:
        return search(asked)[0]
    done = []
    for i in range(rounds):
        best, used = search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i))
        done.append(materialize(best)._verdata_path)
        drop(*used)
    return spark.read.schema(empty.schema).parquet(*done)
