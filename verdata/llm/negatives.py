"""Hard negatives by inner product, mined exactly from cover trees over norm-augmented candidates.

Vectors become integers (``floor(scale * x)``), so all scores are exact. One more component, the square root of what is missing to the largest squared length,
puts all candidates on one sphere; a query gets a zero there, which keeps its inner products. A tree's node is a candidate with a covering radius, the largest distance
to anything below it. Products below a node then lie within the node's own product plus and minus the query's length times the radius.

Candidates are dealt to centres (the nearest of at most ``n_centres`` spread ones, picked from a sample of ``sample`` rows) and, within a centre, to shards of about ``shard_rows`` rows.
Each shard is a tree: below a node, nodes of the next level are picked until every row has one within half the radius, or ``FAN`` are picked (unstructured rows need more than
that; radii are measured, so this costs pruning, never results). Up to ``LEAF`` rows hang on a node directly, and all of them where a level would divide next to nothing. A block of anchors goes down a shard together, the node with the largest upper bound first; an anchor leaves where a node's
bounds miss all its windows or can't beat what it has.

Positives are the anchor's ``n_positives`` nearest other rows of its label: trees of that label's rows, joined by label. A positive's window holds the scores from ``low`` to ``high`` percent of its own; negatives are the
``n_negatives`` best rows of other labels in there. They are searched in two rounds: first at the centre whose own product is the largest, which gives each window a floor, then wherever the bounds of a centre still meet a window above its
floor. Anchors and shards meet in blocks; no task holds more than one shard and one block. Labels of a third of all rows are many shards.

The sample, the centres and their radii, all bounded by parameters, come to the driver; nothing else does. On vectors without structure, bounds exclude little and every shard is gone through once for each block of anchors, as an exhaustive
search would; with structure, few nodes are.

Rows with a null id, label or vector, or with null or non-finite components, take no part; nor do rows whose vector isn't of the commonest length (the larger of equally common ones). Equal rows (id, label and vector) are one; an anchor's own id is never its positive. Of rows
that share an id but differ, each is a row. Scores must fit a long. Ties go to the smaller id. Anchors without a same-label row or without any negative give no row, and an empty table an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdata.plans.storage import broadcast_if_small, materialize

#: Children picked at a level, rows that hang on one node directly, anchors of a block.
FAN, LEAF, BLOCK = 48, 256, 2048
_LOWEST = np.iinfo(np.int64).min


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where these are exact, which the largest possible sum tells."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return q @ x.T
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all squared lengths are ``longest``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))])


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """``children[n]``: rows that hang on row n; ``radius[n]``: the largest distance from n to anything below it. Rows without children are leaves."""

    def __init__(self, x: np.ndarray, longest: float, fan: int = FAN, leaf: int = LEAF):
        lifted = augment(x, longest)
        self.children: dict[int, np.ndarray] = {}
        self.radius: dict[int, float] = {}
        self.root = 0
        if not len(x):
            return
        self.root = int(distances(lifted, lifted.mean(axis=0)).argmin())
        todo = [(self.root, np.delete(np.arange(len(x)), self.root))]
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            own = distances(lifted[below], lifted[node])
            self.radius[node] = float(own.max())
            if len(below) <= leaf or self.radius[node] == 0:
                self.children[node] = below
                continue
            # The node itself covers what lies nearest to it; the first row that is still too far off becomes the next node.
            near, to, picked = own, np.full(len(below), -1), []
            while len(picked) < fan and (far := near > self.radius[node] / 2).any():
                picked.append(int(far.argmax()))
                d = distances(lifted[below], lifted[below[picked[-1]]])
                to = np.where(d < near, len(picked) - 1, to)
                near = np.minimum(near, d)
            to[picked] = np.arange(len(picked))
            if (near > self.radius[node] / 2).any() and np.bincount(to + 1).max() > 0.75 * len(below):
                self.children[node] = below  # this level would divide next to nothing
                continue
            hang = [below[picked]]
            left = below[to == -1]
            for k, p in enumerate(picked):
                todo.append((int(below[p]), below[(to == k) & (np.arange(len(below)) != p)]))
            # What stays with the node itself hangs on one of its rows, a level further down.
            if len(left) > leaf:
                head = int(left[distances(lifted[left], lifted[node]).argmin()])
                hang.append(np.array([head]))
                todo.append((head, left[left != head]))
            else:
                hang.append(left)
            self.children[node] = np.concatenate(hang)


class Found:
    """The best ``k`` scores of each query's windows, ties to the smaller id, and the floor that a further one must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.start = k, floor.astype(np.int64).copy(), floor.astype(np.int64)
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, window: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        if len(window):
            self.rows.append(np.column_stack([window, score, who]))
            self.held += len(window)

    def settle(self) -> np.ndarray:
        """``window, score, id`` of the best; floors rise to each full window's k-th score."""
        rows = np.concatenate(self.rows) if self.rows else np.empty((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        rows, place = rows[place < self.k], place[place < self.k]
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.start[last[:, 0]], last[:, 1])
        self.rows, self.held = [rows], len(rows)
        return rows


def search(tree: CoverTree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, k: int, same: bool) -> np.ndarray:
    """``window, score, id`` of the ``k`` best rows of each window ``low..high`` of the query ``owner`` (rows of its label but not its id if ``same``, else of other labels).

    Best first: of all nodes that some query still wants, that with the largest upper bound. ``owner`` is sorted, with as many windows for each query.
    """
    found = Found(len(low), k, low)
    if not len(x) or not len(q) or not len(low):
        return found.settle()
    length = np.sqrt(np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64)))
    by = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by], np.arange(len(q)))
    top = np.full(len(q), _LOWEST)
    np.maximum.at(top, owner, high)

    def floors() -> np.ndarray:
        out = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(out, owner, found.floor)
        return out

    def take(asked: np.ndarray, rows: np.ndarray, s: np.ndarray) -> None:
        fits = (labels[rows][None, :] == q_labels[asked][:, None]) == same
        if same:
            fits &= ids[rows][None, :] != q_ids[asked][:, None]
        fits &= (s >= floor[asked][:, None]) & (s <= top[asked][:, None])
        i, j = np.nonzero(fits)
        score, who, of = s[i, j], ids[rows[j]], asked[i]
        step = 0
        more = starts[of] + step < np.append(starts[1:], len(by))[of]
        while more.any():
            w = by[np.minimum(starts[of] + step, len(by) - 1)]
            good = more & (score >= found.floor[w]) & (score <= high[w])
            found.add(w[good], score[good], who[good])
            step += 1
            more = starts[of] + step < np.append(starts[1:], len(by))[of]

    floor = floors()
    everyone = np.arange(len(q))
    root = np.array([tree.root])
    s = products(q, x[root])
    take(everyone, root, s)
    queue = [(-math.inf, tree.root, everyone, s[:, 0])]
    while queue:
        _, node, asked, own = heapq.heappop(queue)
        if node not in tree.children:
            continue
        # Bounds are doubles; the margin keeps rounding from excluding anything.
        reach = length[asked] * tree.radius[node] * (1 + 1e-9) + 1e-6 * (1 + np.abs(own)) + 1
        wanted = (own + reach >= floor[asked]) & (own - reach <= top[asked])
        asked = asked[wanted]
        if not len(asked):
            continue
        rows = tree.children[node]
        s = products(q[asked], x[rows])
        take(asked, rows, s)
        if found.held > 4 * k * len(low):
            found.settle()
            floor = floors()
        for j, child in enumerate(rows.tolist()):
            if child in tree.children:
                bound = s[:, j] + length[asked] * tree.radius[child]
                heapq.heappush(queue, (-float(bound.max()), child, asked, s[:, j]))
    return found.settle()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _nearest(longest: float, k: int):
    """The ``k`` best rows of each anchor's own label, of one shard."""
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        x, q = _matrix(rows.column("v")), _matrix(anchors.column("v"))
        n = len(q)
        label = [t.column("label").to_numpy() for t in (rows, anchors)]
        open_ = np.full(n, _LOWEST), np.full(n, np.iinfo(np.int64).max)
        got = search(CoverTree(x, longest), x, rows.column("id").to_numpy(), label[0], q, anchors.column("id").to_numpy(), label[1], *open_, np.arange(n), k, True)
        who = pa.array(got[:, 0])
        return pa.table([anchors.column("id").take(who), anchors.column("key").take(who), pa.array(got[:, 2]), pa.array(got[:, 1])], schema=schema)
    return run


def _negatives(longest: float, k: int):
    """The ``k`` best rows of other labels in each window of the anchors, of one shard."""
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        x, q = _matrix(rows.column("v")), _matrix(anchors.column("v"))
        windows = anchors.column("windows").to_pylist()
        owner = np.repeat(np.arange(len(q)), [len(w) for w in windows])
        number, low, high = (np.array([w[f] for own in windows for w in own], np.int64) for f in ("n", "low", "high"))
        label = [t.column("label").to_numpy() for t in (rows, anchors)]
        got = search(CoverTree(x, longest), x, rows.column("id").to_numpy(), label[0], q, anchors.column("id").to_numpy(), label[1], low, high, owner, k, False)
        who = pa.array(owner[got[:, 0]])
        return pa.table([anchors.column("id").take(who), anchors.column("key").take(who), pa.array(number[got[:, 0]], pa.int32()), pa.array(got[:, 2]), pa.array(got[:, 1])], schema=schema)
    return run


def pick_centres(x: np.ndarray, longest: float, n: int) -> np.ndarray:
    """Rows spread over the sample, farthest first from the one nearest its mean."""
    lifted = augment(x, longest)
    picked = [int(distances(lifted, lifted.mean(axis=0)).argmin())]
    near = distances(lifted, lifted[picked[0]])
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(lifted, lifted[picked[-1]]))
    return x[picked]


def _assign(centres: np.ndarray, longest: float):
    """Each row's nearest centre and the distance to it."""
    lifted = augment(centres, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = augment(_matrix(batch.column("v")), longest)
                d = np.stack([distances(x, c) for c in lifted])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=0), pa.int32()), pa.array(d.min(axis=0))], [*batch.schema.names, "centre", "far"])
    return run


def _route(centres: np.ndarray, radius: dict[int, float], first: bool):
    """The centres that each anchor visits: the one of the largest product first, later all others whose bounds meet one of its windows."""
    held = np.array(sorted(radius))
    r = np.array([radius[c] for c in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"))
            own = products(q, centres[held]).astype(np.float64)
            best = own.argmax(axis=1)
            if first:
                i, j = np.arange(len(q)), best
            else:
                reach = np.sqrt(np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64)))[:, None] * r * (1 + 1e-9) + 1e-6 * (1 + np.abs(own)) + 1
                meets = np.zeros(own.shape, bool)
                for k, windows in enumerate(batch.column("windows").to_pylist()):
                    for w in windows:
                        meets[k] |= (own[k] + reach[k] >= w["low"]) & (own[k] - reach[k] <= w["high"])
                meets[np.arange(len(q)), best] = False
                i, j = np.nonzero(meets)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i)).columns, pa.array(held[j], pa.int32())], [*batch.schema.names, "centre"])
    return run


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _meet(rows: DataFrame, anchors: DataFrame, by: str, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors of equal ``by``, dealt to shards and blocks: each row comes to its shard once for each block, each anchor to its block of every shard."""
    n_rows = rows.groupBy(by).agg(F.count("*").alias("n")).select(F.col(by).alias("_by"), F.ceil(F.col("n") / shard_rows).cast("int").alias("n_s"))
    n_asked = anchors.groupBy(by).agg(F.count("*").alias("n")).select(F.col(by).alias("_to"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n_b"))
    both = broadcast_if_small(materialize(n_rows.join(n_asked, F.col("_by") == F.col("_to")).select("_by", "n_s", "n_b")))
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(both, F.col(by) == F.col("_by")).withColumn("shard", salt(F.col("n_s"))).withColumn("block", each("n_b"))
    come = anchors.join(both, F.col(by) == F.col("_by")).withColumn("block", salt(F.col("n_b"))).withColumn("shard", each("n_s"))
    return dealt.drop("_by", "n_s", "n_b"), come.drop("_by", "n_s", "n_b")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, n_positives: int = 5, n_negatives: int = 3,
                   low: int = 50, high: int = 95, shard_rows: int = 8192, n_centres: int = 32, sample: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``anchors`` is a condition on ``id``."""
    spark = vectors.sparkSession
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    v = name(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(name(id_col).cast("long").alias("id"), name(label_col).cast("long").alias("label"), v.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes["d"]:
        return empty
    rows = materialize(rows.where(F.size("v") == sizes["d"]).select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct())
    squared = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x)
    longest, n = rows.agg(F.max(squared), F.count("*")).first()
    # Rows that share an id but differ are anchors of their own; the key tells them apart.
    asked = materialize(rows.where(anchors).withColumn("key", F.xxhash64("label", "v")))

    # Positives: same label, so an equality join.
    dealt, come = _meet(rows, asked, "label", shard_rows)
    by = ["label", "shard", "block"]
    near = dealt.groupBy(*by).cogroup(come.groupBy(*by)).applyInArrow(_nearest(longest, n_positives), "anchor_id long, key long, vec_id long, score long")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("n") <= n_positives)
    # Of the scores s with low * p <= 100 * s <= high * p, the least and the largest.
    part = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    bounds = F.struct("n", F.col("vec_id").alias("positive_id"), "score", F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high"))
    windows = near.select(F.col("anchor_id").alias("_id"), F.col("key").alias("_key"), bounds.alias("w")).where("w.low <= w.high").groupBy("_id", "_key").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    mine = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    asked = materialize(asked.join(windows, mine).select("id", "key", "label", "v", "windows"))
    if not asked.count():
        return empty

    # Negatives: rows at their centres, anchors where a window may be met.
    some = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(sample).select("v").toArrow()
    centres = pick_centres(_matrix(some.column("v")), longest, max(1, min(n_centres, n // shard_rows)))
    placed = materialize(rows.mapInArrow(_assign(centres, longest), "id long, label long, v array<long>, centre int, far double"))
    radius = {r["centre"]: r["r"] for r in placed.groupBy("centre").agg(F.max("far").alias("r")).collect()}
    placed = placed.drop("far")
    window = "array<struct<n:int,positive_id:long,score:long,low:long,high:long>>"

    def visit(who: DataFrame, first: bool) -> DataFrame:
        sent = materialize(who.mapInArrow(_route(centres, radius, first), f"id long, key long, label long, v array<long>, windows {window}, centre int"))
        dealt, come = _meet(placed, sent, "centre", shard_rows)
        by = ["centre", "shard", "block"]
        rows = dealt.groupBy(*by).cogroup(come.groupBy(*by))
        return rows.applyInArrow(_negatives(longest, n_negatives), "anchor_id long, key long, window int, vec_id long, score long")

    best = Window.partitionBy("anchor_id", "key", "window").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    found = materialize(top(visit(asked, True)))
    if len(radius) > 1:
        # What the first centre gave is a floor for the others.
        full = found.where(F.col("rank") == n_negatives).groupBy(F.col("anchor_id").alias("_id"), F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))
        raised = lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at("floors", w["n"]), w["low"])))
        rest = asked.join(full, mine, "left").select("id", "key", "label", "v", F.transform("windows", raised).alias("windows"))
        found = top(found.drop("rank").unionByName(visit(rest, False)))
    windows = asked.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.explode("windows").alias("w"))
    out = found.join(windows, (F.col("anchor_id") == F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("window") == F.col("w.n")))
    return out.select("anchor_id", F.col("w.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("w.score").alias("positive_score"), F.col("score").alias("negative_score"))
