"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; two documents are linked if 100 * |A and B| >= percent * |A or B|. Documents of equal
sets form a class, and one stands for all. A class keeps the ``k`` smallest shingle hashes (its sketch).

1. Inverted lists of retained values. Linked sets share at least ``t`` of their retained values (``t``: the most that is missed with odds of at most
   1e-8, see :func:`shared_values`), so in one order of all values, rarest first, they meet among the first k - t + 1 of each. Only these are listed, and
   classes with fewer than ``t`` values that others hold as well are out.
2. Pairs. In each list the member with the most common values (the likeliest original) is paired with the others, which makes as many
   pairs as members. The union's bottom-k estimates the similarity from two sketches; pairs far below are out. The rest is verified
   on whole sets; verified links are joined into components, and members that end up in the same component need no pair.
3. Of short lists (at most ``crowd`` members) that still hold more than one component, all other pairs of different components are tested.
   Longer ones mostly hold edits of one original that aren't near enough to each other. Their members
   (and no others) are listed anew, exactly, by whole sets: values rarest first (among these members), for each class of partner sizes as far as a
   pair of these sizes that meets there for the first time can still reach the threshold (prefix, length and positional filter). Edits that are too
   far from the original then no longer meet at what they have from it, but only at what they share besides.
4. While one of these lists holds more than one component, its next members (32 times as many each round) are paired with the members of other
   components, until no pair is left to try. So copies aren't expanded into all pairs, and no link between components is lost.

Without words (or text) a set is empty and linked with nothing. Repeated rows belong to the same class. Rows without doc_id take part,
but name no component; where a component has no other rows its id is null, and they are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdata.llm.components import connected_components, join_components
from verdata.llm.hashing import mix, run_hashes, word_hashes
from verdata.llm.text import LOWER, slices, texts
from verdata.plans.storage import broadcast_if_small, drop, in_tasks, materialize

_SIGNED = np.uint64(1 << 63)


def shingle_sets(raw: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles (all words as one, where they are fewer than ``size``)."""
    words = [t.translate(LOWER).split() if t else [] for t in raw]
    x, ends = word_hashes(words)
    grams = run_hashes(x, size)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(mix(run_hashes(x[a:b], int(b - a), seed=int(b - a))))
        else:
            out.append(x[:0])
    return out


def _signature(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of mixed members."""
    a = int(np.add.reduce(mix(s ^ np.uint64(0x51ED270B)), dtype=np.uint64)) if len(s) else 0
    b = int(np.add.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), dtype=np.uint64)) if len(s) else 0
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def _sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts(batch, "text"), size)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "cls", "sketch"])
    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts(batch, "text"), size)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])
    return run


def _estimate(k: int, percent: int, slack: float):
    """Pairs whose similarity in the bottom-k of the union isn't far below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
            for x, y in zip(left, right):
                x, y = np.array(x).view(np.uint64), np.array(y).view(np.uint64)
                u = np.union1d(x, y)[:k]
                both = np.isin(u, x, assume_unique=True) & np.isin(u, y, assume_unique=True)
                keep.append(100 * both.sum() >= (percent - 100 * slack) * len(u))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_b"):
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _values():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            own = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["cls", "n", "values"])
    return run


def _exact_lists(sets: DataFrame, percent: int, ratio: float = 1.03) -> DataFrame:
    """``cls, value`` (a list's key), ``n, pos`` (the value's place in the set) and ``side``, by whole sets.

    Sizes fall into classes a few percent wide; a list is for one value and two of these, and pairs members of the two (sides 0 and 1; null if they are the same).
    """
    own = materialize(sets.mapInArrow(_values(), "cls long, n long, values array<long>"))
    each = own.select("cls", F.explode("values").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(often, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    rows = own.select("cls", "n").join(held, "cls")
    step = math.log(ratio)
    of = lambda n: F.floor(F.log(n) / step + 1e-9)
    least, most = F.ceil(percent * F.col("n") / 100 - 1e-9), F.floor(100 * F.col("n") / percent + 1e-9)
    rows = rows.withColumn("b", of(F.col("n"))).withColumn("p", F.explode(F.sequence(of(least), of(most))))
    # The least partner of class p, the overlap that a pair with it needs, and the places up to which the first common value may stand.
    partner = F.greatest(least, F.ceil(F.exp((F.col("p") - 1e-6) * step) - 1e-6))
    need = F.ceil(percent * (F.col("n") + partner) / (100 + percent) - 1e-9)
    reach = (F.size("common") - need + 1).cast("int")
    rows = rows.withColumn("prefix", F.slice("common", F.lit(1), F.greatest(F.lit(0), reach)))
    rows = rows.select("cls", "n", "b", "p", (F.col("n") - F.size("common")).alias("alone"), F.posexplode("prefix.value").alias("i", "v"))
    side = F.when(F.col("b") < F.col("p"), F.lit(0)).when(F.col("b") > F.col("p"), F.lit(1))
    return rows.select("cls", F.xxhash64("v", F.least("b", "p"), F.greatest("b", "p")).alias("value"), "n", (F.col("alone") + F.col("i")).alias("pos"), side.alias("side"))


def _need(a, b, percent: int):
    """The overlap that sets of sizes a and b need."""
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


def _alive(lists: DataFrame, percent: int) -> DataFrame:
    """Members that can still pair with one of their list, of lists that have both sides."""
    found = lists.groupBy("value").agg(F.min("n").alias("_n"), F.min("side").alias("_a"), F.max("side").alias("_z"))
    rows = lists.join(found, "value").where(F.col("side").isNull() | (F.col("_a") < F.col("_z")))
    partner = F.greatest("_n", F.ceil(percent * F.col("n") / 100 - 1e-9))
    rows = rows.where(F.col("n") - F.col("pos") >= _need(F.col("n"), partner, percent)).drop("_n", "_a", "_z")
    many = rows.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    return rows.join(many, "value", "left_semi")


def _may_pair(x: str, percent: int):
    """Of a member and hub ``x`` of its list: whether they stand on different sides and can reach the threshold, if this is the first value that they share."""
    n, pos, side = (F.col(f"{x}.{c}") for c in ("n", "pos", "side"))
    left = F.least(F.col("n") - F.col("pos"), n - pos)
    return (side.isNull() | (F.col("side") != side)) & (pos.isNull() | (left >= _need(F.col("n"), n, percent)))


def shared_values(k: int, percent: int, odds: float = 1e-8) -> int:
    """The largest t so that linked sets share fewer than t of k retained values with at most these odds.

    The worst case is a set inside another: each retained value of the larger one is in the smaller with the threshold's probability.
    """
    p, below, t = percent / 100, 0.0, 0
    while t < k:
        below += math.comb(k, t) * p ** t * (1 - p) ** (k - t)
        if below > odds:
            break
        t += 1
    return max(1, t)


def _with_both(pairs: DataFrame, rows: DataFrame, *columns: str, each: int) -> DataFrame:
    """Written ``pairs`` (``a, b``) with the ``columns`` of both classes, as ``<column>_a`` and ``<column>_b``.

    Few pairs are broadcast to the rows of each side, and only rows that are asked for move, dealt by pair: one shuffle, in which a class
    of many pairs isn't one task's. More meet one side after the other. Tasks get about ``each`` pairs, where there are few.
    """
    a, b = (rows.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    few = broadcast_if_small(pairs)
    both = pairs.join(a, "a").join(b, "b") if few is pairs else a.join(few, "a").join(b.join(few, "b"), ["a", "b"])
    return in_tasks(both, pairs.count(), each)


class _Links:
    """Verified links between classes, and the components they make so far."""

    def __init__(self, listed: DataFrame, sets: DataFrame, percent: int, k: int, slack: float):
        self.listed, self.sets, self.percent, self.k, self.slack = listed, sets, percent, k, slack
        self.roots: DataFrame | None = None
        self.known: DataFrame | None = None

    def component(self, members: DataFrame) -> DataFrame:
        """``members`` with ``comp``."""
        if self.roots is None:
            return members.withColumn("comp", F.col("cls"))
        return members.join(self.known, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")

    def test(self, pairs: DataFrame, most: int | None = None) -> None:
        """Estimate and verify pairs ``a, b`` (``most`` at most) and join the linked ones. What is left of them is written after each step; no rows, no further step."""
        percent = self.percent
        pairs = materialize(pairs.distinct() if most is None else in_tasks(pairs.distinct(), most))
        near = found = None
        if pairs.count():
            both = _with_both(pairs, self.listed, "n", "sketch", each=2_000).where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
            near = materialize(both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimate(self.k, percent, self.slack), "a long, b long"))
        if near is not None and near.count():
            both = _with_both(near, self.sets.withColumnRenamed("shingles", "set"), "set", each=500)
            found = materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"))
        if found is not None and (n := found.count()):
            old, self.roots = self.roots, materialize(connected_components(found, most=n) if self.roots is None else join_components(self.roots, found))
            self.known = broadcast_if_small(self.roots)
            drop(old)
        drop(pairs, near, found)


def _chief_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each list's first member with the others, of written ``members``."""
    chief = in_tasks(members.groupBy("value").agg(F.min(F.struct("rank", "n", "pos", "side")).alias("h")).withColumnRenamed("value", "v"), members.count())
    pairs = members.join(chief, (F.col("value") == F.col("v")) & (F.col("rank") != F.col("h.rank")) & _may_pair("h", percent))
    return pairs.select(F.col("h.rank.c").alias("a"), F.col("cls").alias("b"))


def _open(members: DataFrame, rows: int, more: str = "true") -> DataFrame:
    """Lists that hold more than one component, on both sides where they have sides; ``rows``: of members."""
    held = members.where(more).groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.min("side").alias("a"), F.max("side").alias("z"))
    return in_tasks(held, rows).where("x < y and (a is null or a < z)").select("value", "m")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, k: int = 40, share: float | None = None, slack: float = 0.35, crowd: int = 4) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text), ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    ``share``: the share of retained values that must be common (by default from :func:`shared_values`); ``crowd``: members up to which all of a list
    are paired, as far as their components differ; longer lists that stay open are listed anew.
    """
    share = shared_values(k, percent) / k if share is None else share
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    rows = materialize(docs.mapInArrow(_sketch(size, k), "doc_id long, row long, n_shingles long, cls binary, sketch array<long>"))
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min_by(F.struct("doc_id", "row"), F.struct("doc_id", "row")).alias("one"),
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    # The number, fixed once written, stands for the class from here on; signatures only lead from rows to classes.
    classes = materialize(classes.withColumnRenamed("cls", "signature").withColumn("cls", F.monotonically_increasing_id()))
    values = classes.select("cls", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(common, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    t = F.greatest(F.lit(1), F.floor(F.lit(share) * F.size("sketch") + 1e-9)).cast("int")
    listed = classes.join(held, "cls").where(F.size("common") >= t).select(
        "cls", "n", "sketch", "one", F.aggregate("common", F.lit(0.0), lambda s, x: s + F.log(x["df"])).alias("weight"),
        F.slice("common", F.lit(1), F.greatest(F.lit(0), F.size("common") - t + 1)).alias("prefix"))
    listed = materialize(listed)
    asked = broadcast_if_small(listed).select("cls", F.col("one.doc_id").alias("_d"), F.col("one.row").alias("_r"))
    sets = docs.join(asked, docs.doc_id.eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))).select("cls", "text")
    sets = materialize(sets.mapInArrow(_whole(size), "cls long, shingles binary").dropDuplicates(["cls"]))
    links = _Links(listed, sets, percent, k, slack)
    # Order within a list: most common values first; the class settles ties.
    none = [F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("side")]
    first = listed.select("cls", "n", F.explode("prefix.value").alias("value"), F.struct((-F.col("weight")).alias("w"), F.col("cls").alias("c")).alias("rank"), *none)
    many = first.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    first = materialize(first.join(many, "value", "left_semi"))
    n = first.count()
    links.test(_chief_pairs(first, percent), n)
    members = links.component(first)
    few = members.join(_open(members, n).where((F.col("m") > 2) & (F.col("m") <= crowd)).select("value"), "value", "left_semi")
    top = few.select(F.col("value").alias("v"), F.col("cls").alias("a"), F.col("rank").alias("ra"), F.col("comp").alias("ca"))
    links.test(few.join(top, (F.col("value") == F.col("v")) & (F.col("rank") > F.col("ra")) & (F.col("comp") != F.col("ca"))).select("a", F.col("cls").alias("b")))
    unsettled = _open(links.component(first), n).where(F.col("m") > max(2, crowd)).select("value")
    crowded = materialize(in_tasks(first.join(unsettled, "value", "left_semi").select("cls", "rank").distinct(), n))
    drop(first)
    asked = broadcast_if_small(crowded)
    anew = materialize(_exact_lists(sets.join(asked, "cls", "left_semi"), percent))
    lists = materialize(_alive(anew, percent).join(asked, "cls"))
    drop(anew, crowded)
    tried, hubs, active = 0, 1, lists
    while True:
        members, n = links.component(active), active.count()
        members = materialize(in_tasks(members.join(_open(members, n, f"place > {tried}" if tried else "true").select("value"), "value", "left_semi"), n))
        if members.count() == 0:
            break
        if tried == 0:
            links.test(_chief_pairs(members, percent), n)
            # From the second round on a member's place in its list counts; lists of one component by now and those of two members need none.
            comp = links.component(lists)
            left = lists.join(_open(comp, n).where("m > 2").select("value"), "value", "left_semi")
            active = materialize(in_tasks(left.withColumn("place", F.row_number().over(Window.partitionBy("value").orderBy("rank"))), n))
        else:
            top = members.where((F.col("place") > tried) & (F.col("place") <= tried + hubs)).select(F.col("value").alias("v"), F.col("cls").alias("a"), F.struct("rank", "n", "pos", "side").alias("h"), F.col("comp").alias("ca"))
            pairs = members.join(top, (F.col("value") == F.col("v")) & (F.col("rank") > F.col("h.rank")) & (F.col("comp") != F.col("ca")) & _may_pair("h", percent)).select("a", F.col("cls").alias("b"))
            links.test(pairs)
            active = members.drop("comp")
        tried, hubs = tried + hubs, hubs * 32
    # Most classes are linked with none and name themselves.
    node = links.component(classes.select("cls", "signature", "doc_id"))
    if links.roots is not None:
        least = classes.select("cls", "doc_id").join(links.known, F.col("cls") == F.col("node")).groupBy("root").agg(F.min("doc_id").alias("least"))
        least = broadcast_if_small(materialize(least))
        node = node.join(least, F.col("comp") == F.col("root"), "left").withColumn("doc_id", F.coalesce("least", "doc_id"))
    named = node.select(F.col("signature").alias("cls"), F.col("doc_id").alias("component_id"))
    out = rows.drop("sketch").join(named, "cls", "left")
    drop(listed, sets, lists)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns, whatever their names; of rows equal in doc_id and text, one.

    Rows that go are joined by (doc_id, hash of the text); texts stay where they are while there are at most as many as may be broadcast.
    """
    found = materialize(near_duplicates(docs, **parameters).select("doc_id", "row", "kept"))
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("d"), F.col("row").alias("r")).distinct())
    again = materialize(found.where("kept").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"))
    drop(found)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    rows = rows.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left_anti")
    if again.limit(1).count() == 0:
        return rows.select("doc.*")
    # Repeated rows (equal doc_id and text) are few or none: one of each stays, by a number that is fixed once written.
    again = broadcast_if_small(again.select(F.col("doc_id").alias("d"), F.col("row").alias("r")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    one = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "row"])
    return rows.join(again, same, "left_anti").select("doc.*").union(one.select("doc.*"))
