"""Sequence packing by non-negative least squares over shallow length combinations.

A document's token ids, with a separator id after them, are cut into full windows and one remainder. A strategy is a
combination of at most ``depth`` remainder lengths that fills a window exactly. Non-negative least squares finds how often
to repeat each strategy so that together they use up the histogram of remainder lengths; the counts are rounded down, and what
they leave is packed greedily, one after another, cut where a window is full.

Null texts count as empty and hold the separator alone. Repeated rows are packed once for each row; rows of equal doc_id
are separate documents. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import slices
from verdata.operators.numbering import number_rows
from verdata.plans.storage import materialize

#: A pre-token never runs over a space that follows something other than white space.
_BOUND = re.compile(r"(?<=\S)(?= )")
_FOLLOWS_SPACE = re.compile(r"[\s\x1c-\x1f] ")
#: A word of Latin letters, perhaps with marks after it, and perhaps the same again on the next line: up to five pre-tokens.
_WORD = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?#$%&*|]*)"
_PLAIN = re.compile(f"{_WORD}(?:(\n){_WORD})?")
_CACHED = 600_000

#: Up to so many cut remainders are broadcast (about 100 bytes each).
SMALL = 50_000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Each distinct piece between sure pre-token boundaries is encoded once, as long as it is cached. Where the vocabulary is
    byte-level with ids in merge order, plain words get their merges from tiktoken, which has less to do for each; all else goes through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Of pieces that follow a space (kept without it), and of others.
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.merge = self._merger(json.load(f)["model"])

    @staticmethod
    def _merger(model: dict):
        vocabulary = model["vocab"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(vocabulary.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
            return None
        import tiktoken

        # Byte-level vocabularies write a byte as its own character if that is printable, else as one from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        ranks = {bytes(letter[c] for c in w): i for w, i in vocabulary.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before spaces; all pieces but the first lack the space that they begin with."""
        if _FOLLOWS_SPACE.search(text):
            first, *rest = _BOUND.split(text)
            return [first, *[x[1:] for x in rest]]
        return text.split(" ")

    def _learn(self, new: list[str], known: dict[str, bytes], before: str) -> None:
        other = []
        for x in new:
            m = self.merge and _PLAIN.fullmatch(x)
            if m:
                word, *rest = m.groups()
                ids = self.merge(before + word)
                for part in rest:
                    if part:
                        ids += self.merge(part)
                known[x] = array("I", ids).tobytes()
            else:
                other.append(x)
        for at in range(0, len(other), 20_000):
            part = other[at:at + 20_000]
            for x, e in zip(part, self.tokenizer.encode_batch([before + x for x in part], add_special_tokens=False)):
                known[x] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        heads = [c[0] if c else "" for c in cut]
        for c in cut:
            del c[:1]
        self.first = {}
        self._learn(list(set(heads)), self.first, "")
        new = list(set().union(*cut) - self.known.keys())
        self._learn(new, self.known, " ")
        get = self.known.__getitem__
        out = [self.first[h] + b"".join(map(get, c)) for h, c in zip(heads, cut)]
        if len(self.known) > _CACHED:  # the frequent ones are in by now
            for x in new:
                del self.known[x]
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)


def _single_threaded() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def _encode(path: str, separator: int, window: int):
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        encoder = _encoder(path)
        for batch in slices(batches, "text"):
            doc, start, length, crc, total, row = [], [], [], [], [], []
            ids = batch.column("doc_id").to_pylist()
            for i, (d, r, e) in enumerate(zip(ids, batch.column("row").to_pylist(), encoder.encode(batch.column("text").to_pylist()))):
                e += end
                n = len(e) // 4
                for at in range(0, n, window):
                    part = e[4 * at:4 * (at + window)]
                    doc.append(d), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n), row.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (row, start, length, crc, total))],
                                             ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def _crc_parts(path: str, separator: int):
    """crc32 of given (start, length) ranges of a document's ids."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        encoder = _encoder(path)
        for batch in slices(batches, "text"):
            rows = []
            for e, d, r, n, parts in zip(encoder.encode(batch.column("text").to_pylist()), *(batch.column(c).to_pylist() for c in ("doc_id", "row", "doc_tokens", "parts"))):
                e += end
                rows += [(d, r, p["start"], p["length"], zlib.crc32(e[4 * p["start"]:4 * (p["start"] + p["length"])]), n, p["sequence_id"], p["offset"]) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(8)],
                                             ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def combinations(lengths: dict[int, int], window: int, depth: int = 3, per_length: int = 24) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` of the present lengths that sum to ``window``: all of one and two, and for
    each length the ``per_length`` of three with the most frequent partners. Bounded by the window, whatever the data."""
    have = sorted(lengths)
    present = set(have)
    out = {(window,)} if window in present else set()
    out |= {(a, window - a) for a in have if 2 * a >= window and window - a in present}
    if depth >= 3:
        common = sorted(have, key=lambda x: (-lengths[x], x))
        for a in have:
            found = 0
            for b in common:
                c = window - a - b
                if c > 0 and c in present:
                    out.add(tuple(sorted((a, b, c), reverse=True)))
                    found += 1
                    if found == per_length:
                        break
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], target: dict[int, int], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - histogram||^2, with A's columns the combinations' own counts.

    Accelerated projected gradient with restarts; the step is 1 over a bound of the largest eigenvalue of A'A.
    """
    if not columns:
        return np.zeros(0)
    at = {v: i for i, v in enumerate(sorted(target))}
    b = np.array([target[v] for v in sorted(target)], float)
    width = max(map(len, columns))
    idx = np.array([[at[v] for v in c] + [len(at)] * (width - len(c)) for c in columns])
    use = lambda x: np.bincount(idx.ravel(), np.repeat(x, width), len(at) + 1)[:-1]
    back = lambda r: np.append(r, 0.0)[idx].sum(1)
    bound = float(back(use(np.ones(len(columns)))).max())
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(use(y) - b) / bound)
        if np.dot(y - new, new - x) > 0:
            t, y = 1.0, new
        else:
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y = new + (t - 1) / t2 * (new - x)
            t = t2
        x = new
    return x


def plan(lengths: dict[int, int], window: int, depth: int = 3) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Strategies with whole repeat counts, none over the histogram, and how many of each length they use."""
    columns = combinations(lengths, window, depth)
    x = nnls(columns, lengths)
    left = dict(lengths)
    out, used = [], defaultdict(int)
    for i in sorted(range(len(columns)), key=lambda i: (-x[i], columns[i])):
        need = Counter(columns[i])
        n = min(int(x[i] + 1e-6), *(left[v] // k for v, k in need.items()))
        if n > 0:
            out.append((columns[i], n))
            for v, k in need.items():
                left[v] -= k * n
                used[v] += k * n
    # What rounding left over is packed greedily, the largest exact fillings first.
    for c in sorted(columns, reverse=True):
        need = Counter(c)
        n = min(left[v] // k for v, k in need.items())
        if n > 0:
            out.append((c, n))
            for v, k in need.items():
                left[v] -= k * n
                used[v] += k * n
    return out, dict(used)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, separator: int = 0, depth: int = 3) -> DataFrame:
    """One row for each piece: ``doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``row`` is a hash of the text: rows that agree in it and in doc_id are interchangeable. Every id is in exactly one piece, and a sequence's pieces follow each other without a gap from 0.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(keyed.mapInArrow(_encode(tokenizer, separator, window), schema))
    # At most `window` rows.
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = lengths.pop(window, 0)
    strategies, used = plan(lengths, window, depth)
    order = [F.col("doc_id"), F.col("row"), F.col("start")]
    ranked = number_rows(pieces, ["length"], order, "rank")
    # Ranks of each length that go to a strategy's place; at most `depth` rows for each strategy in use.
    places, taken, sequence = [(window, 0, full, 0, 0)], defaultdict(int), full
    for c, n in strategies:
        offset = 0
        for v in c:
            places.append((v, taken[v], taken[v] + n, sequence, offset))
            taken[v] += n
            offset += v
        sequence += n
    table = spark.createDataFrame(places, "p_length long, low long, high long, first long, offset long")
    placed = materialize(ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
                         .select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"))
    done = placed.where("sequence_id is not null")
    # What is left, longest first, fills window after window.
    rest = placed.where("sequence_id is null").drop("sequence_id", "offset")
    rest = number_rows(rest.withColumn("_down", -F.col("length")), [], [F.col("_down"), *order], "_n", weight="length", before="_before")
    cuts = F.filter(F.transform(F.sequence(F.floor(F.col("_before") / window), F.floor((F.col("_before") + F.col("length") - 1) / window)), lambda s: F.struct(
        F.greatest(s * window - F.col("_before"), F.lit(0)).alias("a"),
        F.least((s + 1) * window - F.col("_before"), F.col("length")).alias("z"), s.alias("s"))), lambda x: x["z"] > x["a"])
    rest = rest.select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", F.transform(cuts, lambda x: F.struct(
        (F.col("start") + x["a"]).cast("long").alias("start"), (x["z"] - x["a"]).cast("long").alias("length"),
        (x["s"] + sequence).cast("long").alias("sequence_id"), (F.col("_before") + x["a"] - x["s"] * window).cast("long").alias("offset"))).alias("parts"))
    rest = materialize(rest)
    whole = rest.where(F.size("parts") == 1).select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", F.col("parts")[0]["sequence_id"].alias("sequence_id"), F.col("parts")[0]["offset"].alias("offset"))
    # Only documents whose remainder is cut are encoded once more. Repeated rows meet each other's parts and give each piece more than once.
    split = rest.where(F.size("parts") > 1).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "doc_tokens", "parts")
    # A few thousand rows at most come from rounding; more (a histogram that doesn't add up to windows) are joined by a shuffle.
    if split.limit(SMALL + 1).count() <= SMALL:
        split = F.broadcast(split)
    cut = keyed.join(split, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "row", "text", "doc_tokens", "parts")
    cut = cut.mapInArrow(_crc_parts(tokenizer, separator), schema + ", sequence_id long, offset long")
    return done.unionByName(whole).unionByName(cut.dropDuplicates(["sequence_id", "offset"]))
