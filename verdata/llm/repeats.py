"""Removal of passages that earlier documents hold: repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has a word sequence that
also starts in a document of smaller doc_id.

1. Confirm: of each window, the phrase (``phrase`` words) of smallest hash is its anchor, so equal windows have equal anchors.
   A phrase that is an anchor in two different texts is a recurring one; counting takes one narrow aggregation. What is known then is a set of phrases: a dictionary of their words, read from
   one document each, and for each document which of them it holds, but not where.
2. Compile and stream: documents are dealt out in blocks (Arrow batches), the shards. Each block's automaton is compiled of the words that the dictionary has for its documents' phrases, and all
   the block's documents are streamed through it over words as symbols, which locates every occurrence. Nothing else gives positions: a window is a candidate only where the
   automaton has located its anchor. An automaton has 800,000 words of phrases at most (a block with more, from one very long text, is streamed through several).
3. Exact check: candidate windows are looked up by two 64-bit hashes (of anchor and window, both over 64-bit hashes of the words) among those of all
   documents; the smallest doc_id of each decides.

Documents without a recurring phrase stay where they are, as long as the others' keys may be broadcast; only the others' texts are shuffled.
Rows of equal text count once in 1 and 2: all but those of the smallest doc_id lose every word, if there is a window at all. Null and
empty texts have no words. Rows without a doc_id are kept whole and decide nothing. Repeated rows (equal doc_id and text) aren't earlier than each other.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdata.llm.hashing import run_hashes, sliding_min, word_hashes
from verdata.llm.text import slices, texts, words_of
from verdata.plans.storage import SMALL_ROWS, broadcast_if_small, drop, materialize

#: Code points from here on stand for words; below are the surrogates, which a string can't hold.
_FIRST = 0xE000
#: Words of the phrases of one automaton at most (they must fit into the code points, and bound its memory).
_SHARD_WORDS = 800_000


def _anchors(x: np.ndarray, ends: np.ndarray, window: int, phrase: int):
    """Phrase hashes, and each window's anchor with the mask of windows that lie in one document."""
    grams = run_hashes(x, phrase)
    least = sliding_min(grams, window - phrase + 1)
    inside = np.zeros(len(least), bool)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= window:
            inside[a:b - window + 1] = True
    return grams, least, inside


def _emit_anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, ends = word_hashes([words_of(t) for t in texts(batch, "text")])
            grams, least, inside = _anchors(x, ends, window, phrase)
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
            at = np.flatnonzero(new)
            doc = np.searchsorted(ends, at, "right") - 1
            take = pa.array(doc)
            # Where the anchor stands in its window.
            place = np.concatenate([np.argmax(grams[some[:, None] + np.arange(window - phrase + 1)] == least[some, None], 1) for some in np.array_split(at, 1 + len(at) // 50_000)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(least[at].view(np.int64)), pa.array((at + place - ends[doc]).astype(np.int32))],
                                             ["doc_id", "row", "phrase", "start"])
    return run


def _phrase_words(phrase: int):
    """The words of the phrases at the given places of a document, as 64-bit hashes in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, ends = word_hashes([words_of(t) for t in texts(batch, "text")])
            names, words = [], []
            for own, begin in zip(batch.column("own").to_pylist(), ends):
                for p in own:
                    names.append(p["phrase"]), words.append(x[begin + p["start"]:begin + p["start"] + phrase].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(words, pa.binary())], ["phrase", "words"])
    return run


def _locate(x: np.ndarray, ends: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Positions of all occurrences, in a block of documents, of phrases given by their words (a row each)."""
    step = _SHARD_WORDS // phrases.shape[1]
    return np.unique(np.concatenate([_stream_shard(x, ends, phrases[i:i + step]) for i in range(0, len(phrases), step)]))


def _stream_shard(x: np.ndarray, ends: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Positions of all occurrences of the phrases: one automaton over one code point for each word, through which all documents of the block go."""
    vocabulary = np.unique(phrases)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for row in (np.searchsorted(vocabulary, phrases) + _FIRST + 2).astype("<u4"):
        automaton.add_word(row.tobytes().decode("utf-32-le"), 1)
    automaton.make_automaton()
    at = np.searchsorted(vocabulary, x)
    at[at == len(vocabulary)] = 0
    symbols = np.where(vocabulary[at] == x, at + _FIRST + 2, _FIRST)
    # A symbol of its own between documents: no phrase runs over it.
    stream = np.insert(symbols, ends[1:-1], _FIRST + 1).astype("<u4").tobytes().decode("utf-32-le")
    found = np.fromiter((e for e, _ in automaton.iter(stream)), np.int64)
    breaks = ends[1:-1] + np.arange(len(ends) - 2)
    return found - np.searchsorted(breaks, found) - phrases.shape[1] + 1


_BLOCK = ("doc_id long, row long, n_words long, n_removed long, kept string, text string, "
          "phrases array<long>, hashes array<long>, starts array<int>")
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _keep(words: list[bytes], digest: bool) -> str:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def _stream(window: int, phrase: int, digest: bool):
    span = window - phrase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = texts(batch, "text")
            words = [words_of(t) for t in raw]
            twin = batch.column("twin").to_pylist()
            wanted = sorted({w for own in batch.column("wanted").to_pylist() for w in own or ()})
            out: dict[str, list] = {k: [] for k in ("n_removed", "kept", "text", "phrases", "hashes", "starts")}
            some_ = bool(wanted)
            if some_:
                x, ends = word_hashes(words)
                grams, least, inside = _anchors(x, ends, window, phrase)
                located = _locate(x, ends, np.frombuffer(b"".join(wanted), np.uint64).reshape(-1, phrase))
                there = np.full(len(grams), _NEVER)
                there[located] = grams[located]
                hit = np.flatnonzero(inside & (sliding_min(there, span + 1) == least))
                whole = run_hashes(x, window, seed=1)
                edges = np.searchsorted(hit, ends)
            for i, (w, t) in enumerate(zip(words, raw)):
                a, b = (edges[i], edges[i + 1]) if some_ else (0, 0)
                gone = bool(twin[i]) and len(w) >= window
                some = b > a and not twin[i]
                out["n_removed"].append(len(w) if gone else 0)
                out["kept"].append(None if some else _keep([] if gone else w, digest))
                out["text"].append(t if some else None)
                at = hit[a:b] if some else None
                out["phrases"].append(least[at].view(np.int64) if some else None)
                out["hashes"].append(whole[at].view(np.int64) if some else None)
                out["starts"].append((at - ends[i]).astype(np.int32) if some else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array([len(w) for w in words], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()),
                pa.array(out["text"], pa.binary()).cast(pa.string()), pa.array(out["phrases"], pa.list_(pa.int64())), pa.array(out["hashes"], pa.list_(pa.int64())), pa.array(out["starts"], pa.list_(pa.int32()))],
                ["doc_id", "row", "n_words", "n_removed", "kept", "text", "phrases", "hashes", "starts"])
    return run


def _cut(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, gone, kept = [], [], []
            for t, starts in zip(texts(batch, "text"), batch.column("gone").to_pylist()):
                w = words_of(t)
                cover = np.zeros(len(w) + 1, np.int64)
                if starts:
                    s = np.array(starts)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                stay = np.cumsum(cover)[:-1] == 0
                n.append(len(w)), gone.append(len(w) - int(stay.sum())), kept.append(_keep([a for a, k in zip(w, stay.tolist()) if k], digest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 20, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space (``digest``: their SHA-256)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    key = ["doc_id", "row"]
    same = materialize(docs.select(*key, F.unhex(F.sha2("text", 256)).alias("_text")).distinct())
    first = same.groupBy("_text").agg(F.min("doc_id").alias("_first"))
    twins = same.join(first, "_text").where(F.col("doc_id") > F.col("_first")).select(*key, F.lit(True).alias("twin"))
    anchors = materialize(docs.where("doc_id is not null").mapInArrow(_emit_anchors(window, phrase), "doc_id long, row long, phrase long, start int"))
    one = F.min(F.struct("doc_id", "row", "start"))
    recurring = anchors.groupBy("phrase").agg(F.min("row").alias("a"), F.max("row").alias("b"), one.alias("one")).where("a < b")
    sources = materialize(recurring.groupBy(F.col("one.doc_id").alias("d"), F.col("one.row").alias("r")).agg(F.collect_list(F.struct("phrase", F.col("one.start").alias("start"))).alias("own")))
    here = docs.doc_id.eqNullSafe(F.col("d")) & (docs.row == F.col("r"))
    named = docs.join(broadcast_if_small(sources.select("d", "r")), here, "left_semi").join(sources.hint("merge"), here) if sources.count() <= SMALL_ROWS else docs.join(sources, here)
    # Written first, so that the join with it has a plain exchange on both sides, whose hot keys can be split. A text that comes twice gives its phrases twice.
    dictionary = materialize(named.select("text", "own").mapInArrow(_phrase_words(phrase), "phrase long, words binary").dropDuplicates(["phrase"]))
    mine = anchors.select(*key, "phrase").join(twins.select(*key), key, "left_anti")
    held = mine.join(dictionary, "phrase").groupBy(*key).agg(F.collect_set("words").alias("wanted"))
    plan = materialize(held.join(twins, key, "full").select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "wanted", "twin"))
    drop(same, anchors, sources, dictionary)
    columns = ["doc_id", "row", "text", "wanted", F.coalesce("twin", F.lit(False)).alias("twin")]
    keys = plan.select("d", "r")
    if plan.count() <= SMALL_ROWS:
        planned = docs.join(F.broadcast(keys), here, "left_semi").join(plan.hint("merge"), here)
        plain = docs.join(F.broadcast(keys), here, "left_anti").select("*", F.lit(None).cast("array<binary>").alias("wanted"), F.lit(False).alias("twin"))
        blocks = planned.select(*columns).union(plain)
    else:
        blocks = docs.join(plan, here, "left").select(*columns)
    done = materialize(blocks.mapInArrow(_stream(window, phrase, digest), _BLOCK))
    drop(plan)
    windows = done.where("starts is not null").select(*key, F.explode(F.arrays_zip("phrases", "hashes", "starts")).alias("w")).select(*key, "w.*")
    windows = windows.withColumnsRenamed({"phrases": "phrase", "hashes": "hash", "starts": "start"})
    # Written first, so that the join with it has a plain exchange on both sides, whose hot keys can be split.
    earliest = windows.groupBy("phrase", "hash").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    earliest = materialize(earliest)
    gone = materialize(windows.join(earliest, ["phrase", "hash"]).where("doc_id > _first").groupBy(*key).agg(F.collect_list("start").alias("gone")))
    drop(earliest)
    cut = done.where("starts is not null").select(*key, "text").join(gone, key, "left").select("doc_id", "text", "gone")
    cut = cut.mapInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")
    return done.where("starts is null").select("doc_id", "n_words", "n_removed", "kept").unionByName(cut)
