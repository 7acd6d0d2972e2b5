"""License scan: exact set-similarity join of text blocks with license templates.

Words are what lies between ASCII characters other than letters and digits, with A-Z in lower
case. A block is any ``window`` consecutive words of the text, over line ends as well. Each
template is a set of words; a block holds it if at least ``threshold`` of the template's words occur in
the block. Reported are each line's own blocks (windows of a step of half their length), and of overlapping blocks over line ends
or between these steps the best, where it holds more than its lines' own: by the line of its first word. The join is exact: words are ordered by their frequency over all documents, rarest first;
a block can only reach the threshold if it holds a word of the template's prefix (prefix filter), has
enough template words at all (length filter) and has enough left after its first match (positional filter). Wordings that differ in a word have
words that a block must hold besides (:data:`REQUIRED`). A scan may verify the join's blocks by the order of their words, so that words which only share a window give no label (``ordered``). A label of wider terms gives way where its blocks overlap ones of narrower terms (:data:`NARROWER`).

Null and empty texts have no words and no labels. Repeated rows each get their own result; ties in
frequency go by the word. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import slices, texts

#: Phrases whose words must stand consecutively, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Templates of the set-similarity join: label and wording.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under creative commons attribution noncommercial 4 0"),
    ("cc-by-sa", "licensed under creative commons attribution sharealike 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright all rights reserved no part may be reproduced without written permission"),
    ("bsd", "released under the bsd license"),
    ("gpl", "released under the gpl license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("cc-by", "licensed under creative commons attribution 4 0"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
            "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
                 "express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
            "appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)

#: Short wordings and identifiers, which only make sense word by word: for a scan that verifies the order.
SHORT = (
    ("isc", "released under the isc license"), ("mit", "is mit licensed"), ("bsd", "is bsd licensed"), ("mit", "spdx license identifier mit"), ("isc", "spdx license identifier isc"), ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"), ("bsd", "spdx license identifier bsd 3 clause"), ("gpl-2", "spdx license identifier gpl 2 0"), ("gpl-3", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl 2 1"), ("mpl-2", "spdx license identifier mpl 2 0"), ("cc-by", "spdx license identifier cc by 4 0"), ("unlicense", "spdx license identifier unlicense"),
    ("gpl-2", "gnu general public license version 2"), ("gpl-3", "gnu general public license version 3"), ("lgpl", "gnu lesser general public license"),
)

#: Words that tell a wording from others that share most of its words: a block without all of them doesn't hold it. By label and the wording's first words.
REQUIRED = (
    ("mit", "released under", "mit"), ("bsd", "released under", "bsd"), ("gpl", "released under", "gpl"), ("apache-2", "licensed under", "apache 2"),
    ("gpl-3", "this work is", "gnu 3"), ("gpl-2", "this work is", "gnu 2"), ("cc-by-nc", "licensed under", "creative commons noncommercial"),
    ("cc-by-sa", "licensed under", "creative commons sharealike"), ("cc-by", "licensed under", "creative commons attribution"), ("gpl", "this program", "program gnu general"), ("lgpl", "this library", "lesser"),
    ("mpl-2", "subject to", "mozilla"), ("mpl-2", "this source", "mozilla"),
)

#: The same for the short wordings.
SHORT_REQUIRED = (
    ("isc", "released under", "isc"), ("mit", "is mit", "mit"), ("bsd", "is bsd", "bsd"), ("gpl-2", "gnu general", "2"), ("gpl-3", "gnu general", "3"), ("lgpl", "gnu lesser", "lesser"), ("mit", "spdx", "mit"), ("isc", "spdx", "isc"),
    ("apache-2", "spdx", "apache 2"), ("bsd", "spdx", "bsd clause"), ("gpl-2", "spdx", "gpl 2"), ("gpl-3", "spdx", "gpl 3"), ("lgpl", "spdx", "lgpl"), ("mpl-2", "spdx", "mpl 2"), ("cc-by", "spdx", "cc by"), ("unlicense", "spdx", "unlicense"),
)

#: Labels that stand for a part of others' terms: one isn't reported where all its blocks overlap blocks of these.
NARROWER = {"cc-by": ("cc-by-nc", "cc-by-sa")}

#: Words of a template up to which a verified block holds all of it.
WHOLE = 8

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KEEP_LINES = _KEEP[:10] + b"\n" + _KEEP[11:]

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, blocks array<struct<label:string,line:int,word:int,containment:double>>")


def _count(vocabulary: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in texts(batch, "text"):
                if t:
                    found.update(vocabulary.intersection(t.translate(_KEEP).split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()),
                                          pa.array(list(found.values()), pa.int64())], ["word", "n"])
    return run


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Of each template word, the number of all documents that hold it. Bounded by the templates' words."""
    vocabulary = frozenset(w for _, t in templates for w in t.encode().split())
    counts = docs.select("text").mapInArrow(_count(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"].encode(): r["n"] for r in counts.collect()}
    return {w: got.get(w, 0) for w in vocabulary}


class Index:
    """Templates as word ranks in the global order, and an inverted list over their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float, required=()):
        self.rank = {w: i for i, (_, w) in enumerate(sorted((n, w) for w, n in frequency.items()))}
        self.labels = [label for label, _ in templates]
        self.tokens = [t.encode().split() for _, t in templates]
        self.sets = [sorted({self.rank[w] for w in t.encode().split()}) for _, t in templates]
        self.must = [frozenset(self.rank[w] for l, begin, words in required if l == label and t.startswith(begin) for w in words.encode().split()) for label, t in templates]
        # A required word counts where it stands beside a word that is its neighbour in the wording.
        self.beside = [{w: {(a, b) for a, b in zip(own, own[1:]) if w in (a, b)} for w in own if self.rank[w] in must} for own, must in zip(self.tokens, self.must)]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for k, (s, need) in enumerate(zip(self.sets, self.need)):
            for i in range(len(s) - need + 1):
                self.lists.setdefault(s[i], []).append((k, i))
        self.prefix = frozenset(w for w, r in self.rank.items() if r in self.lists)

    def block(self, words: list[bytes]) -> dict[int, float]:
        """Containment of each template that the block holds."""
        held = sorted({self.rank[w] for w in words if w in self.rank})
        seen: set[int] = set()
        out = {}
        for j, r in enumerate(held):
            for k, i in self.lists.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                s, need = self.sets[k], self.need[k]
                if len(held) < need or min(len(s) - i, len(held) - j) < need:
                    continue  # length and positional filters: the first match is the rarest shared word
                both = len(set(s).intersection(held))
                if both >= need and self.must[k].issubset(held):
                    out[k] = both / len(s)
        return out


    def runs(self, words: list[bytes], window: int) -> Iterator[tuple[int, float, int, int]]:
        """Of each template, the groups of overlapping blocks that hold it: template, largest containment, first word of its block, last word of the group."""
        at = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]
        held = {r for _, r in at}
        for k in sorted({k for r in held for k, _ in self.lists.get(r, ())}):
            s, need = set(self.sets[k]), self.need[k]
            if len(s & held) < need:
                continue
            own = [(i, r) for i, r in at if r in s]
            n: Counter = Counter()
            left, run = 0, None
            for i, r in own:
                n[r] += 1
                # A repeated word at the left adds nothing, so blocks begin at their first needed word.
                while own[left][0] <= i - window or n[own[left][1]] > 1:
                    gone = own[left][1]
                    n[gone] -= 1
                    if not n[gone]:
                        del n[gone]
                    left += 1
                if len(n) < need or not all(w in n for w in self.must[k]):
                    continue
                share, start = len(n) / len(s), own[left][0]
                if run is not None and start > run[3]:
                    yield run
                    run = None
                run = (k, share, start, i) if run is None or share > run[1] else (*run[:3], i)
            if run is not None:
                yield run


    def ordered(self, k: int, words: list[bytes], start: int, last: int, share: float) -> Iterator[tuple[int, int, float]]:
        """Where template k stands in order between two words: first and last word of a window and the part of the template in it.

        A window is an eighth longer than the template (two words at least) and holds a common subsequence of ``share`` of it; all of it for up to ``WHOLE`` words. Required words stand beside a
        neighbour of theirs. The subsequence's length is counted by bits, a word of the text at a time.
        """
        own = self.tokens[k]
        m = len(own)
        need = m if m <= WHOLE else math.ceil(share * m - 1e-9)
        length = m + max(2, m // 8)
        begins = frozenset(own[:m - need + 1])
        bits: dict[bytes, int] = {}
        for j, w in enumerate(own):
            bits[w] = bits.get(w, 0) | 1 << j
        every = (1 << m) - 1
        i = start
        while i <= last:
            if words[i] in begins:
                v, best, end = every, 0, i
                for j in range(i, min(i + length, len(words))):
                    u = v & bits.get(words[j], 0)
                    if u:
                        v = (v + u | v - u) & every
                        if (n := m - v.bit_count()) > best:
                            best, end = n, j
                pairs = set(zip(words[i:end], words[i + 1:end + 1]))
                if best >= need and all(pairs & near for near in self.beside[k].values()):
                    yield i, end, best / m
                    i = end
            i += 1


def _places(joined: bytes, phrases) -> dict[str, list[int]]:
    """Word numbers at which phrases start; ``joined``: words with one space before and after each."""
    out: dict[str, list[int]] = {}
    for phrase, label in phrases:
        needle = b" " + phrase + b" "
        at = joined.find(needle)
        while at >= 0:
            out.setdefault(label, []).append(joined.count(b" ", 0, at))
            at = joined.find(needle, at + 1)
    return out


def _scan(index: Index, phrases, window: int, share: float | None):
    phrases = [(p.encode(), label) for p, label in phrases]
    step = window // 2
    wider = {label for label in index.labels if label in NARROWER}

    def one(t: bytes | None):
        words = t.translate(_KEEP).split() if t else []
        places = _places(b" " + b" ".join(words) + b" ", phrases) if words else {}
        starts = [x for v in places.values() for x in v]
        best: dict[tuple[int, int], tuple] = {}
        reach: list[tuple[int, int, int]] = []
        if words and not index.prefix.isdisjoint(words):
            lines = [line.split() for line in t.translate(_KEEP_LINES).split(b"\n")]
            for no, own in enumerate(lines if share is None else ()):
                if index.prefix.isdisjoint(own):
                    continue
                for at in range(0, max(1, len(own) - step), step):
                    for k, part in index.block(own[at:at + window]).items():
                        key = (k, no)
                        if key not in best or part > best[key][3]:
                            best[key] = (index.labels[k], no, at, part)
            ends = None
            found = index.runs(words, window)
            if share is not None:
                found = ((k, part, a, b) for k, _, start, last in found for a, b, part in index.ordered(k, words, start, last, share))
            for k, part, start, last in found:
                ends = ends or list(accumulate(map(len, lines)))
                no = bisect_right(ends, start)
                if all((k, x) not in best or best[k, x][3] < part for x in range(no, bisect_right(ends, last) + 1)):
                    best[k, no] = (index.labels[k], no, start - ends[no] + len(lines[no]), part)
                reach.append((k, start, last))
        for k in {k for k, _ in best if index.labels[k] in wider}:
            narrow = [(a, b) for x, a, b in reach if index.labels[x] in NARROWER[index.labels[k]]]
            if all(any(a <= last and b >= start for a, b in narrow) for x, start, last in reach if x == k):
                best = {key: v for key, v in best.items() if key[0] != k}
        blocks = [best[k] for k in sorted(best)]
        labels = sorted({*places, *(b[0] for b in blocks)})
        score = max([1.0 if starts else 0.0, *(b[3] for b in blocks)])
        return (len(words), len(starts), min(starts) if starts else None, max(starts) if starts else None,
                ",".join(sorted(places)), ",".join(labels), score,
                [dict(zip(("label", "line", "word", "containment"), b)) for b in blocks])

    block = pa.struct([("label", pa.string()), ("line", pa.int32()), ("word", pa.int32()), ("containment", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [one(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)
    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8, window: int = 64, required=REQUIRED, ordered: float | None = None) -> DataFrame:
    """Licenses in each document: ``blocks`` has the matching templates with their lines and containments.

    One result row for each row of ``docs`` (``doc_id``, ``text``). ``window`` must be at least as long as the longest template (an error if not).
    ``ordered``: of the join's blocks, only what holds this part of the template's words in their order in a window hardly longer than the template (see :meth:`Index.ordered`)
    is reported, with that part as its containment. Without it, words of a block count in any order. ``score``: the largest containment found, 1 where a phrase stands literally, else 0.
    """
    longest = max((len(t.split()) for _, t in templates), default=0)
    if longest > window:
        raise ValueError(f"a window of {window} words can't hold a template of {longest}")
    index = Index(templates, word_frequencies(docs, templates), threshold, required)
    return docs.select("doc_id", "text").mapInArrow(_scan(index, phrases, window, ordered), RESULT)
