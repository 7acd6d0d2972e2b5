"""Sampled segmentations over a SentencePiece vocabulary: Gumbel top-k without replacement on the lattice, and decoding.

Every space starts a unit (the space, written as U+2581, and what follows up to the next one; the model's dummy prefix starts the first). No piece
runs over a unit's start, so a text's lattice is the chain of its units' lattices. An edge is a piece of the vocabulary; a
character without a piece is an edge of its UTF-8 bytes' pieces. The model file gives ranks and no probabilities; with Zipf's law a piece of rank r weighs
``-alpha log(r + 1)``, and a byte as much as the last piece, which makes a distribution over all segmentations of a text. ``alpha`` below 1 flattens it.

Sampling is an A-star search from the top of the tree of segmentations. Its nodes are "all segmentations that agree up to here and not with those taken",
and a node's bound is the largest Gumbel-perturbed log-probability below it. The first sample walks down from the root; on its way, each unit leaves a node with the
other choices, whose bound is a Gumbel of their mass, truncated at the parent's. The best node in the queue gives the next sample, until ``k`` are out; the best
bound left then is the threshold of the inclusion probability ``1 - exp(-exp(log p - threshold))``. Samples come out distinct, largest perturbed value first.

The random numbers are hashes of the row's key, the text and the place, so that the result doesn't depend on partitions or batches.
A null text counts as empty; an empty text has one segmentation, of no pieces, as in the model. Texts with fewer than ``k`` segmentations give all of them, with
inclusion 1. Rows of equal key and text get equal samples. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdata.llm.hashing import mix
from verdata.llm.text import slices

_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BITS = 18
_WORD = (1 << 64) - 1


class Vocabulary:
    """Pieces by hash of their characters, their weights, and what they spell."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.spelled: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        words: list[tuple[str, int]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.spelled.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.spelled.append(b"")
            else:
                self.spelled.append(p.replace(_MARK, " ").encode())
                if _MARK not in p[1:]:
                    words.append((p, i))
        self.buffer = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.length = np.array([len(x) for x in self.spelled], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        words.sort(key=lambda w: w[1])
        self.longest = max(len(p) for p, _ in words)
        self.weight = np.zeros(n)
        for rank, (_, i) in enumerate(words):
            self.weight[i] = -alpha * np.log(rank + 1.0)
        self.of_byte = -alpha * np.log(len(words) + 1.0)
        # Open addressing; a key is the hash of the beginning of a piece, with the piece's id if it is a whole one (-1 if not, -2 for an empty slot).
        with np.errstate(over="ignore"):
            letters = {c: mix(np.array([ord(c) + 1], np.uint64))[0] for p, _ in words for c in p}
            begun: dict[int, int] = {}
            for p, i in words:
                h = np.uint64(0)
                for n, c in enumerate(p, 1):
                    h = h * _BASE + letters[c]
                    key = int(h)
                    begun[key] = i if n == len(p) else begun.get(key, -1)
        raw = np.array(list(begun), np.uint64)
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.ids = np.full(1 << _BITS, -2, np.int32)
        self.probes = 1
        for key, i in zip(mix(raw), begun.values()):
            at, tries = int(key >> np.uint64(64 - _BITS)), 1
            while self.ids[at] > -2:
                at, tries = (at + 1) & ((1 << _BITS) - 1), tries + 1
            self.keys[at], self.ids[at] = key, i
            self.probes = max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of mixed hashes: the piece's id, -1 if only longer pieces begin so, -2 if none does."""
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        ids = self.ids[at]
        out = np.where(self.keys[at] == h, ids, -2)
        open_ = np.flatnonzero((ids > -2) & (out == -2))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << _BITS) - 1)
            ids = self.ids[at[open_]]
            hit = (ids > -2) & (self.keys[at[open_]] == h[open_])
            out[open_[hit]] = ids[hit]
            open_ = open_[(ids > -2) & ~hit]
        return out


@lru_cache(2)
def vocabulary(path: str, alpha: float = 0.25) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of distinct units side by side, as edges: those of a position stand together, the longest first.

    Positions are ordered by their distance from the unit's end, so that edges of equal distance form one stretch; :attr:`first` and :attr:`last`
    are a position's edges, and :attr:`cum` the running share of the position's segmentations that go through them.
    """

    def __init__(self, v: Vocabulary, units: list[str]):
        self.v = v
        n = np.array([len(u) for u in units], np.int64)
        self.start = np.zeros(len(units) + 1, np.int64)
        np.cumsum(n, out=self.start[1:])
        total = int(self.start[-1])
        self.code = code = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        end = np.repeat(self.start[1:], n)
        letter = mix(code.astype(np.uint64) + np.uint64(1))
        # Hashes of runs grow by one character at a time, where the unit goes on and some piece begins like this.
        at, h, found = np.arange(total), np.zeros(total, np.uint64), []
        while len(at) and len(found) < v.longest:
            l = len(found)
            h = h * _BASE + letter[at + l]
            ids = v.find(mix(h))
            whole = ids >= 0
            found.append((at[whole], ids[whole]))
            on = (ids > -2) & (at + l + 1 < end[at])
            at, h = at[on], h[on]
        while len(found) > 1 and not len(found[-1][0]):
            found.pop()
        width = max(1, len(found))
        left = end - np.arange(total)
        order = np.argsort(left, kind="stable")
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total)
        ids = np.full((total, width), -2, np.int32)
        ids[:, width - 1] = -1  # a lone character, unless it is a piece
        for l, (where, own) in enumerate(found):
            ids[rank[where], width - 1 - l] = own
        edge = np.flatnonzero(ids.ravel() > -2)
        row, column = np.divmod(edge, width)
        self.id = ids.ravel()[edge]
        self.source = order[row]
        self.dest = self.source + (width - column)
        count = np.bincount(row, minlength=total)
        upto = np.cumsum(count)
        self.first, self.last = np.empty(total, np.int64), np.empty(total, np.int64)
        self.first[order], self.last[order] = upto - count, upto
        weight = v.weight[self.id]
        lone = np.flatnonzero(self.id < 0)
        letters = code[self.source[lone]]
        weight[lone] = v.of_byte * (1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000))
        # Log-sums over all ways to the unit's end, last positions first. A unit's end is where the next unit starts, whose own sum doesn't count.
        beta = np.zeros(total + 1)
        self.cum = np.empty(len(edge))
        inside = self.dest < end[self.source]
        bounds = np.searchsorted(left[order], np.arange(1, int(n.max(initial=0)) + 2))
        starts = upto - count
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            a, b = int(starts[lo]), int(upto[hi - 1])
            c, s0 = count[lo:hi], starts[lo:hi] - a
            x = weight[a:b] + np.where(inside[a:b], beta[self.dest[a:b]], 0.0)
            top = np.maximum.reduceat(x, s0)
            share = np.exp(x - np.repeat(top, c))
            whole = np.add.reduceat(share, s0)
            beta[order[lo:hi]] = top + np.log(whole)
            run = np.cumsum(share)
            before = run[s0] - share[s0]
            cum = (run - np.repeat(before, c)) / np.repeat(whole, c)
            # Nothing may be drawn beyond the last edge, whatever rounding makes of the sum.
            cum[upto[lo:hi] - a - 1] = 1.0
            self.cum[a:b] = cum
        self.weight, self.beta, self.end = weight, beta, self.start[1:]
        self._lone: dict[int, bool] = {}

    def lone(self, unit: int) -> bool:
        """Whether a unit has one segmentation only."""
        if unit not in self._lone:
            at, stop, alone = int(self.start[unit]), int(self.end[unit]), True
            while alone and at < stop:
                e = int(self.first[at])
                alone, at = self.last[at] - e == 1, int(self.dest[e])
            self._lone[unit] = bool(alone)
        return self._lone[unit]

    def draw(self, at: np.ndarray, r: np.ndarray) -> np.ndarray:
        """An edge of each position, by its share, for uniform numbers."""
        e = self.first[at]
        open_ = np.flatnonzero(self.cum[e] <= r)
        while len(open_):
            e[open_] += 1
            open_ = open_[self.cum[e[open_]] <= r[open_]]
        return e

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each occurrence of a unit: log-probability, and its edges, flat, with their numbers.

        ``key`` seeds each occurrence's random numbers.
        """
        cur, stop = self.start[unit], self.end[unit]
        live = np.flatnonzero(cur < stop)
        logp = np.zeros(len(unit))
        logp[live] = -self.beta[cur[live]]
        counts = np.zeros(len(unit), np.int64)
        steps = []
        while len(live):
            r = (mix(key[live] + np.uint64(len(steps))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            e = self.draw(cur[live], r)
            logp[live] += self.weight[e]
            counts[live] += 1
            steps.append((live, e))
            cur[live] = self.dest[e]
            live = live[cur[live] < stop[live]]
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            flat[first[who] + k] = edge
        return logp, flat, counts

    def pieces(self, flat: np.ndarray) -> np.ndarray:
        """Ids of edges; a character without a piece becomes its bytes."""
        ids = self.id[flat].astype(np.int64)
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids
        codes = self.code[self.source[flat[lone]]]
        if codes.max() < 128:
            ids[lone] = self.v.byte[codes]
            return ids
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(s) for s in spelled]
        out = np.repeat(ids, times)
        at = np.cumsum(times) - times
        for i, s in zip(at[lone], spelled):
            out[i:i + len(s)] = self.v.byte[list(s)]
        return out


def _key(seed: int, text: str, doc: int | None) -> np.uint64:
    return mix(np.array([(zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32) ^ (seed & 0xFFFFFFFF)], np.uint64) ^ mix(np.array([(doc or 0) & (2 ** 64 - 1)], np.uint64)))[0]


def _uniform(key: np.uint64, place: np.ndarray) -> np.ndarray:
    x = mix(np.asarray(key, np.uint64) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class _Rest:
    """What is left of a unit's segmentations when some are taken: a tree of the taken ones, and the branches that leave it.

    Masses of branches are sums of positive numbers, so that they keep their precision however little is left.
    """

    def __init__(self, lattice: Lattice, unit: int):
        self.lattice, self.start, self.stop = lattice, int(lattice.start[unit]), int(lattice.end[unit])
        self.branches: dict[tuple, float] = {}
        self._grow((), self.start, -float(lattice.beta[self.start]))

    def _grow(self, path: tuple, at: int, logp: float) -> None:
        """Branches from a position that the taken segmentations have reached."""
        x = self.lattice
        for e in range(int(x.first[at]), int(x.last[at])):
            end = int(x.dest[e])
            self.branches[path + (e,)] = logp + float(x.weight[e]) + (float(x.beta[end]) if end < self.stop else 0.0)

    def take(self, edges: np.ndarray) -> None:
        x = self.lattice
        path, logp = (), -float(x.beta[self.start])
        for e in edges.tolist():
            path += (e,)
            logp += float(x.weight[e])
            end = int(x.dest[e])
            if self.branches.pop(path, None) is not None and end < self.stop:
                self._grow(path, end, logp)

    def log_mass(self) -> float:
        return float(np.logaddexp.reduce(list(self.branches.values()))) if self.branches else -np.inf

    def draw(self, r: np.ndarray) -> tuple[float, np.ndarray]:
        """A segmentation that isn't taken: a branch by its mass, and on from there as the lattice goes. ``r``: uniform numbers."""
        mass = np.array(list(self.branches.values()))
        share = np.cumsum(np.exp(mass - mass.max()))
        path = list(self.branches)[int(np.searchsorted(share, r[0] * share[-1], "right").clip(max=len(mass) - 1))]
        x, out, k = self.lattice, list(path), 1
        at = int(x.dest[out[-1]])
        while at < self.stop:
            out.append(int(x.draw(np.array([at]), r[k:k + 1])[0]))
            at, k = int(x.dest[out[-1]]), k + 1
        edges = np.array(out, np.int64)
        return float(x.weight[edges].sum() - x.beta[self.start]), edges


class _Path:
    """A sample: its choices by unit, and the queue's nodes that it leaves, from unit ``first`` on."""

    __slots__ = ("value", "logp", "edges", "first", "bound", "upto", "taken")

    def __init__(self, value, logp, edges, first, upto, bound):
        self.value, self.logp, self.edges, self.first, self.upto, self.bound = value, logp, edges, first, upto, bound
        self.taken: dict[int, list] = {}

    def own(self, t: int) -> np.ndarray:
        """Edges of unit ``t``."""
        at = int(self.edges[1][:t].sum())
        return self.edges[0][at:at + self.edges[1][t]]

    def left(self, lattice, unit: int, t: int) -> list:
        """What is left at unit ``t``, and the log-probabilities of what was taken there."""
        if t not in self.taken:
            rest = _Rest(lattice, int(unit))
            rest.take(self.own(t))
            self.taken[t] = [rest, [float(self.logp[t])]]
        return self.taken[t]


def _paths(made: list, keys: list, place: int, lattice: Lattice, units: list) -> list[_Path]:
    """Samples from (value, log-probabilities and edges by unit, first free unit), with the bounds of the nodes that they leave, all at once."""
    sizes = np.array([len(lp) - first for _, lp, _, first in made])
    uptos = [np.concatenate([[0.0], np.cumsum(lp)]) for _, lp, _, _ in made]
    own = np.concatenate([lp[first:] for _, lp, _, first in made])
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(own, 0.0)))
    inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    g = np.concatenate([u[first:-1] for u, (_, _, _, first) in zip(uptos, made)]) + rest - np.log(-np.log(_uniform(np.repeat(np.array(keys, np.uint64), sizes), inner + place)))
    bound = _truncated(g, np.repeat(np.array([value for value, *_ in made]), sizes))
    ends = np.cumsum(sizes)
    out = [_Path(value, lp, edges, first, u, x) for (value, lp, edges, first), u, x in zip(made, uptos, np.split(bound, ends[:-1]))]
    # Where next to nothing is left, or nothing, rounding can't tell; what is left is summed up instead.
    for i in np.flatnonzero(own > -1e-6):
        d, t = int(np.searchsorted(ends, i, "right")), int(inner[i])
        p, unit = out[d], int(units[d][t])
        left = -np.inf if lattice.lone(unit) else p.left(lattice, unit, p.first + t)[0].log_mass()
        p.bound[t] = _truncated(p.upto[p.first + t] + left + g[i] - p.upto[p.first + t] - rest[i], p.value) if left > -np.inf else -np.inf
    return out


def _truncated(g, at):
    """A Gumbel value, given that the largest of all is ``at``."""
    return -np.logaddexp(-at, -g)


def sample_texts(v: Vocabulary, keys: list[int | None], texts: list[str], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct samples: ids, log-probability, perturbed value and inclusion probability."""
    units = [t.split(" ") if t else [] for t in texts]
    distinct: defaultdict = defaultdict(count().__next__)
    number = np.fromiter(map(distinct.__getitem__, chain.from_iterable(units)), np.int64)
    if not distinct:
        return [[(np.empty(0, np.int64), 0.0, 0.0, 1.0)] for _ in texts]
    lattice = Lattice(v, [_MARK + u for u in distinct])
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(u) for u in units], out=ends[1:])
    key = [_key(seed, t, d) for t, d in zip(texts, keys)]

    def walk(todo: list[tuple[int, int, int]]):
        """Fresh choices for units first.. of documents; ``todo``: (document, first, sample number)."""
        sizes = [int(ends[d + 1] - ends[d]) - first for d, first, _ in todo]
        occurrence = np.concatenate([number[ends[d] + first:ends[d + 1]] for d, first, _ in todo])
        seeds = np.concatenate([mix(key[d] + (np.arange(first, first + n).astype(np.uint64) * np.uint64(2654435761) + np.uint64(j << 48))) for (d, first, j), n in zip(todo, sizes)])
        logp, flat, counts = lattice.sample(occurrence, seeds)
        cut = np.cumsum(sizes)[:-1]
        before = np.concatenate([[0], np.cumsum(counts)])
        return np.split(logp, cut), np.split(flat, before[cut]), np.split(counts, cut)

    docs = [d for d in range(len(texts)) if units[d]]
    state: dict[int, list[_Path]] = {}
    values = -np.log(-np.log(_uniform(np.array([key[d] for d in docs], np.uint64), np.full(len(docs), 1 << 40))))
    made = [(value, lp, (flat, counts), 0) for value, lp, flat, counts in zip(values.tolist(), *walk([(d, 0, 0) for d in docs]))]
    for d, p in zip(docs, _paths(made, [key[d] for d in docs], 1 << 41, lattice, [number[ends[d]:ends[d + 1]] for d in docs])):
        state[d] = [p]
    # The search's queue of each text: its paths by the best node that they leave.
    top = lambda p: -float(p.bound.max(initial=-np.inf))
    queues = {d: [(top(paths[0]), 0)] for d, paths in state.items()}
    for j in range(1, k):
        chosen = {}
        for d in docs:
            best, i = queues[d][0]
            if best < np.inf:
                p = state[d][i]
                chosen[d] = [p, p.first + int(p.bound.argmax()), -best, None]
        # Another choice for the node's unit. A few draws at once find one for most first nodes; where all of them are taken, one is drawn from what is left.
        fresh = [d for d, (p, t, _, _) in chosen.items() if t not in p.taken]
        if fresh:
            n = 8
            unit = np.repeat(np.array([number[ends[d] + chosen[d][1]] for d in fresh]), n)
            base = np.array([int(key[d]) + (j << 32) + (chosen[d][1] << 36) & _WORD for d in fresh], np.uint64)
            lp, flat, c = lattice.sample(unit, mix(np.repeat(base, n) + np.tile(np.arange(n), len(fresh)).astype(np.uint64)))
            high = np.cumsum(c)
            for i, d in enumerate(fresh):
                seen = chosen[d][0].own(chosen[d][1]).tobytes()
                for m in range(i * n, (i + 1) * n):
                    edge = flat[high[m] - c[m]:high[m]]
                    if edge.tobytes() != seen:
                        chosen[d][3] = (float(lp[m]), edge)
                        break
        todo = []
        for d, one in chosen.items():
            p, t, value, drawn = one
            unit = int(number[ends[d] + t])
            if drawn is None:
                rest = p.left(lattice, unit, t)[0]
                one[3] = drawn = rest.draw(_uniform(key[d], (np.arange(1 + rest.stop - rest.start) << 20) + np.int64((j << 44) + t + (1 << 60))))
            last = j == k - 1
            if last and t not in p.taken and (gone := np.exp(p.logp[t]) + np.exp(drawn[0])) < 1 - 1e-6:
                log_rest = float(np.log1p(-gone))  # nothing more is drawn here: the mass alone is needed
            else:
                rest, _ = p.left(lattice, unit, t)
                rest.take(drawn[1])
                log_rest = rest.log_mass()
            todo.append((d, t + 1, j))
            g = p.upto[t] + log_rest - np.log(-np.log(_uniform(key[d], np.array([(j << 42) + t]))[0])) if log_rest > -np.inf else -np.inf
            p.bound[t - p.first] = _truncated(g, value)
            heapq.heapreplace(queues[d], (top(p), queues[d][0][1]))
        if not todo:
            break
        made = []
        for (d, first, _), (p, t, value, (lp, edge)), tail_lp, tail, tail_counts in zip(todo, chosen.values(), *walk(todo)):
            at = int(p.edges[1][:t].sum())
            logp = np.concatenate([p.logp[:t], [lp], tail_lp])
            flat = np.concatenate([p.edges[0][:at], edge, tail])
            made.append((value, logp, (flat, np.concatenate([p.edges[1][:t], [len(edge)], tail_counts])), first))
        for (d, _, _), p in zip(todo, _paths(made, [key[d] for d, _, _ in todo], (1 << 41) + (j << 44), lattice, [number[ends[d] + first:ends[d + 1]] for d, first, _ in todo])):
            heapq.heappush(queues[d], (top(p), len(state[d])))
            state[d].append(p)
    out = []
    for d in range(len(texts)):
        if d not in state:
            out.append([(np.empty(0, np.int64), 0.0, 0.0, 1.0)])
            continue
        threshold = max(float(p.bound.max(initial=-np.inf)) for p in state[d])
        own = []
        for p in state[d]:
            lp = float(p.upto[-1])
            inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, lp - threshold))))
            own.append((lattice.pieces(p.edges[0]), lp, p.value, inclusion))
        out.append(own)
    return out


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids; the dummy prefix's space goes."""
    raw = b"".join(map(v.spelled.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def _spelled(v: Vocabulary, samples: list[np.ndarray]) -> list[bytes]:
    """What each of many samples spells, without the dummy prefix's space."""
    ids = np.concatenate(samples) if samples else np.empty(0, np.int64)
    n = v.length[ids]
    upto = np.cumsum(n)
    raw = v.buffer[np.repeat(v.offset[ids] - (upto - n), n) + np.arange(int(n.sum()))].tobytes()
    ends = np.concatenate([[0], upto])[np.cumsum([0] + [len(s) for s in samples])].tolist()
    return [raw[a + (raw[a:a + 1] == b" " and b > a):b] for a, b in zip(ends[:-1], ends[1:])]


def _sampler(path: str, k: int, seed: int, alpha: float, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for batch in slices(batches, "text", 1 << 21):
            docs, raw = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            cols: list[list] = [[] for _ in range(8)]
            found = sample_texts(v, docs, raw, k, seed)
            spelled = iter(_spelled(v, [ids for own in found for ids, *_ in own]))
            for d, t, own in zip(docs, raw, found):
                t = t.encode("utf-8", "surrogatepass")
                for rank, (ids, lp, value, inclusion) in enumerate(own, 1):
                    row = (d, rank, len(ids), lp, value, inclusion, next(spelled) == t,
                           zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
                    for c, x in zip(cols, row):
                        c.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64() if digest else pa.list_(pa.int32())]
            names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids_crc32" if digest else "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
    return run


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 0, alpha: float = 0.25, digest: bool = False) -> DataFrame:
    """``doc_id, sample`` (from 1), ``n_pieces, log_prob, perturbed, inclusion, round_trip`` and ``ids`` (``digest``: their ``ids_crc32``)."""
    last = "ids_crc32 long" if digest else "ids array<int>"
    schema = f"doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, {last}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sampler(model, k, seed, alpha, digest), schema)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            own = [decode_ids(v, np.array(i)) if i is not None else None for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(own, pa.string())], ["doc_id", "sample", "text"])
    return run


def decode(samples: DataFrame, model: str) -> DataFrame:
    """``doc_id, sample, text`` of :func:`sample_segmentations`' ids (null ids: null text)."""
    return samples.select("doc_id", "sample", "ids").mapInArrow(_decoder(model), "doc_id long, sample int, text string")
