"""Plain single-process versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def repeats(rows, window=50):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256)"""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shingles(t):
    w = words(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return set() if not w else {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    common = {}
    for i, (_, s) in enumerate(sets):
        seen = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def licenses(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {}
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        if at:
            places[label] = at
    flat = [x for v in places.values() for x in v]
    return (len(w), len(flat), min(flat, default=None), max(flat, default=None), ",".join(sorted(places)))


def quality(t):
    w = words(t)
    n = len(w)
    tri = {}
    for i in range(n - 2):
        tri.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = {j for v in tri.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def private(t):
    t = t or ""
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    ip = [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    card = [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    phone = [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans + ip + card + phone)
    return (len(spans), len(ip), len(card), len(phone), hashlib.sha256(text.encode()).hexdigest())


def crc(t):
    return zlib.crc32((t or "").encode())
