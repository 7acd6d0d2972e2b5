"""Conversation repair against a parse from the left, on hard conversations and through both ways (arrays and rows)."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from verdata.llm import repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 5, "user", "no end"), (2, None, "user", "first."), (2, 3, None, "x."),
    (2, 4, "assistant", None), (2, 4, "assistant", " \t\n"), (3, 0, "assistant", ""), (4, 7, "user", "a" * 5000 + "."), (4, 8, "assistant", "fine! \n"), (None, 1, "user", "who."), (None, None, "", "?"),
    (5, 0, "tool", "out."), (5, 1, "sys", "odd."), (5, 2, "ua", "a.\x0b"), (5, 3, "user", " "), (6, None, "user", "q."), (6, None, "assistant", "r."), (7, 1, "user", "no. end"), (7, 2, "user", "no. end"),
    *[(8, t, "user" if t % 2 == 0 else "assistant", f"t{t % 23}.") for t in range(70)],
]


def cheapest(rows):
    best = {0: (0, "")}

    def insert():
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                for r in "ua":
                    if (s, r) in STEP:
                        best[STEP[s, r]] = min(best.get(STEP[s, r], (10 ** 9, "")), (c + 2, a + "I"))
    insert()
    for initial, fault in rows:
        old, best = best, {}
        for s, (c, a) in old.items():
            options = [(s, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                options += [(STEP.get((s, initial)), c + more, "K"), *[(STEP.get((s, r)), c + 2 + more, "R") for r in "ua"]]
            for t, d, e in options:
                if t is not None:
                    best[t] = min(best.get(t, (10 ** 9, "")), (d, a + e))
        insert()
    return min(best[s] for s in (0, 3) if s in best)


def plain(raw, hurt):
    by = {}
    for conv, turn, role, text in raw:
        own = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        if hit:
            own += [(turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] * (2 if hit == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(own, faults)])
        size, lines, rest = len(audit) - audit.count("D"), [], iter(own)
        for e in audit:
            role, text = next(rest)[1:] if e != "I" else ("", "")
            if e != "D":
                lines.append((role if e == "K" else ("user", "assistant")[(len(lines) - size % 2) % 2]) + ":" + text)
        out.append((conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hurt", [False, True])
@pytest.mark.parametrize("limit", [256, 4])
def test_repair(spark, hurt, limit):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("pos"), F.lit("x").alias("lost"), F.lit("y").alias("a.b")).repartition(3)
    rows = repair.damage(df) if hurt else df
    lost = "lost" if hurt else None
    got = repair.repair_conversations(rows, lost, limit=limit)
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == plain(ROWS, hurt)
    lines = {}
    for r in sorted(repair.repaired_turns(rows, lost, limit=limit).collect(), key=lambda r: r["at"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in got.collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(repair.damage(df), "lost").count() == 0 and repair.repaired_turns(df).count() == 0


def test_long_texts_are_rows(spark):
    """The bound of bytes sends a conversation of few rows the other way."""
    df = spark.createDataFrame([(1, 0, "user", "x" * 3000), (1, 1, "assistant", "y."), (2, 0, "user", "z.")], "conv_id long, turn long, role string, text string")
    short, long_ = repair._split(repair._plain(df, None), 256, 1000)
    assert {r["conv_id"] for r in short.collect()} == {2} and {r["conv_id"] for r in long_.collect()} == {1}
    assert sorted(map(str, repair.repair_conversations(df, most=1000).collect())) == sorted(map(str, repair.repair_conversations(df).collect()))


def test_cells():
    """Spans combined from halves, in blocks or whole, cost what a parse from the left finds; ties go to the least audit."""
    rng = random.Random(3)
    fault = lambda s: "blank" if s.isdigit() else "truncated" if s.isupper() else ""
    for n in [*range(12)] * 12 + [17, 40, 100]:
        s = "".join(rng.choice("suaoSUAO0123") for _ in range(n))
        assert repair.cheapest(repair.parse(s)) == cheapest([(x.lower(), fault(x)) for x in s]), s
    assert repair.cheapest(repair.parse("u")) == (2, "KI") and repair.cheapest(repair.parse("1")) == (3, "D")
