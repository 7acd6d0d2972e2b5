"""The operators against plain versions: on the smallest tables, on hard cases, and on an empty table."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute as B
from verdata.llm import licenses, lines, nearduplicates, neighbours, packing, private, quality, queries, repeats, segment, sharding

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
CASES = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, LONG), (5, LONG), (5, LONG), (6, PASSAGE), (7, "before " + PASSAGE + " after"), (8, PASSAGE.replace("p55", "x")),
    (9, "mail a.b@c.d_e@f.gh and x@y.z.w. ip 1.2.3.4 1.2.3.400 card 4111 1111 1111 1111 tel +1 (262) 555-3752"), (10, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. CC BY-NC"),
    (11, "a b c d e f"), (12, "A B c d E f"), (13, "é ü 你好 a b c " * 30), (14, "x y z\n" * 40), (None, PASSAGE), (None, None), (15, "4" * 5000), (16, "dup line\ndup line\n\n\nother"),
    (17, PASSAGE + " " + PASSAGE), (18, " ".join(f"q{i}" for i in range(49))), (19, " ".join(f"q{i}" for i in range(50))), (20, "\x0b".join(f"q{i}" for i in range(50))), (21, "@" * 300 + "1.1.1.1.1.1.1.1.1"),
]


@pytest.fixture(scope="module")
def cases(spark):
    """Hard cases with extra columns of names that the operators use themselves."""
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    return df.select("*", F.lit(1).alias("row"), F.lit("x").alias("kept"), F.lit(2).alias("shard"), F.lit(3).alias("n_words"), F.lit("y").alias("cls"))


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def both(spark, cases, small):
    return [(cases, CASES), small]


def test_repeats(spark, cases, small):
    for df, raw in both(spark, cases, small):
        assert rows(repeats.remove_repeats(df, digest=True), "doc_id", "n_words", "n_removed", "kept") == B.repeats(raw)
    assert repeats.remove_repeats(cases.limit(0)).count() == 0
    text = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(cases).collect()}
    assert text[7] == "before after" and text[6] == PASSAGE


def test_repeats_come_from_the_automata(spark, monkeypatch):
    """Small shards find the same; positions come from the automata alone, so without their hits nothing is removed from texts that differ."""
    raw = [(i, f"a{i} b{i} " + PASSAGE + " " + " ".join(f"z{i}x{j}" for j in range(30)) + (" " + PASSAGE if i == 2 else "")) for i in range(4)]
    df = spark.createDataFrame(raw, "doc_id long, text string")
    assert rows(repeats.remove_repeats(df, digest=True), "doc_id", "n_words", "n_removed", "kept") == B.repeats(raw)
    monkeypatch.setattr(repeats, "_SHARD_WORDS", 60)
    starts = np.array([0, 70, 140])
    x = np.arange(200, dtype=np.uint64)
    x[100:120] = x[:20]
    phrases = x[starts[:, None] + np.arange(20)]
    assert repeats._locate(x, np.array([0, 90, 200]), phrases).tolist() == [0, 70, 100, 140]
    assert repeats._locate(x, np.array([0, 110, 200]), phrases).tolist() == [0, 70, 140]  # not over the end of a document
    # One block as a task gets it: the document's words, and the phrases that the dictionary has for it.
    words, ends = repeats.word_hashes([t.encode().split() for _, t in raw])
    anchors = list(repeats._emit_anchors(50, 20)(iter([block(raw)])))[0]
    own = [words[ends[r] + s:ends[r] + s + 20].tobytes() for r, s in zip(anchors.column("doc_id").to_pylist(), anchors.column("start").to_pylist()) if r == 0]
    assert own
    found = lambda: [s for b in repeats._stream(50, 20, False)(iter([block(raw, own)])) for s in b.column("starts").to_pylist()]
    assert all(found())
    monkeypatch.setattr(repeats, "_locate", lambda *_: np.empty(0, np.int64))
    assert found() == [None] * 4


def block(raw, wanted=None):
    import pyarrow as pa

    batch = {"doc_id": pa.array([d for d, _ in raw]), "row": pa.array([d for d, _ in raw]), "text": pa.array([t for _, t in raw]), "twin": pa.array([False] * len(raw)), "wanted": pa.array([wanted] * len(raw), pa.list_(pa.binary()))}
    return pa.RecordBatch.from_pydict(batch)


def test_near_duplicates(spark, cases, small):
    for df, raw in both(spark, cases, small):
        got = nearduplicates.near_duplicates(df)
        want = [(d, n, (d if n == 0 else c), (True if d is None else d == (d if n == 0 else c))) for d, n, c, _ in B.components(raw)]
        assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    assert nearduplicates.near_duplicates(cases.limit(0)).count() == 0
    assert nearduplicates.keep_first(cases).columns == cases.columns


def test_crowded_lists(spark):
    """A family of edits around one original: more members than a list may have before it is listed anew."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(140)]
    raw = []
    for d in range(90):
        w = list(base)
        for i in rng.choice(140, int(rng.integers(0, 9)), replace=False):
            w[i] = f"e{d}x{i}"
        raw.append((d, " ".join(w)))
    df = spark.createDataFrame(raw, "doc_id long, text string").repartition(3)
    assert rows(nearduplicates.near_duplicates(df, crowd=8), "doc_id", "n_shingles", "component_id", "kept") == B.components(raw)


def family(n, seed=7):
    """Edits around one original."""
    rng, raw = np.random.default_rng(seed), []
    for d in range(n):
        w = [f"b{i}" for i in range(140)]
        for i in rng.choice(140, int(rng.integers(0, 9)), replace=False):
            w[i] = f"e{d}x{i}"
        raw.append((d, " ".join(w)))
    return raw


def test_near_duplicates_few_shuffled_tasks(spark):
    """Rounds over few pairs don't run as many tasks as there are shuffle partitions: starting these is the most that small rounds cost."""
    tasks = lambda: sum(t.getStageInfo(s).numCompletedTasks for j in t.getJobIdsForGroup("near") for s in t.getJobInfo(j).stageIds if t.getStageInfo(s))
    sc = spark.sparkContext
    t, before = sc.statusTracker(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("near", "near duplicates")
    try:
        raw = family(90)
        df = spark.createDataFrame(raw, "doc_id long, text string").repartition(3)
        assert rows(nearduplicates.near_duplicates(df, crowd=8), "doc_id", "n_shingles", "component_id", "kept") == B.components(raw)
        assert 0 < tasks() < 900
    finally:
        sc._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_near_duplicates_many_pairs(spark, monkeypatch):
    """Beyond the rows that may be broadcast all joins are shuffled, with the same result."""
    from verdata.llm import components

    raw = family(40) + [(d + 100, t) for d, t in family(20, 8)]
    df = spark.createDataFrame(raw, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(components, "SMALL_ROWS", 0)
    for module in (components, nearduplicates):
        monkeypatch.setattr(module, "broadcast_if_small", lambda written: written)
    assert rows(nearduplicates.near_duplicates(df, crowd=8), "doc_id", "n_shingles", "component_id", "kept") == B.components(raw)


def test_components_flat_edges_need_no_round(spark, monkeypatch):
    from verdata.llm import components

    written = []
    monkeypatch.setattr(components, "materialize", lambda df, f=components.materialize: written.append(1) or f(df))
    find = lambda edges: sorted(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert find([(1, 5), (7, 1), (2, 3), (3, 2)]) == [(1, 1), (2, 2), (3, 2), (5, 1), (7, 1)] and len(written) == 1
    assert find([(1, 2), (2, 3), (9, 3), (9, 8)]) == [(1, 1), (2, 1), (3, 1), (8, 1), (9, 1)] and len(written) > 2


def test_licenses(spark, cases, small):
    for df, raw in both(spark, cases, small):
        got = licenses.scan_licenses(df)
        assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((d, *B.licenses(t)) for d, t in raw), key=str)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(cases).collect()}
    assert found[10]["labels"] == "apache-2,cc-by-nc,mit" and found[10]["score"] == 1.0
    assert licenses.scan_licenses(cases.limit(0)).count() == 0


def test_license_join_is_exact():
    """Filters lose no block: every template and random block against plain counting."""
    rng = np.random.default_rng(1)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.encode().split()})
    index = licenses.Index(licenses.TEMPLATES, {w: int(rng.integers(0, 50)) for w in words}, 0.8)
    for _ in range(3000):
        _, t = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))]
        block = [w for w in t.encode().split() if rng.random() < 0.85] + [words[i] for i in rng.integers(0, len(words), 3)]
        want = {}
        for k, (_, u) in enumerate(licenses.TEMPLATES):
            s = set(u.encode().split())
            if len(s & set(block)) >= 0.8 * len(s) - 1e-9:
                want[k] = len(s & set(block)) / len(s)
        assert index.block(block) == want


def test_license_blocks_cross_lines(spark):
    """Wrapped passages hold their template, and so does any window of 64 words, but no wider one."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    gpl = "This work is licensed under the GNU General Public\nLicense, Version 3."
    template = licenses.TEMPLATES[6][1].split()
    far = lambda n: " ".join(["x"] * 17 + template[:6] + ["y"] * (n - len(template)) + template[6:] + ["z"] * 90)
    raw = [(1, "first line\n" + bsd), (2, gpl), (3, bsd.replace("\n", " ")), (4, far(64)), (5, "Redistribution and use in\nsource"), (6, bsd + "\n\n" + gpl), (7, far(90))]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(raw, "doc_id long, text string")).collect()}
    assert [found[d]["labels"] for d in range(1, 8)] == ["bsd", "gpl-3", "bsd", "bsd", "", "bsd,gpl-3", ""]
    assert [tuple(b) for b in found[1]["blocks"]] == [("bsd", 1, 0, 1.0)] and [b["line"] for b in found[6]["blocks"]] == [3, 0]


def test_licenses_that_differ_in_a_word(spark):
    text = {1: "released under the BSD license", 2: "released under the GPL license", 3: "Licensed under Creative Commons Attribution ShareAlike 4.0", 4: "licensed under creative commons attribution 4.0",
            5: "GNU General Public License, version 2", 6: "Licensed under Creative Commons Attribution NonCommercial 4.0", 7: "this work is licensed under the GNU General Public License version 2",
            8: "licensed under creative commons attribution 4.0 " + "x " * 90 + "licensed under creative commons attribution sharealike 4.0", 9: "released under the zlib license",
            10: "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated files, to deal in the Software without restriction,\nincluding without limitation the rights"}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    want = {1: "bsd", 2: "gpl", 3: "cc-by-sa", 4: "cc-by", 5: "", 6: "cc-by-nc", 7: "gpl-2", 8: "cc-by,cc-by-sa", 9: "", 10: "mit"}
    assert got == want
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"), window=20)


def test_license_labels_and_scores_against_all_windows(spark):
    """``labels`` and ``score`` of random documents against every window of 64 words."""
    rng = np.random.default_rng(5)
    plain = [(label, t) for label, t in licenses.TEMPLATES if label not in licenses.NARROWER]
    raw = []
    for d in range(120):
        words = []
        for _ in range(int(rng.integers(0, 5))):
            for w in plain[int(rng.integers(len(plain)))][1].split():
                words += [w] * bool(rng.random() < 0.9) + ["x"] * int(rng.integers(0, 3) == 0)
            words += ["filler"] * int(rng.integers(0, 40))
        raw.append((d, "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)))
    for r in licenses.scan_licenses(spark.createDataFrame(raw, "doc_id long, text string"), templates=plain, phrases=()).collect():
        w = raw[r["doc_id"]][1].split()
        best: dict = {}
        for i in range(max(1, len(w))):
            held = set(w[i:i + 64])
            for label, t in plain:
                s = set(t.split())
                must = {x for a, begin, words in licenses.REQUIRED if a == label and t.startswith(begin) for x in words.split()}
                if len(s & held) >= 0.8 * len(s) - 1e-9 and must <= held:
                    best[label] = max(best.get(label, 0), len(s & held) / len(s))
        assert r["labels"] == ",".join(sorted(best)) and abs(r["score"] - max(best.values(), default=0)) < 1e-9


def test_license_blocks_are_all_windows():
    """Groups of blocks against every window of the words."""
    rng = np.random.default_rng(3)
    index = licenses.Index(licenses.TEMPLATES, {w: int(rng.integers(0, 50)) for _, t in licenses.TEMPLATES for w in t.encode().split()}, 0.8)
    for _ in range(300):
        words = []
        for _ in range(6):
            t = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))][1].encode().split()
            for w in t:
                words += [w] * bool(rng.random() < 0.9) + [b"x"] * int(rng.integers(0, 8))
        want: dict = {}
        for i in range(len(words)):
            for k, share in index.block(words[i:i + 64]).items():
                want[k] = max(want.get(k, 0), share)
        got: dict = {}
        for k, share, *_ in index.runs(words, 64):
            got[k] = max(got.get(k, 0), share)
        assert got == want


def test_licenses_in_order(spark):
    """Words that only share a window give no label; short wordings and identifiers do; wrapped and slightly changed passages still do."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."
    text = {
        1: ("The code was released under the BSD license. It was written at MIT in 1990.", "bsd"), 2: (lgpl + " See the main program for help.", "lgpl"), 3: ("This work is licensed under the GNU General Public License version 2 (chapter 3 tells how)", "gpl-2"),
        4: ("the film 2 was licensed by apache under the version 0 of the license", ""), 5: ("Our album is released under the label of MIT press with license to copy", ""), 6: ("released under the isc license", "isc"), 7: ("This file is MIT licensed", "mit"),
        8: ("// SPDX-License-Identifier: MIT", "mit"), 9: ("SPDX-License-Identifier: Apache-2.0", "apache-2"), 10: ("words before " + bsd + " words behind", "bsd"), 11: (bsd.replace("or without", "or with no"), "bsd"), 12: (" ".join(reversed(bsd.split())), ""),
        13: ("released under the mit license", "mit"), 14: ("Licensed under Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"), 15: (lgpl.replace("library", "program").replace("Lesser ", ""), "gpl"), 16: (None, ""), 17: ("released under the\nBSD license " * 3, "bsd"),
        18: ("permission to use copy " * 3000, ""),
    }
    df = spark.createDataFrame([(d, t) for d, (t, _) in text.items()], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df, licenses.TEMPLATES + licenses.SHORT, required=licenses.REQUIRED + licenses.SHORT_REQUIRED, ordered=0.8).collect()}
    assert {d: r["labels"] for d, r in found.items()} == {d: want for d, (_, want) in text.items()}
    assert found[11]["score"] == 13 / 14 and [tuple(b)[:3] for b in found[10]["blocks"]] == [("bsd", 0, 2)] and [b["line"] for b in found[17]["blocks"]] == [0, 1, 2]


def test_license_order_against_plain_subsequences():
    """Verified windows by bits against the textbook's table of common subsequences."""
    rng = np.random.default_rng(11)
    some = [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) > licenses.WHOLE]
    index = licenses.Index(some, {w: 1 for _, t in some for w in t.encode().split()}, 0.8)

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]
    hits = 0
    for _ in range(60):
        k = int(rng.integers(len(some)))
        own = index.tokens[k]
        words = [b"y"] * 5 + [w for w in own if rng.random() < 0.9 for w in ([w, b"x"] if rng.random() < 0.08 else [w])] + [b"z"] * 9
        length, m = len(own) + max(2, len(own) // 8), len(own)
        best = max(lcs(own, words[i:i + length]) for i in range(len(words)))
        got = [part for *_, part in index.ordered(k, words, 0, len(words) - 1, 0.8)]
        assert bool(got) == (best >= 0.8 * m - 1e-9)
        hits += bool(got)
    assert 5 < hits < 60


def test_quality(spark, cases, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df, raw in both(spark, cases, small):
        got = quality.judge(df, labels, min_cover=3)
        assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((d, *B.quality(t)) for d, t in raw), key=str)
    none = quality.judge(cases, labels.limit(0))
    assert none.where("rule is not null").count() == 0
    assert quality.keep_good(cases, labels.limit(0)).columns == cases.columns
    assert quality.judge(cases.limit(0), labels).count() == 0


def test_quality_rules_hold_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.judge(docs, train).join(test, "doc_id")
    r = judged.where("not base_failed").agg(F.count_if((F.col("quality") == 0) & F.col("rule").isNotNull()).alias("tp"), F.count_if((F.col("quality") == 1) & F.col("rule").isNotNull()).alias("fp"), F.count_if((F.col("quality") == 0)).alias("p"), F.count_if((F.col("quality") == 1)).alias("n")).first()
    assert r["fp"] <= 0.002 * r["n"] and r["tp"] >= 0.9 * r["p"]


def test_private(spark, cases, small):
    for df, raw in both(spark, cases, small):
        got = []
        for r in private.find_private(df).collect():
            base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "id"]
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            got.append((r["doc_id"], *[sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")], hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(got, key=str) == sorted(((d, *B.private(t)) for d, t in raw), key=str)
    masked = {r["doc_id"]: r["text"] for r in private.mask_private(cases).collect()}
    assert masked[9] == "mail <email><email> and <email>. ip <ip> 1.2.3.400 card <card> tel <phone>"
    assert private.mask_private(cases).columns == cases.columns and masked[0] is None and masked[1] == ""
    assert private.find_private(cases.limit(0)).count() == 0


def test_private_contexts(spark):
    """Contexts of seeds find identifiers of another form; the same form elsewhere stays."""
    raw = [(i, f"filler words here contact number {'+1 (262) 555-%04d' % i} thanks") for i in range(40)] + [(100, "more text contact number ZX81-77-QQ9 bye"), (101, "the version label ZX81-77-QQ8 is old")]
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in private.find_private(spark.createDataFrame(raw, "doc_id long, text string")).collect()}
    assert got[100] == [("id", 25)] and got[101] == [] and got[3] == [("phone", 33)]


def plain_patterns(tokens, rounds=3, prior=1.0, decay=0.9):
    """Scores by dictionaries: (kind_no or None, string, l1, l2, r1) -> pattern -> (score, seeds)."""
    edges = {}
    for kind, m, l1, l2, r1 in tokens:
        for p in [f"l1 {l1}"] * (l1 != "") + [f"l2 {l2} {l1}"] * (l1 != "" and l2 != "") + [f"lr {l1} {r1}"] * (l1 != "" and r1 != ""):
            known = edges.setdefault((p, m.lower()), [])
            known += [kind] if kind is not None else []
    own = {}
    for (_, i), kinds in edges.items():
        own[i] = max(own.get(i, 0.0), float(bool(kinds)))
    score, by = dict(own), {}
    for (p, i), kinds in edges.items():
        by.setdefault(p, []).append((i, min(kinds) if kinds else None))
    for k in range(rounds):
        rated = {p: sum(score[i] for i, _ in own_) / (len(own_) + prior) for p, own_ in by.items()}
        if k < rounds - 1:
            best = {}
            for (p, i) in edges:
                best[i] = max(best.get(i, 0.0), rated[p])
            score = {i: max(own[i], decay * best[i]) for i in own}
    return {p: (round(rated[p], 9), sum(k is not None for _, k in own_), max((sum(k == n for _, k in own_), -n) for n in range(4))[1] * -1) for p, own_ in by.items()}


def test_private_scores_and_discovery(spark):
    """Scores, and the spans that good patterns find, against plain versions; planted identifiers are found and nothing else; any number of patterns gives the same."""
    names = ["alpha", "beta", "gamma"]
    raw = [(i, f"note {i % 7} says reach {names[i % 3]} line {'+1 (262) 555-%04d' % i} today or mail box user{i}@site.org soon") for i in range(60)]
    planted = [(100 + i, f"note says reach {names[i % 3]} line AB{i}9-77-QQ{i} today and mail box AcmeUser{chr(65 + i)} soon") for i in range(9)]
    clean = [(200 + i, f"the part label ZX81-77-QQ{i} is old and the newTitle stays in version 12.{i} of it") for i in range(9)]
    df = spark.createDataFrame(raw + planted + clean, "doc_id long, text string").repartition(3)
    scanned = df.select(private._scan(F.col("text")).alias("s")).select("s.*")
    tokens = scanned.select(F.explode("base").alias("x"), F.lit(True).alias("seed")).union(scanned.select(F.explode("other").alias("x"), F.lit(False).alias("seed")))
    plain = plain_patterns([(r["x"]["kind_no"] if r["seed"] else None, *(r["x"][k] for k in ("m", "l1", "l2", "r1"))) for r in tokens.collect()])
    got = {r["pattern"]: (round(r["score"], 9), r["n_seeds"], r["like"]) for r in private.learn_patterns(tokens).collect()}
    assert got == plain and any(n >= 3 and s >= 0.6 for s, n, _ in got.values())
    found = {r["doc_id"]: r["spans"] for r in private.find_private(df).collect()}
    ids = {d: [s for s in spans if s["kind"] == "id"] for d, spans in found.items()}
    text = dict(raw + planted + clean)
    hit = {(d, text[d][s["start"]:s["end"]]) for d, spans in ids.items() for s in spans}
    want = {(100 + i, x) for i in range(9) for x in (f"AB{i}9-77-QQ{i}", f"AcmeUser{chr(65 + i)}")}
    assert hit == want
    few = {r["doc_id"]: r["spans"] for r in private.find_private(df, max_patterns=3).collect()}
    assert few == found
    masked = {r["doc_id"]: r["text"] for r in private.mask_private(df, max_patterns=3).collect()}
    assert masked == {r["doc_id"]: r["text"] for r in private.mask_private(df).collect()} and masked[100].count("<id>") == 2 and masked[200] == text[200]


def test_lines(spark, cases):
    raw = [(i, f"Page {i} of the report\nbody {i} text unlike others {chr(97 + i) * 5}\nshort") for i in range(6)] + [(6, None), (7, ""), (8, "Page 9 of the report")]
    df = spark.createDataFrame(raw, "doc_id long, text string").withColumn("n_lines", F.lit("old"))
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(df).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 1 and got[i]["text"].startswith("body") for i in range(1, 6))
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "" and got[8]["n_lines"] == 1
    assert lines.drop_recurring_lines(cases.limit(0)).count() == 0
    assert lines.drop_recurring_lines(cases).count() == len(CASES)


def test_lines_merge_word_fields(spark):
    """Fields may hold words, at the start of a line as well, and rare or common ones; other lines of the same leaf stay."""
    who = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi"]
    place = ["Rome", "Oslo", "Bern", "Kyiv", "Riga", "Baku", "Lima", "Cork"]
    raw = [(i, f"Posted by {who[i]} in News\n{who[i]} wrote this on the site\nA report for our readers by {who[i]} from {place[i]} with thanks\nPosted by {who[i]} {place[i]} {'xyzuvwrs'[i]}") for i in range(8)]
    raw += [(20, "Posted by alice in News\nand more"), (21, "Posted by alice in News\nand less"), (22, "Posted by alice in News\nor none"), (23, "Posted by nobody near there"), (24, None), (25, "")]
    df = spark.createDataFrame(raw, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(df, similarity=0.75).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["text"] == raw[0][1]
    for i in range(1, 8):
        assert got[i]["text"] == raw[i][1].split("\n")[3] and got[i]["n_dropped"] == 3
    assert [got[i]["text"] for i in range(20, 26)] == ["and more", "and less", "or none", raw[11][1], None, ""]
    import corpus_pipeline
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert staged == {d: r["text"] for d, r in got.items()}
    assert lines.drop_recurring_lines(df.limit(0), similarity=0.75).count() == 0


def test_pipeline_judges_short_lines(spark):
    import corpus_pipeline
    raw = [(i, f"Read more\n\nunlike{'abcdef'[i]}\nAdvertisement\nPage {i}") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(raw, "doc_id long, text string"), "").collect()}
    assert got == {0: raw[0][1]} | {i: f"\nunlike{'abcdef'[i]}" for i in range(1, 6)}


def test_sharding(spark, cases, small):
    for df, raw in both(spark, cases, small):
        for n in (1, 3, 16):
            got = sharding.shard(df, n).collect()
            assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, B.crc(t)) for d, t in raw), key=str)
            groups: dict = {}
            for d, t in raw:
                g = groups.setdefault(t or "", [d, 0])
                g[0] = min((x for x in (g[0], d) if x is not None), default=None)
                g[1] += len((t or "").encode()) + 1
            sizes = [s for _, s in sorted(groups.values(), key=lambda x: (-1 if x[0] is None else x[0]))]

            def enough(c):
                parts, have = 1, 0
                for s in sizes:
                    if have + s > c:
                        parts, have = parts + 1, 0
                    have += s
                return max(sizes) <= c and parts <= n
            best = next(c for c in range(max(max(sizes), sum(sizes) // n), sum(sizes) + 1) if enough(c))
            load: dict = {}
            for r in got:
                load.setdefault(r["shard"], []).append(r)
            assert max(sum(r["size"] for r in v) for v in load.values()) == best
            assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in load.values())
    assert sharding.shard(cases.limit(0)).count() == 0


def test_sharding_refines_blocks(spark, monkeypatch):
    """The same cuts when the driver sees few blocks at a time."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(1, 1000, 500))], "g long, bytes long")
    want = sharding.minimax_cuts(df, 7)
    monkeypatch.setattr(sharding, "MAX_BLOCKS", 16)
    assert sharding.minimax_cuts(df, 7) == want


def test_packing(spark, cases, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for df, raw in both(spark, cases, small):
        for window in (16, 1024):
            got = packing.pack(df, path, window=window).collect()
            want = sorted(([d, tok.encode(t or "", add_special_tokens=False).ids + [0]] for d, t in raw), key=str)
            per: dict = {}
            for d, ids in want:
                per.setdefault(d, []).append(ids)
            seqs: dict = {}
            for r in got:
                assert any(r["doc_tokens"] == len(ids) and zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in per[r["doc_id"]])
                seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
            for v in seqs.values():
                at = 0
                for o, n in sorted(v):
                    assert o == at
                    at += n
                assert at <= window
            assert len(seqs) * window - sum(r["length"] for r in got) < window
    assert packing.pack(cases.limit(0), path).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    tok.encode_special_tokens = True
    rng = np.random.default_rng(4)
    bits = ["a", "Word", " ", "  ", "\n", ".", ",", "'s", "12", "é", "你", "\t", " ", "　", "!!", "<|endoftext|>", "ß", "'", "|", "ʼ", "\x1c", "x\ny"]
    texts = ["".join(rng.choice(bits, 30)) for _ in range(2000)]
    assert all(np.array(e.ids, "<u4").tobytes() == g for e, g in zip(tok.encode_batch(texts, add_special_tokens=False), enc.encode(texts)))


def test_nnls_uses_up_a_histogram():
    lengths = {300: 50, 724: 50, 512: 20, 100: 30, 824: 0, 424: 30, 500: 30}
    lengths = {k: v for k, v in lengths.items() if v}
    strategies, used = packing.plan(lengths, 1024)
    assert all(sum(c) == 1024 for c, _ in strategies) and used == {300: 50, 724: 50, 512: 20, 100: 30, 424: 30, 500: 30}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 12))
    x[100:140] = x[100]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0]), (None, [1.0] * 12), (5004, [None] * 12), (20, data[20][1])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, leaf_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found) and found == sorted(found, key=lambda p: (-p[1], p[0]))
        hit += len(set(best) & {i for i, _ in found})
    assert hit >= 0.9 * 20 * len(got)
    few = neighbours.nearest(df.where("vec_id < 5"), df.where("vec_id < 5"), 20)
    assert few.count() == 20 and neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_in_rounds_and_small_batches(spark, monkeypatch):
    """What a task holds at once doesn't grow with the queries that it is given, and neither do the visits written at once; rounds and slices find the same."""
    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(3000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    find = lambda: [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 5, leaf_rows=50).orderBy("query_id", "rank").collect()]
    forest = neighbours.Forest(x, float(np.sqrt((x * x).sum(1).max())), 4, 6, 11)
    leaves, n = np.unique(forest.leaves(x) + 64 * np.arange(4), return_counts=True)
    held = {(int(a) // 64, int(a) % 64): int(b) for a, b in zip(leaves, n)}
    asked = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(x.tolist())], ["query_id", "v"])
    got = list(neighbours._visits(forest, 8, held, 3900)(iter([asked])))
    want = [(i, j, *leaf) for i, q in enumerate(x) for j, leaf in enumerate(forest.search(q, held, 3900))]
    assert [(r["query_id"], r["turn"], r["tree"], r["leaf"]) for b in got for r in b.drop_columns("v").to_pylist()] == want
    assert len(want) > 200_000 and max(b.num_rows for b in got) < 10_000
    once = find()
    tables = []
    monkeypatch.setattr(neighbours, "ROUND_VISITS", 4000)
    monkeypatch.setattr(neighbours, "SLICE_QUERIES", 7)
    monkeypatch.setattr(neighbours, "drop", lambda *t: tables.append(t[0].count()))
    assert find() == once and len(once) == 750
    assert len(tables) >= 3 and max(tables) < 8000


def test_segmentations(spark, cases):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = segment.sample_segmentations(cases, path, k=3)
    per: dict = {}
    for r in got.collect():
        assert r["round_trip"] and 0 <= r["inclusion"] <= 1
        per.setdefault((r["doc_id"], r["n_pieces"], tuple(r["ids"])), []).append(r)
    decoded = {(r["doc_id"], r["sample"]): r["text"] for r in segment.decode(got, path).collect() if r["doc_id"] is not None}
    assert all(decoded[d, 1] == (t or "") for d, t in CASES if d is not None)
    again = segment.sample_segmentations(cases.repartition(5), path, k=3)
    assert rows(got, "doc_id", "sample", "log_prob") == rows(again, "doc_id", "sample", "log_prob")
    assert segment.sample_segmentations(cases.limit(0), path).count() == 0


def test_segmentations_follow_the_distribution():
    v = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def every(u):
        if not u:
            return [((), 0.0)]
        out = []
        for n in range(1, len(u) + 1):
            i = sp.piece_to_id(u[:n])
            if i and sp.id_to_piece(i) == u[:n]:
                out += [((i, *r), v.weight[i] + w) for r, w in every(u[n:])]
        return out
    full = {a + b: x + y for a, x in every("▁ab") for b, y in every("▁cd")}
    z = np.log(sum(np.exp(x) for x in full.values()))
    p = {k: np.exp(x - z) for k, x in full.items()}
    n, first, second = 6000, {}, {}
    for r in segment.sample_texts(v, list(range(n)), ["ab cd"] * n, 2, 7):
        a, b = (tuple(x[0].tolist()) for x in r)
        assert a != b and abs(r[0][1] - np.log(p[a])) < 1e-4 and r[0][2] >= r[1][2]
        first[a], second[b] = first.get(a, 0) + 1, second.get(b, 0) + 1
    want = {k: sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k) for k in p}
    assert max(abs(first.get(k, 0) / n - q) for k, q in p.items()) < 0.03
    assert max(abs(second.get(k, 0) / n - q) for k, q in want.items()) < 0.03
    found = segment.sample_texts(v, [1], ["ab cd"], 100, 7)[0]
    assert len(found) == len(full) and all(x[3] == 1.0 for x in found)


def test_segmentations_come_out_whole():
    """All segmentations where k is large enough, and inclusion against all orders of a small lattice."""
    v = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for text, k in (("catty", 40), ("absolute", 200)):
        found = segment.sample_texts(v, [1], [text], k, 7)[0]
        lattice = segment.Lattice(v, ["\u2581" + text])
        ways = [0] * (len(text) + 2)
        ways[len(text) + 1] = 1
        for at in range(len(text), -1, -1):
            ways[at] = sum(ways[int(lattice.dest[e])] for e in range(int(lattice.first[at]), int(lattice.last[at])))
        assert len(found) == len({tuple(x[0].tolist()) for x in found}) == ways[0] and all(x[3] == 1.0 for x in found)
        assert abs(sum(np.exp(x[1]) for x in found) - 1) < 1e-5
    every = {tuple(x[0].tolist()): np.exp(x[1]) for x in segment.sample_texts(v, [1], ["cat"], 50, 7)[0]}
    n = 4000
    for k in (1, 2, 5):
        # A sample's inclusion probability, as the share of draws that hold it and as the mean of 1 / inclusion (Horvitz and Thompson: 1 each).
        weight: dict = dict.fromkeys(every, 0.0)
        for own in segment.sample_texts(v, list(range(n)), ["cat"] * n, k, 3):
            assert len(own) == k
            for ids, _, _, inclusion in own:
                weight[tuple(ids.tolist())] += 1 / inclusion / n
        assert all(abs(weight[x] - 1) < 0.2 for x, p in every.items() if p > 0.05)
    many = segment.sample_texts(v, [1, 2], ["the cat sat on the mat", "the cat sat on the mat"], 60, 3)
    for own in many:
        assert len({tuple(x[0].tolist()) for x in own}) == 60 and all(a[2] >= b[2] for a, b in zip(own, own[1:]))


def test_line_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        assert rows(df, *cols) == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), after.schema)
        assert before.count() <= docs.count()
    got = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on its own input, with hard cases and columns of names that operators use themselves."""
    import duckdb

    import corpus_pipeline

    extra = {"a.b": 0, "_row": 1, "_d": 2, "_r": 3, "doc": 4, "rest": 5, "row": 6, "kept": 7, "gone": 8, "base": 9, "n_lines": 10, "_spans": 11}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(d + 10_000 if d is not None else None, t) for d, t in CASES], "doc_id long, text string"))
    docs = docs.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(v).alias(k) for k, v in extra.items()]).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stages[name](spark, df, SF)
        assert out.columns == docs.columns, name
        rows_ = out.collect()
        assert all(r[k] == v for r in rows_ for k, v in extra.items())
        assert stages[name](spark, df.limit(0), SF).count() == 0
        return spark.createDataFrame(rows_, docs.schema), sorted(((r["doc_id"], r["text"]) for r in rows_), key=str)

    good, kept = run("quality_rules", docs)
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").select("doc_id").collect()
    assert sorted((r["doc_id"] for r in judged), key=str) == sorted((d for d, _ in kept), key=str)
    before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    _, lined = run("line_dedup", docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    named = [(d, t) for d, t in before if d is not None and d != 10_005]
    con.executemany("INSERT INTO documents VALUES (?, ?)", named)
    want = {d: (h, n) for d, n, _, h in con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.OP9})").fetchall()}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == want[d][0] for d, t in lined if d in want)
    _, single = run("near_dedup", docs)
    least = {}
    for d, n, c, k in B.components(before, 80):
        if n == 0 or d is None or d == c:
            least[d] = least.get(d, 0) + 1
    assert {d for d, _ in single} == set(least) and len(single) == len({(d, t) for d, t in before if d in least})
    _, masked = run("pii", docs)
    was, addresses = dict(before), []
    for d, t in masked:
        if d is None or t is None:
            continue
        if B.private(was[d])[:4] == (0, 0, 0, 0) and "<id>" not in t:
            assert t == was[d]
        addresses += (inside := [m.group() for m in B.EMAIL.finditer(was[d])])
        assert not any(x in t for x in inside)
    assert len(addresses) > 5
    packed = corpus_pipeline.STAGES[-1][1](spark, good, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in kept} and all(r["n"] % r["m"] == 0 for r in packed)
