import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdata.operators import balance as B
from verdata.operators import batches as K
from verdata.operators import curate as C
from verdata.operators import evaluate as E
from verdata.operators import prepare as P
from verdata.operators import rewards as R
from verdata.operators import rollouts as G
from verdata.operators import runs as I
from verdata.operators.numbering import number_rows


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        n = int(rng.integers(1, 9))
        rows.append((i, i // 4, [float(x) for x in rng.normal(size=n)], [float(x) for x in rng.normal(size=n)], [1.0] * int(rng.integers(1, n + 1)) + [0.0] * n))
    rows = [(i, u, r, v, m[: len(r)]) for i, u, r, v, m in rows]
    return rows, spark.createDataFrame(rows, "id long, uid long, r array<double>, v array<double>, m array<double>")


def whiten(rows, masks):
    x = np.concatenate([np.array(r)[np.array(m) > 0] for r, m in zip(rows, masks)])
    return [(np.array(r) - x.mean()) / np.sqrt(x.var(ddof=1) + 1e-8) for r in rows]


def test_gae(seqs):
    rows, df = seqs
    gamma, lam, raw, ret = 0.9, 0.8, [], []
    for _, _, r, v, m in rows:
        a, last, after = [0.0] * len(r), 0.0, 0.0
        for t in reversed(range(len(r))):
            if m[t]:
                last, after = r[t] + gamma * after - v[t] + gamma * lam * last, v[t]
            a[t] = last
        raw.append(a), ret.append([x + y for x, y in zip(a, v)])
    want = whiten(raw, [x[4] for x in rows])
    got = {x["id"]: x for x in G.gae(df, "r", "v", "m", gamma, lam).collect()}
    for i in range(len(rows)):
        np.testing.assert_allclose(got[i]["returns"], ret[i], atol=1e-9)
        np.testing.assert_allclose(got[i]["advantages"], want[i], atol=1e-9)


def test_discounted_returns(seqs):
    rows, df = seqs
    got = {x["id"]: x["returns"] for x in G.discounted_returns(df, "r", "m", 0.9).collect()}
    for i, _, r, _, m in rows:
        run, want = 0.0, [0.0] * len(r)
        for t in reversed(range(len(r))):
            want[t] = run = r[t] + 0.9 * run
            run *= m[t]
        np.testing.assert_allclose(got[i], want, atol=1e-9)


def test_group_advantages_of_one_and_ties(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "uid long, candidate_index long, score double")
    assert [x["advantage"] for x in G.grpo_advantage(df).orderBy("uid", "candidate_index").collect()] == [None, 0.0, 0.0]
    assert [x["advantage"] for x in G.rloo_advantage(df).orderBy("uid", "candidate_index").collect()] == [None, 0.0, 0.0]


def test_fill_batches(spark):
    groups = spark.createDataFrame([(g, i) for i, g in enumerate([0] * 3 + [1] * 3 + [2] * 5 + [3] * 1)], "gen long, uid long").withColumn("arrival", F.col("uid"))
    got = [(r["batch"], r["uid"]) for r in G.fill_batches(groups, 4).orderBy("batch", "place").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 6), (1, 7), (1, 8), (1, 9)]
    with pytest.raises(ValueError):
        G.fill_batches(groups, 100, max_tries=2)


def test_token_rewards_and_masks(spark):
    df = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0],)], "ids array<bigint>")
    mask = df.select(P.response_mask(F.col("ids"), (1,)).alias("m")).first()["m"]
    assert mask == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    d = spark.createDataFrame([([1.0, 1.0, 0.0],), ([0.0, 0.0],)], "m array<double>")
    assert [r[0] for r in d.select(R.token_rewards(F.lit(2.0), F.col("m"))).collect()] == [[0.0, 2.0, 0.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="longer than"):
        df.select(P.pad_or_truncate(F.col("ids"), 3, F.lit(0).cast("long"), "left", "error")).collect()


def test_batch_algebra(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abcdef")], "row long, label string")
    assert K.pad_rows(df, 4, "row").count() == 8 and K.unpad_rows(K.pad_rows(df, 4, "row")).count() == 6
    three = df.limit(3)
    assert [r["label"] for r in K.repeat_rows(three, 2, True, "row").orderBy("position").collect()] == list("aabbcc")
    assert [r["label"] for r in K.repeat_rows(three, 2, False, "row").orderBy("position").collect()] == list("abcabc")
    with pytest.raises(ValueError):
        K.chunk(df, 4, "row")
    with pytest.raises(ValueError):
        K.split(df, 4, "row")
    with pytest.raises(Exception, match="differ"):
        K.union_columns(df, df.withColumn("label", F.lit("x")), "row").collect()
    assert K.union_columns(df, df.withColumn("n", F.col("row") * 2), "row").count() == 6
    with pytest.raises(ValueError):
        K.rename_cols(df, ["row"], [])


def test_balance(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 500, 64)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "batch long, row long, tokens long")
    rows = B.balance_partitions(df, 8, True).collect()
    sums, sizes = {}, {}
    for r in rows:
        sums[r["part"]] = sums.get(r["part"], 0) + r["tokens"]
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert set(sizes.values()) == {8} and max(sums.values()) - min(sums.values()) < 100
    micro = B.micro_batches(df, 2000).orderBy("row").collect()
    assert [r["tokens"] for r in micro] == lengths and len({r["micro"] for r in micro}) == -(-sum(lengths) // 2000)
    assert {r["part"] for r in B.greedy_partitions(df, 8, True).collect()} == set(range(8))
    with pytest.raises(Exception, match="equal size"):
        B.balance_partitions(df, 7, True).collect()


def plain_differencing(lengths, k, equal_size):
    """Parts as lists of (id, length); the two states of widest spread are merged until one is left."""
    order = sorted((n, i) for i, n in enumerate(lengths))
    step, weight = k if equal_size else 1, lambda p: (sum(n for _, n in p), len(p), p)
    states = []
    for at in range(0, len(order), step):
        own = [[(i, n)] for n, i in order[at:at + step]]
        states.append(sorted(own + [[]] * (k - len(own)), key=weight, reverse=True))
    spread = lambda s: (weight(s[0])[0] - weight(s[-1])[0], weight(s[0]))
    while len(states) > 1:
        states.sort(key=spread, reverse=True)
        a, b = states.pop(0), states.pop(0)
        states.append(sorted([x + y for x, y in zip(a, reversed(b))], key=weight, reverse=True))
    return [sorted(i for i, _ in p) for p in states[0]]


def plain_greedy(lengths, k, equal_size):
    parts = [[] for _ in range(k)]
    for i in range(len(lengths)):
        key = lambda p: (len(parts[p]) if equal_size else 0, sum(lengths[j] for j in parts[p]), p)
        parts[min(range(k), key=key)].append(i)
    return parts


def test_balance_against_plain_versions(spark):
    rng = np.random.default_rng(8)
    batches = {b: [int(x) for x in rng.integers(0, (3, 500)[b % 2], 32)] for b in range(12)}
    df = spark.createDataFrame([(b, i, n) for b, ns in batches.items() for i, n in enumerate(ns)], "batch long, row long, tokens long")

    def parts(out, name="part"):
        got = {b: [None] * 32 for b in batches}
        for r in out.collect():
            got[r["batch"]][r["row"]] = r[name]
        return got

    def labels(groups):
        return [next(p for p, g in enumerate(groups) if i in g) for i in range(32)]
    for equal in (True, False):
        assert parts(B.balance_partitions(df, 8, equal)) == {b: labels(plain_differencing(n, 8, equal)) for b, n in batches.items()}
        assert parts(B.greedy_partitions(df, 8, equal)) == {b: labels(plain_greedy(n, 8, equal)) for b, n in batches.items()}
    want = {}
    for b, n in batches.items():
        groups = plain_differencing(n, min(32, max(1, -(-sum(n) // 700))), False)
        want[b] = labels(sorted(groups, key=lambda g: (sum(n[i] ** 2 for i in g), min(g, default=0)), reverse=True))
    assert parts(B.micro_batches(df, 700), "micro") == want


def test_fill_batches_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    for batch_groups in (3, 5):
        gens = sorted(int(g) for g in rng.integers(0, 20, 60))
        df = spark.createDataFrame([(g, i) for i, g in enumerate(gens)], "gen long, uid long").withColumn("arrival", F.col("uid"))
        want, have, batch = [], [], 0
        for g in sorted(set(gens)):
            have += [i for i, x in enumerate(gens) if x == g]
            if len(have) >= batch_groups:
                want += [(batch, p + 1, u) for p, u in enumerate(have[:batch_groups])]
                batch, have = batch + 1, []
        assert sorted((r["batch"], r["place"], r["uid"]) for r in G.fill_batches(df, batch_groups).collect()) == want


def test_rescore(spark):
    rows = [(1, "5", [(0, "<think>a b</think> \\boxed{5}"), (1, "it is 5, the answer")]), (2, "x", [(0, "<think>" + "go on " * 20)])]
    df = spark.createDataFrame(rows, "uid long, gold string, candidates array<struct<candidate_index:long,response:string>>")
    got = {(r["uid"], r["candidate_index"]): r for r in E.rescore(df, 20).collect()}
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert (a["response_length"], a["accuracy"], a["format_rate"], a["robust_accuracy"], a["extract_failure"]) == (3, 1.0, 1.0, 1.0, 0.0)
    assert a["train_reward_v1"] == pytest.approx(1.0) and a["diagnostic_score_v2_lite"] == pytest.approx(1.0)
    assert (b["accuracy"], b["robust_accuracy"], b["verifier_false_negative_candidate"], b["missing_boxed_answer"], b["robust_answer"]) == (0.0, 1.0, 1.0, 1.0, "5")
    assert (c["response_length"], c["unclosed_think"], c["hit_length_cap"], c["truncation"], c["repetition"], c["invalid_output_penalty"]) == (40, 1.0, 1.0, 1.0, 1.0, 1.0)
    assert c["diagnostic_score_v2_lite"] == pytest.approx(-0.1)


def test_take_rows_from_the_end(spark):
    df = spark.range(11).withColumnRenamed("id", "row")
    take = lambda i, n=None: sorted(r["row"] for r in K.take_rows(df, i, "row", n).collect())
    for s in (slice(-3, None), slice(None, -2), slice(-5, -1, 2), slice(None, None, -3), slice(8, 2, -2), slice(-100, -50), slice(2, 9, 3), slice(3, None)):
        assert take(s) == sorted(range(11)[s])
    assert take(spark.createDataFrame([(0, -1), (1, 2), (2, -1)], "pos long, take long"), 11) == [2, 10, 10]
    assert K.take_rows(df.limit(0), slice(-3, None), "row").count() == 0


def test_flatten_and_majority(spark):
    df = spark.createDataFrame([(1, "r", [(0, 0.5)]), (2, "r", []), (3, "r", None)], "uid long, run string, candidates array<struct<i:long,score:double>>")
    assert sorted((r["uid"], r["score"]) for r in E.flatten_candidates(df).collect()) == [(1, 0.5), (3, None)]
    c = spark.createDataFrame([(1, 0, "b", "a"), (1, 1, "a", "a"), (1, 2, "A ", "a"), (1, 3, "b", "a"), (2, 0, "", "x")], "uid long, candidate_index long, boxed_answer string, gold string")
    assert [(r["uid"], r["majority_answer"], r["maj_at_k"]) for r in E.maj_at_k(c).orderBy("uid").collect()] == [(1, "b", 0.0), (2, None, 0.0)]


def test_checkpoints(spark):
    df = spark.createDataFrame([("r", s, 30, 10) for s in (5, 10, 15, 20, 25)], "run string, step long, current_step long, best_step long")
    assert sorted(r["step"] for r in I.obsolete_checkpoints(df, 3).collect()) == [5, 15, 20]
    assert I.obsolete_checkpoints(df, 0).count() == 0


def test_validation_reward_falls_back_on_zero(spark):
    log = spark.createDataFrame([(1, (0.0, 0.1, 0.2, 0.7), (3.0, 0.0), None), (2, None, None, None)], I.LOG_SCHEMA)
    assert [r["train_reward_v1"] for r in I.validation_rows(log).collect()] == [0.7]


def test_numbering_is_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, i int")
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = number_rows(df, ["g"], [F.col("i")], "k", weight="i", before="b").collect()
        for r in got:
            own = [i for i in range(100) if i % 3 == r["g"] and i < r["i"]]
            assert r["k"] == len(own) and r["b"] == sum(own)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert number_rows(df.limit(0), [], [F.col("i")], "k").count() == 0


def test_kl_coefficient_of_any_sign(spark):
    """Multipliers above, at and below 0 against a plain loop, over many partitions and rows of one run."""
    rng = random.Random(8)
    raw = [("a", i, rng.choice([0.1, 0.3, 0.5, None]), rng.choice([100.0, 50_000.0, 60_000.0])) for i in range(200)] + [("b", i, 0.1, 50_000.0 if i == 7 else 60_000.0) for i in range(20)]
    raw += [("c", i, rng.uniform(0.2, 0.4), 512.0) for i in range(3000)] + [("d", 5, 0.3, 1.0)] + [("e", i, 0.1, 60_000.0) for i in range(9)]
    want = {}
    for run in "abcde":
        coef = 0.01
        for _, i, kl, n in sorted(r for r in raw if r[0] == run):
            want[run, i] = coef
            if kl is not None:
                coef *= 1 + max(-0.2, min(kl / 0.3 - 1, 0.2)) * n / 10_000
    df = spark.createDataFrame(raw, "run string, step long, kl double, n_steps double").repartition(5)
    got = {(r["run"], r["step"]): r["kl_coef"] for r in G.kl_coef_by_step(df, 0.01, 0.3, 10_000).collect()}
    assert got.keys() == want.keys()
    assert [(k, got[k], v) for k, v in want.items() if not math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-300)] == []
    assert want["b", 19] == 0 and min(want.values()) < 0 < max(want.values())
    assert {r["kl_coef"] for r in G.kl_coef_by_step(df, 0.5).collect()} == {0.5}


def test_checkpoint_tracker(spark):
    rng = random.Random(9)
    raw = [(run, i * 5, rng.choice([None, -1.0, 0.2, round(rng.random(), 2)])) for run in ("x", "y", None) for i in range(300)] + [("z", 1, -2.0)]
    df = spark.createDataFrame(raw, "run string, step long, score double").repartition(4)
    want = []
    for run in ("x", "y", None, "z"):
        best, at = -1.0, None
        for _, step, score in (r for r in raw if r[0] == run):
            if score is not None and score > best:
                best, at = score, step
            want.append((run, step, best, at, step))
    got = I.checkpoint_tracker(df).select("run", "step", "best_score", "best_step", "last_step").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def plain_batches(counts, size):
    """(gen, batch) of full batches, by a loop."""
    out, batch, have, own = [], 0, 0, []
    for g, n in sorted(counts.items()):
        own.append(g)
        have += n
        if have >= size:
            out += [(x, batch) for x in own]
            batch, have, own = batch + 1, 0, []
    return out


def test_batch_starts_of_many_generations(spark):
    """20,000 generation batches of any numbering: pointers double, nothing is folded in one task."""
    rng = random.Random(10)
    counts = {3 * g - 50: rng.choice([1, 1, 1, 2, 40]) for g in range(20_000)}
    df = spark.createDataFrame(pd.DataFrame({"gen": list(counts), "n": list(counts.values())}))
    groups = df.select("gen", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).select("gen", (F.col("gen") * 100 + F.col("k")).alias("uid")).withColumn("arrival", F.col("uid"))
    got = G.fill_batches(groups, 32)
    assert sorted({(r["gen"], r["batch"]) for r in got.select("gen", "batch").distinct().collect()}) == sorted(plain_batches(counts, 32))
    assert got.groupBy("batch").count().where("count <> 32").count() == 0
    assert G.fill_batches(groups.where("gen < 0"), 10_000).count() == 0 and G.fill_batches(groups.limit(0), 4).count() == 0


def test_moments_far_from_zero(spark):
    """Equal to two passes at a mean of 10^8."""
    rng = np.random.default_rng(12)
    raw = [(i, (1e8 + rng.standard_normal(9)).tolist(), (rng.random(9) < 0.7).astype(float).tolist()) for i in range(300)] + [(300, [], []), (301, [5.0], [0.0])]
    df = spark.createDataFrame(raw, "i int, x array<double>, mask array<double>").repartition(4)
    x = np.concatenate([np.array(v)[np.array(m) > 0] for _, v, m in raw if v])
    r = G.masked_moments(df, "x", "mask").first()
    assert r["n"] == len(x) and math.isclose(r["mean"], x.mean(), rel_tol=1e-14) and math.isclose(r["var"], x.var(ddof=1), rel_tol=1e-6)
    white = np.concatenate([np.array(r["w"])[np.array(r["mask"]) > 0] for r in G.masked_whiten(df, "x", "mask", "w").collect() if r["w"]])
    assert abs(white.mean()) < 1e-6 and abs(white.var(ddof=1) - 1) < 1e-6
    alone = G.masked_moments(df.where("i = 301"), "x", "mask").first()
    assert alone["n"] == 0 and alone["mean"] is None


def test_exact_quantiles(spark):
    """Against numpy: distinct, repeated, skewed and few values; a sketch too coarse for its ranks; no map of values."""
    rng = np.random.default_rng(13)
    groups = {"normal": rng.standard_normal(60_000), "ties": rng.integers(0, 5, 20_000).astype(float), "heavy": rng.pareto(0.3, 20_000), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(500, 7.0), "wide": np.concatenate([np.full(9_000, -1e300), np.full(1_000, 1e300)])}
    pdf = pd.DataFrame({"g": np.repeat(list(groups), [len(v) for v in groups.values()]), "x": np.concatenate(list(groups.values()))})
    df = spark.createDataFrame(pdf).repartition(5).unionByName(spark.createDataFrame([("none", None), ("one", None), (None, 3.0)], "g string, x double"))
    points = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
    for accuracy in (10_000, 20):
        got = {r["g"]: r["p"] for r in C.exact_quantiles(df, "x", "g", points, accuracy).collect()}
        assert set(got) == {*groups, None} and got[None] == [3.0] * 6
        for g, v in groups.items():
            assert np.allclose(got[g], np.quantile(v, points), rtol=1e-12), (g, accuracy)
    stats = {r["g"]: r for r in C.length_stats(df, "x", "g").collect()}
    assert stats["two"]["p50"] == 2.5 and stats["two"]["n"] == 2 and "none" not in stats


def test_reports_by_run(spark):
    """Each run's report is that of its rows alone; candidates are dealt out by problem once."""
    rng = random.Random(14)
    raw = [(f"run{u % 3}", u // 3, k, rng.choice(["1", "2", " 2", "", None]), str(u % 2 + 1), rng.choice([0.0, 1.0, None]), rng.choice([0.0, 1.0]), rng.choice([None, 0.5, 0.9]), rng.randrange(90)) for u in range(90) for k in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(raw, "run string, uid long, candidate_index long, boxed_answer string, gold string, accuracy double, format_rate double, train_reward_v1 double, response_length long").repartition(3)
    for report in (E.full_report, E.eval_report):
        every = {r["run"]: r for r in report(df, run="run").collect()}
        assert len(every) == 3
        for run, r in every.items():
            alone = report(df.where(F.col("run") == run)).first().asDict()
            assert {k: round(v, 12) for k, v in alone.items()} == {k: round(r[k], 12) for k in alone}
    best = {(r["run"], r["uid"]): r["candidate_index"] for r in E.select_best(df, ("run", "uid")).collect()}
    assert len(best) == 90 and {(r["run"], r["uid"]): r["maj_at_k"] for r in E.maj_at_k(df, ("run", "uid")).collect()}.keys() == best.keys() == {(r["run"], r["uid"]) for r in E.pass_at_k(df, ("run", "uid")).collect()}
    out = E.full_report(df, run="run")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len([x for x in final.splitlines() if "Exchange hashpartitioning(run" in x and "uid" in x]) == 1 and "Join" not in final


def test_comparison_rounds_like_sql(spark):
    """Halves, negative and large numbers as DuckDB rounds and prints them; what is missing is shown as such."""
    import duckdb

    values = [476.39 / 200, 467.07 / 120, 0.00005, 0.00015, 2.5, -476.39 / 200, -0.00003, 1 / 3, 123456.78905, 1e13 + 0.25, 0.0]
    rows = spark.createDataFrame([(f"r{i}", 1, v, v, v) for i, v in enumerate(values)], "run string, step long, accuracy double, format_rate double, train_reward_v1 double")
    base = spark.createDataFrame([(values[0], values[1], None, 3)], "accuracy double, format_rate double, train_reward_v1 double, count long")
    want = {f"r{i}": duckdb.execute("SELECT printf('%.4f', round(?::DOUBLE, 4))", [v]).fetchone()[0] for i, v in enumerate(values)}
    names = spark.createDataFrame([(r,) for r in [*want, "none"]], "run string")
    got = {r["run"]: r for r in I.compare_runs(names, rows, base=base).collect()}
    assert {r: got[r]["accuracy"] for r in want} == {r: got[r]["train_reward_v1"] for r in want} == want
    assert got["none"]["accuracy"] == got["none"]["accuracy_drop"] == got["base"]["train_reward_v1"] == "-"
    assert (got["base"]["accuracy"], got["base"]["format_rate"], got["base"]["count"]) == ("2.3819", "3.8923", "3")


def test_many_batches_are_balanced_together(spark, monkeypatch):
    """Batches of equal size are solved as one matrix, with the parts that each has alone; odd ones, a null key and groups that go over several Arrow batches come along."""
    rng = np.random.default_rng(3)
    for top in (1, 3, 50, 30000):
        for n, k in ((8, 8), (24, 8), (13, 5), (9, 1)):
            x = rng.integers(0, top, (20, n))
            for equal in {False, n % k == 0}:
                assert B._differencing_all(x, k, equal).tolist() == [B._labels(B._differencing(r, k, equal), n).tolist() for r in x.tolist()]
                assert B._greedy_all(x, k, equal).tolist() == [B._labels(B._greedy(r, k, equal), n).tolist() for r in x.tolist()]
    sizes = {**{f"b{i}": 16 + 8 * (i % 2) for i in range(60)}, "large": 1200, "odd": 40, None: 16}
    data = [(b, i, int(v)) for b, n in sizes.items() for i, v in enumerate(rng.integers(1, 90, n))]
    df = spark.createDataFrame(data, "batch string, row long, tokens long").repartition(7, "row")
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for out, alone in ((B.balance_partitions(df, 8, True), lambda x: B._differencing(x, 8, True)), (B.balance_partitions(df, 4), lambda x: B._differencing(x, 4, False)), (B.greedy_partitions(df, 8, True), lambda x: B._greedy(x, 8, True))):
            assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
            got: dict = {}
            for r in out.collect():
                got.setdefault(r["batch"], {})[r["row"]] = (r["tokens"], r["part"])
            assert {b: len(g) for b, g in got.items()} == sizes
            for g in got.values():
                x = [g[i][0] for i in range(len(g))]
                assert [g[i][1] for i in range(len(g))] == B._labels(alone(x), len(x)).tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="null tokens"):
        B.greedy_partitions(df.withColumn("tokens", F.nullif("tokens", F.lit(5))), 8).collect()
