"""Rollout groups and token arithmetic. Sequences are ragged arrays; a group's rows share ``uid``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from verdata.operators.numbering import number_rows, prefix_scan
from verdata.plans.storage import drop, materialize

_EPS = 1e-6


def _spread(df: DataFrame, value: Column, mask: str | None, name: str) -> DataFrame:
    return df.withColumn(name, F.transform(mask, lambda m: value * m) if mask else value)


def grpo_advantage(df: DataFrame, by: str = "uid", score: str = "score", mask: str | None = None, eps: float = _EPS, name: str = "advantage") -> DataFrame:
    """(score - group mean) / (sample deviation + eps); rows of a group of one get null."""
    w = Window.partitionBy(by)
    return _spread(df, (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps), mask, name)


def grpo_passk_advantage(df: DataFrame, by: str = "uid", score: str = "score", index: str = "candidate_index", mask: str | None = None, eps: float = _EPS, name: str = "advantage") -> DataFrame:
    """Only the best row of a group gets something: (best - second) / (deviation + eps)."""
    w = Window.partitionBy(by)
    top = w.orderBy(F.desc(score), index)
    value = F.when(F.row_number().over(top) == 1, (F.col(score) - F.lead(score).over(top)) / (F.stddev_samp(score).over(w) + eps)).otherwise(0.0)
    return _spread(df, value, mask, name)


def rloo_advantage(df: DataFrame, by: str = "uid", score: str = "score", mask: str | None = None, name: str = "advantage") -> DataFrame:
    """score - mean of the group's others; null in a group of one."""
    w = Window.partitionBy(by)
    n = F.count(score).over(w)
    others = F.when(n > 1, (F.sum(score).over(w) - F.col(score)) / (n - 1))
    return _spread(df, F.col(score) - others, mask, name)


def _scan(df: DataFrame, inputs: list[str], outputs: list[str], step) -> DataFrame:
    """Backward recurrences: rows of an Arrow batch are padded to one matrix, and ``step`` walks over time with all rows at once.

    Only the inputs go to Python; the other columns stay where they are.
    """
    @F.pandas_udf(StructType([StructField(o, ArrayType(DoubleType())) for o in outputs]))
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame[inputs[0]].map(len).to_numpy(int) if len(frame) else np.zeros(0, int)
        grids = []
        for c in inputs:
            g = np.zeros((len(frame), int(n.max(initial=0))))
            for i, row in enumerate(frame[c]):
                g[i, : n[i]] = row
            grids.append(g)
        return pd.DataFrame({o: [r[:k] for r, k in zip(g, n)] for o, g in zip(outputs, step(*grids))})
    return df.withColumn("_scanned", run(F.struct(*inputs))).select(*df.columns, *[F.col(f"_scanned.{o}").alias(o) for o in outputs])


def discounted_returns(df: DataFrame, rewards: str, mask: str, gamma: float, name: str = "returns") -> DataFrame:
    """Return-to-go that starts anew after each masked token."""
    def step(r, m):
        out, run = np.zeros_like(r), np.zeros(len(r))
        for t in reversed(range(r.shape[1])):
            out[:, t] = run = r[:, t] + gamma * run
            run = run * m[:, t]
        return (out,)
    return _scan(df, [rewards, mask], [name], step)


def reinforce_pp(df: DataFrame, rewards: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """``returns``, and ``advantages``: the returns whitened over all valid tokens. The recurrence runs once, into a written table that whitening reads."""
    return masked_whiten(materialize(discounted_returns(df, rewards, mask, gamma)), "returns", mask, "advantages")


def remax_advantage(df: DataFrame, baselines: DataFrame, rewards: str, mask: str, by: str = "uid", baseline: str = "baseline") -> DataFrame:
    """``advantages``: (sum of rewards - baseline) on valid tokens; ``returns``: sums of what is still to come."""
    joined = df.join(baselines.select(by, baseline), by)
    joined = discounted_returns(joined.withColumn("_r", F.zip_with(rewards, mask, lambda x, m: x * m)), "_r", mask, 1.0, "_togo")
    total = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)
    out = joined.withColumn("advantages", F.transform(mask, lambda m: (total - F.col(baseline)) * m)).withColumn("returns", F.zip_with("_togo", mask, lambda x, m: x * m))
    return out.drop("_r", "_togo")


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantages by row: masked tokens are skipped and repeat the next valid token's; ``returns`` = advantages + values; ``advantages`` whitened."""
    def step(r, v, m):
        raw, last, after = np.zeros_like(r), np.zeros(len(r)), np.zeros(len(r))
        for t in reversed(range(r.shape[1])):
            new = r[:, t] + gamma * after - v[:, t] + gamma * lam * last
            last = np.where(m[:, t] > 0, new, last)
            after = np.where(m[:, t] > 0, v[:, t], after)
            raw[:, t] = last
        return raw, raw + v
    return masked_whiten(materialize(_scan(df, [rewards, values, mask], ["raw_advantages", "returns"], step)), "raw_advantages", mask, "advantages").drop("raw_advantages")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _masked(values, mask) -> Column:
    return _sum(F.zip_with(values, mask, lambda x, m: x * m))


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: ``n``, ``mean`` and ``var`` (Bessel's correction) over all valid tokens (mask above 0); null where there are too few.

    One pass: count, mean and squared deviations of parts are merged pairwise, which loses nothing where the mean is large against the deviation.
    """
    valid = df.select(F.explode(F.arrays_zip(F.col(values).alias("x"), F.col(mask).alias("m"))).alias("t")).where(F.col("t.m") > 0).select("t.x")
    return valid.agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def masked_whiten(df: DataFrame, values: str, mask: str, name: str, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over all valid tokens; the moments are one broadcast row from one scan."""
    m = masked_moments(df, values, mask).select(F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    return df.crossJoin(F.broadcast(m)).withColumn(name, F.transform(values, lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + eps))).drop("_mean", "_var")


def average_loss(values: Column, mask: Column, mode: str = "token", eps: float = 1e-8) -> Column:
    """Aggregate: the mean over all valid tokens, or the mean of the sequences' means."""
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    total = _masked(values, mask)
    if mode == "token":
        return F.sum(total) / (F.sum(n) + eps)
    if mode == "seq":
        return F.avg(total / (n + eps))
    raise ValueError(f"unknown mode: {mode}")


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def kl(log_probs: Column, ref_log_probs: Column, kind: str = "kl") -> Column:
    """Divergence by token; ``full`` takes arrays of distributions and sums over the last axis."""
    if kind == "full":
        return F.zip_with(log_probs, ref_log_probs, lambda p, q: _sum(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b))))

    def one(a, b):
        if kind == "kl":
            return a - b
        if kind == "abs":
            return F.abs(a - b)
        if kind == "mse":
            return 0.5 * (a - b) * (a - b)
        if kind == "low_var_kl":
            d = _clamp(b - a, -20, 20)
            return _clamp(F.exp(d) - d - 1, -10, 10)
        raise ValueError(f"unknown kind: {kind}")
    return F.zip_with(log_probs, ref_log_probs, one)


def apply_kl_penalty(df: DataFrame, scores: str, log_probs: str, ref_log_probs: str, mask: str, coef: float, kind: str = "kl") -> DataFrame:
    """``token_level_rewards`` = scores - coef * KL * mask, and ``row_kl``, the row's masked mean of KL (whose average is the batch's metric)."""
    df = df.withColumn("_kl", F.zip_with(kl(F.col(log_probs), F.col(ref_log_probs), kind), mask, lambda x, m: x * m))
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    return df.withColumn("token_level_rewards", F.zip_with(scores, "_kl", lambda s, k: s - coef * k)).withColumn("row_kl", _sum(F.col("_kl")) / (n + 1e-8)).drop("_kl")


def kl_coef_by_step(steps: DataFrame, init: float, target: float | None = None, horizon: float | None = None, by: str = "run", step: str = "step", current: str = "kl", n: str = "n_steps") -> DataFrame:
    """``kl_coef`` in force before each step; without a target it stays.

    The product of the multipliers before a step comes of three running values: how many are 0, how many are negative, and the logarithms' sum. These are associative,
    so range partitions of the steps are scanned on their own and no task holds a run. Steps without a current value change nothing.
    """
    if target is None:
        return steps.withColumn("kl_coef", F.lit(init))
    m = F.when(F.col(current).isNotNull(), 1 + _clamp(F.col(current) / target - 1, -0.2, 0.2) * F.col(n) / horizon)
    scans = {"_zero": (F.sum, (m == 0).cast("long")), "_less": (F.sum, (m < 0).cast("long")), "_log": (F.sum, F.when(m != 0, F.ln(F.abs(m))))}
    out = prefix_scan(steps, [by], [F.col(step)], scans, inclusive=False)
    sign = F.when(F.coalesce("_zero", F.lit(0)) > 0, 0.0).when(F.coalesce("_less", F.lit(0)) % 2 == 1, -1.0).otherwise(1.0)
    return out.withColumn("kl_coef", init * sign * F.exp(F.coalesce("_log", F.lit(0.0)))).drop(*scans)


def filter_groups(df: DataFrame, key: str = "accuracy", low: float = 0.01, high: float = 0.99, by: str = "uid") -> DataFrame:
    """Groups whose mean lies strictly between the bounds."""
    w = Window.partitionBy(by)
    return df.withColumn("_mean", F.avg(key).over(w)).where((F.col("_mean") > low) & (F.col("_mean") < high)).drop("_mean")


def _batch_starts(counts: DataFrame, batch_groups: int) -> DataFrame:
    """``i, last, batch``: the generation batches that begin a train batch, with the one that fills it (null: none does), numbered. ``counts``: ``i`` (0, 1, ...), ``n`` and ``before`` (the sum of earlier n).

    A train batch that begins with i ends with the first j whose running sum reaches ``before(i) + batch_groups``; the next begins with j + 1. Sums and what is to be reached are sorted
    together, and a running minimum from the top finds j. The beginnings are then the nodes on the path from 0 along these pointers: in each round pointers get twice as long, and every
    known beginning finds another one that much further on, so there are as many rounds as the logarithm of the number of batches, each written.
    """
    sums = counts.select((F.col("before") + F.col("n")).alias("v"), F.lit(0).alias("kind"), "i", F.col("i").alias("there"))
    asked = counts.select((F.col("before") + batch_groups).alias("v"), F.lit(1).alias("kind"), "i", F.lit(None).cast("long").alias("there"))
    ends = prefix_scan(sums.union(asked), [], [F.desc("v"), F.col("kind"), F.desc("i")], {"last": (F.min, F.col("there"))}).where("kind = 1").select("i", "last")
    ends = materialize(ends)
    jumps = materialize(ends.where("last is not null").select(F.col("i").alias("a"), (F.col("last") + 1).alias("b")))
    known, step = materialize(ends.where("i = 0").select("i", F.lit(0).cast("long").alias("batch"))), 1
    while True:
        more = known.join(jumps, F.col("i") == F.col("a")).select(F.col("b").alias("i"), (F.col("batch") + step).alias("batch"))
        new = materialize(known.union(more))
        if new.count() == known.count():
            drop(new)
            return known.join(ends, "i").select("i", "last", "batch")
        longer = materialize(jumps.join(jumps.select(F.col("a").alias("c"), F.col("b").alias("d")), F.col("b") == F.col("c")).select("a", F.col("d").alias("b")))
        drop(known, jumps)
        known, jumps, step = new, longer, 2 * step


def fill_batches(groups: DataFrame, batch_groups: int, max_tries: int = 0, gen: str = "gen", arrival: str = "arrival", by: str = "uid") -> DataFrame:
    """Train batches from kept groups in order of arrival. ``groups``: one row for each kept group with its generation batch.

    Each batch takes ``batch_groups`` groups and drops the surplus of the generation batch that completes it. So a batch starts with the
    generation batch after its predecessor's last one. With ``max_tries`` > 0, more generation batches than that for one train batch are an error.
    Only counts for each generation batch decide; where batches begin is found by doubling pointers (see :func:`_batch_starts`), and a running maximum deals out the others.
    """
    counts = groups.where(F.col(gen).isNotNull()).groupBy(F.col(gen).cast("long").alias("gen")).agg(F.count("*").alias("n"))
    counts = materialize(number_rows(counts, [], [F.col("gen")], "i", "n", "before"))
    starts = materialize(_batch_starts(counts, batch_groups))
    if max_tries > 0:
        many = counts.count()
        # The batch that isn't full yet has tried all that is left.
        tries = F.when(F.col("last").isNull(), F.lit(many) - F.col("i") + 1).otherwise(F.col("last") - F.col("i") + 1)
        if starts.where(tries > max_tries).limit(1).count():
            raise ValueError(f"no full batch after {max_tries} generation batches")
    begun = counts.join(starts.select(F.col("i").alias("_i"), "batch"), F.col("i") == F.col("_i"), "left")
    table = prefix_scan(begun, [], [F.col("i")], {"_batch": (F.max, F.col("batch"))})
    full = starts.where("last is not null").select(F.col("batch").alias("_full"))
    table = table.join(full, F.col("_batch") == F.col("_full")).select(F.col("gen").alias("_gen"), F.col("_batch").alias("batch"))
    rows = groups.join(table, F.col(gen) == F.col("_gen"))
    w = Window.partitionBy("batch").orderBy(arrival)  # a batch's generation batches: a few thousand groups at most
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= batch_groups).drop("_gen")


def policy_loss(df: DataFrame, loss_type: str = "default", clip_low: float = 0.2, clip_high: float = 0.3, clip_dual: float = 3.0, tau_positive: float = 1.0, tau_negative: float = 1.05,
                mode: str = "token", log_probs: str = "log_probs", old: str = "old_log_probs", advantages: str = "advantages", mask: str = "mask") -> DataFrame:
    """One row of diagnostics of the clipped objective over logged log-probabilities (values, no gradients)."""
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    df = df.withColumn("_d", F.zip_with(log_probs, old, lambda a, b: a - b))
    if loss_type in ("gspo", "gspo_token"):
        mean = _masked("_d", mask) / (n + 1e-8)
        df = df.withColumn("_mean", mean).withColumn("_log", F.transform(mask, lambda m: F.col("_mean") * (m if loss_type == "gspo" else F.lit(1.0))))
    else:
        df = df.withColumn("_log", F.col("_d"))
    low, high = float(np.log(1 - clip_low)), float(np.log(1 + clip_high))
    df = df.withColumn("_t", F.transform("_log", lambda x: F.struct(F.exp(_clamp(x, -20, 20)).alias("r"), F.exp(_clamp(x, low, high)).alias("c"))))
    df = df.withColumn("_t", F.arrays_zip("_t", F.col(advantages).alias("a"), F.col(log_probs).alias("lp")))
    r, c, a, lp = (lambda x: x["_t"]["r"]), (lambda x: x["_t"]["c"]), (lambda x: x["a"]), (lambda x: x["lp"])
    higher = lambda x: F.greatest(-a(x) * r(x), -a(x) * c(x))
    if loss_type == "cispo":
        loss = lambda x: -a(x) * lp(x) * c(x)
    elif loss_type == "sapo":
        gate = lambda x, tau: 4.0 / tau / (1 + F.exp(-tau * (r(x) - 1.0)))
        loss = lambda x: -a(x) * F.when(a(x) >= 0, gate(x, tau_positive)).otherwise(gate(x, tau_negative))
    else:
        loss = lambda x: F.when(a(x) < 0, F.least(higher(x), -a(x) * clip_dual)).otherwise(higher(x))
    mean_of = lambda f: average_loss(F.transform("_t", f), F.col(mask))
    out = [average_loss(F.transform("_t", loss), F.col(mask), mode).alias("pg_loss"), average_loss(F.transform("_t", lambda x: -lp(x)), F.col(mask), mode).alias("entropy_loss"),
           average_loss(F.transform("_d", lambda x: -x), F.col(mask)).alias("ppo_kl")]
    if loss_type not in ("cispo", "sapo"):
        out += [mean_of(lambda x: (-a(x) * r(x) < -a(x) * c(x)).cast("double")).alias("pg_clipfrac_higher"),
                mean_of(lambda x: ((higher(x) > -a(x) * clip_dual) & (a(x) < 0)).cast("double")).alias("pg_clipfrac_lower")]
    return df.agg(*out)


def value_loss(df: DataFrame, cliprange: float, mode: str = "token", vpreds: str = "vpreds", returns: str = "returns", values: str = "values", mask: str = "mask") -> DataFrame:
    """One row: clipped value loss, how often the clip decides, mean prediction."""
    t = F.arrays_zip(F.col(vpreds).alias("p"), F.col(returns).alias("r"), F.col(values).alias("v"))
    clipped = lambda x: F.least(F.greatest(x["p"], x["v"] - cliprange), x["v"] + cliprange)
    plain = lambda x: (x["p"] - x["r"]) * (x["p"] - x["r"])
    other = lambda x: (clipped(x) - x["r"]) * (clipped(x) - x["r"])
    m = F.col(mask)
    return df.withColumn("_t", t).agg((0.5 * average_loss(F.transform("_t", lambda x: F.greatest(plain(x), other(x))), m, mode)).alias("vf_loss"),
                                      average_loss(F.transform("_t", lambda x: (plain(x) < other(x)).cast("double")), m).alias("vf_clipfrac"), average_loss(F.col(vpreds), m).alias("vpred_mean"))


def weighted_loss(df: DataFrame, by: str, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """Shard losses combined by their tokens."""
    return df.groupBy(by).agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("loss"))
