"""Queries over ``sequences``, ``candidates`` and ``run_log``: token arithmetic, batch algebra, balancing, metrics and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdata.operators import balance as B
from verdata.operators import batches as K
from verdata.operators import metrics as M
from verdata.operators import rewards as R
from verdata.operators import rollouts as G
from verdata.operators import runs as I
from verdata.operators.numbering import number_rows
from verdata.plans.fixtures import sequences, view, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return fn
    return add


def _cand(spark, sf_dir):
    return view(spark, sf_dir, "candidates").withColumn("score", F.col("train_reward_v1"))


def _total(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _weighted(c):
    """A sum that depends on the order of an array's elements."""
    return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


_W = "OVER (PARTITION BY uid)"


@query("d7_token_rewards", "SELECT seq_id, CAST(7 + seq_id % 57 AS BIGINT) AS place, CAST(seq_id % 5 AS DOUBLE) AS total FROM (SELECT DISTINCT seq_id FROM tokens)", "tokens")
def d7(spark, sf_dir):
    r = sequences(spark, sf_dir).select("seq_id", R.token_rewards(F.expr("seq_id % 5 + 1"), F.col("mask")).alias("r"))
    return r.select("seq_id", F.expr("array_position(transform(r, v -> v > 0), true) - 1").alias("place"), (_total("r") - 1).alias("total"))


@query("g1_grpo", f"SELECT uid, candidate_index, round((train_reward_v1 - avg(train_reward_v1) {_W}) / (stddev_samp(train_reward_v1) {_W} + 1e-6), 6) + 0.0 AS advantage FROM candidates", "candidates")
def g1(spark, sf_dir):
    return G.grpo_advantage(_cand(spark, sf_dir)).select("uid", "candidate_index", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("g2_grpo_passk", f"""SELECT uid, candidate_index, round(CASE WHEN p = 1 THEN (s - nxt) / (sd + 1e-6) ELSE 0.0 END, 6) AS advantage FROM (SELECT uid, candidate_index, train_reward_v1 AS s, stddev_samp(train_reward_v1) {_W} AS sd,
 row_number() OVER o AS p, lead(train_reward_v1) OVER o AS nxt FROM candidates WINDOW o AS (PARTITION BY uid ORDER BY train_reward_v1 DESC, candidate_index))""", "candidates")
def g2(spark, sf_dir):
    return G.grpo_passk_advantage(_cand(spark, sf_dir)).select("uid", "candidate_index", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("g3_rloo", f"SELECT uid, candidate_index, round(train_reward_v1 - CASE WHEN count(*) {_W} > 1 THEN (sum(train_reward_v1) {_W} - train_reward_v1) / (count(*) {_W} - 1) END, 6) + 0.0 AS advantage FROM candidates", "candidates")
def g3(spark, sf_dir):
    return G.rloo_advantage(_cand(spark, sf_dir)).select("uid", "candidate_index", (F.round("advantage", 6) + 0.0).alias("advantage"))


_TOGO = "sum(score) OVER (PARTITION BY seq_id ORDER BY pos DESC)"
_WHITE = "(r - (SELECT sum(r * mask) / sum(mask) FROM t)) / sqrt((SELECT sum(mask * (r - m) * (r - m)) / (sum(mask) - 1) FROM t, (SELECT sum(r * mask) / sum(mask) AS m FROM t) mm) + 1e-8)"


@query("g4_reinforce_pp", f", t AS (SELECT *, {_TOGO} AS r FROM tokens) SELECT seq_id, round(sum(r * (pos + 1)), 6) AS returns, round(sum(({_WHITE}) * mask), 6) AS advantages FROM t GROUP BY seq_id", "tokens")
def g4(spark, sf_dir):
    out = G.reinforce_pp(sequences(spark, sf_dir), "scores", "mask", 1.0)
    return out.select("seq_id", F.round(_weighted("returns"), 6).alias("returns"), F.round(_total(F.zip_with("advantages", "mask", lambda a, m: a * m)), 6).alias("advantages"))


@query("g4_reinforce_pp_discounted")
def g4d(spark, sf_dir):
    return G.reinforce_pp(sequences(spark, sf_dir), "scores", "mask", 0.97).select("seq_id", F.round(_weighted("returns"), 6).alias("returns"))


@query("g5_remax", """SELECT seq_id, round(sum(mask * (tot - base)), 6) AS advantages, round(sum(togo * mask), 6) AS returns FROM (SELECT t.*, sum(score) OVER (PARTITION BY t.seq_id) AS tot, b.base, sum(score * mask) OVER (PARTITION BY t.seq_id ORDER BY pos DESC) AS togo
 FROM tokens t JOIN (SELECT uid, CAST(uid % 3 AS DOUBLE) / 2 AS base FROM (SELECT DISTINCT uid FROM tokens)) b ON t.uid = b.uid) GROUP BY seq_id""", "tokens")
def g5(spark, sf_dir):
    s = sequences(spark, sf_dir)
    base = s.select("uid").distinct().withColumn("baseline", F.expr("double(uid % 3) / 2"))
    out = G.remax_advantage(s, base, "scores", "mask")
    return out.select("seq_id", F.round(_total("advantages"), 6).alias("advantages"), F.round(_total("returns"), 6).alias("returns"))


@query("g6_gae")
def g6(spark, sf_dir):
    out = G.gae(sequences(spark, sf_dir), "scores", "values", "mask", 0.99, 0.95)
    return out.select("seq_id", F.round(_weighted("advantages"), 6).alias("advantages"), F.round(_weighted("returns"), 6).alias("returns"))


# With gamma = lambda = 1 the advantage is the reward to come less the value: no recurrence is left.
@query("g6_gae_undiscounted", ", t AS (SELECT *, CASE WHEN mask > 0 THEN sum(score) OVER (PARTITION BY seq_id ORDER BY pos DESC) - value END AS a FROM tokens) SELECT seq_id, round(sum(a + value), 6) AS returns FROM t WHERE mask > 0 GROUP BY seq_id", "tokens")
def g6u(spark, sf_dir):
    out = G.gae(sequences(spark, sf_dir), "scores", "values", "mask", 1.0, 1.0)
    return out.select("seq_id", F.round(_total(F.zip_with("returns", "mask", lambda x, m: x * m)), 6).alias("returns"))


@query("g7_masked_moments", ", t AS (SELECT x2 AS r, mask FROM (SELECT value * 2 AS x2, mask FROM tokens)) SELECT round(sum(mask), 6) AS n, round(sum(r * mask) / sum(mask), 6) AS mean, round((SELECT sum(mask * (r - m) * (r - m)) / (sum(mask) - 1) FROM t, (SELECT sum(r * mask) / sum(mask) AS m FROM t) mm), 6) AS var FROM t", "tokens")
def g7(spark, sf_dir):
    return _rounded(G.masked_moments(sequences(spark, sf_dir), "x", "mask"))


@query("g7_average_loss", "SELECT round(sum(value * mask) / (sum(mask) + 1e-8), 6) AS token, round((SELECT avg(l) FROM (SELECT sum(value * mask) / (sum(mask) + 1e-8) AS l FROM tokens GROUP BY seq_id)), 6) AS seq FROM tokens", "tokens")
def g7l(spark, sf_dir):
    v, m = F.col("values"), F.col("mask")
    return _rounded(sequences(spark, sf_dir).agg(G.average_loss(v, m).alias("token"), G.average_loss(v, m, "seq").alias("seq")))


_LOW = "least(greatest(exp(least(greatest(ref_log_prob - log_prob, -20), 20)) - least(greatest(ref_log_prob - log_prob, -20), 20) - 1, -10), 10)"


@query("g8_kl", f"SELECT seq_id, round(sum(log_prob - ref_log_prob), 6) AS kl, round(sum(abs(log_prob - ref_log_prob)), 6) AS abs, round(sum(0.5 * (log_prob - ref_log_prob) * (log_prob - ref_log_prob)), 6) AS mse, round(sum({_LOW}), 6) AS low_var_kl FROM tokens GROUP BY seq_id", "tokens")
def g8(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", *[F.round(_total(G.kl(F.col("log_probs"), F.col("ref_log_probs"), k)), 6).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")])


@query("g8_kl_full", "SELECT seq_id, round(sum(exp(log_prob) * (log_prob - ref_log_prob)), 6) AS full_kl FROM tokens GROUP BY seq_id", "tokens")
def g8f(spark, sf_dir):
    one = G.kl(F.array("log_probs"), F.array("ref_log_probs"), "full")
    return sequences(spark, sf_dir).select("seq_id", F.round(one[0], 6).alias("full_kl"))


@query("g9_apply_kl_penalty", "SELECT seq_id, round(sum((score - 0.1 * (log_prob - ref_log_prob) * mask) * (pos + 1)), 6) AS rewards, round(sum((log_prob - ref_log_prob) * mask) / (sum(mask) + 1e-8), 6) AS row_kl FROM tokens GROUP BY seq_id", "tokens")
def g9(spark, sf_dir):
    out = G.apply_kl_penalty(sequences(spark, sf_dir), "scores", "log_probs", "ref_log_probs", "mask", 0.1)
    return out.select("seq_id", F.round(_weighted("token_level_rewards"), 6).alias("rewards"), F.round("row_kl", 6).alias("row_kl"))


@query("g10_kl_coef_by_step", "SELECT run, step, round(0.001 * exp(coalesce(sum(ln(1 + least(greatest(overall_reward / 0.3 - 1, -0.2), 0.2) * 512 / 10000)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 9) AS kl_coef FROM run_log", "run_log")
def g10(spark, sf_dir):
    log = view(spark, sf_dir, "run_log").selectExpr("run", "step", "overall_reward AS kl", "512D AS n_steps")
    return G.kl_coef_by_step(log, 0.001, 0.3, 10000).select("run", "step", F.round("kl_coef", 9).alias("kl_coef"))


@query("g11_filter_groups", f"SELECT uid, candidate_index FROM (SELECT uid, candidate_index, avg(accuracy) {_W} AS a FROM candidates) WHERE a > 0.01 AND a < 0.99", "candidates")
def g11(spark, sf_dir):
    return G.filter_groups(_cand(spark, sf_dir)).select("uid", "candidate_index")


# The batch of each generation batch by a fold in SQL; the last batch counts only if it becomes full.
@query("g12_fill_batches", """, kept AS (SELECT uid, CAST(uid // 64 AS BIGINT) AS gen FROM (SELECT uid FROM candidates GROUP BY uid HAVING avg(accuracy) > 0.01 AND avg(accuracy) < 0.99)),
 counts AS (SELECT gen, n, row_number() OVER (ORDER BY gen) AS i FROM (SELECT gen, count(*) AS n FROM kept GROUP BY gen)),
 fold AS (WITH RECURSIVE f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS gen, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS have
  UNION ALL SELECT c.i, c.gen, CASE WHEN f.have >= 16 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.have >= 16 THEN c.n ELSE f.have + c.n END FROM f JOIN counts c ON c.i = f.i + 1) SELECT * FROM f WHERE i > 0)
SELECT batch, CAST(place AS INTEGER) AS place, uid FROM (SELECT batch, uid, row_number() OVER (PARTITION BY batch ORDER BY uid) AS place, max(have) OVER (PARTITION BY batch) AS have FROM kept JOIN fold ON kept.gen = fold.gen) x WHERE place <= 16 AND have >= 16""", "candidates")
def g12(spark, sf_dir):
    kept = G.filter_groups(_cand(spark, sf_dir)).select("uid").distinct()
    return G.fill_batches(kept.selectExpr("uid", "uid AS arrival", "bigint(uid div 64) AS gen"), 16).select("batch", "place", "uid")


_PG = """SELECT {loss} AS pg_loss, round(sum(-log_prob * mask) / (sum(mask) + 1e-8), 6) AS entropy_loss, round(sum(-d * mask) / (sum(mask) + 1e-8), 6) AS ppo_kl {more}
FROM (SELECT *, log_prob - old_log_prob AS d, {log} AS lr, exp(least(greatest({log}, -20), 20)) AS r, exp(least(greatest({log}, ln(0.8)), ln(1.3))) AS c FROM {src})"""
_CLIP = ", round(sum(CASE WHEN -adv * r < -adv * c THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS pg_clipfrac_higher, round(sum(CASE WHEN adv < 0 AND greatest(-adv * r, -adv * c) > -adv * 3 THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS pg_clipfrac_lower"
_MEAN = "round(sum(({}) * mask) / (sum(mask) + 1e-8), 6)"
_PPO = _MEAN.format("CASE WHEN adv < 0 THEN least(greatest(-adv * r, -adv * c), -adv * 3) ELSE greatest(-adv * r, -adv * c) END")
_SEQ = "(SELECT *, sum((log_prob - old_log_prob) * mask) OVER (PARTITION BY seq_id) / (sum(mask) OVER (PARTITION BY seq_id) + 1e-8) * mask AS sl FROM tokens)"


def _loss(spark, sf_dir, kind):
    return _rounded(G.policy_loss(sequences(spark, sf_dir), kind))


@query("g13_policy_loss", _PG.format(loss=_PPO, more=_CLIP, log="log_prob - old_log_prob", src="tokens"), "tokens")
def g13(spark, sf_dir):
    return _loss(spark, sf_dir, "default")


@query("g13_policy_loss_gspo", _PG.format(loss=_PPO, more=_CLIP, log="sl", src=_SEQ), "tokens")
def g13g(spark, sf_dir):
    return _loss(spark, sf_dir, "gspo")


@query("g13_policy_loss_cispo", _PG.format(loss=_MEAN.format("-adv * log_prob * c"), more="", log="log_prob - old_log_prob", src="tokens"), "tokens")
def g13c(spark, sf_dir):
    return _loss(spark, sf_dir, "cispo")


@query("g13_policy_loss_sapo", _PG.format(loss=_MEAN.format("-adv * CASE WHEN adv >= 0 THEN 4.0 / (1 + exp(-(r - 1))) ELSE 4.0 / 1.05 / (1 + exp(-1.05 * (r - 1))) END"), more="", log="log_prob - old_log_prob", src="tokens"), "tokens")
def g13s(spark, sf_dir):
    return _loss(spark, sf_dir, "sapo")


_CL = "least(greatest(adv, value - 0.2), value + 0.2)"


@query("g14_value_loss", f"SELECT round(0.5 * sum(greatest((adv - score) * (adv - score), ({_CL} - score) * ({_CL} - score)) * mask) / (sum(mask) + 1e-8), 6) AS vf_loss, round(sum(CASE WHEN (adv - score) * (adv - score) < ({_CL} - score) * ({_CL} - score) THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS vf_clipfrac, round(sum(adv * mask) / (sum(mask) + 1e-8), 6) AS vpred_mean FROM tokens", "tokens")
def g14(spark, sf_dir):
    return _rounded(G.value_loss(sequences(spark, sf_dir), 0.2, vpreds="advantages", returns="scores"))


@query("g15_weighted_loss", "SELECT uid % 10 AS shard, round(sum(train_reward_v1 * response_length) / sum(response_length), 6) AS loss FROM candidates GROUP BY uid % 10", "candidates")
def g15(spark, sf_dir):
    return _rounded(G.weighted_loss(_cand(spark, sf_dir).withColumn("shard", F.col("uid") % 10), "shard", "train_reward_v1", "response_length"), "shard")


def _numbered(spark, sf_dir):
    return number_rows(_cand(spark, sf_dir).select("uid", "candidate_index", "response_length", "accuracy"), [], [F.col("uid"), F.col("candidate_index")], "row")


_ROWS = "r AS (SELECT uid, candidate_index, response_length, accuracy, row_number() OVER (ORDER BY uid, candidate_index) - 1 AS row, count(*) OVER () AS n FROM candidates)"


def _r(sql: str) -> str:
    return with_views("", "candidates").rstrip() + ", " + _ROWS + " " + sql


@query("k1_columns", "SELECT uid AS problem, candidate_index, accuracy FROM candidates", "candidates")
def k1(spark, sf_dir):
    taken, rest = K.pop_cols(_cand(spark, sf_dir), ["accuracy", "not there"], keep=("uid", "candidate_index"))
    assert "accuracy" not in rest.columns
    return K.rename_cols(K.select_cols(taken, ["uid", "candidate_index", "accuracy", "nothing"]), ["uid"], ["problem"])


@query("k2_take_rows", _r("SELECT 'slice' AS kind, row, uid FROM r WHERE row >= 5 AND row < 500 AND (row - 5) % 3 = 0 UNION ALL SELECT 'mask', row, uid FROM r WHERE accuracy > 0 UNION ALL SELECT 'list', r.row, uid FROM r JOIN (SELECT unnest([7, 3, 3, 11]) AS take) t ON r.row = t.take"))
def k2(spark, sf_dir):
    r = _numbered(spark, sf_dir)
    index = spark.createDataFrame([(0, 7), (1, 3), (2, 3), (3, 11)], "pos long, take long")
    parts = (("slice", K.take_rows(r, slice(5, 500, 3), "row")), ("mask", K.take_rows(r, F.col("accuracy") > 0, "row")), ("list", K.take_rows(r, index, "row")))
    return K.concat_rows([df.select(F.lit(n).alias("kind"), "row", "uid") for n, df in parts])


@query("k2_take_from_end", _r("SELECT 'tail' AS kind, row, uid FROM r WHERE row >= n - 40 UNION ALL SELECT 'head', row, uid FROM r WHERE row < n - 7 UNION ALL SELECT 'back', row, uid FROM r WHERE row % 4 = (n - 1) % 4 UNION ALL SELECT 'list', row, uid FROM r WHERE row IN (2, n - 1)"))
def k2n(spark, sf_dir):
    r = _numbered(spark, sf_dir)
    index = spark.createDataFrame([(0, -1), (1, 2)], "pos long, take long")
    parts = (("tail", K.take_rows(r, slice(-40, None), "row")), ("head", K.take_rows(r, slice(None, -7), "row")), ("back", K.take_rows(r, slice(None, None, -4), "row")), ("list", K.take_rows(r, index, "row", n=r.count())))
    return K.concat_rows([df.select(F.lit(n).alias("kind"), "row", "uid") for n, df in parts])


@query("k3_union_columns", _r("SELECT row, uid, accuracy, response_length FROM r"))
def k3(spark, sf_dir):
    r = _numbered(spark, sf_dir)
    return K.union_columns(r.select("row", "uid", "accuracy"), r.select("row", "uid", "response_length"), "row").select("row", "uid", "accuracy", "response_length")


@query("k4_concat_rows", "SELECT uid, candidate_index FROM candidates UNION ALL SELECT uid, candidate_index FROM candidates WHERE accuracy > 0", "candidates")
def k4(spark, sf_dir):
    c = _cand(spark, sf_dir).select("uid", "candidate_index", "accuracy")
    return K.concat_rows([c, c.where("accuracy > 0")]).drop("accuracy")


def _padded_sql(divisor: int) -> str:
    """All rows, and those from the top again until their number divides."""
    return f"p AS (SELECT row, uid, response_length, false AS padded FROM r UNION ALL SELECT row + n, uid, response_length, true FROM r WHERE row < ({divisor} - n % {divisor}) % {divisor}), s AS (SELECT *, count(*) OVER () AS m FROM p)"


def _p(divisor: int, sql: str) -> str:
    return with_views("", "candidates").rstrip() + ", " + _ROWS + ", " + _padded_sql(divisor) + " " + sql


def _padded(spark, sf_dir, divisor):
    return K.pad_rows(_numbered(spark, sf_dir), divisor, "row")


@query("k5_chunk", _p(256, "SELECT row, CAST(floor(row / (m / 8)) AS BIGINT) AS chunk, CAST(floor(row / 32) AS BIGINT) AS part FROM s"))
def k5(spark, sf_dir):
    r = _padded(spark, sf_dir, 256).select("row")
    return K.split(K.chunk(r, 8, "row").withColumnRenamed("chunk", "c"), 32, "row").select("row", F.col("c").alias("chunk"), F.col("chunk").alias("part"))


@query("k6_pad_rows", _p(64, "SELECT row, uid, padded FROM s"))
def k6(spark, sf_dir):
    return _padded(spark, sf_dir, 64).select("row", "uid", "padded")


@query("k7_repeat_rows", _r("SELECT row * 3 + k AS position, row AS aabb, k * n + row AS abab FROM r, (SELECT unnest([0, 1, 2]) AS k) t"))
def k7(spark, sf_dir):
    r = _numbered(spark, sf_dir).select("row")
    a = K.repeat_rows(r, 3, True, "row").select("row", "rep", "position")
    b = K.repeat_rows(r, 3, False, "row").select("row", "rep", F.col("position").alias("abab"))
    return a.join(b, ["row", "rep"]).select("position", F.col("row").alias("aabb"), "abab")


def _batches(spark, sf_dir, size=128):
    """Batches of equal size over all rows; the last is filled up from the top."""
    return _padded(spark, sf_dir, size).selectExpr("row", f"bigint(row div {size}) AS batch", "response_length AS tokens")


@query("j1_balance_partitions")
def j1(spark, sf_dir):
    return B.balance_partitions(_batches(spark, sf_dir), 8, True)


@query("j1_balance_partitions_free")
def j1f(spark, sf_dir):
    return B.balance_partitions(_batches(spark, sf_dir), 8, False)


@query("j1_serpentine", _p(128, "SELECT batch, row, CAST(CASE WHEN t < 8 THEN t ELSE 15 - t END AS BIGINT) AS part FROM (SELECT batch, row, (row_number() OVER (PARTITION BY batch ORDER BY response_length DESC, row) - 1) % 16 AS t FROM (SELECT *, CAST(floor(row / 128) AS BIGINT) AS batch FROM s))"))
def j1s(spark, sf_dir):
    return B.serpentine_partitions(_batches(spark, sf_dir), 8).select("batch", "row", "part")


@query("j2_greedy_partitions")
def j2(spark, sf_dir):
    return B.greedy_partitions(_batches(spark, sf_dir), 8, True)


@query("j3_imbalance", _p(128, """SELECT b.batch, CAST(min AS BIGINT) AS min, CAST(max AS BIGINT) AS max, CAST(max - min AS BIGINT) AS minmax_diff, CAST(balanced_min AS BIGINT) AS balanced_min, CAST(balanced_max AS BIGINT) AS balanced_max, round(mean, 6) AS mean
FROM (SELECT batch, min(s) AS min, max(s) AS max, sum(s) / 8.0 AS mean FROM (SELECT CAST(floor(row / 128) AS BIGINT) AS batch, floor((row % 128) / 16) AS sl, sum(response_length) AS s FROM s GROUP BY ALL) GROUP BY batch) b
JOIN (SELECT batch, min(s) AS balanced_min, max(s) AS balanced_max FROM (SELECT batch, CASE WHEN t < 8 THEN t ELSE 15 - t END AS part, sum(response_length) AS s FROM (SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY response_length DESC, row) - 1) % 16 AS t FROM (SELECT *, CAST(floor(row / 128) AS BIGINT) AS batch FROM s)) GROUP BY ALL) GROUP BY batch) c ON b.batch = c.batch"""))
def j3(spark, sf_dir):
    return B.imbalance(B.serpentine_partitions(_batches(spark, sf_dir), 8), 8).withColumn("mean", F.round("mean", 6))


@query("j4_micro_batches")
def j4(spark, sf_dir):
    return B.micro_batches(_batches(spark, sf_dir), 512)


@query("h1_data_metrics", """, t AS (SELECT seq_id % 5 AS step, seq_id, score, adv, value, value * 2 AS ret, mask FROM tokens), q AS (SELECT step, seq_id, sum(score) AS s FROM t GROUP BY step, seq_id), v AS (SELECT step, avg(adv) AS advantages_mean, max(adv) AS advantages_max, min(adv) AS advantages_min, avg(ret) AS returns_mean,
 max(ret) AS returns_max, min(ret) AS returns_min, avg(value) AS values_mean, max(value) AS values_max, min(value) AS values_min, 1 - var_samp(ret - value) / (var_samp(ret) + 1e-5) AS vf FROM t WHERE mask > 0 GROUP BY step)
SELECT v.step, round(avg(s), 6) AS score_mean, round(max(s), 6) AS score_max, round(min(s), 6) AS score_min, round(any_value(advantages_mean), 6) AS advantages_mean, round(any_value(advantages_max), 6) AS advantages_max, round(any_value(advantages_min), 6) AS advantages_min,
 round(any_value(returns_mean), 6) AS returns_mean, round(any_value(returns_max), 6) AS returns_max, round(any_value(returns_min), 6) AS returns_min, round(any_value(values_mean), 6) AS values_mean, round(any_value(values_max), 6) AS values_max, round(any_value(values_min), 6) AS values_min,
 round(any_value(vf), 6) AS vf_explained_var FROM v JOIN q ON v.step = q.step GROUP BY v.step""", "tokens")
def h1(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("step", F.expr("seq_id % 5")).withColumn("returns", F.col("x")).withColumn("token_level_rewards", F.col("scores")).withColumn("token_level_scores", F.col("scores"))
    return _rounded(M.data_metrics(s, "step").drop("reward_mean", "reward_max", "reward_min"), "step")


@query("h2_length_metrics", """SELECT uid % 10 AS step, round(avg(response_length), 6) AS response_length_mean, CAST(max(response_length) AS DOUBLE) AS response_length_max, CAST(min(response_length) AS DOUBLE) AS response_length_min, round(avg(CAST(response_length = 50 AS DOUBLE)), 6) AS response_length_clip_ratio,
 round(avg(1 + uid % 7), 6) AS prompt_length_mean, CAST(max(1 + uid % 7) AS DOUBLE) AS prompt_length_max, CAST(min(1 + uid % 7) AS DOUBLE) AS prompt_length_min, round(avg(CAST(uid % 7 = 6 AS DOUBLE)), 6) AS prompt_length_clip_ratio FROM candidates GROUP BY uid % 10""", "candidates")
def h2(spark, sf_dir):
    c = _cand(spark, sf_dir).withColumn("step", F.col("uid") % 10).withColumn("prompt_length", 1 + F.col("uid") % 7)
    return _rounded(M.length_metrics(c, "step", 50, 7), "step")


def _timings(spark, sf_dir):
    tokens = _cand(spark, sf_dir).groupBy((F.col("uid") % 10).alias("step")).agg(F.sum("response_length").alias("response_tokens"), F.sum(F.col("response_length") + 1 + F.col("uid") % 7).alias("total_tokens"))
    times = tokens.select("step", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), (F.col("step") + k + 1.5).alias("seconds")) for k, s in enumerate(("gen", "ref", "adv", "step"))])).alias("t")).select("step", "t.*")
    return times, tokens


_TOK = "tk AS (SELECT uid % 10 AS step, sum(response_length) AS rt, sum(response_length + 1 + uid % 7) AS tt FROM candidates GROUP BY uid % 10)"


@query("h3_timing_metrics", with_views("", "candidates").rstrip() + f", {_TOK} SELECT step, section, CAST(step + k + 1.5 AS DOUBLE) AS seconds, round(CASE section WHEN 'gen' THEN (step + k + 1.5) * 1000 / rt WHEN 'step' THEN NULL ELSE (step + k + 1.5) * 1000 / tt END, 6) AS ms_per_token FROM tk, (SELECT unnest(['gen', 'ref', 'adv', 'step']) AS section, unnest([0, 1, 2, 3]) AS k) s")
def h3(spark, sf_dir):
    return M.timing_metrics(*_timings(spark, sf_dir)).withColumn("ms_per_token", F.round("ms_per_token", 6))


@query("h3_throughput", with_views("", "candidates").rstrip() + f", {_TOK} SELECT step, CAST(tt AS BIGINT) AS total_tokens, CAST(step + 4.5 AS DOUBLE) AS time_per_step, round(tt / ((step + 4.5) * 8), 6) AS throughput FROM tk")
def h3t(spark, sf_dir):
    return M.throughput(*_timings(spark, sf_dir), 8).withColumn("throughput", F.round("throughput", 6))


@query("h4_reduce_metrics", "SELECT run, step % 10 AS step, round(avg(overall_reward), 6) AS value FROM run_log GROUP BY run, step % 10", "run_log")
def h4(spark, sf_dir):
    return _rounded(M.reduce_metrics(view(spark, sf_dir, "run_log").selectExpr("run", "step % 10 AS step", "overall_reward AS value"), ("run", "step")), "run", "step")


_MODEL = {"hidden_size": 2048, "vocab_size": 151936, "num_hidden_layers": 36, "num_key_value_heads": 2, "num_attention_heads": 16, "intermediate_size": 11008}
_MOE = {**_MODEL, "moe_intermediate_size": 768, "num_experts_per_tok": 8, "num_experts": 128}


def _mfu(mlp: int) -> str:
    weights = 36 * (mlp + 2048 * (2 * 2048 + 2 * 256)) + 2 * 151936 * 2048
    return f"SELECT uid % 10 AS step, round((6.0 * {weights} * CAST(sum(response_length) AS DOUBLE) + 12.0 * 128 * 16 * 36 * CAST(sum(response_length * response_length) AS DOUBLE)) / 2.5 / 1e12, 6) AS tflops FROM candidates GROUP BY uid % 10"


def _estimate(spark, sf_dir, model):
    c = _cand(spark, sf_dir).selectExpr("uid % 10 AS step", "response_length AS tokens", "2.5D AS seconds")
    return _rounded(M.estimate_mfu(c, "step", model, "seconds", 989.0).select("step", "tflops"), "step")


@query("h5_estimate_mfu", _mfu(2048 * 11008 * 3), "candidates")
def h5(spark, sf_dir):
    return _estimate(spark, sf_dir, _MODEL)


@query("h5_estimate_mfu_moe", _mfu(2048 * 768 * 8 * 3 + 2048 * 128), "candidates")
def h5m(spark, sf_dir):
    return _estimate(spark, sf_dir, _MOE)


def _nested(spark, sf_dir):
    return (
        view(spark, sf_dir, "run_log").withColumn("val", F.when(F.col("is_validation"), F.struct("reward_score", F.col("accuracy").alias("accuracy_reward"), "format_reward", "overall_reward")))
        .withColumn("val_response_length", F.struct((F.col("step") * 1.5).alias("mean"), F.lit(None).cast("double").alias("clip_ratio")))
        .withColumn("actor", F.struct(*[(F.col("overall_reward") / (k + 2)).alias(c) for k, c in enumerate(("kl_loss", "ppo_kl", "pg_clipfrac_higher", "pg_clipfrac_lower", "grad_norm", "lr"))]))
        .select("run", "step", "val", "val_response_length", "actor"))


@query("h6_flatten_metrics", "SELECT run, step, 'val/overall_reward' AS metric, round(overall_reward, 6) AS value FROM run_log WHERE is_validation UNION ALL SELECT run, step, 'val/reward_score', round(reward_score, 6) FROM run_log WHERE is_validation AND reward_score IS NOT NULL UNION ALL SELECT run, step, 'val_response_length/mean', round(step * 1.5, 6) FROM run_log", "run_log")
def h6(spark, sf_dir):
    long = M.flatten_metrics(_nested(spark, sf_dir).select("run", "step", F.struct("val.overall_reward", "val.reward_score").alias("val"), F.struct("val_response_length.mean").alias("val_response_length")), ["run", "step"])
    return long.withColumn("value", F.round("value", 6))


@query("h6_unflatten_metrics", "SELECT run, step, round(overall_reward, 6) AS reward, round(step * CAST(1.5 AS DOUBLE), 6) AS mean FROM run_log", "run_log")
def h6u(spark, sf_dir):
    long = M.flatten_metrics(view(spark, sf_dir, "run_log").select("run", "step", F.struct("overall_reward").alias("a"), F.struct(F.struct((F.col("step") * 1.5).alias("mean")).alias("c")).alias("b")), ["run", "step"])
    wide = M.unflatten_metrics(long, ["run", "step"], ["a/overall_reward", "b/c/mean"])
    return wide.select("run", "step", F.round("a.overall_reward", 6).alias("reward"), F.round("b.c.mean", 6).alias("mean"))


def _val(spark, sf_dir):
    return I.validation_rows(_nested(spark, sf_dir), ("run",)).select("run", "step", "accuracy", "format_rate", "train_reward_v1")


@query("i1_validation_rows", "SELECT run, step, round(accuracy, 6) AS accuracy, round(format_rate, 6) AS format_rate, round(train_reward_v1, 6) AS train_reward_v1 FROM validation", "validation")
def i1(spark, sf_dir):
    return _rounded(_val(spark, sf_dir), "run", "step")


_BEST = "(SELECT *, row_number() OVER (PARTITION BY run ORDER BY train_reward_v1 DESC NULLS LAST, step) AS b, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS l FROM validation)"


@query("i2_best_row", f"SELECT run, step, round(train_reward_v1, 6) AS train_reward_v1 FROM {_BEST} x WHERE b = 1", "validation")
def i2(spark, sf_dir):
    return _rounded(I.best_row(_val(spark, sf_dir), "train_reward_v1").select("run", "step", "train_reward_v1"), "run", "step")


@query("i2_last_row", f"SELECT run, step, round(accuracy, 6) AS accuracy FROM {_BEST} x WHERE l = 1", "validation")
def i2l(spark, sf_dir):
    return _rounded(I.last_row(_val(spark, sf_dir)).select("run", "step", "accuracy"), "run", "step")


_STAB = f"SELECT b.run, b.step AS best_step, l.step AS last_step, b.train_reward_v1 - l.train_reward_v1 AS reward_drop, b.accuracy - l.accuracy AS accuracy_drop, l.format_rate - b.format_rate AS format_change FROM {_BEST} b JOIN {_BEST} l ON b.run = l.run AND b.b = 1 AND l.l = 1"


@query("i3_stability", f"SELECT run, best_step, last_step, round(reward_drop, 6) AS reward_drop, round(accuracy_drop, 6) AS accuracy_drop, round(format_change, 6) AS format_change FROM ({_STAB}) s", "validation")
def i3(spark, sf_dir):
    return _rounded(I.stability(_val(spark, sf_dir)), "run", "best_step", "last_step")


@query("i4_compare_runs", f"""SELECT n.run, coalesce(CAST(s.best_step AS VARCHAR), '-') AS best_step, coalesce(printf('%.4f', round(b.accuracy, 4)), '-') AS accuracy, coalesce(printf('%.4f', round(b.format_rate, 4)), '-') AS format_rate, coalesce(printf('%.4f', round(b.train_reward_v1, 4)), '-') AS train_reward_v1,
 coalesce(CAST(s.last_step AS VARCHAR), '-') AS last_step, coalesce(printf('%.4f', round(s.accuracy_drop, 4)), '-') AS accuracy_drop FROM (SELECT DISTINCT run FROM run_log UNION ALL SELECT 'base') n LEFT JOIN (SELECT * FROM {_BEST} x WHERE b = 1) b ON n.run = b.run LEFT JOIN ({_STAB}) s ON n.run = s.run""", "validation")
def i4(spark, sf_dir):
    names = view(spark, sf_dir, "run_log").select("run").distinct().union(spark.createDataFrame([("base",)], "run string"))
    return I.compare_runs(names, _val(spark, sf_dir))


_LONG = "CAST(step % 97 AS DOUBLE) + CAST(0.5 AS DOUBLE)"
_BASE = "SELECT avg(overall_reward) AS accuracy, avg(format_reward) AS format_rate, max(overall_reward) AS train_reward_v1, count(*) AS count FROM run_log"
_SHOWN = {"best_step": "CAST(s.best_step AS VARCHAR)", "accuracy": "printf('%.4f', round(b.accuracy, 4))", "format_rate": "printf('%.4f', round(b.format_rate, 4))", "train_reward_v1": "printf('%.4f', round(b.train_reward_v1, 4))",
          "mean_response_length": "printf('%.4f', b.step % 97 + 0.5)", "last_step": "CAST(s.last_step AS VARCHAR)", "accuracy_drop": "printf('%.4f', round(s.accuracy_drop, 4))"}


@query("i4_comparison", f"""SELECT 'runs' AS section, n.run, {", ".join(f"coalesce({e}, '-') AS {c}" for c, e in _SHOWN.items())}, '-' AS count
 FROM (SELECT DISTINCT run FROM run_log) n LEFT JOIN (SELECT * FROM {_BEST} x WHERE b = 1) b ON n.run = b.run LEFT JOIN ({_STAB}) s ON n.run = s.run
 UNION ALL SELECT 'base', 'base', '-', printf('%.4f', round(accuracy, 4)), printf('%.4f', round(format_rate, 4)), printf('%.4f', round(train_reward_v1, 4)), '-', '-', '-', CAST(count AS VARCHAR) FROM ({_BASE}) z""", "validation")
def i4b(spark, sf_dir):
    log = view(spark, sf_dir, "run_log")
    base = log.agg(F.avg("overall_reward").alias("accuracy"), F.avg("format_reward").alias("format_rate"), F.max("overall_reward").alias("train_reward_v1"), F.count("*").alias("count"))
    return I.compare_runs(log.select("run").distinct(), _val(spark, sf_dir).withColumn("mean_response_length", F.expr(_LONG)), base=base)


_METRICS = {"best_step": "b.step", "accuracy": "b.accuracy", "format_rate": "b.format_rate", "train_reward_v1": "b.train_reward_v1", "mean_response_length": "b.step % 97 + 0.5", "accuracy_drop_from_best": "s.accuracy_drop"}


@query("i7_checkpoint_metrics", " UNION ALL ".join([f"SELECT 'base/{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM ({_BASE}) z" for c in ("accuracy", "format_rate", "train_reward_v1")]
       + [f"SELECT 'checkpoint/' || b.run || '/{c}', round(CAST({e} AS DOUBLE), 6) FROM (SELECT * FROM {_BEST} x WHERE b = 1) b JOIN ({_STAB}) s ON b.run = s.run WHERE {e} IS NOT NULL" for c, e in _METRICS.items()]), "validation")
def i7c(spark, sf_dir):
    base = view(spark, sf_dir, "run_log").agg(F.avg("overall_reward").alias("accuracy"), F.avg("format_reward").alias("format_rate"), F.max("overall_reward").alias("train_reward_v1"))
    return I.checkpoint_metrics(base, _val(spark, sf_dir).withColumn("mean_response_length", F.expr(_LONG))).withColumn("value", F.round("value", 6))


@query("i7_eval_metrics", "SELECT 'eval/all/' || metric AS metric, value FROM (SELECT 'greedy_accuracy' AS metric, round(avg(accuracy) FILTER (candidate_index = 0), 6) AS value FROM candidates UNION ALL SELECT 'count', CAST(count(DISTINCT uid) AS DOUBLE) FROM candidates) m", "candidates")
def i7e(spark, sf_dir):
    report = _cand(spark, sf_dir).agg(F.avg(F.when(F.col("candidate_index") == 0, F.col("accuracy"))).alias("greedy_accuracy"), F.count_distinct("uid").alias("count"), F.lit("x").alias("model_path"))
    return I.eval_metrics(report, "eval/all").withColumn("value", F.round("value", 6))


@query("i7_collected_metrics", """SELECT 'reports/r' || CAST(u AS VARCHAR) || '/n' || CASE WHEN u = 1 THEN 'na' ELSE CAST(u AS VARCHAR) END || '/' || metric AS metric, value
 FROM (SELECT uid % 3 AS u, 'format_at_k' AS metric, round(avg(format_rate), 6) AS value FROM candidates GROUP BY uid % 3 UNION ALL SELECT uid % 3, 'count', CAST(count(*) AS DOUBLE) FROM candidates GROUP BY uid % 3) m""", "candidates")
def i7r(spark, sf_dir):
    per = _cand(spark, sf_dir).groupBy(F.expr("uid % 3").alias("u")).agg(F.avg("format_rate").alias("format_at_k"), F.count("*").alias("count"))
    per = per.selectExpr("*", "IF(u = 0, 'r0', '') AS run_name", "concat('out/r', u, '.jsonl') AS output_file", "IF(u = 1, NULL, u) AS n")
    return I.collected_metrics(per, "reports").withColumn("value", F.round("value", 6))


@query("i5_obsolete_checkpoints", with_views("", "run_log").rstrip() + ", ck0 AS (SELECT run, step, overall_reward FROM run_log), ck AS (SELECT c.run, c.step, m.cur, m.best FROM ck0 c JOIN (SELECT run, max(step) AS cur, arg_max(step, ROW(overall_reward, -step)) AS best FROM ck0 GROUP BY run) m ON c.run = m.run), o AS (SELECT run, step, best, sum(CASE WHEN step = best THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS hb FROM ck WHERE step < cur) SELECT run, step FROM (SELECT run, step, hb, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM o WHERE step <> best) WHERE r > greatest(0, 2 - hb)")
def i5(spark, sf_dir):
    c = view(spark, sf_dir, "run_log").select("run", "step", "overall_reward")
    top = c.groupBy("run").agg(F.max("step").alias("current_step"), F.max_by("step", F.struct("overall_reward", -F.col("step"))).alias("best_step"))
    return I.obsolete_checkpoints(c.join(top, "run"), 3).select("run", "step")


@query("i6_checkpoint_tracker", "SELECT run, step, round(best_score, 6) AS best_score, (SELECT min(w.step) FROM validation w WHERE w.run = v.run AND w.step <= v.step AND w.train_reward_v1 = v.best_score) AS best_step, step AS last_step FROM (SELECT run, step, max(train_reward_v1) OVER (PARTITION BY run ORDER BY step) AS best_score FROM validation) v", "validation")
def i6(spark, sf_dir):
    out = I.checkpoint_tracker(_val(spark, sf_dir).selectExpr("run", "step", "train_reward_v1 AS score"))
    return out.select("run", "step", F.round("best_score", 6).alias("best_score"), "best_step", "last_step")


@query("i7_report_metrics", "SELECT 'all' AS report, run, 'metrics/accuracy' AS metric, round(avg(coalesce(accuracy, 0)), 6) AS value FROM run_log GROUP BY run UNION ALL SELECT 'all', run, 'metrics/n', CAST(count(*) AS DOUBLE) FROM run_log GROUP BY run", "run_log")
def i7(spark, sf_dir):
    per = view(spark, sf_dir, "run_log").groupBy("run").agg(F.struct(F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("accuracy"), F.count("*").alias("n")).alias("metrics"))
    report = per.groupBy(F.lit("all").alias("report")).agg(F.collect_list(F.struct("run", "metrics")).alias("runs"))
    return I.report_metrics(report, ["report"], "runs").withColumn("value", F.round("value", 6))


@query("i8_episode_summary", "SELECT device_id, count(*) AS episodes, count(*) FILTER (completed_rounds >= 10) AS successful, CAST(sum(completed_rounds) AS BIGINT) AS rounds FROM episodes GROUP BY ROLLUP (device_id)", "episodes")
def i8(spark, sf_dir):
    return I.episode_summary(view(spark, sf_dir, "episodes"))


@query("i9_run_delta", "SELECT a.run, a.dataset, a.n, round(a.accuracy, 6) AS accuracy, round(a.accuracy - b.accuracy, 6) AS delta FROM (SELECT 'r' || CAST(uid % 4 AS VARCHAR) AS run, uid % 2 AS dataset, count(*) % 1 AS n, avg(accuracy) AS accuracy FROM candidates GROUP BY uid % 4, uid % 2) a JOIN (SELECT uid % 2 AS dataset, avg(accuracy) AS accuracy FROM candidates WHERE uid % 4 IN (0, 1) GROUP BY uid % 2) b ON a.dataset = b.dataset WHERE a.run NOT IN ('r0', 'r1')", "candidates")
def i9(spark, sf_dir):
    c = _cand(spark, sf_dir).withColumn("run", F.expr("IF(uid % 4 IN (0, 1), 'base', concat('r', uid % 4))")).withColumn("dataset", F.col("uid") % 2)
    out = I.run_delta(c.groupBy("run", "dataset").agg(F.avg("accuracy").alias("accuracy")).withColumn("n", F.lit(0).cast("long")), "base")
    return _rounded(out, "run", "dataset", "n")
