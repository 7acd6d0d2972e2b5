"""Metrics of rollout batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _stats(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def data_metrics(df: DataFrame, by: str, critic: bool = True, scores: str = "token_level_scores", rewards: str = "token_level_rewards", advantages: str = "advantages",
                 returns: str = "returns", values: str = "values", mask: str = "mask") -> DataFrame:
    """Statistics of sequence scores and rewards, and of valid tokens' advantages, returns and values.

    Token statistics come from each row's partial sums; variances from a second pass around the mean.
    """
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    kept = lambda c: F.filter(F.zip_with(c, mask, lambda x, m: F.when(m > 0, x)), lambda x: x.isNotNull())
    token = lambda c, name: [(F.sum(_sum(kept(c))) / F.sum(n)).alias(f"{name}_mean"), F.max(F.array_max(kept(c))).alias(f"{name}_max"), F.min(F.array_min(kept(c))).alias(f"{name}_min")]
    out = [*_stats(_sum(scores), "score"), *_stats(_sum(rewards), "reward"), *token(advantages, "advantages"), *token(returns, "returns")]
    if not critic:
        return df.groupBy(by).agg(*out)
    df = df.withColumn("_diff", F.zip_with(returns, values, lambda r, v: r - v))
    first = df.groupBy(by).agg(*out, *token(values, "values"), F.sum(n).alias("_n"), (F.sum(_sum(kept("_diff"))) / F.sum(n)).alias("_diff_mean"))
    means = F.broadcast(first.select(F.col(by).alias("_by"), "_diff_mean", F.col("returns_mean").alias("_ret_mean"), "_n"))
    square = lambda c, m: F.sum(F.aggregate(kept(c), F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    second = df.join(means, F.col(by) == F.col("_by")).groupBy(by).agg((square("_diff", F.col("_diff_mean")) / (F.first("_n") - 1)).alias("_dv"), (square(returns, F.col("_ret_mean")) / (F.first("_n") - 1)).alias("_rv"))
    return first.join(second, by).withColumn("vf_explained_var", 1.0 - F.col("_dv") / (F.col("_rv") + 1e-5)).drop("_n", "_diff_mean", "_dv", "_rv")


def length_metrics(df: DataFrame, by: str, max_response: int, max_prompt: int, response: str = "response_length", prompt: str = "prompt_length") -> DataFrame:
    """Mean, max, min and the share at the limit of both lengths."""
    out = []
    for c, limit in ((response, max_response), (prompt, max_prompt)):
        out += [*_stats(F.col(c).cast("double"), c), F.avg((F.col(c) == limit).cast("double")).alias(f"{c}_clip_ratio")]
    return df.groupBy(by).agg(*out)


#: Sections whose time is counted by response tokens, and by all tokens (fixed values).
RESPONSE_SECTIONS, ALL_SECTIONS = ("gen", "reward"), ("ref", "old", "values", "adv", "update_critic", "update_actor")


def timing_metrics(timings: DataFrame, tokens: DataFrame, by: str = "step") -> DataFrame:
    """Milliseconds a token by section. ``timings``: step, section, seconds; ``tokens``: step, response_tokens, total_tokens."""
    n = F.when(F.col("section").isin(*RESPONSE_SECTIONS), F.col("response_tokens")).when(F.col("section").isin(*ALL_SECTIONS), F.col("total_tokens"))
    return timings.join(tokens, by).select(by, "section", "seconds", (F.col("seconds") * 1000 / n).alias("ms_per_token"))


def throughput(timings: DataFrame, tokens: DataFrame, n_gpus: int, by: str = "step") -> DataFrame:
    """Tokens a second and GPU, over the section ``step``."""
    rows = timings.where(F.col("section") == "step").join(tokens, by)
    return rows.select(by, "total_tokens", F.col("seconds").alias("time_per_step"), (F.col("total_tokens") / (F.col("seconds") * n_gpus)).alias("throughput"))


def reduce_metrics(df: DataFrame, by: tuple[str, ...] = ("step", "metric")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("value").alias("value"))


def estimate_mfu(df: DataFrame, by: str, model: dict, seconds: str, peak_tflops: float, length: str = "tokens") -> DataFrame:
    """Achieved TFLOPS of a decoder by step, from the sums of lengths and of their squares; with ``num_experts`` the feed-forward part counts active experts and the gate."""
    h, heads = model["hidden_size"], model["num_attention_heads"]
    d = model.get("head_dim", h // heads)
    q, kv = heads * d, model["num_key_value_heads"] * d
    if "num_experts" in model:
        mlp = 3 * h * model["moe_intermediate_size"] * model["num_experts_per_tok"] + h * model["num_experts"]
    else:
        mlp = 3 * h * model["intermediate_size"]
    weights = model["num_hidden_layers"] * (mlp + h * (2 * q + 2 * kv)) + 2 * model["vocab_size"] * h
    attention = 12 * d * heads * model["num_hidden_layers"]
    n = F.col(length).cast("double")
    out = df.groupBy(by).agg(F.sum(n).alias("total_tokens"), F.sum(n * n).alias("_sq"), F.max(seconds).alias("seconds"))
    tflops = (F.lit(6.0 * weights) * F.col("total_tokens") + F.lit(float(attention)) * F.col("_sq")) / F.col("seconds") / 1e12
    return out.withColumn("tflops", tflops).withColumn("mfu", F.col("tflops") / peak_tflops).drop("_sq")


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()):
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, (*path, f.name))
        elif isinstance(f.dataType, T.NumericType):
            yield (*path, f.name)


def flatten_metrics(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Long form ``metric, value`` with ``a/b`` names for nested numbers; nulls go."""
    paths = [p for p in _leaves(df.schema) if p[0] not in id_cols]
    pairs = F.array(*[F.struct(F.lit("/".join(p)).alias("metric"), F.col(".".join(f"`{x}`" for x in p)).cast("double").alias("value")) for p in paths])
    return df.select(*id_cols, F.explode(pairs).alias("m")).select(*id_cols, "m.metric", "m.value").where(F.col("value").isNotNull())


def unflatten_metrics(df: DataFrame, id_cols: list[str], metrics: list[str]) -> DataFrame:
    """Nested structs from the long form; ``metrics`` are the wanted ``a/b`` names."""
    wide = df.groupBy(*id_cols).pivot("metric", metrics).agg(F.first("value"))

    def build(names: list[tuple[str, ...]], depth: int) -> list[Column]:
        out = []
        for head in dict.fromkeys(n[depth] for n in names):
            own = [n for n in names if n[depth] == head]
            leaf = next((n for n in own if len(n) == depth + 1), None)
            out.append(F.col(f"`{'/'.join(leaf)}`").alias(head) if leaf else F.struct(*build(own, depth + 1)).alias(head))
        return out
    return wide.select(*id_cols, *build([tuple(m.split("/")) for m in metrics], 0))
