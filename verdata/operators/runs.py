"""Summaries of training runs from their logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdata.operators.numbering import prefix_scan

#: Schema of an experiment log's lines, as far as the summaries read them (fixed names).
LOG_SCHEMA = ("step long, val struct<reward_score:double,accuracy_reward:double,format_reward:double,overall_reward:double>, "
              "val_response_length struct<mean:double,clip_ratio:double>, "
              "actor struct<kl_loss:double,ppo_kl:double,pg_clipfrac_higher:double,pg_clipfrac_lower:double,grad_norm:double,lr:double>")


def validation_rows(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a nested log that hold ``val``; the reward is ``reward_score``, or ``overall_reward`` where that is missing or 0."""
    v, n, a = "val.", "val_response_length.", "actor."
    return log.where(F.col("val").isNotNull()).select(
        *keep, "step", F.col(v + "accuracy_reward").alias("accuracy"), F.col(v + "format_reward").alias("format_rate"),
        F.coalesce(F.nullif(F.col(v + "reward_score"), F.lit(0.0)), F.col(v + "overall_reward")).alias("train_reward_v1"),
        F.col(n + "mean").alias("mean_response_length"), F.col(n + "clip_ratio").alias("clip_ratio"), F.col(a + "kl_loss").alias("kl_loss"), F.col(a + "ppo_kl").alias("approx_kl"),
        *[F.col(a + c).alias(c) for c in ("pg_clipfrac_higher", "pg_clipfrac_lower", "grad_norm", "lr")])


def _all(df: DataFrame, by: str) -> Column:
    return F.struct(*[c for c in df.columns if c != by])


def best_row(df: DataFrame, key: str, by: str = "run", seq: str = "step") -> DataFrame:
    """Each run's best row by ``key``, the first of equals; null keys don't count."""
    return df.where(F.col(key).isNotNull()).groupBy(by).agg(F.max_by(_all(df, by), F.struct(F.col(key), -F.col(seq))).alias("_b")).select(by, "_b.*")


def last_row(df: DataFrame, by: str = "run", seq: str = "step") -> DataFrame:
    return df.groupBy(by).agg(F.max_by(_all(df, by), F.col(seq)).alias("_b")).select(by, "_b.*")


def stability(df: DataFrame, by: str = "run", seq: str = "step") -> DataFrame:
    """What each run lost between its best and its last row. One aggregation finds both."""
    fields = F.struct(F.col(seq).alias("step"), "train_reward_v1", "accuracy", "format_rate")
    best = F.when(F.col("train_reward_v1").isNotNull(), F.struct(F.col("train_reward_v1"), -F.col(seq)))
    both = df.groupBy(by).agg(F.max_by(fields, best).alias("b"), F.max_by(fields, F.col(seq)).alias("l")).where(F.col("b").isNotNull())
    return both.select(by, F.col("b.step").alias("best_step"), F.col("l.step").alias("last_step"), (F.col("b.train_reward_v1") - F.col("l.train_reward_v1")).alias("reward_drop"),
                       (F.col("b.accuracy") - F.col("l.accuracy")).alias("accuracy_drop"), (F.col("l.format_rate") - F.col("b.format_rate")).alias("format_change"))


def _four(x: Column) -> Column:
    """Four decimals as text. The number is scaled, rounded half away from zero and scaled back, as SQL's ``round`` does on doubles; formatting alone decides halves by the digits of the unscaled number."""
    size = F.abs(x)
    near = F.when(size < 1e15, F.round(size * 10000) / 10000).otherwise(size)
    return F.format_string("%.4f", F.when(x < 0, -near).otherwise(near))


def compare_runs(names: DataFrame, rows: DataFrame, by: str = "run", base: DataFrame | None = None) -> DataFrame:
    """Comparison table as text: four decimals, ``-`` where a run has no log. ``names``: every run.

    ``mean_response_length`` is shown if the rows have it. ``base``: the base model's row (``accuracy, format_rate, train_reward_v1, count``), which comes
    first, in the section ``base``, with its count; the others' section is ``runs``.
    """
    more = [c for c in ("mean_response_length",) if c in rows.columns]
    best = best_row(rows, "train_reward_v1", by).select(by, F.col("step").alias("best_step"), "accuracy", "format_rate", "train_reward_v1", *more)
    out = names.join(best, by, "left").join(stability(rows, by).select(by, "last_step", "accuracy_drop"), by, "left")
    text = lambda c, kind: F.coalesce(_four(F.col(c)) if kind == "d" else F.col(c).cast("string"), F.lit("-"))
    shown = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(text(c, "d" if isinstance(out.schema[c].dataType, T.DoubleType) else "i"))
    table = out.select(by, *[shown(c).alias(c) for c in ("best_step", "accuracy", "format_rate", "train_reward_v1", *more, "last_step", "accuracy_drop")])
    if base is None:
        return table
    figure = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(_four(F.col(c).cast("double"))) if c != "count" else F.coalesce(F.col(c).cast("string"), F.lit("-"))
    first = base.select(F.lit("base").alias("section"), F.lit("base").alias(by), *[figure(c).alias(c) for c in ("accuracy", "format_rate", "train_reward_v1", "count")])
    return first.unionByName(table.withColumn("section", F.lit("runs")), allowMissingColumns=True).fillna("-")


def obsolete_checkpoints(catalog: DataFrame, save_limit: int, by: str = "run", step: str = "step", current: str = "current_step", best: str = "best_step") -> DataFrame:
    """Steps to remove: of those before the current one, the newest ``save_limit - 1`` stay; the best always stays and takes one of these places. A plan; nothing is deleted."""
    if save_limit <= 0:
        return catalog.limit(0)
    old = catalog.where(F.col(step) < F.col(current))
    w = Window.partitionBy(by)
    has_best = F.max((F.col(step) == F.col(best)).cast("int")).over(w)
    rows = old.withColumn("_slots", F.greatest(F.lit(0), save_limit - 1 - F.coalesce(has_best, F.lit(0)))).where(~F.coalesce(F.col(step) == F.col(best), F.lit(False)))
    return rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(step)))).where(F.col("_r") > F.col("_slots")).drop("_r", "_slots")


def checkpoint_tracker(evals: DataFrame, by: str = "run", step: str = "step", score: str = "score") -> DataFrame:
    """After each evaluation: the best score so far (from -1, strictly improved) and its step, and the last step. Range partitions of the steps are scanned on their own, so no task holds a run."""
    ranked = F.when(F.col(score) > -1, F.struct(F.col(score).alias("s"), (-F.col(step)).alias("t")))
    out = prefix_scan(evals, [by], [F.col(step)], {"_top": (F.max, ranked), "last_step": (F.max, F.col(step))})
    return out.withColumn("best_score", F.coalesce("_top.s", F.lit(-1.0))).withColumn("best_step", -F.col("_top.t")).select(*evals.columns, "best_score", "best_step", "last_step")


def report_metrics(reports: DataFrame, id_cols: list[str], array_field: str | None = None) -> DataFrame:
    """Every number of the reports as (metric path, value). An array of runs is exploded first, its entries named by their ``run``."""
    from verdata.operators.metrics import flatten_metrics

    if array_field:
        reports = reports.select(*id_cols, F.explode(array_field).alias("_r")).select(*id_cols, "_r.*")
        id_cols = [*id_cols, "run"]
    return flatten_metrics(reports, id_cols)


def _named(df: DataFrame, prefix: Column, keys: dict[str, str]) -> DataFrame:
    """``metric`` (prefix and name) and ``value`` of the columns that ``df`` has; what is null isn't reported."""
    each = F.array(*[F.struct(F.concat(prefix, F.lit(f"/{name}")).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in keys.items() if c in df.columns])
    return df.select(F.explode(each).alias("m")).select("m.*").where("value is not null")


def checkpoint_metrics(base: DataFrame, rows: DataFrame, by: str = "run") -> DataFrame:
    """A stability report's numbers: ``base/...`` of the base model's row, and ``checkpoint/<run>/...`` of each run's best row with what it lost since."""
    own = _named(base, F.lit("base"), {c: c for c in ("accuracy", "format_rate", "train_reward_v1")})
    best = best_row(rows.where(F.col(by).isNotNull() & (F.col(by) != "")), "train_reward_v1", by).withColumnRenamed("step", "best_step")
    best = best.join(stability(rows, by).select(by, "accuracy_drop"), by, "left")
    keys = {"best_step": "best_step", **{c: c for c in ("accuracy", "format_rate", "train_reward_v1", "mean_response_length")}, "accuracy_drop_from_best": "accuracy_drop"}
    return own.unionByName(_named(best, F.concat(F.lit("checkpoint/"), F.col(by)), keys))


#: Numbers that evaluation and collected reports show (fixed values).
COLLECTED_KEYS = ("greedy_accuracy", "best_of_N_accuracy", "pass_at_k", "maj_at_k", "format_at_k", "mean_response_length", "count")
EVAL_KEYS = ("greedy_accuracy", "best_of_N_accuracy", "pass_at_k", "maj_at_k", "format_at_k", "selected_train_reward_v1", "selected_diagnostic_score_v2_lite", "mean_response_length", "count")


def eval_metrics(reports: DataFrame, prefix: str) -> DataFrame:
    """``<prefix>/<name>`` of an evaluation report's numbers."""
    return _named(reports, F.lit(prefix), {c: c for c in EVAL_KEYS})


def collected_metrics(reports: DataFrame, prefix: str) -> DataFrame:
    """``<prefix>/<run>/n<n>/<name>`` of collected reports; a run without ``run_name`` is named by the stem of its ``output_file``, a missing ``n`` is ``na``."""
    col = lambda c: F.col(c).cast("string") if c in reports.columns else F.lit(None).cast("string")
    stem = F.regexp_extract(F.coalesce(col("output_file"), F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    name = F.coalesce(F.when(col("run_name") != "", col("run_name")), stem)
    return _named(reports, F.concat(F.lit(f"{prefix}/"), name, F.lit("/n"), F.coalesce(col("n"), F.lit("na"))), {c: c for c in COLLECTED_KEYS})


def episode_summary(episodes: DataFrame, by: str = "device_id") -> DataFrame:
    """Episodes, successes (10 completed rounds) and rounds by device, and in total (device null)."""
    return episodes.rollup(by).agg(F.count("*").alias("episodes"), F.count_if(F.col("completed_rounds") >= 10).alias("successful"), F.sum("completed_rounds").cast("long").alias("rounds"))


def run_delta(reports: DataFrame, base: str, on: tuple[str, ...] = ("dataset", "n"), by: str = "run", metric: str = "accuracy") -> DataFrame:
    """Each run's metric less the base run's on the same benchmark."""
    b = reports.where(F.col(by) == base).select(*on, F.col(metric).alias("_base"))
    return reports.where(F.col(by) != base).join(b, list(on)).select(by, *on, metric, (F.col(metric) - F.col("_base")).alias("delta"))
