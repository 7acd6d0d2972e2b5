"""Scoring of responses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from verdata.functions import answers as A
from verdata.functions.text import extract_choice, text_of, trim_ws

DIAGNOSTICS = ("accuracy", "format_rate", "train_reward_v1", "diagnostic_score_v2_lite", "answer_extractable", "extract_failure", "robust_answer_extractable",
               "robust_extract_failure", "robust_accuracy", "verifier_false_negative_candidate", "hit_length_cap", "unclosed_think", "missing_boxed_answer",
               "prompt_contamination", "truncation", "repetition", "invalid_output_penalty")


def _score(df: DataFrame, accuracy: Column, fmt: Column, weight: float) -> DataFrame:
    out = df.withColumn("accuracy", accuracy.cast("double")).withColumn("format", fmt.cast("double"))
    return out.withColumn("overall", (1 - weight) * F.col("accuracy") + weight * F.col("format"))


def score_math(df: DataFrame, format_weight: float = 0.1) -> DataFrame:
    """Boxed answer against ``gold``, and the format; weight 0 counts answers only, 1 the format only."""
    return _score_boxed(df.withColumn("boxed_answer", A.extract_boxed(F.col("response"))), format_weight)


def _score_boxed(df: DataFrame, format_weight: float = 0.1) -> DataFrame:
    return _score(df, A.answer_equal(F.col("boxed_answer"), F.col("gold")), A.format_reward(F.col("response")), format_weight)


def score_answer_tag(df: DataFrame, format_weight: float = 0.5) -> DataFrame:
    """What the ``<answer>`` element holds (on one line), else the whole response, against ``gold``."""
    t = text_of(F.col("response"))
    given = F.when(t.rlike("(?d)<answer>(.*?)</answer>"), F.regexp_extract(t, "(?d)<answer>(.*?)</answer>", 1)).otherwise(t)
    return _score(df, A.answer_equal(trim_ws(given), trim_ws(text_of(F.col("gold")))), A.format_reward(F.col("response"), "answer"), format_weight)


def score_choice(df: DataFrame) -> DataFrame:
    """1 if the chosen digit is ``gold``."""
    hit = (extract_choice(F.col("response")) == trim_ws(text_of(F.col("gold")))).cast("double")
    return df.withColumn("accuracy", hit).withColumn("overall", hit)


def score_dapo(df: DataFrame, max_length: int, buffer: int, penalty: float) -> DataFrame:
    """The last ``Answer:`` line of the last 300 characters: 1 or -1, with a ramp of penalties for the last ``buffer`` tokens of the limit."""
    tail = F.right(text_of(F.col("response")), F.lit(300))
    found = F.regexp_extract_all(tail, F.lit(r"(?i)Answer(?U:\s*):(?U:\s*)([^\n]+)"), F.lit(1))
    answer = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))
    hit = F.when(A.normalize_final_answer(answer) == A.normalize_final_answer(F.col("gold")), 1.0).otherwise(-1.0)
    n, free = F.col("response_length"), max_length - buffer
    over = F.when(n <= free, 0.0).when(n <= max_length, (free - n) / buffer).otherwise(-1.0)
    out = df.withColumn("accuracy", hit).withColumn("overlong", over.cast("double"))
    return out.withColumn("overall", F.col("accuracy") + penalty * F.col("overlong")).withColumn("accuracy_normalized", 0.5 * (F.col("accuracy") + 1.0))


def apply_reward(df: DataFrame, fn: Callable, kind: str, metrics: tuple[str, ...] = ("overall",), **kwargs) -> DataFrame:
    """A user's reward over (response, response_length, ground_truth) dictionaries: ``batch`` gets and returns lists, ``sequential`` single ones. A missing or null metric is 0.

    Only the three columns go to Python; the others stay where they are.
    """
    if kind not in ("batch", "sequential"):
        raise ValueError(f"unknown kind: {kind}")

    @F.pandas_udf(StructType([StructField(m, DoubleType()) for m in metrics]))
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [{"response": r, "response_length": None if pd.isna(n) else int(n), "ground_truth": g} for r, n, g in zip(frame["response"], frame["response_length"], frame["gold"])]
        scores = fn(rows, **kwargs) if kind == "batch" else [fn(x, **kwargs) for x in rows]
        return pd.DataFrame({m: [float(s.get(m, 0.0) or 0.0) for s in scores] for m in metrics}, dtype="float64")
    return df.withColumn("_scored", run(F.struct("response", "response_length", "gold"))).select(*df.columns, *[F.col(f"_scored.{m}").alias(m) for m in metrics])


def diagnose(df: DataFrame, max_response_length: int | None = None) -> DataFrame:
    """All diagnostics of each response; ``accuracy``, ``format_rate`` and ``train_reward_v1`` are reused where all three columns are there."""
    reused = {"accuracy", "format_rate", "train_reward_v1"}
    text = text_of(F.col("response"))
    df = df.withColumn("boxed_answer", A.extract_boxed(text)).withColumn("robust_answer", A.robust_answer(text, F.col("gold"), F.col("boxed_answer")))
    if reused <= set(df.columns):
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in reused})
    else:
        df = _score_boxed(df).withColumnsRenamed({"format": "format_rate", "overall": "train_reward_v1"})
    df = df.withColumn("repetition", A.severe_repetition(text).cast("double"))
    df = df.withColumns(A.issue_flags(F.col("response"), F.col("boxed_answer"), F.col("response_length"), max_response_length))
    one = lambda c: c.cast("double")
    found = F.col("robust_answer") != ""
    df = df.withColumns({
        "robust_accuracy": one(found & A.relaxed_answer_equal(F.col("robust_answer"), F.col("gold"))),
        "answer_extractable": one((F.col("boxed_answer") != "") & (F.length("boxed_answer") <= 100)),
        "robust_answer_extractable": one(found & (F.length("robust_answer") <= 120)),
        "invalid_output_penalty": one((F.col("truncation") > 0) | (F.col("repetition") > 0) | (F.col("prompt_contamination") > 0)),
    })
    return df.withColumns({
        "extract_failure": 1.0 - F.col("answer_extractable"), "robust_extract_failure": 1.0 - F.col("robust_answer_extractable"),
        "verifier_false_negative_candidate": one((F.col("accuracy") <= 0) & (F.col("robust_accuracy") > 0)),
        "diagnostic_score_v2_lite": 0.85 * F.col("accuracy") + 0.10 * F.col("format_rate") + 0.05 * F.col("answer_extractable") - 0.10 * F.col("invalid_output_penalty"),
    })


def token_rewards(score: Column, mask: Column) -> Column:
    """The score on the last valid token, 0 elsewhere; all 0 for an empty response."""
    last = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m.cast("long")) - 1
    return F.transform(mask, lambda m, i: F.when(i == last, score.cast("double")).otherwise(F.lit(0.0)))
