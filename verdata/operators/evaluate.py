"""Evaluation of several candidates for each problem, rescoring and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.functions.answers import answer_equal
from verdata.functions.text import normalize_text, seeded
from verdata.operators.rewards import DIAGNOSTICS, diagnose


def flatten_candidates(df: DataFrame, field: str = "candidates") -> DataFrame:
    """A row for each candidate; records without the array stay one row, an empty one leaves none. A candidate's fields override the record's."""
    if field not in df.columns:
        return df
    inner = df.schema[field].dataType.elementType.fieldNames()
    kept = [c for c in df.columns if c != field]
    each = df.where(F.col(field).isNotNull()).select(*[c for c in kept if c not in inner], F.explode(field).alias("_c")).select(*[c for c in kept if c not in inner], "_c.*")
    alone = df.where(F.col(field).isNull()).drop(field)
    return each.unionByName(alone, allowMissingColumns=True)


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def select_best(df: DataFrame, by: str | Sequence[str] = "uid", index: str = "candidate_index") -> DataFrame:
    """Each problem's best candidate: by reward, accuracy, then the shorter response, then the lower index. ``by``: a problem's column, or several (run and problem)."""
    keys = _keys(by)
    order = F.struct(F.col("train_reward_v1"), F.col("accuracy"), -F.col("response_length"), -F.col(index))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_b")).select(*keys, "_b.*")


def pass_at_k(df: DataFrame, by: str | Sequence[str] = "uid", accuracy: str = "accuracy") -> DataFrame:
    """1 if any candidate is right."""
    return df.groupBy(*_keys(by)).agg(F.max((F.coalesce(accuracy, F.lit(0.0)) > 0).cast("double")).alias("pass_at_k"))


def _majority(votes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The commonest non-empty answer of each problem, graded; ``votes``: a row for each normalized answer."""
    real = F.when(F.col("_norm") != "", F.struct("_n", -F.col("_i")))
    won = votes.groupBy(*keys).agg(F.max_by("_raw", real).alias("majority_answer"), F.first("_gold").alias("_gold"), *more)
    hit = F.when(F.col("majority_answer").isNotNull(), answer_equal(F.col("majority_answer"), F.col("_gold")).cast("double"))
    return won.withColumn("maj_at_k", F.coalesce(hit, F.lit(0.0))).drop("_gold")


def _votes(index: str) -> list[Column]:
    return [F.count("*").alias("_n"), F.min(index).alias("_i"), F.min_by("boxed_answer", index).alias("_raw"), F.first("gold").alias("_gold")]


def maj_at_k(df: DataFrame, by: str | Sequence[str] = "uid", index: str = "candidate_index") -> DataFrame:
    """The commonest non-empty answer (the first seen of equals), graded by its first form; 0 without answers."""
    votes = df.withColumn("_norm", normalize_text(F.col("boxed_answer"))).groupBy(*_keys(by), "_norm").agg(*_votes(index))
    return _majority(votes, _keys(by))


def group_means(df: DataFrame, by: str | Sequence[str] = "uid") -> DataFrame:
    return df.groupBy(*_keys(by)).agg(F.avg("format_rate").alias("format_at_k"), F.avg("response_length").alias("mean_response_length"))


def _folded(df: DataFrame, keys: list[str], index: str, greedy: dict[str, str], chosen: dict[str, str], hits: dict[str, str], means: dict[str, str]) -> DataFrame:
    """One row for each problem: columns of its first candidate, of its best one, whether any is above 0, and means; with ``maj_at_k``. Null or missing columns count as 0.

    Rows are dealt out by problem once. Answers are folded first and problems of answers then, both where the rows are, so there is no other exchange on the problem and no join.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    best = [F.col("train_reward_v1"), F.col("accuracy"), -F.col("response_length"), -F.col(index)]
    first = F.struct(F.col(index).alias("_at"), *[value(c).alias(n) for n, c in greedy.items()])
    top = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(best)], *[value(c).alias(n) for n, c in chosen.items()])
    rows = df.select(*keys, index, "boxed_answer", "gold", normalize_text(F.col("boxed_answer")).alias("_norm"), first.alias("_first"), top.alias("_top"), *[(value(c) > 0).cast("double").alias(n) for n, c in hits.items()], *[value(c).alias(n) for n, c in means.items()])
    votes = rows.repartition(*keys).groupBy(*keys, "_norm").agg(*_votes(index), F.min("_first").alias("_first"), F.max("_top").alias("_top"), *[F.max(n).alias(n) for n in hits], *[F.sum(n).alias(n) for n in means])
    one = _majority(votes, keys, F.min("_first").alias("_first"), F.max("_top").alias("_top"), *[F.max(n).alias(n) for n in hits], *[(F.sum(n) / F.sum("_n")).alias(n) for n in means])
    return one.select(*keys, "maj_at_k", *hits, *means, *[F.col(f"_first.{n}").alias(n) for n in greedy], *[F.col(f"_top.{n}").alias(n) for n in chosen])


def _report(one: DataFrame, run: str | None, count: str, names: list[str]) -> DataFrame:
    """Averages over problems, of each run or of all."""
    return one.groupBy(*([run] if run else [])).agg(F.count("*").alias(count), *[F.avg(n).alias(n) for n in names])


def eval_report(df: DataFrame, by: str = "uid", index: str = "candidate_index", rates: tuple[str, ...] = ("accuracy", "format_rate", "train_reward_v1"), run: str | None = None) -> DataFrame:
    """Rates averaged over problems: of the first candidate (greedy), of the selected one, and over all of a problem's candidates. With ``run``, a report for each run."""
    greedy, chosen = {f"greedy_{c}": c for c in rates}, {f"selected_{c}": c for c in rates}
    one = _folded(df, [*([run] if run else []), by], index, greedy, chosen, {"pass_at_k": "accuracy"}, {"format_at_k": "format_rate", "mean_length": "response_length"})
    return _report(one, run, "problems", ["pass_at_k", "maj_at_k", "format_at_k", "mean_length", *greedy, *chosen])


#: Issues whose rate is that of the first candidate, by the name of the rate (fixed values).
GREEDY_RATES = {"verifier_false_negative_candidate_rate": "verifier_false_negative_candidate", "robust_extract_failure_rate": "robust_extract_failure", "hit_length_cap_rate": "hit_length_cap",
                "unclosed_think_rate": "unclosed_think", "missing_boxed_answer_rate": "missing_boxed_answer", "prompt_contamination_rate": "prompt_contamination"}


def full_report(df: DataFrame, by: str = "uid", index: str = "candidate_index", run: str | None = None) -> DataFrame:
    """The count and all 17 rates of an evaluation report, averaged over problems; with ``run``, a report for each run. ``df``: diagnosed candidates; null or missing diagnostics count as 0."""
    greedy = {"greedy_accuracy": "accuracy", "greedy_robust_accuracy": "robust_accuracy", **GREEDY_RATES}
    chosen = {"best_of_N_accuracy": "accuracy", "selected_train_reward_v1": "train_reward_v1", "selected_diagnostic_score_v2_lite": "diagnostic_score_v2_lite", "best_of_N_robust_accuracy": "robust_accuracy"}
    hits, means = {"pass_at_k": "accuracy", "robust_pass_at_k": "robust_accuracy"}, {"format_at_k": "format_rate", "mean_response_length": "response_length"}
    one = _folded(df, [*([run] if run else []), by], index, greedy, chosen, hits, means)
    return _report(one, run, "count", [*greedy, *chosen, *hits, *means, "maj_at_k"])


def rescore(df: DataFrame, max_response_length: int | None = None) -> DataFrame:
    """Flattened candidates with all diagnostics; without ``response_length`` the words are counted."""
    from verdata.functions.text import whitespace_tokens

    rows = flatten_candidates(df)
    words = whitespace_tokens(F.col("response"))
    rows = rows.withColumn("response_length", F.coalesce(F.col("response_length").cast("long"), words) if "response_length" in rows.columns else words)
    return diagnose(rows, max_response_length)


def run_summary(df: DataFrame, by: str = "run", keys: tuple[str, ...] = DIAGNOSTICS) -> DataFrame:
    """Averages by run; null counts as 0 and stays in the denominator."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(k).cast("double"), F.lit(0.0))).alias(k) for k in keys if k in df.columns])


def summarize_scores(df: DataFrame, by: str = "source_file") -> DataFrame:
    return run_summary(df, by, ("overall", "format", "accuracy"))


#: Endings of report names, removed in this order (fixed values).
REPORT_SUFFIXES = ("_math12k_greedy", "_math12k_best_of_4", "_math12k_best_of_8", "_gsm8k_greedy", "_report")


def collect_reports(df: DataFrame, file_col: str = "source_file", n_col: str = "n", suffixes: tuple[str, ...] = REPORT_SUFFIXES) -> DataFrame:
    """Run name from the file's stem, and whether it is a greedy or a best-of-n report."""
    name = F.regexp_extract(F.col(file_col), r"([^/]*?)(?:\.[^./]*)?$", 1)
    for s in suffixes:
        name = F.replace(name, F.lit(s), F.lit(""))
    return df.withColumn("run", name).withColumn("metric_family", F.when(F.coalesce(F.col(n_col), F.lit(1)) > 1, "best_of_n").otherwise("greedy"))


def suspicious(df: DataFrame) -> DataFrame:
    """Rows where accuracy and format disagree, or an issue is flagged."""
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    odd = (v("accuracy") > 0) != (v("format_rate") > 0)
    for c in ("extract_failure", "truncation", "repetition", "invalid_output_penalty"):
        odd = odd | (v(c) > 0)
    return df.where(odd)


def _pool(df: DataFrame, n: int, seed: int, id_col: str, priority: int) -> DataFrame:
    key = seeded(F.col(id_col), seed)
    return df.withColumn("_key", key).orderBy("_key", id_col).limit(n).withColumn("_priority", F.lit(priority)).select(*df.columns, "_priority", "_key")


def _first_of(pools: list[DataFrame], size: int, id_col: str) -> DataFrame:
    """Union of small pools, each row once where it comes first, cut to ``size``. ``place`` numbers the result."""
    rows = pools[0]
    for p in pools[1:]:
        rows = rows.unionByName(p)
    columns = [c for c in rows.columns if c != id_col]
    once = rows.groupBy(id_col).agg(F.min_by(F.struct(*columns), F.struct("_priority", "_key")).alias("_r")).select(id_col, "_r.*")
    return once.orderBy("_priority", "_key", id_col).limit(size).withColumn("pool", F.col("_priority").cast("long")).drop("_priority", "_key")


def audit_sample(cases: DataFrame, id_col: str = "case_id", sizes: tuple[int, int, int] = (50, 30, 20), size: int = 100, seed: int = 0) -> DataFrame:
    """Suspicious, incorrect and random cases; a case counts in the first pool that draws it, and random ones fill up to ``size``."""
    wrong = cases.where(F.coalesce(F.col("accuracy"), F.lit(0.0)) <= 0)
    return _first_of([_pool(suspicious(cases), sizes[0], seed, id_col, 0), _pool(wrong, sizes[1], seed + 1, id_col, 1), _pool(cases, sizes[2], seed + 2, id_col, 2),
                      _pool(cases, size + sum(sizes), seed + 3, id_col, 3)], size, id_col)


def error_sample(cases: DataFrame, id_col: str = "case_id", size: int = 50, seed: int = 0) -> DataFrame:
    """Incorrect cases first, then suspicious, then others."""
    wrong = cases.where(F.coalesce(F.col("accuracy"), F.lit(0.0)) <= 0)
    return _first_of([_pool(wrong, size, seed + 1, id_col, 0), _pool(suspicious(cases), size, seed, id_col, 1), _pool(cases, 2 * size, seed + 2, id_col, 2)], size, id_col)


def audit_summary(verdicts: DataFrame, labels: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Label counts, agreement between verifier and human, false positives and negatives."""
    both = labels.join(verdicts, id_col, "left")
    n = lambda label: F.count_if(F.col("human_audit_label") == label)
    return both.agg(F.count("*").alias("audited"), n("correct_accept").alias("correct_accept"), n("correct_reject").alias("correct_reject"), n("wrong_accept").alias("false_positives"),
                    n("wrong_reject").alias("false_negatives"), F.count_if(~F.col("human_audit_label").isin("correct_accept", "correct_reject", "wrong_accept", "wrong_reject")).alias("other_labels"),
                    F.avg((F.col("verifier_accepts") == F.col("human_correct")).cast("double")).alias("agreement_rate"))


def sample_generations(df: DataFrame, k: int, seed: int = 42, input_col: str = "input") -> DataFrame:
    """``k`` generations to log, in a fixed shuffle."""
    return df.orderBy(seeded(F.col(input_col), seed), input_col).limit(k)
