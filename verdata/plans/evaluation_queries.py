"""Queries over ``responses``, ``candidates`` and ``audit``: extraction, rewards, evaluation and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdata.functions import answers as A
from verdata.functions import text as T
from verdata.operators import evaluate as E
from verdata.operators import rewards as R
from verdata.plans.fixtures import view, with_views
from verdata.plans.storage import shared_dir
from verdata.sources import files as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return add


_BOX = "trim(coalesce(list_last(regexp_extract_all(response, '\\\\boxed\\{([^{}]*(?:\\{[^{}]*\\}[^{}]*)*)\\}', 1)), ''))"
_TURN = "(?i)(?:^|\\n)\\s*(?:Human|Assistant|User|System)\\s*:"
_FORMAT = "CAST(regexp_full_match(regexp_replace(response, '\\s*(<|>|/)\\s*', '\\1', 'g'), '(?s)<think>.*</think>.*\\\\boxed\\{.*\\}.*') AS DOUBLE)"
_WORDS = "list_filter(regexp_split_to_array(response, '\\s+'), lambda x: x <> '')"
#: Strict equality of short answers: as text, or as whole numbers.
_ACC = f"CAST(lower({_BOX}) = lower(trim(gold)) AS DOUBLE)"
_SCORED = f"s AS (SELECT *, {_BOX} AS boxed_answer, {_ACC} AS accuracy, {_FORMAT} AS format_rate FROM responses)"


def _s(sql: str) -> str:
    return with_views("", "responses").rstrip() + ", " + _SCORED + " " + sql


def _raw(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn
    return add


def _responses(spark, sf_dir):
    return view(spark, sf_dir, "responses")


@query("c7_extract_boxed", f"SELECT case_id, {_BOX} AS boxed FROM responses", "responses")
def c7(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", A.extract_boxed(F.col("response")).alias("boxed"))


@query("c8_postprocess", f"SELECT case_id, md5(CASE WHEN regexp_matches(response, '{_TURN}') THEN rtrim(regexp_split_to_array(response, '{_TURN}')[1], ' ' || chr(10)) ELSE response END) AS cut_md5 FROM responses", "responses")
def c8(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", F.md5(A.postprocess_generation(F.col("response"), cut_turn_markers=True)).alias("cut_md5"))


@query("c8_stop_after_boxed", "SELECT case_id, md5(CASE WHEN contains(response, 'boxed{') THEN regexp_extract(response, '(?s)^(.*boxed\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\})', 1) ELSE response END) AS cut_md5 FROM responses", "responses")
def c8b(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", F.md5(A.postprocess_generation(F.col("response"), stop_after_boxed=True)).alias("cut_md5"))


# The responses' own texts in the other style: whole, without an end, or as they are.
_STYLED = """CASE WHEN case_id % 2 = 0 THEN concat('<think>', response, '</think>', chr(10), ' <answer> ', CASE WHEN case_id % 3 = 0 THEN gold ELSE response END, ' </answer>')
 WHEN case_id % 3 = 0 THEN concat('<think>', response, '</think><answer>', gold) ELSE response END"""
_TAGGED = "CAST(regexp_full_match(styled, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>') AS DOUBLE)"


@query("c9_format_reward", f"SELECT case_id, {_FORMAT} AS boxed_format, {_TAGGED} AS answer_format FROM (SELECT *, {_STYLED} AS styled FROM responses) x", "responses")
def c9(spark, sf_dir):
    return _responses(spark, sf_dir).withColumn("styled", F.expr(_STYLED)).select("case_id", A.format_reward(F.col("response")).alias("boxed_format"), A.format_reward(F.col("styled"), "answer").alias("answer_format"))


@query("c10_answer_equal", "SELECT idx, trim(answer) = '' OR regexp_full_match(trim(answer), '[-+]?\\d+(\\.\\d+)?') OR lower(trim(answer)) = 'none' AS equal FROM examples", "examples")
def c10(spark, sf_dir):
    other = F.expr("CASE WHEN rlike(answer, '^[-+]?[0-9]+([.][0-9]+)?$') THEN concat(answer, IF(contains(answer, '.'), '00', '.0')) WHEN answer = '' THEN ' ' WHEN answer = 'None' THEN ' NONE' ELSE concat(answer, 'x') END")
    return view(spark, sf_dir, "examples").select("idx", A.answer_equal(other, F.col("answer")).alias("equal"))


@query("c11_relaxed_normalize")
def c11(spark, sf_dir):
    a = F.col("answer")
    return view(spark, sf_dir, "examples").select("idx", A.relaxed_normalize(a).alias("relaxed"), A.relaxed_answer_equal(F.concat(F.lit("$"), a, F.lit("$ cm")), a).alias("equal"))


@query("c12_robust_answer")
def c12(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", A.robust_answer(F.col("response"), F.col("gold")).alias("robust"))


def _final_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    out = "list_last(string_split('x = ' || answer, '='))"
    for before, after in (*A.SUBSTITUTIONS, *((r, "") for r in A.REMOVED)):
        out = f"replace({out}, {text(before)}, {text(after)})"
    for pattern, by in (("(.*?)\\$(.*?)\\$(.*)", "$\\2$"), ("\\\\text\\{(.*?)\\}", "\\1"), ("\\\\textbf\\{(.*?)\\}", "\\1"), ("\\\\overline\\{(.*?)\\}", "\\1"), ("\\\\boxed\\{(.*)\\}", "\\1"), ("(frac)([^{])(.)", "frac{\\2}{\\3}"), ("(sqrt)([^{])", "sqrt{\\2}")):
        out = f"regexp_replace({out}, {text(pattern)}, {text(by)}, 'g')"
    return f"SELECT idx, trim(CASE WHEN regexp_full_match(replace(f, ',', ''), '[0-9]+') THEN replace(f, ',', '') ELSE f END) AS final FROM (SELECT idx, replace({out}, '$', '') AS f FROM examples) e"


@query("c13_normalize_final_answer", _final_sql(), "examples")
def c13(spark, sf_dir):
    return view(spark, sf_dir, "examples").select("idx", A.normalize_final_answer(F.concat(F.lit("x = "), "answer")).alias("final"))


@query("c14_issue_flags", f"""SELECT case_id, CAST(response_length >= 127 AS DOUBLE) AS hit_length_cap, CAST(contains(response, '<think>') AND NOT contains(response, '</think>') AS DOUBLE) AS unclosed_think,
 CAST({_BOX} = '' AS DOUBLE) AS missing_boxed_answer, CAST(regexp_matches(response, '{_TURN}') AS DOUBLE) AS prompt_contamination,
 CAST(response_length >= 127 OR (contains(response, '<think>') AND NOT contains(response, '</think>')) AS DOUBLE) AS truncation FROM responses""", "responses")
def c14(spark, sf_dir):
    r = F.col("response")
    flags = A.issue_flags(r, A.extract_boxed(r), F.col("response_length"), 128)
    return _responses(spark, sf_dir).select("case_id", *[c.alias(n) for n, c in flags.items()])


_GRAMS = f"list_transform(range(1, len({_WORDS}) - 2), lambda i: list_aggregate(({_WORDS})[i:i + 3], 'string_agg', ' '))"


@query("c15_severe_repetition", f"""SELECT case_id, coalesce(len(w) >= 12 AND (1.0 - len(list_distinct(g)) / CAST(len(g) AS DOUBLE) >= 0.34 OR many >= 3), false) AS repeats
FROM (SELECT case_id, {_WORDS} AS w, list_transform(range(1, CAST(greatest(len({_WORDS}) - 2, 1) AS BIGINT)), lambda i: array_to_string(({_WORDS})[i:i + 3], ' ')) AS g,
 (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_filter(list_transform(string_split(response, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12)) AS l) GROUP BY l)) AS many FROM responses)""", "responses")
def c15(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", A.severe_repetition(F.col("response")).alias("repeats"))


@query("c16_extract_choice", "SELECT case_id, regexp_extract(response, '[012]') AS choice FROM responses", "responses")
def c16(spark, sf_dir):
    return _responses(spark, sf_dir).select("case_id", T.extract_choice(F.col("response")).alias("choice"))


@_raw("d1_score_math", _s("SELECT case_id, accuracy, format_rate AS format, round(0.9 * accuracy + 0.1 * format_rate, 6) AS overall FROM s"))
def d1(spark, sf_dir):
    return R.score_math(_responses(spark, sf_dir)).select("case_id", "accuracy", "format", F.round("overall", 6).alias("overall"))


_ANS = "trim(coalesce(list_last(regexp_extract_all(right(response, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)), '[INVALID]'))"
_OVER = "CASE WHEN response_length <= 160 THEN 0.0 WHEN response_length <= 256 THEN CAST(160 - response_length AS DOUBLE) / 96 ELSE -1.0 END"


@query("d2_score_dapo", f"SELECT case_id, CAST(CASE WHEN {_ANS} = gold THEN 1.0 ELSE -1.0 END AS DOUBLE) AS accuracy, round(CAST({_OVER} AS DOUBLE), 6) AS overlong, round(CAST(CASE WHEN {_ANS} = gold THEN 1.0 ELSE -1.0 END + 0.5 * ({_OVER}) AS DOUBLE), 6) AS overall FROM responses", "responses")
def d2(spark, sf_dir):
    out = R.score_dapo(_responses(spark, sf_dir), 256, 96, 0.5)
    return out.select("case_id", "accuracy", F.round("overlong", 6).alias("overlong"), F.round("overall", 6).alias("overall"))


@query("d3_score_answer_tag", f"""SELECT case_id, accuracy, format, round(0.5 * accuracy + 0.5 * format, 6) AS overall FROM (SELECT case_id, {_TAGGED} AS format,
 CAST(lower(regexp_replace(trim(CASE WHEN regexp_matches(styled, '<answer>[^\n]*?</answer>') THEN regexp_extract(styled, '<answer>([^\n]*?)</answer>', 1) ELSE styled END, ' ' || chr(10)), '\\s+', ' ', 'g')) = gold AS DOUBLE) AS accuracy
 FROM (SELECT *, {_STYLED} AS styled FROM responses) x) y""", "responses")
def d3(spark, sf_dir):
    return R.score_answer_tag(_responses(spark, sf_dir).withColumn("response", F.expr(_STYLED))).select("case_id", "accuracy", "format", F.round("overall", 6).alias("overall"))


@query("d4_score_choice", "SELECT case_id, CAST(regexp_extract(response, '[012]') = gold AS DOUBLE) AS overall FROM responses", "responses")
def d4(spark, sf_dir):
    return R.score_choice(_responses(spark, sf_dir)).select("case_id", "overall")


def _brevity(rows, weight):
    return [{"overall": weight * (x["response_length"] % 7), "even": float(x["response_length"] % 2 == 0)} for x in rows]


@query("d5_apply_reward", "SELECT case_id, CAST(0.5 * (response_length % 7) AS DOUBLE) AS overall, CAST(response_length % 2 = 0 AS DOUBLE) AS even FROM responses", "responses")
def d5(spark, sf_dir):
    return R.apply_reward(_responses(spark, sf_dir), _brevity, "batch", ("overall", "even"), weight=0.5).select("case_id", "overall", "even")


def _brief(row, weight):
    return {"overall": weight * (row["response_length"] % 7) if row["ground_truth"] != "3" else None}


@query("d5_sequential", "SELECT case_id, CASE WHEN gold <> '3' THEN CAST(0.25 * (response_length % 7) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS overall, CAST(0 AS DOUBLE) AS missing FROM responses", "responses")
def d5s(spark, sf_dir):
    return R.apply_reward(_responses(spark, sf_dir), _brief, "sequential", ("overall", "missing"), weight=0.25).select("case_id", "overall", "missing")


_D6 = ("accuracy", "format_rate", "answer_extractable", "extract_failure", "hit_length_cap", "unclosed_think", "missing_boxed_answer", "prompt_contamination", "truncation")


@_raw("d6_diagnose", _s(f"""SELECT case_id, accuracy, format_rate, CAST(boxed_answer <> '' AND length(boxed_answer) <= 100 AS DOUBLE) AS answer_extractable, 1.0 - CAST(boxed_answer <> '' AND length(boxed_answer) <= 100 AS DOUBLE) AS extract_failure,
 CAST(response_length >= 127 AS DOUBLE) AS hit_length_cap, CAST(contains(response, '<think>') AND NOT contains(response, '</think>') AS DOUBLE) AS unclosed_think, CAST(boxed_answer = '' AS DOUBLE) AS missing_boxed_answer,
 CAST(regexp_matches(response, '{_TURN}') AS DOUBLE) AS prompt_contamination, CAST(response_length >= 127 OR (contains(response, '<think>') AND NOT contains(response, '</think>')) AS DOUBLE) AS truncation FROM s"""))
def d6(spark, sf_dir):
    return R.diagnose(_responses(spark, sf_dir), 128).select("case_id", *_D6)


@query("d6_diagnose_all")
def d6a(spark, sf_dir):
    return R.diagnose(_responses(spark, sf_dir), 128).select("case_id", *R.DIAGNOSTICS, "boxed_answer", "robust_answer")


@query("f1_flatten_candidates", "SELECT uid, candidate_index, accuracy, uid % 5 <> 0 AS nested FROM candidates WHERE uid % 5 <> 0 UNION ALL SELECT DISTINCT uid, CAST(-1 AS BIGINT), CAST(NULL AS DOUBLE), false FROM candidates WHERE uid % 5 = 0", "candidates")
def f1(spark, sf_dir):
    c = view(spark, sf_dir, "candidates").groupBy("uid").agg(F.collect_list(F.struct("candidate_index", "accuracy")).alias("candidates"))
    c = c.select("uid", F.lit(-1).cast("long").alias("candidate_index"), (F.col("uid") % 5 != 0).alias("nested"), F.when(F.col("uid") % 5 != 0, F.col("candidates")).alias("candidates"))
    return E.flatten_candidates(c).select("uid", "candidate_index", "accuracy", "nested")


_BEST = "row_number() OVER (PARTITION BY uid ORDER BY train_reward_v1 DESC, accuracy DESC, response_length, candidate_index)"


@query("f2_select_best", f"SELECT uid, candidate_index, response_length, boxed_answer FROM (SELECT *, {_BEST} AS p FROM candidates) WHERE p = 1", "candidates")
def f2(spark, sf_dir):
    return E.select_best(view(spark, sf_dir, "candidates")).select("uid", "candidate_index", "response_length", "boxed_answer")


@query("f3_pass_at_k", "SELECT uid, max(CASE WHEN accuracy > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS pass_at_k FROM candidates GROUP BY uid", "candidates")
def f3(spark, sf_dir):
    return E.pass_at_k(view(spark, sf_dir, "candidates"))


_MAJ = """SELECT u.uid, v.answer AS majority_answer, CAST(coalesce(v.answer = u.gold, false) AS DOUBLE) AS maj_at_k FROM (SELECT uid, min(gold) AS gold FROM candidates GROUP BY uid) u LEFT JOIN
 (SELECT uid, answer FROM (SELECT uid, boxed_answer AS answer, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, min(candidate_index)) AS p FROM candidates WHERE boxed_answer <> '' GROUP BY uid, boxed_answer) WHERE p = 1) v ON u.uid = v.uid"""


@query("f4_maj_at_k", _MAJ, "candidates")
def f4(spark, sf_dir):
    return E.maj_at_k(view(spark, sf_dir, "candidates"))


@query("f5_group_means", "SELECT uid, round(avg(format_rate), 6) AS format_at_k, round(avg(response_length), 6) AS mean_response_length FROM candidates GROUP BY uid", "candidates")
def f5(spark, sf_dir):
    return E.group_means(view(spark, sf_dir, "candidates")).select("uid", F.round("format_at_k", 6).alias("format_at_k"), F.round("mean_response_length", 6).alias("mean_response_length"))


@query("f6_eval_report", f"""SELECT count(*) AS problems, round(avg(pass), 6) AS pass_at_k, round(avg(maj_at_k), 6) AS maj_at_k, round(avg(fmt), 6) AS format_at_k, round(avg(len), 6) AS mean_length, round(avg(ga), 6) AS greedy_accuracy,
 round(avg(gf), 6) AS greedy_format_rate, round(avg(gr), 6) AS greedy_train_reward_v1, round(avg(sa), 6) AS selected_accuracy, round(avg(sf), 6) AS selected_format_rate, round(avg(sr), 6) AS selected_train_reward_v1
FROM (SELECT uid, max(CASE WHEN accuracy > 0 THEN 1.0 ELSE 0.0 END) AS pass, avg(format_rate) AS fmt, avg(response_length) AS len, arg_min(accuracy, candidate_index) AS ga, arg_min(format_rate, candidate_index) AS gf,
 arg_min(train_reward_v1, candidate_index) AS gr, max(accuracy) FILTER (p = 1) AS sa, max(format_rate) FILTER (p = 1) AS sf, max(train_reward_v1) FILTER (p = 1) AS sr FROM (SELECT *, {_BEST} AS p FROM candidates) GROUP BY uid) a JOIN ({_MAJ}) m ON a.uid = m.uid""", "candidates")
def f6(spark, sf_dir):
    out = E.eval_report(view(spark, sf_dir, "candidates"))
    return out.select("problems", *[F.round(c, 6).alias(c) for c in out.columns if c != "problems"])


_MORE = {
    "robust_accuracy": "CAST(accuracy > 0 OR (uid + candidate_index) % 4 = 0 AS DOUBLE)", "missing_boxed_answer": "CAST(boxed_answer = '' AS DOUBLE)",
    "verifier_false_negative_candidate": "CAST(accuracy <= 0 AND (uid + candidate_index) % 4 = 0 AS DOUBLE)", "robust_extract_failure": "CAST(boxed_answer = '' AND uid % 2 = 0 AS DOUBLE)",
    "hit_length_cap": "CAST(response_length >= 40 AS DOUBLE)", "unclosed_think": "CAST((uid + candidate_index) % 3 = 1 AS DOUBLE)", "prompt_contamination": "CAST(uid % 11 = 0 AS DOUBLE)",
    "diagnostic_score_v2_lite": "CAST(0.85 AS DOUBLE) * accuracy + CAST(0.1 AS DOUBLE) * format_rate + CAST(0.05 AS DOUBLE) * CAST(boxed_answer <> '' AS DOUBLE)"}
_RATES = {"verifier_false_negative_candidate_rate": "verifier_false_negative_candidate", "robust_extract_failure_rate": "robust_extract_failure", "hit_length_cap_rate": "hit_length_cap", "unclosed_think_rate": "unclosed_think",
          "missing_boxed_answer_rate": "missing_boxed_answer", "prompt_contamination_rate": "prompt_contamination", "greedy_accuracy": "accuracy", "greedy_robust_accuracy": "robust_accuracy"}
_CHOSEN = {"best_of_N_accuracy": "accuracy", "selected_train_reward_v1": "train_reward_v1", "selected_diagnostic_score_v2_lite": "diagnostic_score_v2_lite", "best_of_N_robust_accuracy": "robust_accuracy"}


@query("f6_full_report", f"""SELECT count(*) AS count, round(avg(maj_at_k), 6) AS maj_at_k, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("pass_at_k", "robust_pass_at_k", "format_at_k", "mean_response_length", *_RATES, *_CHOSEN))}
FROM (SELECT uid, CAST(bool_or(accuracy > 0) AS DOUBLE) AS pass_at_k, CAST(bool_or(robust_accuracy > 0) AS DOUBLE) AS robust_pass_at_k, avg(format_rate) AS format_at_k, avg(response_length) AS mean_response_length,
 {", ".join(f"arg_min({c}, candidate_index) AS {name}" for name, c in _RATES.items())}, {", ".join(f"max({c}) FILTER (p = 1) AS {name}" for name, c in _CHOSEN.items())}
 FROM (SELECT *, {_BEST} AS p FROM (SELECT *, {", ".join(f"{e} AS {name}" for name, e in _MORE.items())} FROM candidates)) GROUP BY uid) a JOIN ({_MAJ}) m ON a.uid = m.uid""", "candidates")
def f6f(spark, sf_dir):
    out = E.full_report(view(spark, sf_dir, "candidates").selectExpr("*", *[f"{e} AS {name}" for name, e in _MORE.items()]))
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


@query("f6_report_by_run", f""", r AS (SELECT *, concat('run', CAST((uid + candidate_index) % 3 AS VARCHAR)) AS run FROM candidates),
best AS (SELECT *, row_number() OVER (PARTITION BY run, uid ORDER BY train_reward_v1 DESC, accuracy DESC, response_length, candidate_index) AS p FROM r),
votes AS (SELECT run, uid, boxed_answer AS answer, row_number() OVER (PARTITION BY run, uid ORDER BY count(*) DESC, min(candidate_index)) AS p FROM r WHERE boxed_answer <> '' GROUP BY run, uid, boxed_answer),
one AS (SELECT run, uid, min(gold) AS gold, max(CASE WHEN accuracy > 0 THEN 1.0 ELSE 0.0 END) AS pass_at_k, avg(format_rate) AS format_at_k, avg(response_length) AS mean_response_length, arg_min(accuracy, candidate_index) AS greedy_accuracy,
 max(accuracy) FILTER (p = 1) AS best_of_N_accuracy, max(train_reward_v1) FILTER (p = 1) AS selected_train_reward_v1 FROM best GROUP BY run, uid)
SELECT one.run, count(*) AS count, round(avg(pass_at_k), 6) AS pass_at_k, round(avg(format_at_k), 6) AS format_at_k, round(avg(mean_response_length), 6) AS mean_response_length, round(avg(greedy_accuracy), 6) AS greedy_accuracy,
 round(avg(best_of_N_accuracy), 6) AS best_of_N_accuracy, round(avg(selected_train_reward_v1), 6) AS selected_train_reward_v1, round(avg(CAST(coalesce(answer = gold, false) AS DOUBLE)), 6) AS maj_at_k
FROM one LEFT JOIN (SELECT * FROM votes WHERE p = 1) v ON one.run = v.run AND one.uid = v.uid GROUP BY one.run""", "candidates")
def f6r(spark, sf_dir):
    rows = view(spark, sf_dir, "candidates").withColumn("run", F.concat(F.lit("run"), ((F.col("uid") + F.col("candidate_index")) % 3).cast("string")))
    out = E.full_report(rows, run="run")
    shown = ("pass_at_k", "format_at_k", "mean_response_length", "greedy_accuracy", "best_of_N_accuracy", "selected_train_reward_v1", "maj_at_k")
    return out.select("run", "count", *[F.round(c, 6).alias(c) for c in shown])


@query("f7_rescore")
def f7(spark, sf_dir):
    r = _responses(spark, sf_dir).select("conv_id", "gold", F.struct(F.col("turn").alias("candidate_index"), "response").alias("c"))
    nested = r.groupBy("conv_id", "gold").agg(F.sort_array(F.collect_list("c")).alias("candidates"))
    return E.rescore(nested, 128).select("conv_id", "gold", "candidate_index", "response_length", *R.DIAGNOSTICS)


@_raw("f8_run_summary", _s("SELECT CONCAT('run', CAST(conv_id % 3 AS VARCHAR)) AS run, count(*) AS n, round(avg(CASE WHEN turn % 4 = 0 THEN 0.0 ELSE accuracy END), 6) AS accuracy, round(avg(format_rate), 6) AS format_rate, round(avg(CAST(boxed_answer = '' AS DOUBLE)), 6) AS missing_boxed_answer FROM s GROUP BY conv_id % 3"))
def f8(spark, sf_dir):
    d = R.diagnose(_responses(spark, sf_dir), 128).withColumn("run", F.expr("concat('run', conv_id % 3)")).withColumn("accuracy", F.expr("CASE WHEN turn % 4 <> 0 THEN accuracy END"))
    out = E.run_summary(d)
    return out.select("run", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "format_rate", "missing_boxed_answer")])


@_raw("f9_summarize_scores", _s("SELECT 'scores/part-' || CAST(conv_id % 2 AS VARCHAR) AS source_file, count(*) AS n, round(avg(0.9 * accuracy + 0.1 * format_rate), 6) AS overall, round(avg(format_rate), 6) AS format, round(avg(accuracy), 6) AS accuracy FROM s GROUP BY conv_id % 2"))
def f9(spark, sf_dir):
    scored = R.score_math(_responses(spark, sf_dir)).withColumn("source_file", F.expr("concat('scores/part-', conv_id % 2)"))
    out = E.summarize_scores(scored)
    return out.select("source_file", "n", *[F.round(c, 6).alias(c) for c in ("overall", "format", "accuracy")])


@query("f10_collect_reports", "SELECT CAST(1 + uid % 7 % 2 * 3 AS BIGINT) AS n, 'r' || CAST(uid % 7 AS VARCHAR) AS run, CASE WHEN uid % 7 % 2 = 1 THEN 'best_of_n' ELSE 'greedy' END AS metric_family, round(avg(accuracy), 6) AS accuracy FROM candidates GROUP BY uid % 7", "candidates")
def f10(spark, sf_dir):
    """Reports written for seven runs, each in a folder of its name, and collected from there."""
    at = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    names = "concat('r', uid % 7, IF(uid % 7 % 2 = 1, '_math12k_best_of_4', '_gsm8k_greedy'), '_report') AS name"
    reports = view(spark, sf_dir, "candidates").selectExpr(names, "bigint(1 + uid % 7 % 2 * 3) AS n", "accuracy").groupBy("name", "n").agg(F.avg("accuracy").alias("accuracy"))
    reports.write.partitionBy("name").json(at)
    found = S.read_reports(spark, f"{at}/name=*/*", "n long, accuracy double").withColumn("source_file", F.regexp_extract("source_file", "name=([^/]+)/", 1))
    return E.collect_reports(found).select("n", "run", "metric_family", F.round("accuracy", 6).alias("accuracy"))


_CASES = "(SELECT uid * 100 + candidate_index AS case_id, accuracy, format_rate, CASE WHEN response_length > 45 THEN CAST(1 AS DOUBLE) END AS truncation FROM candidates)"


def _cases(spark, sf_dir):
    return view(spark, sf_dir, "candidates").selectExpr("uid * 100 + candidate_index AS case_id", "accuracy", "format_rate", "CASE WHEN response_length > 45 THEN 1D END AS truncation")


_ODD = "((accuracy > 0) <> (format_rate > 0) OR coalesce(truncation, 0) > 0)"


@query("f11_suspicious", f"SELECT case_id FROM {_CASES} c WHERE {_ODD}", "candidates")
def f11(spark, sf_dir):
    return E.suspicious(_cases(spark, sf_dir)).select("case_id")


def _pool(where: str, n: int, seed: int, priority: int) -> str:
    return f"(SELECT case_id, {priority} AS pr, md5('{seed}|' || CAST(case_id AS VARCHAR)) AS k FROM {_CASES} c WHERE {where} ORDER BY k, case_id LIMIT {n})"


def _sample(pools: list[str], size: int) -> str:
    both = " UNION ALL ".join(f"SELECT * FROM {p}" for p in pools)
    return f"SELECT case_id, CAST(pr AS BIGINT) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pr, k) AS f FROM ({both})) WHERE f = 1 ORDER BY pr, k, case_id LIMIT {size}"


@query("f12_audit_sample", _sample([_pool(_ODD, 50, 0, 0), _pool("accuracy <= 0", 30, 1, 1), _pool("true", 20, 2, 2), _pool("true", 200, 3, 3)], 100), "candidates")
def f12(spark, sf_dir):
    return E.audit_sample(_cases(spark, sf_dir)).select("case_id", "pool")


@query("f13_error_sample", _sample([_pool("accuracy <= 0", 50, 1, 0), _pool(_ODD, 50, 0, 1), _pool("true", 100, 2, 2)], 50), "candidates")
def f13(spark, sf_dir):
    return E.error_sample(_cases(spark, sf_dir)).select("case_id", "pool")


@query("f14_audit_summary", """SELECT count(*) AS audited, count(*) FILTER (human_audit_label = 'correct_accept') AS correct_accept, count(*) FILTER (human_audit_label = 'correct_reject') AS correct_reject, count(*) FILTER (human_audit_label = 'wrong_accept') AS false_positives,
 count(*) FILTER (human_audit_label = 'wrong_reject') AS false_negatives, count(*) FILTER (human_audit_label = 'truncation') AS other_labels, round(avg(CAST(verifier_accepts = human_correct AS DOUBLE)), 6) AS agreement_rate FROM audit""", "audit")
def f14(spark, sf_dir):
    a = view(spark, sf_dir, "audit")
    out = E.audit_summary(a.select("case_id", "verifier_accepts"), a.select("case_id", "human_correct", "human_audit_label"))
    return out.withColumn("agreement_rate", F.round("agreement_rate", 6))


@query("f15_sample_generations", "SELECT case_id FROM (SELECT min(case_id) AS case_id, response FROM responses GROUP BY response) x ORDER BY md5('42|' || response), response LIMIT 10", "responses")
def f15(spark, sf_dir):
    return E.sample_generations(_responses(spark, sf_dir).groupBy("response").agg(F.min("case_id").alias("case_id")), 10, input_col="response").select("case_id")
