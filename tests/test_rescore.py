"""Rescored candidates of all responses against plain versions."""

from pyspark.sql import functions as F

from tests.test_text import plain_boxed, plain_equal, plain_robust, plain_strict, repeats_badly
from verdata.operators import evaluate as E
from verdata.plans.evaluation_queries import QUERIES
from verdata.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_rescore_of_all_responses(spark):
    """Every nested candidate comes out once, with words counted where no length is given."""
    texts = {(r["conv_id"], r["turn"]): (r["response"], r["gold"]) for r in view(spark, SF, "responses").collect()}
    got = QUERIES["f7_rescore"](spark, SF).collect()
    assert {(r["conv_id"], r["candidate_index"]) for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        t, gold = texts[r["conv_id"], r["candidate_index"]]
        n = len(t.split())
        box, robust = plain_boxed(t), plain_robust(t, gold)
        truncated = n >= 127 or ("<think>" in t and "</think>" not in t)
        assert r["response_length"] == n and r["accuracy"] == float(plain_strict(box, gold)) and r["robust_accuracy"] == float(robust != "" and plain_equal(robust, gold))
        assert r["truncation"] == float(truncated) and r["repetition"] == float(repeats_badly(t)) and r["missing_boxed_answer"] == float(box == "")
        assert r["answer_extractable"] == float(0 < len(box) <= 100) and r["robust_answer_extractable"] == float(0 < len(robust) <= 120)


def test_run_summary_has_every_diagnostic(spark):
    """Averages over all rows of each run, null as 0, of all 17 columns."""
    from verdata.operators.rewards import DIAGNOSTICS, diagnose

    d = diagnose(view(spark, SF, "responses"), 128).withColumn("run", F.expr("concat('run', conv_id % 3)")).withColumn("format_rate", F.expr("CASE WHEN turn % 3 > 0 THEN format_rate END"))
    rows = [r.asDict() for r in d.select("run", *DIAGNOSTICS).collect()]
    for r in E.run_summary(d).collect():
        own = [x for x in rows if x["run"] == r["run"]]
        assert r["n"] == len(own) and all(abs(r[k] - sum(x[k] or 0 for x in own) / len(own)) < 1e-12 for k in DIAGNOSTICS)


def test_user_rewards_leave_other_columns_alone(spark):
    from verdata.operators.rewards import apply_reward

    df = spark.createDataFrame([("a", 3, "x", [1, 2], None), (None, None, None, None, 5)], "response string, response_length long, gold string, other array<int>, `a.b` int").withColumnRenamed("a.b", "c")
    out = apply_reward(df, lambda rows, k: [{"overall": k * len(x["response"] or ""), "n": x["response_length"]} for x in rows], "batch", ("overall", "n"), k=2)
    assert [tuple(r) for r in out.collect()] == [("a", 3, "x", [1, 2], None, 2.0, 3.0), (None, None, None, None, 5, 0.0, 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
