"""Views over the given tables that stand for the library's inputs. The SQL runs on Spark and on DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdata.operators.numbering import number_rows
from verdata.sources.files import read_spread

TABLES = ("documents", "embeddings", "conversations", "events", "lineitem", "labels", "benchmark")

_RUN = "concat('run', CAST(user_id % 6 AS STRING)) AS run"
_LOG = """event_type = 'purchase' AS is_validation,
 CASE WHEN event_type = 'purchase' THEN value / CAST(100 AS DOUBLE) END AS accuracy,
 CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN value / CAST(120 AS DOUBLE) END AS reward_score,
 value / CAST(150 AS DOUBLE) AS overall_reward, value / CAST(200 AS DOUBLE) AS format_reward"""
_LOGGED = ("is_validation", "accuracy", "reward_score", "overall_reward", "format_reward")
_RUN_ROWS = f"SELECT {_RUN}, ts, event_id, {_LOG} FROM events"

VIEWS = {
    "examples": """
SELECT doc_id AS idx, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, text AS problem,
 CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN CAST(n_chars AS STRING)
  WHEN 3 THEN concat('-', CAST(n_chars AS STRING), '.5') WHEN 4 THEN concat(CAST(n_chars AS STRING), '/7')
  WHEN 5 THEN concat(chr(92), 'frac{', CAST(n_chars AS STRING), '}{7}') WHEN 6 THEN concat('2', chr(92), 'sqrt{3}')
  WHEN 7 THEN concat('x^2+', CAST(doc_id AS STRING)) WHEN 8 THEN concat('2', chr(92), 'pi')
  WHEN 9 THEN concat(chr(92), 'text{yes}') WHEN 10 THEN '1, 2'
  ELSE concat(chr(92), 'left(', repeat('9+', 30), '1', chr(92), 'right)') END AS answer
FROM documents""",
    "candidates": """
SELECT uid, candidate_index, response_length, boxed_answer, gold, format_rate, accuracy,
 CAST(0.9 AS DOUBLE)*accuracy + CAST(0.1 AS DOUBLE)*format_rate AS train_reward_v1
FROM (SELECT *, CASE WHEN boxed_answer = gold THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS accuracy
 FROM (SELECT l_orderkey AS uid,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS candidate_index,
  CAST(l_quantity AS BIGINT) AS response_length,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(l_partkey % 3 AS STRING) END AS boxed_answer,
  CAST(l_orderkey % 3 AS STRING) AS gold,
  CASE WHEN l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS format_rate
 FROM lineitem) a) b""",
    "responses": """
SELECT conv_id * 1000 + turn AS case_id, conv_id, turn, CAST((conv_id + turn) % 5 AS STRING) AS gold,
 CAST(length(text) AS BIGINT) AS response_length,
 CASE (conv_id + turn) % 6
  WHEN 0 THEN concat('<think>', text, '</think> The answer is ', chr(92), 'boxed{', CAST((conv_id*7 + turn) % 5 AS STRING), '}. More text')
  WHEN 1 THEN concat('<think>', text)
  WHEN 2 THEN concat(text, chr(10), coalesce(next_role, 'user'), ': ', coalesce(next_text, ''))
  WHEN 3 THEN concat(text, ' so ', chr(92), 'boxed{1} then ', chr(92), 'boxed{', chr(92), 'frac{3}{4}}')
  WHEN 4 THEN concat(text, chr(10), 'Answer: ', CAST((conv_id + turn) % 5 AS STRING))
  ELSE repeat(concat('again and again it ', chr(10)), 6) END AS response
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) c""",
    "run_log": f"""
SELECT {_RUN}, CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS BIGINT) AS step, {_LOG}
FROM events""",
    "validation": """
SELECT run, step, accuracy, format_reward AS format_rate, coalesce(nullif(reward_score, CAST(0 AS DOUBLE)), overall_reward) AS train_reward_v1
FROM run_log WHERE is_validation""",
    "audit": """
SELECT doc_id AS case_id, doc_id % 3 <> 0 AS verifier_accepts, quality = 1 AS human_correct,
 CASE WHEN toxic = 1 THEN 'truncation' WHEN doc_id % 3 <> 0 AND quality = 1 THEN 'correct_accept' WHEN doc_id % 3 <> 0 THEN 'wrong_accept'
  WHEN quality = 1 THEN 'wrong_reject' ELSE 'correct_reject' END AS human_audit_label
FROM labels""",
    "messages": """
SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN concat('<image>', text) ELSE text END AS prompt FROM conversations""",
    "episodes": """
SELECT CAST(user_id % 10 AS STRING) AS device_id, user_id AS episode_id, least(count(*), 10) AS completed_rounds FROM events GROUP BY user_id""",
}
#: Long form of the token arrays, one row for each token.
_PROPERTIES = """
 -abs(x) AS log_prob, -abs(x) * CAST(0.9 AS DOUBLE) - CAST(0.001 AS DOUBLE) * pos AS ref_log_prob, -abs(x) * CAST(1.05 AS DOUBLE) AS old_log_prob, x * CAST(0.5 AS DOUBLE) AS value,
 CASE WHEN pos < 8 + seq_id % 57 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS mask,
 CASE WHEN pos = 7 + seq_id % 57 THEN CAST(seq_id % 3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score, seq_id - seq_id % 4 AS uid, x * CAST(3 AS DOUBLE) AS adv"""
TOKENS_SQL = f"SELECT seq_id, pos, {_PROPERTIES} FROM (SELECT vec_id AS seq_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e"
_NEEDS = {"validation": ("run_log",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = " ".join(VIEWS[n] for n in (*_NEEDS.get(name, ()), name))
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            read_spread(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in _NEEDS.get(name, ()):
        _run(spark, n).createOrReplaceTempView(n)
    return _run(spark, name)


def _run(spark: SparkSession, name: str) -> DataFrame:
    """A view over registered tables. The steps of ``run_log`` come from range partitions here: in its SQL each run is one window."""
    if name != "run_log":
        return spark.sql(VIEWS[name])
    rows = spark.sql(_RUN_ROWS)
    return number_rows(rows, ["run"], [F.col("ts"), F.col("event_id")], "step").withColumn("step", F.col("step") + 1).select("run", "step", *_LOGGED)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays by sequence, from the embeddings' components."""
    e = read_spread(spark, f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS seq_id", "vec_id - vec_id % 4 AS uid", "cast(embedding AS array<double>) AS x", "8 + vec_id % 57 AS n")
    arr = lambda body: f"transform(x, (v, i) -> {body})"
    return e.selectExpr("seq_id", "uid", "x", f"{arr('-abs(v)')} AS log_probs", f"{arr('-abs(v) * 0.9D - 0.001D * i')} AS ref_log_probs", f"{arr('-abs(v) * 1.05D')} AS old_log_probs",
                        f"{arr('v * 0.5D')} AS values", f"{arr('CASE WHEN i < n THEN 1D ELSE 0D END')} AS mask", f"{arr('CASE WHEN i = n - 1 THEN cast(seq_id % 3 AS double) ELSE 0D END')} AS scores",
                        f"{arr('v * 3D')} AS advantages", "cast(least(n, size(x)) AS bigint) AS n_tokens")


def with_views(sql: str, *names: str) -> str:
    """SQL over the named views, for DuckDB."""
    parts = []
    for n in names:
        if n == "tokens":
            parts.append(f"tokens AS ({TOKENS_SQL})")
            continue
        for m in (*_NEEDS.get(n, ()), n):
            if not any(p.startswith(f"{m} AS") for p in parts):
                parts.append(f"{m} AS ({VIEWS[m]})")
    return f"WITH {', '.join(parts)}{sql}" if sql.startswith(",") else f"WITH {', '.join(parts)} {sql}"
