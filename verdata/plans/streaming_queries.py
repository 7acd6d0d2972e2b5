"""Streams over logs that Spark writes from the given tables, each run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdata.plans.fixtures import view, with_views
from verdata.plans.rollout_queries import _BEST
from verdata.plans.storage import materialize, shared_dir
from verdata.streaming import logs as L
from verdata.streaming.upserts import latest

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@query("l1_stream_best", f"SELECT run, step, round(train_reward_v1, 6) AS train_reward_v1 FROM {_BEST} x WHERE b = 1", "validation")
def l1(spark, sf_dir):
    at, rows = _folder(spark), view(spark, sf_dir, "validation").select("run", "step", "train_reward_v1")
    for k in range(3):  # each part of the log comes while the stream is stopped; it goes on from its checkpoint
        rows.where(F.pmod("step", F.lit(3)) == k).write.mode("append").json(f"{at}/in")
        L.stream_best(spark, f"{at}/in", rows.schema, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return latest(spark, f"{at}/out", "run").select("run", "step", F.round("train_reward_v1", 6).alias("train_reward_v1"))


@query("l2_stream_progress", "SELECT 'audit' AS artifact, count(*) AS n, count(*) >= 100 AS done FROM audit UNION ALL SELECT 'errors', count(*) FILTER (human_audit_label LIKE 'wrong%'), count(*) FILTER (human_audit_label LIKE 'wrong%') >= 50 FROM audit", "audit")
def l2(spark, sf_dir):
    at, rows = _folder(spark), view(spark, sf_dir, "audit")
    for k in range(3):
        part = rows.where(F.pmod("case_id", F.lit(3)) == k)
        part.write.mode("append").json(f"{at}/in/audit")
        part.where("human_audit_label LIKE 'wrong%'").write.mode("append").json(f"{at}/in/errors")
        for q in L.stream_progress(spark, {n: f"{at}/in/{n}" for n in ("audit", "errors")}, rows.schema, {"audit": 100, "errors": 50}, f"{at}/out", f"{at}/checkpoint"):
            q.awaitTermination()
    return latest(spark, f"{at}/out/audit", "artifact").unionByName(latest(spark, f"{at}/out/errors", "artifact"))


# A group's candidates come in three parts; it is complete with the part of its last one.
@query("l3_stream_fill_batches", """SELECT CAST(floor((row_number() OVER (ORDER BY part, uid) - 1) / 16) AS BIGINT) AS train_batch, uid FROM (SELECT uid, max(candidate_index % 3) AS part FROM candidates GROUP BY uid HAVING avg(accuracy) > 0.01 AND avg(accuracy) < 0.99)
 QUALIFY row_number() OVER (ORDER BY part, uid) <= floor(count(*) OVER () / 16) * 16""", "candidates")
def l3(spark, sf_dir):
    at = _folder(spark)
    rows = materialize(view(spark, sf_dir, "candidates").selectExpr("uid", "candidate_index", "accuracy", "uid AS arrival", "count(*) OVER (PARTITION BY uid) AS n_candidates", "timestamp_seconds(candidate_index % 3 * 60 + 60) AS time"))
    for k in range(3):
        rows.where(F.col("candidate_index") % 3 == k).write.mode("append").json(f"{at}/in")
        L.stream_fill_batches(spark, f"{at}/in", rows.schema, 16, f"{at}/out", f"{at}/checkpoint", size="n_candidates").awaitTermination()
    return spark.read.parquet(f"{at}/out/full").select("train_batch", "uid").distinct()
