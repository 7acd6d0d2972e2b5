"""Incremental jobs over append-only logs and result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdata.operators.numbering import number_rows
from verdata.operators.rollouts import filter_groups
from verdata.plans.storage import drop, materialize
from verdata.streaming.groups import gather_groups
from verdata.streaming.upserts import upsert


def best_of_stream(log: DataFrame, by: str = "run", key: str = "train_reward_v1", seq: str = "step") -> DataFrame:
    """The best row of each run so far. State: one row a run. For update or complete mode."""
    rest = [c for c in log.columns if c != by]
    return log.where(F.col(key).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(F.col(key), -F.col(seq))).alias("_b")).select(by, "_b.*")


def stream_best(spark: SparkSession, path: str, schema, out: str, checkpoint: str, by: str = "run", key: str = "train_reward_v1", seq: str = "step", every: int = 16):
    """Follow JSON lines under ``path``; each trigger writes the runs whose best row has changed, under its id (see :mod:`verdata.streaming.upserts`; ``latest`` reads the table)."""
    rows = spark.readStream.schema(schema).json(path)
    return best_of_stream(rows, by, key, seq).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, batch_id: upsert(batch, batch_id, out, by, every)).start()


def stream_progress(spark: SparkSession, folders: dict[str, str], schema, targets: dict[str, int], out: str, checkpoint: str, every: int = 16) -> list:
    """Rows of each artifact's folder so far, and whether its target is reached; each trigger writes what has changed. One query for each folder; state: one row."""
    queries = []
    for name, path in folders.items():
        counted = spark.readStream.schema(schema).json(path).groupBy(F.lit(name).alias("artifact")).agg(F.count("*").alias("n"))
        done = counted.withColumn("done", F.col("n") >= targets.get(name, 0))
        queries.append(done.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).foreachBatch(
            lambda batch, batch_id, name=name: upsert(batch, batch_id, f"{out}/{name}", "artifact", every)).start())
    return queries


def fill_step(batch: DataFrame, batch_id: int, batch_groups: int, out: str, key: str = "accuracy", low: float = 0.01, high: float = 0.99, by: str = "uid", order: str = "arrival") -> None:
    """One micro-batch of whole groups: mixed ones join the remainder, and train batches of ``batch_groups`` groups are given out in order (micro-batch, arrival, key).

    ``held``, ``full`` and ``next`` are written under the micro-batch's id; the remainder (less than one batch) is read from its predecessor's, so a replayed micro-batch gives
    the same rows in the same place. The micro-batch itself is read once.
    """
    spark = batch.sparkSession
    new = filter_groups(batch, key, low, high, by).withColumn("since", F.lit(batch_id))
    at = lambda kind, b: f"{out}/{kind}/batch={b:09d}"
    number = 0
    if batch_id:
        before = spark.read.parquet(at("next", batch_id - 1)).first()
        number = before["next"]
        old = spark.read.parquet(at("held", batch_id - 1)).where(F.col("_i") >= before["given"]).drop("_i")
        new = old.unionByName(new)
    rows = materialize(new)
    # One micro-batch's groups: the numbering is over its group keys alone.
    groups = materialize(number_rows(rows.groupBy(by).agg(F.min("since").alias("_s"), F.min(order).alias("_o")), [], [F.col("_s"), F.col("_o"), F.col(by)], "_i"))
    n = groups.count()
    given = n // batch_groups * batch_groups
    held = at("held", batch_id)
    rows.join(groups.select(by, "_i"), by).write.mode("overwrite").parquet(held)
    full = spark.read.parquet(held).where(F.col("_i") < given).withColumn("train_batch", F.floor(F.col("_i") / batch_groups) + number)
    full.drop("_i", "since").write.mode("overwrite").parquet(at("full", batch_id))
    spark.range(1).select(F.lit(number + n // batch_groups).cast("long").alias("next"), F.lit(given).cast("long").alias("given")).write.mode("overwrite").parquet(at("next", batch_id))
    drop(rows, groups)


def stream_fill_batches(spark: SparkSession, path: str, schema, batch_groups: int, out: str, checkpoint: str, key: str = "accuracy", low: float = 0.01, high: float = 0.99, by: str = "uid", order: str = "arrival",
                        size: str | None = None, time: str = "time", wait_ms: int = 3_600_000):
    """Train batches from a stream of candidates, numbered on over all micro-batches; see :func:`fill_step`.

    With ``size``, a column that says how many rows a group has, a group's rows may come in any number of micro-batches; a table holds them until the last has come (see
    :func:`~verdata.streaming.groups.gather_groups`). Groups that aren't complete when the latest ``time`` is ``wait_ms`` past their first row's go to ``partial`` instead. Without it, a group
    must arrive whole within one micro-batch.
    """
    rows = spark.readStream.schema(schema).json(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        if size:
            batch, given_up = gather_groups(batch, batch_id, out, by, size, time, wait_ms)
            given_up.write.mode("overwrite").parquet(f"{out}/partial/batch={batch_id:09d}")
        fill_step(batch, batch_id, batch_groups, out, key, low, high, by, order)
        drop(batch)
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
