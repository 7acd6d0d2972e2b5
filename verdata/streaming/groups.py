"""Groups whose rows arrive in parts: held in a table until they are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdata.plans.storage import delete, materialize


def gather_groups(batch: DataFrame, batch_id: int, out: str, by: str, size: str, time: str, wait_ms: int) -> tuple[DataFrame, DataFrame]:
    """One micro-batch and the rows that wait since earlier ones: the rows of groups that are complete now, and of those given up; each group's at once.

    A group is complete when as many rows have come as its rows' ``size`` says (a null is 0). It is given up when the latest ``time`` so far is ``wait_ms`` past the first of the rows that
    began it (rows without a time count as of time 0). The others are written to ``waiting`` under the micro-batch's id, with the latest time in ``clock``, and read with the next one: a replayed
    micro-batch gives the same groups. A group is a prompt's candidates, so it is small; each micro-batch shuffles its own rows and the incomplete groups' by key, with no work for each key
    in Python. No row is dropped for coming late; rows that come after their group was given out begin another one.
    """
    spark = batch.sparkSession
    at = lambda kind, b: f"{out}/{kind}/batch={b:09d}"
    rows, clock = batch.withColumn("_until", F.lit(None).cast("long")), None
    if batch_id:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(at("waiting", batch_id - 1)))
        clock = spark.read.parquet(at("clock", batch_id - 1)).first()["latest"]
    w, millis = Window.partitionBy(by), F.unix_millis(F.col(time).cast("timestamp"))
    until = F.coalesce(F.min("_until").over(w), F.coalesce(F.min(millis).over(w), F.lit(0)) + wait_ms)
    marked = materialize(rows.withColumns({"_whole": F.count("*").over(w) >= F.max(F.coalesce(size, F.lit(0))).over(w), "_until": until}))
    latest = max((x for x in (clock, marked.agg(F.max(millis)).first()[0]) if x is not None), default=None)
    spark.range(1).select(F.lit(latest).cast("long").alias("latest")).write.mode("overwrite").parquet(at("clock", batch_id))
    late = F.coalesce(F.col("_until") <= F.lit(latest).cast("long"), F.lit(False))
    marked.where(~F.col("_whole") & ~late).select(rows.columns).write.mode("overwrite").parquet(at("waiting", batch_id))
    if batch_id > 1:
        # Only the last micro-batch can be replayed.
        delete(spark, at("waiting", batch_id - 2))
    whole, given_up = marked.where("_whole").select(batch.columns), marked.where(~F.col("_whole") & late).select(batch.columns)
    whole._verdata_path = marked._verdata_path
    return whole, given_up
