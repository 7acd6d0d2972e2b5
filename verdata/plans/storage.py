"""Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts a job's lineage: a lost executor makes Spark read it again
instead of computing it anew, and later stages see one fixed version of the rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast by :func:`broadcast_if_small`.
SMALL_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; on a single machine without one (tests), one of this session's own.

    More than one machine can't share a local folder, so without the setting this is an error there.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_verdata_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._verdata_shared = own
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdata_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing will read them again."""
    for df in tables:
        path = getattr(df, "_verdata_path", None)
        if path:
            delete(df.sparkSession, path)


def broadcast_if_small(written: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of narrow rows with a broadcast hint if it has at most ``rows`` rows; as it is (for a shuffled join) beyond.

    The count reads Parquet footers only.
    """
    return F.broadcast(written) if written.count() <= rows else written


def in_tasks(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """``df``, made of ``rows`` rows at most, in no more tasks than these need at ``each`` a task, but one for each core.

    A shuffle of few rows has as many partitions as one of many, and starting them is what it costs; nothing moves, neighbouring ones share a task.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))
