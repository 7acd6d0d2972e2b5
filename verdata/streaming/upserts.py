"""Tables of the latest row of each key, kept as changes by micro-batch over a base that is compacted now and then.

``changes/batch=<id>`` holds the keys that a micro-batch changed, ``base/batch=<id>`` all keys as of a micro-batch. A micro-batch writes its own folder only, under its
own id, so one that runs again writes the same rows in the same place; readers take a key's row of the highest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the finished folders below ``path``."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n.split("=")[1]) for n in names if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def _at(out: str, kind: str, batch: int) -> str:
    return f"{out}/{kind}/batch={batch:09d}"


def latest(spark: SparkSession, out: str, by: str, upto: int | None = None) -> DataFrame | None:
    """The row of each key after micro-batch ``upto`` (default: the last one); None before the first. Reads one base and the changes since."""
    fits = lambda kind: [b for b in _batches(spark, f"{out}/{kind}") if upto is None or b <= upto]
    bases = fits("base")[-1:]
    changes = [b for b in fits("changes") if not bases or b > bases[0]]
    parts = [spark.read.parquet(_at(out, kind, b)).withColumn("_batch", F.lit(b)) for kind, some in (("base", bases), ("changes", changes)) for b in some]
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [c for c in rows.columns if c != "_batch"]
    if len(parts) == 1:
        return rows.select(*names)
    return rows.groupBy(by).agg(F.max_by(F.struct(*names), "_batch").alias("_r")).select("_r.*").select(*names)


def upsert(changed: DataFrame, batch_id: int, out: str, by: str, every: int = 16) -> None:
    """Write the changed keys of a micro-batch; each ``every`` micro-batches, all keys as well. What no reader needs any more, behind the base before the last, goes."""
    changed.write.mode("overwrite").parquet(_at(out, "changes", batch_id))
    if batch_id % every == every - 1:
        spark = changed.sparkSession
        # Its own folder isn't among what it reads: an earlier run of this micro-batch may have left it.
        before = [b for b in _batches(spark, f"{out}/base") if b >= batch_id]
        for b in before:
            p, fs = _folder(spark, _at(out, "base", b))
            fs.delete(p, True)
        latest(spark, out, by, batch_id).write.mode("overwrite").parquet(_at(out, "base", batch_id))
        old = [b for b in _batches(spark, f"{out}/base") if b < batch_id]
        if old:
            for kind, limit in (("changes", old[-1] + 1), ("base", old[-1])):
                for b in _batches(spark, f"{out}/{kind}"):
                    if b < limit:
                        p, fs = _folder(spark, _at(out, kind, b))
                        fs.delete(p, True)
