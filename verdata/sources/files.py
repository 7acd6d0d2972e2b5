"""Sources and sinks: example files, JSON lines, tagged runs and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdata.operators.numbering import number_rows, prefix_scan
from verdata.plans.storage import broadcast_if_small, materialize


def load_examples(spark: SparkSession, path_spec: str, limit: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read ``path[@split]``. The file type is the extension (``jsonl`` is json); the split (default ``train``) is kept in column ``split``.

    A directory named after the split below the path is preferred; else a ``split`` column filters, if there is one.
    """
    path, _, split = path_spec.partition("@")
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "txt": "text"}.get(kind, kind if kind in ("json", "parquet", "csv", "orc", "text") else "parquet")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}))
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if "split" in df.columns:
        df = df.where(F.col("split") == (split or "train"))
    else:
        df = df.withColumn("split", F.lit(split or "train"))
    return df.limit(limit) if limit else df


def read_spread(spark: SparkSession, path: str, least: int = 256) -> DataFrame:
    """A Parquet table with work for all cores: where fewer scan tasks hold rows than there are cores (a small table in one row group), its rows are dealt out in one exchange.

    Larger tables, and those with fewer than ``least`` rows for each core, are read as they are. Rows and columns are the table's in either case; what is counted comes from the files' footers.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return df.repartition(cores) if tasks["tasks"] < cores and tasks["n"] >= least * cores else df


def read_jsonl(spark: SparkSession, paths, schema, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema. Blank lines are skipped; malformed ones fail (``strict``) or are skipped as well."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition, text unescaped UTF-8."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_runs(spark: SparkSession, runs: dict[str, str], schema) -> tuple[DataFrame, DataFrame]:
    """JSON lines of several runs with a column ``run``, and a row for each run with its count: 0 where the path is missing."""
    names = spark.createDataFrame([(n, p) for n, p in runs.items()], "run string, path string")
    parts = [read_jsonl(spark, p, schema).withColumn("run", F.lit(n)) for n, p in runs.items() if _exists(spark, p)]
    if parts:
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x, allowMissingColumns=True)
    else:
        rows = spark.createDataFrame([], schema).withColumn("run", F.lit(""))
    counts = names.join(rows.groupBy("run").agg(F.count("*").alias("n")), "run", "left").select("run", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows, counts


def read_reports(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """Whole-file JSON reports with the file that each came from; unreadable ones are left out."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(kept).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(pattern)
    return rows.withColumn("source_file", F.col("_metadata.file_path")).where(F.col("_bad").isNull()).drop("_bad")


def with_row_id(df: DataFrame, order_cols: list[str], split: str) -> DataFrame:
    """``row_id``: ``<split>-<number, six digits>`` in the given order, which should be unique."""
    out = number_rows(df, [], [F.col(c) for c in order_cols], "row_index")
    return out.withColumn("row_id", F.format_string(f"{split}-%06d", "row_index"))


def with_file_row_id(df: DataFrame, split: str) -> DataFrame:
    """``row_index`` and ``row_id`` (``<split>-<number, six digits>``) of a table read from files, in the order of the files' paths and of the rows in them.

    ``df`` is a reader's table (or one with rows filtered out): a row's place is its file, the block of the file that its task has read, and its turn there. Blocks are counted, and running sums of
    the counts give what lies before each, so rows aren't sorted and neither file nor table goes through one task. The partitioning makes no difference.
    """
    names = df.columns
    rows = materialize(df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_turn")))
    blocks = rows.groupBy("_path", "_block").agg(F.min("_turn").alias("_from"), F.count("*").alias("_rows"))
    before = prefix_scan(blocks, [], [F.col("_path"), F.col("_block")], {"_before": (F.sum, F.col("_rows"))}, inclusive=False)
    before = broadcast_if_small(materialize(before.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_from", F.coalesce("_before", F.lit(0)).alias("_before"))))
    out = rows.join(before, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    out = out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names], (F.col("_turn") - F.col("_from") + F.col("_before")).alias("row_index"))
    return out.withColumn("row_id", F.format_string(f"{split}-%06d", "row_index"))
