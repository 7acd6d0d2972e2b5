"""Profiling and curation of (problem, answer) datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdata.functions import text as T
from verdata.operators.numbering import number_rows
from verdata.plans.storage import broadcast_if_small, materialize


def build_manifest(df: DataFrame, template: str = "{{ content }}", max_prompt_length: int = 512, id_cols: tuple[str, ...] = ("split", "idx"),
                   tokens: Column | None = None) -> DataFrame:
    """One row for each example with its hashes, labels, lengths and tags. No shuffle."""
    out = df.select("*", T.normalize_text(F.col("problem")).alias("_text"), F.length(T.render_prompt(F.col("problem"), template)).cast("long").alias("prompt_chars"),
                    (tokens if tokens is not None else F.lit(None)).cast("long").alias("prompt_tokens"), T.classify_answer(F.col("answer")).alias("answer_type"))
    known = F.col("prompt_tokens")
    return out.select(
        *id_cols, "problem", "answer", "prompt_chars", "prompt_tokens", "answer_type",
        T.stable_hash(F.col("_text")).alias("problem_hash"),
        T.stable_hash(F.concat(F.col("_text"), F.lit("\n"), T.normalize_text(F.col("answer")))).alias("pair_hash"),
        T.classify_topic(F.col("problem"), F.col("_text")).alias("topic"),
        T.classify_difficulty(F.col("problem"), F.col("answer_type"), F.col("prompt_chars"), known, F.col("_text")).alias("difficulty"),
        F.length(T.trim_ws(T.text_of(F.col("answer")))).cast("long").alias("answer_chars"),
        T.verifier_risk_tags(F.col("answer"), F.col("prompt_chars"), max_prompt_length, known, F.col("answer_type")).alias("tags"))


def distributions(manifest: DataFrame, fields: tuple[str, ...] = ("topic", "difficulty", "answer_type")) -> DataFrame:
    """``split, field, value, n``: all fields' counts from one aggregation over grouping sets."""
    sets = [[F.col("split"), F.col(f)] for f in fields]
    rows = manifest.groupingSets(sets, "split", *fields).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"_{f}") for f in fields])
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        field = F.when(F.col(f"_{f}") == 0, F.lit(f)).otherwise(field)
        value = F.when(F.col(f"_{f}") == 0, F.col(f)).otherwise(value)
    return rows.select("split", field.alias("field"), value.alias("value"), F.col("n").cast("long").alias("n"))


def risk_distribution(manifest: DataFrame) -> DataFrame:
    """``split, tag, n, verifier_ready_rate``: tag counts, with the share of clean rows."""
    # A null tag stands for each row, so that one pass counts tags and rows; what the window sees is one row for each split and tag.
    tags = manifest.select("split", F.explode(F.concat("tags", F.array(F.lit(None).cast("string")))).alias("tag")).groupBy("split", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("split")
    clean, every = F.max(F.when(F.col("tag") == "clean", F.col("n"))).over(w), F.max(F.when(F.col("tag").isNull(), F.col("n"))).over(w)
    return tags.select("split", "tag", "n", (F.coalesce(clean, F.lit(0)) / every).alias("verifier_ready_rate")).where("tag is not null")


def exact_quantiles(df: DataFrame, column: str, by: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """``by`` and an array ``p``: exact quantiles with linear interpolation, by selection instead of a table of all values.

    A sketch gives a range of values around each wanted rank that holds about 4 / ``accuracy`` of the rows; rows below and inside are counted; a range that missed its rank is opened on that side. Only rows inside ranges
    are numbered, over range partitions. Three passes over two narrow columns; no task holds a group. Null values don't count, NaN is the largest.
    """
    rows = materialize(df.where(F.col(column).isNotNull()).select(F.col(by).alias("_g"), F.col(column).cast("double").alias("x")))
    slack = 2 / accuracy
    grid = [q for p in points for q in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = rows.groupBy("_g").agg(F.count("*").alias("n"), F.percentile_approx("x", grid, accuracy).alias("s"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at"), F.col("s")[2 * i].alias("lo"), F.col("s")[2 * i + 1].alias("hi")) for i, p in enumerate(points)]))
    ranges = materialize(sketch.select(F.col("_g").alias("g"), at.alias("r")).select("g", "r.*").select("g", "i", F.floor("at").alias("k"), F.ceil("at").alias("k2"), (F.col("at") - F.floor("at")).alias("part"), "lo", "hi"))
    held = broadcast_if_small(ranges)
    counted = rows.join(held, F.col("_g").eqNullSafe(F.col("g"))).groupBy("g", "i").agg(F.count_if(F.col("x") < F.col("lo")).alias("below"), F.count_if((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).alias("inside"))
    counted = counted.select(F.col("g").alias("_cg"), F.col("i").alias("_ci"), "below", "inside")
    fixed = ranges.join(counted, F.col("g").eqNullSafe(F.col("_cg")) & (F.col("i") == F.col("_ci")))
    low = F.col("below") > F.col("k")
    fixed = materialize(fixed.select("g", "i", "k", "k2", "part", F.when(low, float("-inf")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("below") + F.col("inside") <= F.col("k2"), float("nan")).otherwise(F.col("hi")).alias("hi"), F.when(low, 0).otherwise(F.col("below")).alias("below")))
    inside = rows.join(broadcast_if_small(fixed), F.col("_g").eqNullSafe(F.col("g")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select("g", "i", "k", "k2", "part", "below", "x")
    numbered = number_rows(inside, ["g", "i"], [F.col("x")], "_no").withColumn("_no", F.col("_no") + F.col("below"))
    ends = numbered.where((F.col("_no") == F.col("k")) | (F.col("_no") == F.col("k2"))).groupBy("g", "i").agg(F.min_by("x", "_no").alias("a"), F.max_by("x", "_no").alias("b"), F.first("part").alias("part"))
    value = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return ends.groupBy(F.col("g").alias(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("p"))


def length_stats(df: DataFrame, column: str, by: str, over: int | None = None, approximate: int | None = None) -> DataFrame:
    """Count, min, percentiles with linear interpolation, max and mean; rows over a limit. ``approximate``: accuracy of ``percentile_approx`` instead.

    Lengths are integers of few different values, which one aggregation counts; percentiles of floating-point columns come from :func:`exact_quantiles`.
    """
    points = [0.5, 0.9, 0.95, 0.99]
    selected = not approximate and df.schema[column].dataType.typeName() in ("double", "float")
    p = F.percentile_approx(column, points, approximate) if approximate else F.percentile(column, F.array(*[F.lit(x) for x in points]))
    out = df.where(F.col(column).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.min(column).alias("min"), *([] if selected else [p.alias("p")]), F.max(column).alias("max"), F.avg(column).alias("mean"),
        F.count_if(F.col(column) > over if over is not None else F.lit(False)).alias("n_over"))
    if selected:
        exact = exact_quantiles(df, column, by, tuple(points)).withColumnRenamed(by, "_g")
        out = out.join(exact, F.col(by).eqNullSafe(F.col("_g")), "left")
    return out.select(by, "n", "min", *[F.col("p")[i].cast("double").alias(f"p{round(100 * x)}") for i, x in enumerate(points)], "max", "mean", "n_over")


def field_checks(df: DataFrame, by: str = "split", prompt: str = "problem", answer: str = "answer") -> DataFrame:
    """Rows without a field, and with an empty normalized prompt or answer. A column that isn't there is missing from every row."""
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(col(prompt).isNull()).alias("missing_prompt"), F.count_if(col(answer).isNull()).alias("missing_answer"),
        F.count_if(T.normalize_text(col(prompt)) == "").alias("empty_prompt"), F.count_if(T.normalize_text(col(answer)) == "").alias("empty_answer"))


def _repeats(manifest: DataFrame, column: str) -> DataFrame:
    return manifest.groupBy("split", F.col(column).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(manifest: DataFrame) -> DataFrame:
    """Rows beyond the first of each problem hash and pair hash, by split. Only hashes are shuffled."""
    # A pair has one problem, so the problems' counts are sums of their pairs' and the manifest is read once.
    pairs = manifest.groupBy("split", "problem_hash", "pair_hash").agg(F.count("*").alias("n"))
    problems = pairs.groupBy("split", "problem_hash").agg((F.sum("n") - 1).alias("more"), F.sum(F.col("n") - 1).alias("more_pairs"))
    return problems.groupBy("split").agg(F.sum("more").cast("long").alias("duplicate_problem_rows"), F.sum("more_pairs").cast("long").alias("duplicate_pair_rows"))


def duplicate_examples(manifest: DataFrame, k: int = 20, column: str = "problem_hash") -> DataFrame:
    """The ``k`` most repeated hashes; smaller hashes first among equals."""
    return _repeats(manifest, column).orderBy(F.desc("n"), "hash", "split").limit(k)


def leakage(train: DataFrame, val: DataFrame, hash_col: str = "problem_hash") -> DataFrame:
    """Distinct hashes of both sides and how many they share."""
    side = lambda df, t, v: df.select(F.col(hash_col).alias("hash"), F.lit(t).alias("t"), F.lit(v).alias("v"))
    held = side(train, 1, 0).union(side(val, 0, 1)).groupBy("hash").agg(F.max("t").alias("t"), F.max("v").alias("v"))
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return held.agg(n(F.col("t"), "train_distinct"), n(F.col("v"), "val_distinct"), n(F.col("t") * F.col("v"), "overlap"))


def overlap_sample(train: DataFrame, val: DataFrame, k: int = 50, hash_col: str = "problem_hash") -> DataFrame:
    """The ``k`` smallest shared hashes."""
    return train.select(hash_col).intersect(val.select(hash_col)).orderBy(hash_col).limit(k)


def leakage_examples(train: DataFrame, val: DataFrame, k: int = 20, index: str = "idx") -> DataFrame:
    """Of the ``k`` smallest shared hashes, the first row of ``val``."""
    shared = val.join(train.select("problem_hash"), "problem_hash", "left_semi")
    return shared.groupBy("problem_hash").agg(F.min(index).alias(index), F.min_by("answer", index).alias("answer")).orderBy("problem_hash").limit(k)


def clean_split(manifest: DataFrame, policy: str = "strict_clean", drop_tags: tuple[str, ...] = T.RISK_TAGS) -> DataFrame:
    """The manifest with a column ``kept``."""
    if policy == "strict_clean":
        kept = F.col("tags") == F.array(F.lit("clean"))
    elif policy == "drop_high_risk":
        kept = ~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in drop_tags]))
    else:
        raise ValueError(f"unknown policy: {policy}")
    return manifest.withColumn("kept", kept)


def clean_report(split: DataFrame) -> DataFrame:
    """Rows before and after, by split, with the rate."""
    return split.groupBy("split").agg(F.count("*").alias("original_rows"), F.count_if("kept").alias("kept_rows"), F.count_if(~F.col("kept")).alias("dropped_rows"),
                                      F.avg(F.col("kept").cast("double")).alias("keep_rate"))


def dropped_counts(split: DataFrame) -> DataFrame:
    """Tags and answer types of the dropped rows: ``split, field, value, n``."""
    gone = split.where(~F.col("kept"))
    both = F.concat(F.transform("tags", lambda t: F.struct(F.lit("risk").alias("field"), t.alias("value"))), F.array(F.struct(F.lit("answer_type").alias("field"), F.col("answer_type").alias("value"))))
    return gone.select("split", F.explode(both).alias("x")).groupBy("split", "x.field", "x.value").agg(F.count("*").alias("n"))


def stratified_sample(manifest: DataFrame, per_bucket: int, seed: int = 0, id_col: str = "idx") -> DataFrame:
    """``per_bucket`` rows of each topic, difficulty and risk tag, in seeded hash order. A row may be in many buckets.

    The rank filter limits every map task's rows before the shuffle, so a large bucket costs no more than a small one.
    """
    risks = F.transform(F.filter("tags", lambda t: t != "clean"), lambda t: F.concat(F.lit("risk:"), t))
    buckets = F.concat(F.array(F.concat(F.lit("topic:"), "topic"), F.concat(F.lit("difficulty:"), "difficulty")), risks)
    rows = manifest.select("*", F.explode(buckets).alias("bucket"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(T.seeded(F.col(id_col), seed), id_col))
    return rows.withColumn("place", place).where(F.col("place") <= per_bucket)


def sample_rows(df: DataFrame, n: int, seed: int = 0, id_col: str = "idx") -> DataFrame:
    """Exactly ``n`` rows (or all) in seeded hash order, without a full sort."""
    return df.orderBy(T.seeded(F.col(id_col), seed), id_col).limit(n)


def eval_subset(manifest: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """The first ``n`` rows by index."""
    return manifest.orderBy(index).limit(n)
