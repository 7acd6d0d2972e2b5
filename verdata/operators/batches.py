"""Row and column algebra of batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_cols(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; unknown names are ignored."""
    return df.select(*[n for n in names if n in df.columns])


def pop_cols(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest; ``keep`` (a row id) stays in both. Unknown names are ignored."""
    return select_cols(df, [*keep, *[n for n in names if n not in keep]]), df.drop(*[n for n in names if n not in keep])


def rename_cols(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names for {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new)))


def take_rows(df: DataFrame, index, id_col: str, n: int | None = None) -> DataFrame:
    """Rows by position (numbered by ``id_col`` from 0): a slice, a boolean column, or a table of positions (``pos``, ``take``), which may repeat.

    Negative positions and steps count from the end, as in Python. For a slice the number of rows is taken from the table if ``n`` isn't given; a table of positions needs ``n`` for them.
    """
    at = F.col(id_col)
    if isinstance(index, slice):
        if min(index.start or 0, index.stop or 0, index.step or 1) < 0:
            if n is None:
                n = (df.agg(F.max(at)).first()[0] or 0) + 1
            rows = range(*index.indices(n))
            if not rows:
                return df.limit(0)
            first, last = sorted((rows[0], rows[-1]))
            return df.where(at.between(first, last) & ((at - first) % abs(rows.step) == 0))
        out, step = df.where(at >= (index.start or 0)), index.step or 1
        if index.stop is not None:
            out = out.where(at < index.stop)
        return out.where((at - (index.start or 0)) % step == 0) if step != 1 else out
    if isinstance(index, Column):
        return df.where(index)
    if n is not None:
        index = index.withColumn("take", F.when(F.col("take") < 0, F.col("take") + n).otherwise(F.col("take")))
    return df.join(index, df[id_col] == index["take"]).drop("take")


def union_columns(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Columns of two aligned tables. Rows of one side only, and shared columns that differ, are an error at run time."""
    shared = [c for c in a.columns if c in b.columns and c != on]
    right = b.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_b_{c}" if c in shared else c) for c in b.columns if c != on])
    out = a.join(right, F.col(on) == F.col("_on"), "full")
    bad = F.col(on).isNull() | F.col("_on").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    checked = F.when(bad, F.raise_error(F.lit("tables differ in rows or in a shared column")).cast(a.schema[on].dataType)).otherwise(F.col(on))
    return out.withColumn(on, checked).drop("_on", *[f"_b_{c}" for c in shared])


def concat_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk(df: DataFrame, k: int, id_col: str, n: int | None = None) -> DataFrame:
    """``chunk``: k equal runs of consecutive rows; the row count (``n``, else counted) must divide."""
    n = df.count() if n is None else n
    if n % k:
        raise ValueError(f"{n} rows don't make {k} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(id_col) / max(1, n // k)))


def split(df: DataFrame, size: int, id_col: str, n: int | None = None) -> DataFrame:
    """``chunk``: runs of ``size`` rows; the row count must divide."""
    n = df.count() if n is None else n
    if n % size:
        raise ValueError(f"{n} rows don't make chunks of {size}")
    return df.withColumn("chunk", F.floor(F.col(id_col) / size))


def pad_rows(df: DataFrame, divisor: int, id_col: str, n: int | None = None) -> DataFrame:
    """Rows repeated from the top until the count divides; ``padded`` tells them, and their ids go on."""
    n = df.count() if n is None else n
    missing = -n % divisor
    out = df.withColumn("padded", F.lit(False))
    if not missing or not n:
        return out
    times = F.sequence(F.lit(0), F.lit(-(-missing // n) - 1))
    extra = df.where(F.col(id_col) < missing).withColumn("_r", F.explode(times)).withColumn(id_col, F.col(id_col) + F.col("_r") * n)
    extra = extra.where(F.col(id_col) < missing).withColumn(id_col, F.col(id_col) + n).drop("_r").withColumn("padded", F.lit(True))
    return out.unionByName(extra)


def unpad_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("padded")).drop("padded")


def repeat_rows(df: DataFrame, times: int, interleave: bool, id_col: str, n: int | None = None) -> DataFrame:
    """Each row ``times`` times; ``position`` orders them aabb (interleaved) or abab."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return out.withColumn("position", F.col(id_col) * times + F.col("rep"))
    n = df.count() if n is None else n
    return out.withColumn("position", F.col("rep") * F.lit(n) + F.col(id_col))
