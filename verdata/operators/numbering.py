"""Gapless numbers and running values for rows, without putting a group or the table into one task.

``row_number()`` over a window sends each group to a single task, and all rows to one
where there is no group. Here the rows are range-partitioned and sorted, every partition
numbers its own part, and a summary of one row for each (partition, group) gives what
lies before that part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdata.plans.storage import broadcast_if_small, materialize


def _scanned(df: DataFrame, keys: list[str], order: list, scans: dict[str, tuple[Callable[[Column], Column], Column]], inclusive: bool) -> DataFrame:
    """``df`` with ``_at``, and for each scan what lies before the row in its partition (``_in_``) and in earlier partitions (``_off_``); ``_row``: the row's number."""
    kept = [F.col(k) for k in keys]
    rows = df.withColumns({f"_x_{n}": x for n, (_, x) in scans.items()})
    rows = rows.repartitionByRange(*kept, *order).sortWithinPartitions(*kept, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*kept, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[f(F.col(f"_x_{n}")).alias(f"_w_{n}") for n, (f, _) in scans.items()])
    # One row for each partition and group: far fewer than the rows themselves.
    w = (Window.partitionBy(*kept) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                           *[f(F.col(f"_w_{n}")).over(w).alias(f"_off_{n}") for n, (f, _) in scans.items()])
    offsets = broadcast_if_small(materialize(offsets))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*kept, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(offsets, on, "left").withColumn("_row", F.col("_at") - F.col("_first") + F.col("_off"))
    return out.withColumns({f"_in_{n}": f(F.col(f"_x_{n}")).over(inside) for n, (f, _) in scans.items()}) if scans else out


def prefix_scan(df: DataFrame, keys: list[str], order: list, scans: dict[str, tuple[Callable[[Column], Column], Column]], inclusive: bool = True) -> DataFrame:
    """Add, for each name, an aggregate (``F.sum``, ``F.max``, ``F.min``) of a column over the group's rows up to this one (``inclusive``) or before it; null where there is nothing.

    The aggregates must be associative: each range partition is scanned for itself, and only a summary of one row for each (partition, group) is scanned as a whole. ``order`` should be
    unique within a group. Nulls of the column don't count; null keys form a group, nulls in the order come first.
    """
    out = _scanned(df, keys, order, scans, inclusive)
    joined = lambda f, n: F.coalesce(F.col(f"_off_{n}") + F.col(f"_in_{n}"), f"_off_{n}", f"_in_{n}") if f is F.sum else (F.least if f is F.min else F.greatest)(f"_off_{n}", f"_in_{n}")
    return out.select(*df.columns, *[joined(f, n).alias(n) for n, (f, _) in scans.items()])


def number_rows(df: DataFrame, keys: list[str], order: list, name: str, weight: str | None = None,
                before: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group of ``keys`` in the given order.

    With ``weight`` (a long column), also add ``before``: the sum of the weights of the
    group's earlier rows. ``order`` should end in a unique column, so that the numbers don't depend on
    the partitioning. The summary of the partitions' parts is written, counted, and
    broadcast if it is small. Nulls form a group of their own and come first. The input is evaluated twice (once for the range bounds).
    """
    out = _scanned(df, keys, order, {"weight": (F.sum, F.col(weight))} if weight else {}, False)
    cols = [F.col(c) for c in df.columns] + [F.col("_row").alias(name)]
    if weight:
        cols.append((F.coalesce("_off_weight", F.lit(0)) + F.coalesce("_in_weight", F.lit(0))).alias(before))
    return out.select(*cols)
