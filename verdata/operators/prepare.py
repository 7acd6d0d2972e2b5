"""Prompts, chat messages and token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.functions.text import seeded, text_of, trim_ws, whitespace_tokens
from verdata.operators.numbering import number_rows


def build_messages(df: DataFrame, prompt: str, media: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """``content``: typed parts of the prompt, cut at ``<image>`` and the like; empty text parts go."""
    tags = "|".join(f"<{m}>" for m in media)
    marked = F.split(F.regexp_replace(text_of(F.col(prompt)), f"({tags})", "\u0001$1\u0001"), "\u0001", -1)
    part = lambda x: F.struct(F.when(x.rlike(rf"\A(?:{tags})\z"), F.regexp_replace(x, "[<>]", "")).otherwise("text").alias("type"),
                              F.when(~x.rlike(rf"\A(?:{tags})\z"), x).alias("text"))
    return df.withColumn("content", F.transform(F.filter(marked, lambda x: x != ""), part))


def filter_overlong(df: DataFrame, prompt: str, max_length: int, length_fn: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Rows of at most ``max_length`` tokens; ``length_fn`` may be any column function, a pandas UDF over a tokenizer among them."""
    return df.withColumn("prompt_tokens", length_fn(F.col(prompt))).where(F.col("prompt_tokens") <= max_length)


def pad_or_truncate(ids: Column, max_len: int, pad: Column, side: str = "left", truncation: str = "right") -> Column:
    """An array of exactly ``max_len``: padded on ``side``, cut on ``truncation``'s side or an error if it says so."""
    n = F.size(ids)
    fill = F.array_repeat(pad, F.greatest(F.lit(0), max_len - n))
    padded = F.concat(fill, ids) if side == "left" else F.concat(ids, fill)
    cut = {"left": lambda: F.slice(ids, F.greatest(F.lit(1), n - max_len + 1), F.lit(max_len)), "right": lambda: F.slice(ids, F.lit(1), F.lit(max_len)),
           "error": lambda: F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(str(max_len)))).cast("array<bigint>")}[truncation]()
    return F.when(n > max_len, cut).otherwise(padded)


def response_mask(ids: Column, eos_ids: tuple[int, ...]) -> Column:
    """1 up to and with the first end token, then 0."""
    found = F.array_min(F.filter(F.array(*[F.array_position(ids, e) for e in eos_ids]), lambda p: p > 0))
    return F.transform(ids, lambda x, i: (found.isNull() | (i < found)).cast("long"))


def position_ids(mask: Column, long_table: bool = False) -> Column:
    """Positions of a left-padded mask: 0 while it is 0, then counting from 0."""
    first = F.array_position(mask, 1) - 1
    return F.transform(mask, lambda x, i: F.when(first < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), i - first)).cast("long"))


def response_positions(last_prompt_position: Column, mask: Column) -> Column:
    """Positions of response tokens: counting on from the last prompt position."""
    return F.transform(mask, lambda x, i: (last_prompt_position + i + 1).cast("long"))


def coalesce_gold(df: DataFrame, keys: tuple[str, ...] = ("ground_truth", "answer", "gold", "target")) -> DataFrame:
    """``gold``: the first of the columns that is present in the schema, stripped, whatever it holds."""
    key = next((k for k in keys if k in df.columns), None)
    return df.withColumn("gold", trim_ws(text_of(F.col(key))) if key else F.lit(""))


def assign_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """``batch`` numbers over a seeded shuffle; -1 puts all rows into batch 0. The numbering never gathers the table in one task."""
    rows = number_rows(df.withColumn("_key", seeded(F.col(id_col), seed)), [], [F.col("_key"), F.col(id_col)], "position").drop("_key")
    if batch_size < 0:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    rows = rows.withColumn("batch", F.floor(F.col("position") / batch_size))
    if drop_last:
        full = df.agg(F.floor(F.count("*") / batch_size).alias("_full"))
        rows = rows.crossJoin(F.broadcast(full)).where(F.col("batch") < F.col("_full")).drop("_full")
    return rows


def collate(df: DataFrame, batch_col: str, order_col: str, columns: list[str]) -> DataFrame:
    """Each column of a batch as an array in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(order_col, *columns)))
    return df.groupBy(batch_col).agg(rows.alias("_rows")).select(batch_col, *[F.col(f"_rows.{c}").alias(c) for c in columns])
