"""Brace groups behind a command, by built-in expressions: a text becomes tokens, and one fold over them keeps positions and depth."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdata.functions.text import WHITE, once, text_of

#: White space as Python strips it.
SPACE = rf"[\x1C-\x1F{WHITE}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def strip_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<!{SPACE}){SPACE}++\z", "")


def fold_groups(text: Column, command: str = "\\boxed", keep: Callable[[Column], Column] | None = None) -> Column:
    """A struct about the balanced groups of ``command`` in a text: ``open`` and ``end``, the code points between which the last one's content lies (0 and -1: there is none),
    and ``best``, the stripped content of the last one that ``keep`` accepts.

    A group begins at the first brace behind a command, whatever stands between them, and ends where its depth is 0 again; commands inside of it don't count. A group without
    an end ends the search. The fold's state is a few numbers, so a text costs time in proportion to its length.
    """
    first = re.escape(command[0])
    tokens = lambda t: F.regexp_extract_all(t, F.lit(rf"{re.escape(command)}|[{{}}]|[^{{}}{first}]++|{first}"), F.lit(0))
    nothing = F.lit(None).cast("string")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("asked"), F.lit(0).alias("from"), F.lit(0).alias("open"), F.lit(-1).alias("end"), nothing.alias("best"))

    def step(whole: Column) -> Callable[[Column, Column], Column]:
        def one(s: Column, x: Column) -> Column:
            opens = (x == "{") & (s["asked"] | (s["depth"] > 0))
            closes = (x == "}") & (s["depth"] > 0)
            ends = closes & (s["depth"] == 1)
            best = s["best"]
            if keep:
                content = strip(F.substring(whole, s["from"] + 1, s["at"] - s["from"]))
                best = F.when(ends, once(content, lambda c: F.when(keep(c), c).otherwise(s["best"]))).otherwise(s["best"])
            return F.struct((s["at"] + F.length(x)).alias("at"), F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
                            F.when(opens, False).otherwise(s["asked"] | ((s["depth"] == 0) & (x == command))).alias("asked"),
                            F.when(opens & (s["depth"] == 0), s["at"] + 1).otherwise(s["from"]).alias("from"), F.when(ends, s["from"]).otherwise(s["open"]).alias("open"),
                            F.when(ends, s["at"]).otherwise(s["end"]).alias("end"), best.alias("best"))
        return one

    def found(t: Column) -> Column:
        # Texts without the command needn't be taken apart.
        return F.aggregate(F.when(t.contains(command), tokens(t)).otherwise(F.array().cast("array<string>")), zero, step(t), lambda s: F.struct(s["open"].alias("open"), s["end"].alias("end"), s["best"].alias("best")))
    return once(text_of(text), found)


def extract_boxed(text: Column) -> Column:
    """Content of the last balanced ``\\boxed{...}``, stripped; without one, of the last flat one (one level of braces inside); else empty."""
    flat = F.regexp_extract_all(text, F.lit(r"(?s)\\boxed\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"), F.lit(1))
    last = F.coalesce(F.try_element_at(flat, F.lit(-1)), F.lit(""))
    return once(fold_groups(text), lambda g: strip(F.when(g["end"] >= 0, F.substring(text, g["open"] + 1, g["end"] - g["open"])).when(text.contains("\\boxed{"), last).otherwise("")))


def stop_after_boxed(text: Column) -> Column:
    """The text up to its last balanced box, without white space at the end; unchanged if there is none."""
    return once(fold_groups(text), lambda g: F.when(g["end"] >= 0, strip_end(F.substring(text, F.lit(1), g["end"] + 1))).otherwise(text))
