"""Conversation structure repair by weighted interval parsing (CYK) with a grammar of edits.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. The grammar is in Chomsky normal form over the states of
that language (0: start, 1: after s, 2: after u, 3: after a; 0 and 3 may end): ``[p,q] -> [p,r] [r,q]`` for all states r, and for a
single row ``[0,1] -> s``, ``[0,2] [1,2] [3,2] -> u``, ``[2,3] -> a``, each by keeping it or by giving it the role user or assistant,
and ``[p,p] -> deleted``. A span's cell holds, for each ``[p,q]``, the least (cost, audit); the audit is the edits' initials in order.
Inserted turns are closed over in every cell, on either side. Cells are combined bottom-up by span length.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and duplicate rows), Insert of an empty user or assistant
turn 2; a truncated row that stays adds 1. An audit's letters fix its cost, so of two audits of equal cost neither begins with the other,
and the least of a whole is made of the least of its parts. The states at a boundary are all that two halves need to know of each other, so
spans of more than ``SPAN`` rows are combined from two halves only, with the same result as from all splits.

A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (its last
visible character is none of ``.!?``). Rows are taken by turn, nulls first; of equal turns by role, then text. Null roles, texts and keys stand
as one space. Rows of a null ``conv_id`` are one conversation. Repeated rows are duplicates. An empty table gives an empty result; columns
of other names are ignored.

A conversation of at most ``limit`` rows and ``LONG_BYTES`` of text is one array, gathered, judged and spelled by built-in functions; Python gets a symbol
for each row only. Longer ones stay rows: they are numbered by range partitions, duplicates found by grouped hashes, cells built for blocks of ``SPAN`` rows and
combined sixteen at a time in rounds. Only the digest of a long conversation is taken in one task, which streams its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from verdata.operators.numbering import number_rows
from verdata.plans.storage import broadcast_if_small, materialize

#: Rows of a span within which all splits are tried; rows and bytes up to which a conversation is one array; blocks combined at once.
SPAN, LIMIT, LONG_BYTES, FAN = 16, 256, 16 << 20, 16
#: Fixed values of the grammar: the state pairs that a row of each initial can stand for.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
EMPTY = hashlib.sha256(b"").hexdigest()

Cell = dict  # (p, q) -> (cost, audit)


def _better(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def _join(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """All ``[p,q]`` from ``[p,r]`` of the left and ``[r,q]`` of the right part."""
    out: Cell = {} if into is None else into
    for (p, r), (c, a) in left.items():
        for q in range(4):
            if (r, q) in right:
                d, b = right[r, q]
                _better(out, (p, q), (c + d, a + b))
    return out


def _insertions() -> Cell:
    """The cell of an empty span: nothing, or inserted turns only."""
    one = {k: (2, "I") for role in "ua" for k in STEPS[role]}
    cell: Cell = {(p, p): (0, "") for p in range(4)} | one
    for _ in range(3):
        cell = _join(cell, one, cell.copy())
    return cell


NOTHING = _insertions()


@lru_cache(maxsize=None)
def _row(symbol: str) -> tuple:
    """The closed cell of one row. Symbols: ``suao`` a row in order, ``SUAO`` a truncated one, ``0123`` one that must go (o: any other initial)."""
    cell: Cell = {(p, p): (3, "D") for p in range(4)}
    if not symbol.isdigit():
        extra, own = int(symbol.isupper()), symbol.lower()
        for role, steps in STEPS.items():
            for k in steps:
                if role == own:
                    _better(cell, k, (extra, "K"))
                elif role != "s":
                    _better(cell, k, (2 + extra, "R"))
    return tuple(_join(_join(NOTHING, cell), NOTHING).items())


@lru_cache(maxsize=20_000)
def _short(symbols: str) -> tuple:
    """CYK over all spans and splits of up to ``SPAN`` rows."""
    n = len(symbols)
    cells = {(i, i + 1): dict(_row(s)) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                _join(cells[i, k], cells[k, i + length], cell)
            cells[i, i + length] = cell
    return tuple((cells[0, n] if n else NOTHING).items())


def parse(symbols: str) -> Cell:
    """The cell of any number of rows: spans of up to ``SPAN`` rows, then pairs of neighbouring spans, bottom-up."""
    return combine([dict(_short(symbols[i:i + SPAN])) for i in range(0, len(symbols), SPAN)])


def combine(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [_join(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else dict(NOTHING)


def cheapest(cell: Cell) -> tuple[int, str]:
    """Of the empty conversation and a whole one."""
    return min(cell[k] for k in ((0, 0), (0, 3)) if k in cell)


def illegal_pairs(symbols: str) -> int:
    """Adjacent rows whose initials aren't su, ua or au, whatever their faults."""
    s = symbols.lower().translate(str.maketrans("0123", "suao"))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(s, s[1:]))


def plan(audit: str) -> list[tuple[int | None, str | None, str]]:
    """For each repaired turn: the number of its row (None: inserted), its role (None: as it was) and its edit."""
    size = len(audit) - audit.count("D")
    out, row = [], 0
    for e in audit:
        if e != "D":
            role = ("user", "assistant")[(len(out) - size % 2) % 2]
            out.append((None if e == "I" else row, None if e == "K" else role, e))
        row += e != "I"
    return out


def symbol(role: Column, truncated: Column, gone: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), F.instr(F.lit("sua"), initial)).otherwise(4)
    return F.when(gone, (kind - 1).cast("string")).when(truncated, F.substring(F.lit("SUAO"), kind, F.lit(1))).otherwise(F.substring(F.lit("suao"), kind, F.lit(1)))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*+\z")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space, damaged by ``crc32(conv_id:turn) % 20``: ``lost``, emptied, without ``.!?``, repeated, or of role user (0 to 4)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), hit.alias("hit"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("lost"), F.explode(times).alias("copy")).drop("copy")


_TURN = pa.struct([("src", pa.int32()), ("role", pa.string()), ("edit", pa.string())])
_ANSWER = StructType().add("illegal", "long").add("cost", "long").add("audit", "string")
_TURNS = ArrayType(StructType().add("src", "integer").add("role", "string").add("edit", "string"))
_PART = pa.struct([("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("p", pa.list_(pa.int32())), ("q", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])


@F.arrow_udf(StructType([*_ANSWER, StructField("plan", _TURNS)]))
def _judge(symbols: pa.Array) -> pa.Array:
    found = [_solved(s) for s in symbols.to_pylist()]
    cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(_TURN)))]
    return pa.StructArray.from_arrays(cols, ["illegal", "cost", "audit", "plan"])


@lru_cache(maxsize=20_000)
def _solved(symbols: str) -> tuple:
    cost, audit = cheapest(parse(symbols))
    return illegal_pairs(symbols), cost, audit, [{"src": i, "role": r, "edit": e} for i, r, e in plan(audit)]


def _part(first: str, last: str, illegal: int, cell: Cell) -> dict:
    keys = sorted(cell)
    return {"first": first, "last": last, "illegal": illegal, "p": [p for p, _ in keys], "q": [q for _, q in keys], "cost": [cell[k][0] for k in keys], "audit": [cell[k][1] for k in keys]}


_CELL = StructType().add("first", "string").add("last", "string").add("illegal", "long").add("p", ArrayType(IntegerType())).add("q", ArrayType(IntegerType()))
_CELL = _CELL.add("cost", ArrayType(LongType())).add("audit", ArrayType(StringType()))


@F.arrow_udf(_CELL)
def _block(symbols: pa.Array) -> pa.Array:
    return pa.array([_part(s[0], s[-1], illegal_pairs(s), dict(_short(s))) for s in symbols.to_pylist()], _PART)


@F.arrow_udf(_CELL)
def _combined(parts: pa.Array) -> pa.Array:
    def one(some: list[dict]) -> dict:
        cells = [{(p, q): (c, a) for p, q, c, a in zip(x["p"], x["q"], x["cost"], x["audit"])} for x in some]
        between = sum(illegal_pairs(x["last"] + y["first"]) for x, y in zip(some, some[1:]))
        return _part(some[0]["first"], some[-1]["last"], sum(x["illegal"] for x in some) + between, combine(cells))
    return pa.array([one(some) for some in parts.to_pylist()], _PART)


@F.arrow_udf(_ANSWER)
def _whole(parts: pa.Array) -> pa.Array:
    best = [(x["illegal"], *cheapest({(p, q): (c, a) for p, q, c, a in zip(x["p"], x["q"], x["cost"], x["audit"])})) for x in parts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([b[k] for b in best], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["illegal", "cost", "audit"])


def _arrays(rows: DataFrame) -> DataFrame:
    """One row for each conversation: the counts, the parse and ``turns``, the repaired conversation."""
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("lost"), F.struct("turn", "role", "text")))).alias("r"))
    whole = whole.withColumn("said", F.transform("r", lambda x: F.struct(x["role"], x["text"])))
    whole = whole.withColumn("f", F.transform("r", lambda x, i: F.when(is_blank(x["text"]), 1).when(F.array_position("said", F.struct(x["role"], x["text"])) <= i, 2).when(is_truncated(x["text"]), 3).otherwise(0)))
    times = F.filter(F.transform("r", lambda x: x["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(times) - F.array_min(times) + 1 - F.size(F.array_distinct(times)), F.lit(0)).cast("long")
    count = lambda k: F.size(F.filter("f", lambda x: x == k)).cast("long")
    symbols = F.array_join(F.zip_with("r", "f", lambda x, f: symbol(x["role"], f == 3, f.isin(1, 2))), "")
    whole = whole.select("conv_id", "r", gaps.alias("gaps"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), _judge(symbols).alias("j"))
    turn = lambda p: F.struct(F.coalesce(p["role"], F.get("r", p["src"])["role"]).alias("role"), F.when(p["src"].isNull(), "").otherwise(F.get("r", p["src"])["text"]).alias("text"), p["edit"].alias("edit"))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "j.illegal", "j.cost", "j.audit", F.transform("j.plan", turn).alias("turns"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _edits(batches: Iterator[pa.RecordBatch], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A row for each repaired turn of long audits, some at a time: ``pos`` is its row (-1: inserted), ``to`` its new role (null: as it was)."""
    for batch in batches:
        for i, audit in enumerate(batch.column("audit").to_pylist()):
            e = np.frombuffer(audit.encode(), np.uint8)
            row = np.cumsum(e != ord("I")) - 1
            e, row = e[e != ord("D")], np.where(e == ord("I"), -1, row)[e != ord("D")]
            for a in range(0, len(e), step):
                at = np.arange(a, min(a + step, len(e)))
                to = pa.array(np.where((at - len(e) % 2) % 2 == 0, "user", "assistant"), mask=e[at] == ord("K"))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array([i] * len(at))), pa.array(at), pa.array(row[at]), to, pa.array([chr(x) for x in e[at]])], ["conv_id", "at", "pos", "to", "edit"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation; rows come sorted, so only the running digest is held."""
    names, running, key = ["conv_id", "repaired_sha256"], None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array([running.hexdigest()])], names)
    for batch in batches:
        ids = batch.column("conv_id")
        for i, (who, role, text) in enumerate(zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())):
            if running is None or key[0].as_py() != who:
                if running is not None:
                    yield done()
                running, key = hashlib.sha256(), ids.slice(i, 1)
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
    if running is not None:
        yield done()


def _rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for long conversations: reports without a digest, and the repaired turns as rows. Lost rows have gone."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbered = materialize(number_rows(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "pos"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marks = numbered.select("conv_id", "turn", "role", "pos", key.alias("key"), is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("cut"))
    first = marks.groupBy("conv_id", "key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_id"), F.col("key").alias("_key"), "first")
    marks = marks.join(first, _same("conv_id", "_id") & (F.col("key") == F.col("_key")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    marks = materialize(marks.select("conv_id", "turn", "pos", fault.alias("f"), symbol(F.col("role"), fault == 3, fault.isin(1, 2)).alias("symbol")))
    sums = marks.groupBy("conv_id").agg(*[F.count_if(F.col("f") == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    times = marks.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ordered = lambda c, by: F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c])
    parts = marks.groupBy("conv_id", F.floor(F.col("pos") / SPAN).alias("block")).agg(F.array_join(ordered("symbol", "pos"), "").alias("s")).select("conv_id", "block", _block("s").alias("part"))
    parts = materialize(parts)
    while parts.agg(F.max("block")).first()[0]:
        parts = materialize(parts.groupBy("conv_id", F.floor(F.col("block") / FAN).alias("block")).agg(ordered("part", "block").alias("parts")).select("conv_id", "block", _combined("parts").alias("part")))
    parsed = materialize(parts.select("conv_id", _whole("part").alias("j")).select("conv_id", "j.*"))
    sums = sums.select(F.col("conv_id").alias("_id"), "blank", "duplicate", "truncated")
    times = times.select(F.col("conv_id").alias("_who"), "gaps")
    report = parsed.join(sums, _same("conv_id", "_id")).join(times, _same("conv_id", "_who"), "left")
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = parsed.select("conv_id", "audit").mapInArrow(_edits, f"conv_id {kind}, at long, pos long, to string, edit string")
    had = numbered.select(F.col("conv_id").alias("_id"), F.col("pos").alias("_pos"), "role", "text")
    turns = edits.join(had, _same("conv_id", "_id") & (F.col("pos") == F.col("_pos")), "left")
    return report, turns.select("conv_id", "at", F.coalesce("to", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def _split(rows: DataFrame, limit: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short and of long conversations (None: there are none)."""
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = materialize(size.where((F.col("n") > limit) | (F.col("bytes") > most)).select(F.col("conv_id").alias("_id")))
    if not many.count():
        return rows, None
    many = broadcast_if_small(many)
    return rows.join(many, _same("conv_id", "_id"), "left_anti"), rows.join(many, _same("conv_id", "_id"), "left_semi")


def _plain(rows: DataFrame, lost: str | None) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), (F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)).alias("lost"))


def repair_conversations(rows: DataFrame, lost: str | None = None, limit: int = LIMIT, most: int = LONG_BYTES) -> DataFrame:
    """A row for each conversation of ``conv_id, turn, role, text``: ``gaps`` in its turns, faults, ``illegal`` neighbours, ``cost`` and ``audit`` of the
    cheapest repair, and ``repaired_sha256`` of the repaired ``role:text`` lines. Rows marked in ``lost`` only name their conversation; without others it has
    zeros, an empty audit and the empty string's digest."""
    short, long_ = _split(_plain(rows, lost), limit, most)
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = _arrays(short).withColumn("repaired_sha256", F.sha2(spelled, 256)).drop("turns")
    if long_ is None:
        return out
    report, turns = _rows(long_.where("not lost"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    digests = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    report = report.join(digests, _same("conv_id", "_id"), "left").drop("_id").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY)))
    return out.unionByName(report.select(*out.columns))


def repaired_turns(rows: DataFrame, lost: str | None = None, limit: int = LIMIT, most: int = LONG_BYTES) -> DataFrame:
    """``conv_id, at, role, text, edit``: the turns of the repaired conversations in order (``at`` from 0), with the initial of each one's edit."""
    short, long_ = _split(_plain(rows, lost), limit, most)
    out = _arrays(short).select("conv_id", F.posexplode("turns").alias("at", "t")).select("conv_id", F.col("at").cast("long").alias("at"), "t.*")
    return out if long_ is None else out.unionByName(_rows(long_.where("not lost"))[1])
