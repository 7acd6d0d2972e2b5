"""Line dedup by a log-template tree. DataFrame functions only.

A line's path in the tree is its number of tokens and its leading ``depth`` tokens; in its leaf, the template is the whole line. Everywhere,
a token that holds a digit is a variable field and stands as ``<*>``, so that lines which differ in numbers, dates or ids share a template. A template that
occurs in at least ``min_docs`` documents of different text recurs: its lines go from every document but those of the smallest doc_id that has it.

With a ``similarity`` below 1, words may be variable fields too, as long as that share of a line's tokens stays (``<*>`` counts as one token) and
at most ``max_fields`` words go. Down the path, and then at each position of a leaf, a token that fewer than ``min_docs`` lines have there becomes a field (a line
counts once for each text). What stays is the line's merged template; so is the same with any one token less that the leaf has alternatives
for, so that lines whose field holds a common value meet those with a rare one. A line with a merged template that recurs goes by the same rule. Only lines that can have
one are looked at: at most w fields leave one of w + 1 pieces of the line whole, and a piece must recur at its place among lines of as many tokens.

Tokens are what lies between ASCII white space; a line without tokens is never dropped. Lines of at least ``min_tokens`` tokens are
judged. Null texts stay null and empty ones empty. Copies of a whole text count as one document (whole copies are the
near-duplicate operator's task) and lose the same lines. Rows without doc_id come after all others. An empty table gives an empty result.
Templates are compared by 128 bits; 64 bits stand for texts, pieces and words at a position of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import let
from verdata.plans.storage import broadcast_if_small, drop, materialize

_BLANK = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++"
_FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
_LAST = (1 << 63) - 1

LEAF = ["template", "check"]


def _general(line: Column) -> Column:
    """A line with variable fields as ``<*>`` and single spaces between tokens; most lines need neither change."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    plain = F.when(odd, F.regexp_replace(line, _BLANK, " ")).otherwise(line)
    return F.trim(F.when(line.rlike("[0-9]"), F.regexp_replace(plain, _FIELD, "<*>")).otherwise(plain))


def _tokens(line: Column) -> Column:
    return F.when(line == "", F.lit(0)).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _raw(docs: DataFrame) -> DataFrame:
    """``doc`` (doc_id, nulls last), ``row`` (hash of the text), ``at`` (number of the line) and ``raw`` of each line with a token."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    rows = docs.select(doc, F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    # Only the raw line is tested here: a test of a computed column would be pushed down and computed twice.
    return rows.where(F.col("raw").rlike(r"\S"))


def _lines(docs: DataFrame) -> DataFrame:
    """Of each line of :func:`_raw`: ``line`` (general), its ``tokens`` and template."""
    rows = _raw(docs).select("doc", "row", "at", _general(F.col("raw")).alias("line"))
    return rows.select("doc", "row", "at", "line", _tokens(F.col("line")).alias("tokens"), F.xxhash64("line").alias("template"), F.xxhash64(F.lit(7), "line").alias("check"))


def _recurring(once: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """Of ``once`` (a row for each text of a template): the templates of at least ``min_docs`` texts and their first documents."""
    return once.groupBy(*by).agg(F.min("first").alias("first"), F.count("*").alias("texts")).where(F.col("texts") >= min_docs).drop("texts")


def _fields(tokens: Column, similarity: float, max_fields: int) -> Column:
    """How many words of a line may be fields."""
    return F.least(F.lit(max_fields), F.floor(tokens * (1 - similarity) + 1e-9).cast("int"))


def _pieces(line: Column, tokens: Column, fields: Column, most: int) -> Column:
    """Hashes of the line's ``fields + 1`` pieces with their places, as a struct of ``most + 1`` numbers."""
    at = lambda k: F.floor(F.lit(k) * tokens / (fields + 1)).cast("int")
    one = lambda w, k: F.when(fields >= k, F.xxhash64(tokens, F.lit(k), F.slice(w, at(k) + 1, at(k + 1) - at(k))))
    return F.when(fields > 0, let(F.split(line, " ", -1), lambda w: F.struct(*[one(w, k).alias(f"p{k}") for k in range(most + 1)])))


def _merged(docs: DataFrame, found: DataFrame, once: DataFrame, min_docs: int, depth: int, similarity: float, max_fields: int) -> DataFrame:
    """The templates that a merged template lets recur, with the first document of it. ``once``: a row for each text of a template, with its pieces."""
    keys = once.where("p0 is not null").select(*LEAF, F.explode(F.array(*[f"p{k}" for k in range(max_fields + 1)])).alias("piece")).where("piece is not null")
    often = keys.groupBy("piece").count().where(F.col("count") >= min_docs).select("piece")
    likely = materialize(keys.join(often, "piece", "left_semi").select(*LEAF).distinct())
    held = materialize(once.join(broadcast_if_small(likely), LEAF, "left_semi").select(*LEAF, "row", "first"))
    lines = held.groupBy(*LEAF).agg(F.count("*").alias("n"))
    # One line stands for each template.
    one = found.join(broadcast_if_small(likely), LEAF, "left_semi").groupBy(*LEAF, "tokens").agg(F.min(F.struct("doc", "row", "at")).alias("one"))
    one = materialize(one.select(*LEAF, "tokens", "one.*"))
    words = _raw(docs).join(broadcast_if_small(one), ["doc", "row", "at"]).select(*LEAF, "tokens", _general(F.col("raw")).alias("line")).dropDuplicates(LEAF)
    able = words.join(lines, LEAF).select(*LEAF, "n", "tokens", F.transform(F.split("line", " ", -1), lambda x, i: F.xxhash64(x, i)).alias("words"))
    able = materialize(able.withColumn("path", F.col("tokens").cast("long")).withColumn("lead", F.array().cast("array<struct<word:bigint,loose:boolean>>")))
    for k in range(depth):
        now = able.withColumn("word", F.get("words", F.lit(k)))
        seen = materialize(now.where("word is not null").groupBy("path", "word").agg(F.sum("n").alias("lines")))
        stays = seen.where(F.col("lines") >= min_docs).select("path", "word", F.lit(True).alias("stays"))
        loose = seen.groupBy("path").agg((F.count("*") > 1).alias("loose"))
        step = now.join(stays, ["path", "word"], "left").join(loose, "path", "left")
        kept = F.when(F.col("stays"), F.array(F.struct("word", "loose"))).otherwise(F.array())
        step = step.select(*LEAF, "n", "tokens", "words", F.xxhash64("path", F.when(F.col("stays"), F.col("word"))).alias("path"), F.concat("lead", kept).alias("lead"))
        written, able = able, materialize(step)
        drop(written)
    each = materialize(able.select(*LEAF, "path", "n", F.posexplode("words").alias("at", "word")).where(F.col("at") >= depth))
    seen = materialize(each.groupBy("path", "at", "word").agg(F.sum("n").alias("lines")))
    loose = seen.groupBy("path", "at").agg((F.count("*") > 1).alias("loose"))
    stays = materialize(seen.where(F.col("lines") >= min_docs).drop("lines").join(loose, ["path", "at"]))
    rest = each.join(stays, ["path", "at", "word"]).groupBy(*LEAF).agg(F.collect_list(F.struct("word", "loose")).alias("rest"))
    kept = able.join(rest, LEAF, "left").select(*LEAF, "tokens", F.concat("lead", F.coalesce("rest", F.array())).alias("kept"))
    # A set of words stands as its size and two exclusive sums.
    sums = lambda f: F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(f(x["word"])))
    other = lambda w: F.xxhash64(w, F.lit(3))
    spare = F.size("kept") - (F.col("tokens") - _fields(F.col("tokens"), similarity, max_fields))
    kept = kept.where(spare >= 0).withColumn("key", sums(lambda w: w)).withColumn("key2", sums(other))
    whole = F.struct(F.size("kept").alias("size"), F.col("key").alias("key"), F.col("key2").alias("key2"))
    less = F.transform(F.filter("kept", lambda x: x["loose"]), lambda x: F.struct((F.size("kept") - 1).alias("size"), F.col("key").bitwiseXOR(x["word"]).alias("key"), F.col("key2").bitwiseXOR(other(x["word"])).alias("key2")))
    kept = materialize(kept.select(*LEAF, "tokens", F.explode(F.concat(F.array(whole), F.when(spare > 0, less).otherwise(F.array()))).alias("k")).select(*LEAF, "tokens", "k.*"))
    by = ["tokens", "size", "key", "key2"]
    texts = kept.join(held, LEAF).groupBy(*by, "row").agg(F.min("first").alias("first"))
    out = materialize(kept.join(_recurring(texts, by, min_docs), by).groupBy(*LEAF).agg(F.min("first").alias("first")))
    drop(likely, held, one, able, each, seen, stays, kept)
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = 4, depth: int = 3, min_tokens: int = 3, similarity: float = 1.0, max_fields: int = 4, counts: bool = True) -> DataFrame:
    """The columns of ``docs`` (with ``text`` less its dropped lines); with ``counts``, also ``n_lines`` and ``n_dropped``, which replace columns of these names.

    Texts are read row by row, and go through one join (by doc_id and hash of the text) with the numbers of their lines that go.
    """
    fields = _fields(F.col("tokens"), similarity, max_fields)
    found, pieces = _lines(docs), []
    if similarity < 1:
        found = found.withColumn("pieces", _pieces(F.col("line"), F.col("tokens"), fields, max_fields))
        pieces = [f"p{k}" for k in range(max_fields + 1)]
    found = materialize(found.select("doc", "row", "at", "tokens", *LEAF, *(["pieces.*"] if pieces else [])))
    written, found = found, found.where(F.col("tokens") >= min_tokens)
    once = materialize(found.groupBy(*LEAF, "row").agg(F.min("doc").alias("first"), *[F.max(p).alias(p) for p in pieces]))
    recurring = _recurring(once, LEAF, min_docs)
    if similarity < 1:
        recurring = recurring.union(_merged(docs, found, once, min_docs, depth, similarity, max_fields)).groupBy(*LEAF).agg(F.min("first").alias("first"))
    recurring = materialize(recurring)
    # A text stays whole where its first copy does.
    own = once.groupBy("row").agg(F.min("first").alias("own"))
    gone = found.select("doc", "row", "at", *LEAF).join(broadcast_if_small(recurring), LEAF).groupBy("doc", "row").agg(F.collect_set(F.struct("at", "first")).alias("all"))
    gone = gone.join(own, "row").select(F.col("doc").alias("d"), F.col("row").alias("r"), F.filter("all", lambda x: x["first"] < F.col("own")).alias("gone")).where(F.size("gone") > 0)
    gone = materialize(gone.select("d", "r", F.transform("gone", lambda x: x["at"]).alias("gone")))
    drop(written, once, recurring)
    rows = docs.select(F.struct("*").alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("row"))
    # Most documents lose lines somewhere, so ``gone`` grows with the input and is never broadcast.
    rows = rows.join(gone.hint("merge"), (F.col("row") == F.col("r")) & (F.col("doc") == F.col("d")), "left")
    text = F.col("rest.text")
    block = 256  # numbers are looked up in their block of lines
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.array_max("gone") / block).cast("int")), lambda b: F.filter("gone", lambda g: F.floor(g / block) == b))
    stays = lambda held: F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(F.get(held, F.floor(i / block).cast("int")), i), F.lit(False)))
    kept = F.when(F.col("gone").isNull(), text).otherwise(let(blocks, lambda held: F.array_join(stays(held), "\n")))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    more = [n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return rows.select(*[kept.alias(c) if c == "text" else F.col("rest")[c].alias(c) for c in names], *more)
