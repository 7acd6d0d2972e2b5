"""Personal data by patterns, and further identifiers by bootstrapped contexts. DataFrame functions only.

Base kinds are found by patterns with checks (see :data:`KINDS`), leftmost and without overlap within a kind. They are the seeds:
1. Candidates are, in what base spans leave of the text, runs of tokens with a digit that single spaces join, and tokens with an ``@`` or ``_`` or with a capital
   after a small letter. Base spans are the seeds.
2. Seeds induce lexical patterns: the word to the left, the two words to the left, and the words to the left and right (whole words, however far).
3. Patterns and instances (the strings of seeds and candidates) form a graph. In each round a pattern's score is the mean score of its instances (seeds: 1), shrunk by
   ``prior`` doubtful instances, and an instance's score that of its best pattern, times ``decay``.
4. Patterns of high confidence (score and number of different seed instances) discover the other candidates in their places, if these look like
   identifiers (at least ``min_length`` characters with two digits; without digits, at least ``min_plain`` characters). Their kind is ``id``, and ``like`` is the
   kind of most seeds of the best pattern that found them.

Everything but the graph is done row by row where the texts are: what the graph's joins move are patterns and short strings. Up to ``max_patterns``
good patterns are broadcast as one row (a hash of 8 bytes, a score and a kind each); more of them are joined on their hashes.

Null texts count as empty and have no spans. Repeated rows have the same spans, and count once in the graph. Positions are code points.
An empty table gives an empty result. Extra columns of any name are kept by :func:`mask_private` and ignored by :func:`find_private`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import let, running
from verdata.plans.storage import broadcast_if_small, drop, materialize

#: Kinds in order, with their patterns: greedy parts that can't give back are possessive, and a match starts where an
#: earlier start of the same run would have matched, so that matching takes linear time; the matches are those of the plain patterns.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(doubled(i), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = F.regexp_replace(m, "[^0-9]", "")
    card = F.when(F.length(digits).between(13, 19), let(digits, _luhn)).otherwise(F.lit(False))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", card).otherwise(F.length(digits).between(9, 15))


#: What stands for a base span while candidates are looked for; no token with it is one.
_TAKEN = "\x01"
_DIGITS = r"[^\s0-9\x01]*+[0-9][^\s\x01]*+(?!\S)"
_SHAPED = r"[^\s@_\x01]*+[@_][^\s\x01]*+(?!\S)|[^\s\x01]*?[a-z][A-Z][^\s\x01]*+(?!\S)"
CANDIDATE = rf"(?<!\S)(?:{_DIGITS}(?:\x20{_DIGITS})*+|{_SHAPED})"
_SPACE = " \t\n\x0b\x0c\r"
_SPAN = "array<struct<kind_no:int,start:bigint,end:bigint,m:string,l1:string,l2:string,r1:string>>"
_BUCKETS = 4096


def _context(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(word, F.lit("")), r"[^\p{L}\p{N}=:]+", ""))


def _around(before: Column, after: Column) -> list[Column]:
    """The two words before a match and the one after it, from the pieces of text around it."""
    left = F.split(F.rtrim(before, F.lit(_SPACE)), r"\s+")
    return [_context(F.element_at(left, -1)).alias("l1"), _context(F.try_element_at(left, F.lit(-2))).alias("l2"),
            _context(F.regexp_extract(after, r"\A\s*+(\S++)", 1)).alias("r1")]


def _found(text: Column, pattern: str, kind_no: int, guard: Column) -> Column:
    """Matches with places and the words around them, from two passes of the same pattern: the matches, and the pieces between them."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def places(s: Column) -> Column:
        lengths = F.transform(s["found"], lambda m, i: (F.length(m) + F.length(F.get(s["gaps"], i))).cast("long"))
        return let(running(lengths, lambda a, x: a + x), lambda ends: F.transform(s["found"], lambda m, i: F.struct(
            F.lit(kind_no).alias("kind_no"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"),
            *_around(F.get(s["gaps"], i), F.get(s["gaps"], i + 1)))))

    return F.coalesce(F.when(guard, let(both, places)), F.array()).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Base spans of a text with their strings and the words around them, by kind, then start."""
    t = text
    guards = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.rlike(r"\+[0-9]")}
    valid = lambda kind: lambda s: _valid(F.lit(kind), s["m"])
    return F.concat(*[F.filter(_found(t, p, i, guards[k]), valid(k)) for i, (k, p) in enumerate(KINDS)])


def _redraw(text: Column, spans: Column, fill) -> Column:
    """The text with ``fill(span, from)`` in place of spans, where ``from`` is the first position that no earlier span covers."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))))

    def draw(s: Column) -> Column:
        def pieces(upto: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                before = F.coalesce(F.get(upto, i - 1), F.lit(0).cast("long"))
                start = F.greatest(x["start"], before)
                gap = F.substring(text, (before + 1).cast("int"), (start - before).cast("int"))
                return F.concat(gap, F.when(start < x["end"], fill(x, start)).otherwise(F.lit("")))
            return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, (F.element_at(upto, -1) + 1).cast("int"), F.length(text)))
        return let(running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), pieces)

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, draw))


def _candidates(text: Column, base: Column) -> Column:
    left = _redraw(text, base, lambda x, start: F.repeat(F.lit(_TAKEN), (x["end"] - start).cast("int")))
    return let(left, lambda t: _found(t, CANDIDATE, len(KINDS), t.rlike(r"[0-9@_]|[a-z][A-Z]")))


def _scan(text: Column) -> Column:
    """``base`` and ``other``: base spans and candidates of a text."""
    t = F.coalesce(text, F.lit(""))
    return let(F.when(t.rlike(r"[0-9@_]|[a-z][A-Z]"), base_spans(t)).otherwise(F.array().cast(_SPAN)),
               lambda base: F.struct(base.alias("base"), _candidates(t, base).alias("other")))


def _patterns(x: Column) -> Column:
    """Lexical patterns of a seed or candidate."""
    l1, l2, r1 = x["l1"], x["l2"], x["r1"]
    return F.filter(F.array(
        F.when(l1 != "", F.concat(F.lit("l1 "), l1)),
        F.when((l1 != "") & (l2 != ""), F.concat(F.lit("l2 "), l2, F.lit(" "), l1)),
        F.when((l1 != "") & (r1 != ""), F.concat(F.lit("lr "), l1, F.lit(" "), r1))), lambda p: p.isNotNull())


def learn_patterns(tokens: DataFrame, rounds: int = 3, prior: float = 1.0, decay: float = 0.9) -> DataFrame:
    """Scores of lexical patterns: ``pattern, score, n_seeds`` and ``like`` (the number of the kind of most of its seeds).

    ``tokens``: ``x``, a seed or candidate with its string and the words around, and a boolean ``seed``.
    """
    edges = tokens.select(F.explode(_patterns(F.col("x"))).alias("pattern"), F.lower("x.m").alias("instance"), F.when(F.col("seed"), F.col("x.kind_no")).alias("kind_no"))
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.min("kind_no").alias("kind_no")))
    # Patterns without a seed can only gain a score through shared instances; those of one instance have nothing to share.
    own = edges.groupBy("instance").agg(F.max(F.col("kind_no").isNotNull().cast("double")).alias("own"))
    scores = own.select("instance", F.col("own").alias("score"))
    kinds = [F.count_if(F.col("kind_no") == i).alias(f"k{i}") for i in range(len(KINDS))]
    written = []
    for k in range(rounds):
        last = k == rounds - 1
        rated = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("score"), F.count("kind_no").alias("n_seeds"), *(kinds if last else []))
        if last:
            most = F.array_max(F.array(*[F.struct(F.col(f"k{i}").alias("n"), F.lit(-i).alias("no")) for i in range(len(KINDS))]))
            rated = materialize(rated.select("pattern", "score", "n_seeds", (-most["no"]).alias("like")))
            drop(edges, *written)
            return rated
        best = edges.join(rated.select("pattern", F.col("score").alias("s")), "pattern").groupBy("instance").agg(F.max("s").alias("s"))
        scores = materialize(own.join(best, "instance").select("instance", F.greatest("own", decay * F.col("s")).alias("score")))
        written.append(scores)
    raise ValueError("rounds must be at least 1")


def _looks(m: Column, min_length: int, min_plain: int) -> Column:
    """Whether a candidate looks like an identifier."""
    return F.when(m.rlike("[0-9]"), (F.length(m) >= min_length) & m.rlike("[0-9].*[0-9]")).otherwise(F.length(m) >= min_plain)


def _good(found: DataFrame, min_score: float, min_seeds: int, **learning) -> DataFrame:
    """``key`` (hash), ``like`` and ``score`` of the patterns of high confidence. ``found``: ``base`` and ``other`` of each row."""
    seeds = found.select(F.explode("base").alias("x"), F.lit(True).alias("seed"))
    rated = learn_patterns(seeds.union(found.select(F.explode("other").alias("x"), F.lit(False).alias("seed"))), **learning)
    good = rated.where((F.col("score") >= min_score) & (F.col("n_seeds") >= min_seeds))
    good = materialize(good.groupBy(F.xxhash64("pattern").alias("key")).agg(F.max("score").alias("score"), F.min("like").alias("like")))
    drop(rated)
    return good


def _as_row(good: DataFrame) -> DataFrame:
    """All good patterns in one row: ``good``, an array of buckets by hash."""
    bucket = F.pmod("key", F.lit(_BUCKETS)).cast("int")
    held = good.groupBy(bucket.alias("b")).agg(F.collect_list(F.struct("key", "score", "like")).alias("own"))
    every = good.sparkSession.range(_BUCKETS).select(F.col("id").cast("int").alias("b")).join(held, "b", "left")
    row = every.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("own", F.array()).alias("own")))), lambda x: x["own"]).alias("good"))
    return F.broadcast(row)


def _like(x: Column, like: Column) -> Column:
    return F.struct(x["kind_no"].alias("kind_no"), x["start"].alias("start"), x["end"].alias("end"), like.alias("like"))


def _discovered(other: Column, good: Column, min_length: int, min_plain: int) -> Column:
    """Of candidates, those that a good pattern finds: spans with ``like``, the seed kind of the best pattern."""
    def best(x: Column) -> Column:
        keys = F.transform(_patterns(x), lambda p: F.xxhash64(p))
        own = lambda k: F.filter(F.get(good, F.pmod(k, F.lit(_BUCKETS)).cast("int")), lambda g: g["key"] == k)
        return F.array_max(F.transform(F.flatten(F.transform(keys, own)), lambda g: F.struct(g["score"].alias("score"), (-g["like"]).alias("like"))))

    return F.filter(F.transform(F.filter(other, lambda x: _looks(x["m"], min_length, min_plain)), lambda x: _like(x, -best(x)["like"])), lambda s: s["like"].isNotNull())


def _same_other(other: str = "other") -> list[Column]:
    """Rows of equal candidates have equal spans, so these two hashes name them."""
    return [F.xxhash64(other).alias("_k1"), F.xxhash64(other, F.lit(1)).alias("_k2")]


def _joined(found: DataFrame, good: DataFrame, min_length: int, min_plain: int) -> DataFrame:
    """The same for any number of good patterns, by a join on their hashes: ``_k1, _k2`` and ``new``, the spans discovered in rows of these candidates."""
    each = found.where(F.size("other") > 0).select(*_same_other(), "other").dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.explode("other").alias("x"))
    each = each.where(_looks(F.col("x.m"), min_length, min_plain))
    uses = each.select("_k1", "_k2", _like(F.col("x"), F.lit(None).cast("int")).alias("s"), F.explode(F.transform(_patterns(F.col("x")), lambda p: F.xxhash64(p))).alias("key"))
    best = uses.join(good, "key").groupBy("_k1", "_k2", "s").agg(F.max(F.struct("score", (-F.col("like")).alias("like"))).alias("best"))
    return best.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(_like(F.col("s"), -F.col("best.like")))).alias("new"))


def _spans(rows: DataFrame, min_score: float = 0.6, min_seeds: int = 3, min_length: int = 8, min_plain: int = 5, max_patterns: int = 500_000, **learning) -> Callable[[DataFrame], DataFrame]:
    """Learn the good patterns from ``base`` and ``other`` of all rows (written without texts); gives a function that adds the final ``spans`` to such rows.

    Up to ``max_patterns`` good patterns are broadcast as one row. More are joined on their hashes, and what they find is joined to the rows.
    """
    found = materialize(rows.select("base", "other"))
    good = _good(found, min_score, min_seeds, **learning)
    base = F.transform("base", lambda s: _like(s, F.lit(None).cast("int")))
    spans = lambda new: F.sort_array(F.array_distinct(F.concat(base, new)))
    few = good.count() <= max_patterns
    new = None if few else materialize(_joined(found, good, min_length, min_plain))
    drop(found)

    def add(df: DataFrame) -> DataFrame:
        if few:
            return df.crossJoin(_as_row(good)).withColumn("spans", spans(_discovered(F.col("other"), F.col("good"), min_length, min_plain)))
        return df.withColumns(dict(zip(("_k1", "_k2"), _same_other()))).join(broadcast_if_small(new), ["_k1", "_k2"], "left").withColumn("spans", spans(F.coalesce("new", F.array().cast(new.schema["new"].dataType))))

    return add


def find_private(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, and ``like`` for the kind ``id``; by kind, then start) of each row of ``docs``."""
    rows = materialize(docs.select("doc_id", _scan(F.col("text")).alias("s")).select("doc_id", "s.base", "s.other"))
    out = _spans(rows, **parameters)(rows)
    return out.select("doc_id", F.transform("spans", lambda s: F.struct(_name(s["kind_no"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _name(s["like"]).alias("like"))).alias("spans"))


def _name(no: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k, _ in KINDS], F.lit("id")), no)


def mask_private(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by ``<kind>``; of overlapping spans, the earlier (then the earlier kind) names it.

    Two narrow passes over the texts, one for the graph and one that masks; no text is shuffled.
    """
    rows = docs.select(F.struct("*").alias("doc"), _scan(F.col("text")).alias("s")).select("doc", "s.base", "s.other")
    out = _spans(rows, **parameters)(rows)
    label = lambda x, start: F.when(start == x["start"], F.concat(F.lit("<"), _name(x["kind_no"]), F.lit(">"))).otherwise(F.lit(""))
    out = out.withColumn("text", _redraw(F.col("doc.text"), F.col("spans"), label))
    return out.select(*[F.col("text").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
