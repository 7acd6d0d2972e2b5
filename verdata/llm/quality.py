"""Quality rules: text statistics, and a decision list learned from labelled ones. DataFrame functions only.

Sequential covering: a rule for the bad class grows threshold by threshold (by information gain on a growing set), is
pruned on a held-out set, and takes away what it covers; the rules become one ordered Spark ``when`` expression.

Null and empty texts have all statistics 0. Rows with null labels aren't used; without both classes in the labels there
are no rules, and nothing but the base test rejects. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import SPACE_WORD, let
from verdata.plans.storage import drop, materialize


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                                                  | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                                             F.lit(0).cast("long"), lambda a, x: a + x))

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(words, of)


def _statistics(text: Column) -> Column:
    """Counts of a text, as a struct."""
    t = F.coalesce(text, F.lit(""))
    gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeated(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        gone(r"[#*$%&|<>]").alias("n_symbols"),
        gone(r"[A-Z]").alias("n_upper"), gone(r"[!?]").alias("n_marks"), gone(r"[0-9]").alias("n_digits"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))


def _flat(s: Column) -> dict[str, Column]:
    """The single counts of :func:`_statistics`."""
    own = {c: s[c] for c in ("word_chars", "n_symbols", "n_upper", "n_marks", "n_digits")}
    return {c: s["w"][c] for c in ("n_words", "n_distinct", "n_repeat_words")} | own | {c: s["l"][c] for c in ("n_lines", "n_dup_lines")}


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (a hash of the text) and counts of each text of ``docs``; 64-bit hashes stand for 3-word windows."""
    counted = docs.select("doc_id", F.xxhash64("text").alias("row"), _statistics(F.col("text")).alias("s"))
    return counted.select("doc_id", "row", *[c.alias(n) for n, c in _flat(F.col("s")).items()])


#: What conditions may test: a count, or the share of one count in another (0 where that is 0).
FEATURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def _feature(name: str, of) -> Column:
    """A feature's value; ``of`` gives the column of a count."""
    a, b = FEATURES[name]
    return of(a).cast("double") if b is None else F.when(of(b) > 0, of(a) / of(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, "<=" or ">", threshold) that hold together for bad texts; the precision on the fitted rows."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self, of=F.col) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (_feature(f, of) <= t if op == "<=" else _feature(f, of) > t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)


def _test(c) -> Column:
    f, op, b = c
    return F.col(f) <= b if op == "<=" else F.col(f) > b


def learn_rules(docs: DataFrame, labels: DataFrame, max_sample: int = 20_000, bins: int = 24, max_rules: int = 8,
                max_conditions: int = 3, min_precision: float = 0.99, min_cover: int = 12) -> list[Rule]:
    """An ordered decision list for ``quality = 0``, fitted on at most ``max_sample`` labelled rows.

    The sample is the rows of smallest hash of doc_id; only their texts are looked at. It has at most ``max_sample`` rows of two
    numbers and is broadcast. Only counts by feature and bin come to the driver.
    """
    asked = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    asked = asked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(asked), "doc_id")
    x = texts.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), _statistics(F.col("text")).alias("s"))
    own = _flat(F.col("s"))
    x = materialize(x.select("bad", "held", *[_feature(f, own.__getitem__).alias(f) for f in FEATURES]))
    # Cut points lie at quantiles of both classes, so that a rare class has its own.
    share = [i / bins for i in range(1, bins)]
    found = x.groupBy("bad").agg(*[F.percentile_approx(f, share, 10_000).alias(f) for f in FEATURES]).collect()
    if len(found) < 2:
        drop(x)
        return []
    cuts = {f: sorted({v for r in found for v in r[f]}) for f in FEATURES}
    binned = x.select("bad", "held", *[sum([(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES])
    binned = materialize(binned.groupBy("bad", "held", *FEATURES).agg(F.count("*").alias("n")).coalesce(2))
    drop(x)

    def counts(df: DataFrame) -> dict:
        rows = df.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("c"))
        return {(r["f"], r["b"], r["bad"]): r["n"] for r in rows.groupBy("c.f", "c.b", "bad").agg(F.sum("n").alias("n")).collect()}

    rules, left = [], F.lit(True)
    banned: set[str] = set()
    for _ in range(max_rules + len(FEATURES)):
        grown: list[tuple[str, str, int]] = []
        for _ in range(max_conditions):
            now = left & ~F.col("held")
            for c in grown:
                now = now & _test(c)
            n = counts(binned.where(now))
            some = next(iter(FEATURES))
            p0, n0 = (sum(v for (f, _, y), v in n.items() if f == some and y == k) for k in (1, 0))
            if not p0 or not n0:
                break
            best = None
            for f in FEATURES:
                if not grown and f in banned:
                    continue
                p = q = 0
                for b in range(len(cuts[f])):
                    p, q = p + n.get((f, b, 1), 0), q + n.get((f, b, 0), 0)
                    for op, pp, nn in (("<=", p, q), (">", p0 - p, n0 - q)):
                        if pp >= min_cover:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, (f, op, b))
            if best is None or best[0] <= 0:
                break
            grown.append(best[1])
        if not grown:
            break
        # Prune: of the rule's beginnings that are precise enough over all rows, the one with the best (p - n) / (p + n) on the held-out set; shorter wins ties.
        sums, so_far = [], F.lit(True)
        for i, c in enumerate(grown):
            so_far = so_far & _test(c)
            sums += [F.sum(F.when(so_far & (F.col("bad") == y) & (F.col("held") | F.lit(every)), F.col("n"))).alias(f"{k}{i}{e}") for k, y in (("p", 1), ("n", 0)) for e, every in (("h", False), ("a", True))]
        r = binned.where(left).agg(*sums).first().asDict()
        p, n = ({e: [r[f"{k}{i}{e}"] or 0 for i in range(len(grown))] for e in "ha"} for k in "pn")
        precision = [x / (x + y) if x + y else 0.0 for x, y in zip(p["a"], n["a"])]
        value = [(x - y) / (x + y) if x + y else -1.0 for x, y in zip(p["h"], n["h"])]
        fine = [i for i in range(len(grown)) if precision[i] >= min_precision and value[i] > 0]
        if not fine:  # another feature has to begin the rule
            banned.add(grown[0][0])
            continue
        at = max(fine, key=lambda i: (round(value[i], 6), -i))
        kept = grown[: at + 1]
        rules.append(Rule(tuple((f, op, cuts[f][b]) for f, op, b in kept), precision[at]))
        covered = F.lit(True)
        for c in kept:
            covered = covered & _test(c)
        left = left & ~covered
        if len(rules) == max_rules:
            break
    drop(binned)
    return rules


def verdict(rules: list[Rule], of=F.col) -> Column:
    """Number of the first rule that holds (from 1), null if none does; ``of`` gives the column of a count."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(of), F.lit(i)) if out is None else out.when(r.column(of), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Statistics of each row of ``docs`` with ``base_failed``, ``rule`` (the number of the rule that rejects it) and ``kept``; one narrow pass after the fit."""
    rules = learn_rules(docs, labels, **fit)
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, whatever their names. A filter: nothing is joined or shuffled after the fit."""
    rules = learn_rules(docs, labels, **fit)

    def good(s: Column) -> Column:
        of = _flat(s).__getitem__
        return ~base_failed(of) & verdict(rules, of).isNull()

    return docs.where(let(_statistics(F.col("text")), good))
