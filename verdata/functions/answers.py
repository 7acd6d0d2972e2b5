"""Answer extraction, comparison and output checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdata.functions import braces as B
from verdata.functions.text import WHITE, normalize_text, once, text_of, trim_ws

#: A chat turn's head, at a line's start or after a closing bracket (fixed value).
TURN = r"(?i)(?:^|\n|(?<=[\]\)\}]))(?U:\s*)(?:Human|Assistant|User|System)(?U:\s*):"
#: What Python's float() accepts (without underscores): other engines' casts differ.
_NUMBER = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def extract_boxed(c: Column) -> Column:
    return once(text_of(c), B.extract_boxed)


def postprocess_generation(c: Column, cut_turn_markers: bool = False, stop_after_boxed: bool = False) -> Column:
    """Cut a response at the first chat turn, after the last boxed answer, or both."""
    out = text_of(c)
    if cut_turn_markers:
        head = F.split(out, TURN, 2)
        out = F.when(F.size(head) > 1, F.regexp_replace(head[0], r"(?U)\s+\z", "")).otherwise(out)
    return once(out, B.stop_after_boxed) if stop_after_boxed else out


def format_reward(c: Column, style: str = "boxed") -> Column:
    """1.0 if the whole response is ``<think>..</think>`` with a boxed answer (``answer``: an ``<answer>`` element) after it."""
    if style == "answer":
        return text_of(c).rlike(r"(?s)\A<think>.*?</think>(?U:\s*)<answer>.*?</answer>\z").cast("double")
    tight = F.regexp_replace(text_of(c), r"(?U)\s*(<|>|/)\s*", "$1")
    return tight.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")


def _close(a: Column, b: Column) -> Column:
    x, y = (F.when(v.rlike(_NUMBER), F.expr("1D") * v.try_cast("double")) for v in (a, b))
    return F.coalesce(F.abs(x - y) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-9)), F.lit(False))


def answer_equal(pred: Column, gold: Column) -> Column:
    """Equal as normalized text, or close as numbers. Two empty answers are equal."""
    a, b = normalize_text(pred), normalize_text(gold)
    return (a == b) | _close(a, b)


#: Units that a relaxed comparison ignores (fixed value).
_UNITS = (r"(?i)\b(?:degrees?|degree|cm|mm|km|m|meters?|inches?|inch|feet|foot|ft|seconds?|minutes?|hours?|dollars?|cents?|units?)\b"
          r"(?:\s*\^\{?\d+\}?)?")
#: Ordered replacements of the relaxed form: pattern, replacement (fixed values).
RELAXED = (
    (r"\\[dt]frac", r"\\frac"), (r"\$+", ""), (r"\\(?:left|right)\s*", ""), (r"\\(?:text|mbox|mathrm)\{([^{}]*)\}", "$1"), (r"\\(?:,|!|;|:)", ""),
    (r"(?<=\d),(?=\d{3}\b)", ""), (r"_\{([^{}]+)\}", "_$1"), (r"\^\{?\\circ\}?", ""), ("°", ""), (r"\\%", "%"), (_UNITS, ""), ("%", ""),
    (r"\A\s+|\s+\z", ""), (r"\A\{(.+)\}\n?\z", "$1"),
)


def relaxed_normalize(c: Column) -> Column:
    """An answer without LaTeX decoration, units, thousands commas and white space, in lower case."""
    out = B.strip(text_of(c))
    for pattern, by in RELAXED:
        out = F.regexp_replace(out, "(?U)" + pattern.replace(r"\s", B.SPACE), by)
    return F.regexp_replace(F.lower(out), B.SPACE + "++", "")


def _forms(c: Column) -> Column:
    """The strict and the relaxed form of an answer."""
    return F.struct(normalize_text(c).alias("strict"), relaxed_normalize(c).alias("loose"))


def _equal_forms(a: Column, b: Column) -> Column:
    return (a["strict"] == b["strict"]) | _close(a["strict"], b["strict"]) | ((a["loose"] != "") & (a["loose"] == b["loose"])) | _close(a["loose"], b["loose"])


def relaxed_answer_equal(pred: Column, gold: Column) -> Column:
    return _equal_forms(_forms(pred), _forms(gold))


#: Kinds of answers looked for in a response's tail, and cues near an answer (fixed values).
TAIL, NEAR_END, AROUND = 1800, 220, 260
SPANS = tuple("(?sU)" + p for p in (
    r"\\begin\{pmatrix\}.*?\\end\{pmatrix\}", r"-?\\(?:dfrac|tfrac|frac)\{[^{}\n]{1,80}\}\{[^{}\n]{1,80}\}", r"-?\\sqrt\{[^{}\n]{1,80}\}",
    r"\([^()\n]{1,80}\)", r"-?\d+(?:\.\d+)?_\{?\d+\}?", rf"-?\d+(?:\.\d+)?(?:{B.SPACE}*(?:\\%|%|\\circ|°|degrees?))?"))
CUES = ("answer", "final", "therefore", "thus", "hence", "so", "equals", "is", "=", "\\boxed")


def _last_span(text: Column, size: Column, tail: Column, base: Column, pattern: str, equal) -> Column:
    """The last match of a kind that equals gold and stands near the end or a cue; null if there is none."""
    near = lambda a, b: F.exists(F.array(*map(F.lit, CUES)), lambda cue: F.contains(F.lower(F.substring(text, F.greatest(a - AROUND, F.lit(0)) + 1, b + AROUND - F.greatest(a - AROUND, F.lit(0)))), cue))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        value = B.strip(x["match"])
        fits = equal(value) & ((end >= size - NEAR_END) | near(start, end))
        return F.struct(end.alias("at"), F.when(fits, value).otherwise(s["best"]).alias("best"))
    # What a split leaves between the matches tells where they stand.
    matches, gaps = F.regexp_extract_all(tail, F.lit(pattern), F.lit(0)), F.split(tail, pattern, -1)
    both = once(matches, lambda m: F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("match"), b.alias("gap"))))
    return F.aggregate(both, F.struct(base.alias("at"), F.lit(None).cast("string").alias("best")), step, lambda s: s["best"])


def robust_answer(response: Column, gold: Column, boxed: Column | None = None) -> Column:
    """The boxed answer; if that is empty, the last span of the tail (kinds from last to first) that equals gold and stands near the end or a cue, else the last
    boxed content that equals gold. ``boxed``: the boxed answer, if it is known."""
    def search(t: Column) -> Column:
        def by_gold(g: Column) -> Column:
            equal = lambda v: once(_forms(v), lambda f: _equal_forms(f, g))
            size = F.length(t)
            base = F.greatest(size - TAIL, F.lit(0))
            last = lambda p: once(F.substring(t, base + 1, F.lit(TAIL)), lambda tail: _last_span(t, size, tail, base, p, equal))
            return F.coalesce(*map(last, reversed(SPANS)), B.fold_groups(t, keep=equal)["best"], F.lit(""))
        return once(_forms(gold), by_gold)

    def answer(t: Column) -> Column:
        return once(extract_boxed(t) if boxed is None else text_of(boxed), lambda box: F.when(box != "", box).otherwise(search(t)))
    return once(text_of(response), answer)


#: Ordered substitutions and removals of the final-answer form (fixed values).
SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def normalize_final_answer(c: Column) -> Column:
    """What follows the last ``=``, without units and LaTeX wrapping, with shorthand fractions and roots written out."""
    out = F.element_at(F.split(text_of(c), "=", -1), -1)
    for before, after in (*SUBSTITUTIONS, *((r, "") for r in REMOVED)):
        out = F.replace(out, F.lit(before), F.lit(after))
    for pattern, by in ((r"(.*?)\$(.*?)\$(.*)", r"\$$2\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"),
                        (r"\\boxed\{(.*)\}", "$1"), (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}")):
        out = F.regexp_replace(out, "(?d)" + pattern, by)
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return trim_ws(F.when(bare.rlike(r"(?U)\A\d+\z"), bare).otherwise(out))


def has_turn_marker(c: Column) -> Column:
    return text_of(c).rlike(TURN)


def issue_flags(response: Column, boxed: Column, length: Column, max_length: int | None) -> dict[str, Column]:
    """Flags as 0.0 and 1.0, so that averages can be taken of them."""
    t = text_of(response)
    cap = F.coalesce(length >= max_length - 1, F.lit(False)) if max_length else F.lit(False)
    unclosed = t.contains("<think>") & ~t.contains("</think>")
    one = lambda c: c.cast("double")
    return {"hit_length_cap": one(cap), "unclosed_think": one(unclosed), "missing_boxed_answer": one(boxed == ""),
            "prompt_contamination": one(has_turn_marker(response)), "truncation": one(cap | unclosed)}


def severe_repetition(c: Column, n: int = 4, threshold: float = 0.34, long_line: int = 12) -> Column:
    """Whether a text of at least 3n words has a share of ``threshold`` n-grams that repeat others, or a long line three times; null is no text."""
    white = rf"[\x1C-\x1F{WHITE}]"
    t = text_of(c)
    words = F.filter(F.split(t, white + "+", -1), lambda w: w != "")
    lines = F.filter(F.transform(F.split(t, r"[\n-\r\x1C-\x1E\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, rf"\A{white}+|{white}+\z", "")), lambda x: F.length(x) >= long_line)

    def grams_repeat(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return 1 - F.size(F.array_distinct(grams)) / (F.size(w) - n + 1) >= threshold

    def thrice(s: Column) -> Column:
        return F.when(F.size(s) < 3, False).otherwise(F.exists(F.sequence(F.lit(3), F.greatest(F.size(s), F.lit(3))), lambda i: F.element_at(s, i) == F.element_at(s, i - 2)))
    # An array of one is a name for its element, which is computed once then.
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < 3 * n, False).otherwise(grams_repeat(w) | F.transform(F.array(F.sort_array(lines)), thrice)[0]))[0]
