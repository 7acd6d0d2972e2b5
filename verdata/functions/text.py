"""Column functions for prompts and problem texts. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics in order with the substrings that hint at them (fixed values).
TOPICS = (
    ("geometry", ("triangle", "circle", "angle", "area", "perimeter", "radius", "diameter", "polygon", "cube", "sphere")),
    ("number_theory", ("integer", "prime", "divisible", "modulo", "remainder", "factor", "gcd", "lcm", "congruent")),
    ("combinatorics", ("how many", "ways", "arrange", "permutation", "combination", "choose", "distinct", "probability")),
    ("algebra", ("equation", "solve", "polynomial", "quadratic", "root", "system", "value of x", "function")),
    ("sequence", ("sequence", "recurrence", "arithmetic progression", "geometric progression", "term")),
    ("probability", ("probability", "random", "expected", "dice", "coin")),
    ("arithmetic", ("sum", "product", "average", "mean", "ratio", "percent", "fraction")),
)
#: Words that make a problem more complex, and answer types that do (fixed values).
COMPLEX_WORDS = ("prove", "minimum", "maximum", "equilateral", "modulo", "probability")
HARD_TYPES = ("sqrt_expression", "power_expression", "text_or_symbolic", "other_expression", "none_or_no_solution")
#: Every tag of :func:`verifier_risk_tags` but ``clean`` (fixed values).
RISK_TAGS = ("empty_gold_answer", "none_or_no_solution_gold", "symbolic_or_text_gold", "possible_multi_answer", "long_gold_answer",
             "complex_latex_gold", "over_max_prompt_tokens", "possibly_overlong_prompt")


#: Unicode's white space, as Python strips and splits it in ``\\s`` (fixed values).
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def trim_ws(c: Column) -> Column:
    """Strip white space of any kind from both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def once(value: Column, body) -> Column:
    """``body(value)``, with the value computed once for each row: an array of one is a name for its element."""
    return F.transform(F.array(value), body)[0]


def text_of(c: Column) -> Column:
    """Null counts as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    """White space collapsed to single spaces, stripped, lower case."""
    # A whole run at a time, but for a single space between words, which nearly all runs are. One character class and no branch, which is cheaper at every character.
    return F.lower(F.trim(F.regexp_replace(text_of(c), rf"[{WHITE}]++(?<!(?<![{WHITE}]) )", " ")))


def stable_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 16)


def seeded(c: Column, seed: int) -> Column:
    """Sort key of a reproducible shuffle: equal on every engine and partitioning."""
    return F.md5(F.encode(F.concat(F.lit(f"{seed}|"), c.cast("string")), "UTF-8"))


def render_prompt(c: Column, template: str = "{{ content }}", strip_template: bool = False) -> Column:
    """Put a text in the place of ``{{ content }}`` (or ``{{ content | trim }}``, which strips it)."""
    template = template.strip() if strip_template else template
    for hole, value in (("{{ content | trim }}", trim_ws(text_of(c))), ("{{ content }}", text_of(c))):
        if hole in template:
            before, _, after = template.partition(hole)
            return F.concat(F.lit(before), value, F.lit(after))
    return F.lit(template)


def classify_answer(c: Column, variant: str = "profile") -> Column:
    """First matching answer type. ``inspect`` has no class for "none" and knows the degree sign instead of the word."""
    text = trim_ws(text_of(c))
    compact = F.replace(text, F.lit(" "), F.lit(""))
    has = lambda *parts: F.greatest(*[compact.contains(p) for p in (*parts, parts[0])])
    full = lambda pattern: compact.rlike(rf"(?U)\A(?:{pattern})\z")
    out = F.when(text == "", "empty")
    if variant == "profile":
        out = out.when(F.lower(compact).isin("none", "no solution", "undefined", "does not exist"), "none_or_no_solution")
    constants = ("\\pi", "pi", "^\\circ", "degree") if variant == "profile" else ("\\pi", "pi", "°", "^\\circ")
    return (out.when(full(r"[-+]?\d+"), "integer").when(full(r"[-+]?\d+\.\d+"), "decimal").when(full(r"[-+]?\d+/\d+"), "plain_fraction")
            .when(has("\\frac"), "latex_fraction").when(has("sqrt"), "sqrt_expression").when(has("^", "**"), "power_expression")
            .when(has(*constants), "symbolic_constant").when(compact.rlike("[a-zA-Z]"), "text_or_symbolic").otherwise("other_expression"))


def classify_topic(c: Column, normalized: Column | None = None) -> Column:
    """The topic with most hints in the text; the earlier one of equals; ``other`` without any. ``normalized``: the normalized text, where there is one already."""
    text = normalize_text(c) if normalized is None else normalized
    scored = [F.struct(sum([text.contains(p).cast("int") for p in hints], F.lit(0)).alias("hits"), F.lit(-k).alias("order"), F.lit(topic).alias("topic"))
              for k, (topic, hints) in enumerate(TOPICS)]
    none = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("order"), F.lit("other").alias("topic"))
    return F.array_max(F.array(*scored, none))["topic"]


def classify_difficulty(problem: Column, answer_type: Column, prompt_chars: Column, prompt_tokens: Column | None = None, normalized: Column | None = None) -> Column:
    """easy, medium or hard by length (tokens, where known) and complexity."""
    text = normalize_text(problem) if normalized is None else normalized
    length = F.coalesce(prompt_tokens, prompt_chars) if prompt_tokens is not None else prompt_chars
    words = F.greatest(*[text.contains(w) for w in COMPLEX_WORDS])
    # One array holds the number, so that the two tests below don't count it twice.
    complexity = F.array(F.regexp_count(text, F.lit(r"\\frac|sqrt|\\sqrt|\^")) + F.regexp_count(text_of(problem), F.lit(r"\$[^$]+\$"))
                         + answer_type.isin(*HARD_TYPES).cast("int") + words.cast("int"))
    grade = lambda n: F.when((length >= 900) | (n >= 5), "hard").when((length >= 500) | (n >= 3), "medium").otherwise("easy")
    return F.element_at(F.transform(complexity, grade), 1)


def verifier_risk_tags(answer: Column, prompt_chars: Column, max_prompt_length: int, prompt_tokens: Column | None = None,
                       answer_type: Column | None = None) -> Column:
    """What could mislead a verifier about this gold answer or prompt; ``[clean]`` if nothing. ``answer_type``: its class, where there is one already."""
    text = trim_ws(text_of(answer))
    lower = F.lower(F.replace(text, F.lit(" "), F.lit("")))
    kind = classify_answer(answer) if answer_type is None else answer_type
    known = prompt_tokens if prompt_tokens is not None else F.lit(None).cast("long")
    rules = (
        (text == "", "empty_gold_answer"),
        (lower.isin("none", "nosolution", "undefined", "doesnotexist"), "none_or_no_solution_gold"),
        (kind.isin("text_or_symbolic", "other_expression", "symbolic_constant"), "symbolic_or_text_gold"),
        (text.contains(",") | F.lower(text).contains(" or "), "possible_multi_answer"),
        (F.length(text) > 50, "long_gold_answer"),
        (text.contains("\\begin") | text.contains("\\left") | text.contains("\\right"), "complex_latex_gold"),
        (known > max_prompt_length, "over_max_prompt_tokens"),
        (known.isNull() & (prompt_chars > 4 * max_prompt_length), "possibly_overlong_prompt"),
    )
    tags = F.array_compact(F.array(*[F.when(test, tag) for test, tag in rules]))
    return F.when(F.size(tags) == 0, F.array(F.lit("clean"))).otherwise(tags)


def extract_gold(c: Column, mode: str = "auto") -> Column:
    """What follows the last ``####`` (modes ``auto`` and ``gsm8k``), stripped; else the stripped text."""
    if mode in ("auto", "gsm8k"):
        return trim_ws(F.element_at(F.split(text_of(c), "####", -1), -1))
    return trim_ws(text_of(c))


def extract_choice(c: Column) -> Column:
    """The first of the digits 0, 1 and 2 in the text, or nothing."""
    return F.regexp_extract(trim_ws(text_of(c)), "[012]", 0)


def whitespace_tokens(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(text_of(c), r"(?U)\s+", -1), lambda x: x != "")).cast("long")
