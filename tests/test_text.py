import random
import re

from pyspark.sql import functions as F

from verdata.functions import answers as A
from verdata.functions import text as T
from verdata.operators import rewards as R
from verdata.plans.fixtures import view


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("o")).orderBy("i").select("o").collect()]


def test_normalize_and_strip(spark):
    assert column(spark, ["  A  b\n\tC ", None, ""], T.normalize_text) == ["a b c", "", ""]
    assert column(spark, ["  x \n"], T.trim_ws) == ["x"]


def test_classify_answer(spark):
    got = column(spark, ["", " none ", "no solution", "+12", "-1.5", "3/4", "\\frac{1}{2}", "2sqrt3", "x^2", "2\\pi", "spin", "yes", "(1)", "9^\\circ"], T.classify_answer)
    assert got == ["empty", "none_or_no_solution", "text_or_symbolic", "integer", "decimal", "plain_fraction", "latex_fraction", "sqrt_expression", "power_expression", "symbolic_constant",
                   "symbolic_constant", "text_or_symbolic", "other_expression", "power_expression"]
    assert column(spark, ["none", "90°", "90 degree"], lambda c: T.classify_answer(c, "inspect")) == ["text_or_symbolic", "symbolic_constant", "text_or_symbolic"]


def test_topic_ties_and_difficulty(spark):
    assert column(spark, ["determine it", "the probability", "xyz", "prime triangle"], T.classify_topic) == ["sequence", "combinatorics", "other", "geometry"]
    df = spark.createDataFrame([("$a$ $b$ prove \\frac \\frac", "integer", 10), ("x", "integer", 900), ("x", "integer", 500), ("x", "integer", 1)], "p string, t string, n int")
    assert [r[0] for r in df.select(T.classify_difficulty(F.col("p"), F.col("t"), F.col("n"))).collect()] == ["hard", "hard", "medium", "easy"]


def test_risk_tags(spark):
    got = column(spark, ["12", "", "no solution", "1 or 2", "\\left(1\\right)"], lambda c: T.verifier_risk_tags(c, F.lit(10), 512))
    assert got == [["clean"], ["empty_gold_answer"], ["none_or_no_solution_gold", "symbolic_or_text_gold"], ["symbolic_or_text_gold", "possible_multi_answer"], ["symbolic_or_text_gold", "complex_latex_gold"]]


def test_gold_and_choice(spark):
    assert column(spark, ["a #### b #### 42 ", "7", None], T.extract_gold) == ["42", "7", ""]
    assert column(spark, ["0", "The answer is 1", "I don't know", ""], T.extract_choice) == ["0", "1", "", ""]


def test_boxed_and_cuts(spark):
    assert column(spark, ["Try \\boxed{12}. Final answer is \\boxed{\\frac{3}{4}}.", "\\boxed{1} \\boxed{2", "\\boxed x {3}", "none", None], A.extract_boxed) == ["\\frac{3}{4}", "1", "3", "", ""]
    assert column(spark, ["<think>done</think> The answer is \\boxed{42}. Extra unfinished reasoning"], lambda c: A.postprocess_generation(c, stop_after_boxed=True))[0].endswith("\\boxed{42}")
    assert column(spark, ["Reasoning complete.\nAssistant: let me continue", "plain"], lambda c: A.postprocess_generation(c, cut_turn_markers=True)) == ["Reasoning complete.", "plain"]


def test_format_and_equality(spark):
    assert column(spark, ["<think>a</think> so \\boxed{1}.", "< think >a< / think >\\boxed{1}", "x <think>a</think>\\boxed{1}", "<think>a"], A.format_reward) == [1.0, 1.0, 0.0, 0.0]
    pairs = [("", "", True), ("1.0", "1", True), (" A  b", "a B", True), ("1d", "1", False), ("1000000001", "1000000000", True), ("1.1", "1", False), ("x", "y", False)]
    df = spark.createDataFrame(pairs, "a string, b string, e boolean")
    assert [r[0] for r in df.select(A.answer_equal(F.col("a"), F.col("b"))).collect()] == [e for *_, e in pairs]


def plain_groups(t):
    """Contents and ends of boxes, character by character."""
    out, at = [], 0
    while True:
        start = t.find("\\boxed", at)
        brace = t.find("{", start + 6) if start >= 0 else -1
        if brace < 0:
            return out
        depth, end = 0, None
        for i in range(brace, len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if depth == 0:
                end = i
                break
        if end is None:
            return out
        out.append((t[brace + 1:end].strip(), start, end + 1))
        at = end + 1


def plain_boxed(t):
    t = t or ""
    if found := plain_groups(t):
        return found[-1][0]
    flat = re.findall(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", t)
    return flat[-1].strip() if flat else ""


def plain_relaxed(t):
    t = (t or "").strip()
    t = t.replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("$", "")
    t = re.sub(r"\\(?:left|right)\s*", "", t)
    t = re.sub(r"\\(?:text|mbox|mathrm)\{([^{}]*)\}", r"\1", t)
    for x in ("\\,", "\\!", "\\;", "\\:"):
        t = t.replace(x, "")
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    t = re.sub(r"\^\{?\\circ\}?", "", re.sub(r"_\{([^{}]+)\}", r"_\1", t)).replace("°", "").replace("\\%", "%")
    units = "degrees?|degree|cm|mm|km|m|meters?|inches?|inch|feet|foot|ft|seconds?|minutes?|hours?|dollars?|cents?|units?"
    t = re.sub(rf"(?i)\b(?:{units})\b(?:\s*\^\{{?\d+\}}?)?", "", t).replace("%", "").strip()
    return re.sub(r"\s+", "", re.sub(r"^\{(.+)\}$", r"\1", t).lower())


def plain_close(a, b):
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    if not (re.fullmatch(number, a) and re.fullmatch(number, b)):
        return False
    x, y = float(a), float(b)
    return abs(x - y) <= max(1e-9 * max(abs(x), abs(y)), 1e-9)


def plain_strict(a, b):
    a, b = (re.sub(r"\s+", " ", (t or "").strip()).lower() for t in (a, b))
    return a == b or plain_close(a, b)


def plain_equal(a, b):
    x, y = plain_relaxed(a), plain_relaxed(b)
    return plain_strict(a, b) or (x != "" and x == y) or plain_close(x, y)


def plain_robust(t, gold):
    t = t or ""
    if box := plain_boxed(t):
        return box
    base = max(0, len(t) - 1800)
    spans = [(c, a, b) for c, a, b in plain_groups(t)]
    for p in (r"\\begin\{pmatrix\}.*?\\end\{pmatrix\}", r"-?\\(?:dfrac|tfrac|frac)\{[^{}\n]{1,80}\}\{[^{}\n]{1,80}\}", r"-?\\sqrt\{[^{}\n]{1,80}\}", r"\([^()\n]{1,80}\)",
              r"-?\d+(?:\.\d+)?_\{?\d+\}?", r"-?\d+(?:\.\d+)?(?:\s*(?:\\%|%|\\circ|°|degrees?))?"):
        spans += [(m.group().strip(), base + m.start(), base + m.end()) for m in re.finditer(p, t[base:], re.DOTALL)]
    for c, a, b in reversed(spans):
        around = t[max(0, a - 260):b + 260].lower()
        cue = any(x in around for x in ("answer", "final", "therefore", "thus", "hence", "so", "equals", "is", "=", "\\boxed"))
        if (b >= len(t) - 220 or cue) and plain_equal(c, gold):
            return c.strip()
    return ""


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["\\boxed", "\\boxed{", "{", "}", "}}", "\\", "\\frac{1}{2}", "-\\dfrac{3}{4}", "x+y", " so ", " é😀", "3", "-12.5", "7 \\%", "\\sqrt{2}", "(1, 2)", "2_{10}", "\\begin{pmatrix} 1 \\end{pmatrix}", "\n", "\x1c ", "word " * 30, "is = ", "45°", "10 degrees", "\\text{yes}"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_boxes_against_a_plain_scan(spark):
    texts = random_texts(600, 1) + ["\\boxed{" * 300 + "}" * 300, "\\boxed{a" + "{b}" * 20_000 + "}", "\\boxed{ \\boxed{3}", "\\\\boxed{4}", "x" * 200_000 + "\\boxed{ q }" + "y" * 100_000, "\\boxed{\x1c z \x1f}"]
    assert column(spark, texts, A.extract_boxed) == [plain_boxed(t) for t in texts]
    cut = lambda t: t[:found[-1][2]].rstrip() if (found := plain_groups(t)) else t
    assert column(spark, texts, lambda c: A.postprocess_generation(c, stop_after_boxed=True)) == [cut(t) for t in texts]
    assert sum(t != cut(t) for t in texts) > 100


def test_relaxed_forms_against_a_plain_version(spark):
    texts = ["\\dfrac{1}{2}", "$1,234$ cm^2", "90^{\\circ}", "\\text{yes} ", "{x}", "5 \\%", "x_{10}", "\\left( 1, 2 \\right)", "3 meters", "12,5", "100°", "{a}\n", "1,2345", "7 Inches^{2}", "\\mathrm{k m}m", "12 m", "a\\;b"] + random_texts(300, 2)
    assert column(spark, texts, A.relaxed_normalize) == [plain_relaxed(t) for t in texts]
    assert plain_relaxed("$1,234$ cm^2") == "1234" and plain_relaxed("\\dfrac{1}{2}") == "\\frac{1}{2}"


def test_robust_answer(spark):
    rows = [("so it is 3/4 or \\frac{3}{4} in all", "\\frac{3}{4}"), ("\\boxed{5} then 6", "6"), ("nothing here", "6"), ("so \\boxed{x+y}, that is \\boxed{}", "x+y"), ("", ""), (None, None), ("\\boxed{}", ""), ("the answer is 7", "7"),
            ("is 5 %", "5"), ("5" + " word" * 800, "5"), ("is \\boxed{1} \\boxed{2} \\boxed{ }", "1"), ("3 " + "x" * 400 + " 4 " + "y" * 500, "4"), ("45°", "45"), ("= 1,234 or (3, 4)", "(3,4)")]
    golds = ["1/2", "\\frac{1}{2}", "3", "x+y", "-12.5", "7", "(1,2)", "2_10", "45", "yes", ""]
    rng = random.Random(3)
    rows += [(t, rng.choice(golds)) for t in random_texts(500, 4)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "i int, t string, g string")
    got = [tuple(r) for r in df.orderBy("i").select(A.robust_answer(F.col("t"), F.col("g")), A.robust_answer(F.col("t"), F.col("g"), A.extract_boxed(F.col("t")))).collect()]
    want = [plain_robust(t, g) for t, g in rows]
    assert [r[0] for r in got] == want and [r[1] for r in got] == want
    assert want[3] == "x+y" and sum(w != "" and plain_boxed(t) == "" for w, (t, _) in zip(want, rows)) > 30


def test_diagnostics_of_all_responses(spark):
    """Every column of every response against a plain version; no Python worker."""
    df = view(spark, "/root/testdata/sf0.001", "responses").select("case_id", "response", "response_length", "gold")
    extra = [(10_000 + i, t, len(t), g) for i, (t, g) in enumerate(zip(random_texts(150, 5), ["3", "x+y", "\\frac{1}{2}"] * 50))]
    df = df.unionByName(spark.createDataFrame(extra + [(20_000, None, None, None), (20_001, "User: x", 127, "")], df.schema))
    out = R.diagnose(df, 128)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    marker = re.compile(r"(?:^|\n|(?<=[\]\)\}]))\s*(?:Human|Assistant|User|System)\s*:", re.I)
    form = re.compile(r"<think>.*</think>.*\\boxed\{.*\}.*", re.DOTALL)
    seen = set()
    for r in out.collect():
        t, gold = r["response"] or "", r["gold"] or ""
        box, robust = plain_boxed(t), plain_robust(t, gold)
        v = {"accuracy": plain_strict(box, gold), "format_rate": bool(form.fullmatch(re.sub(r"\s*(<|>|/)\s*", r"\1", t))), "robust_accuracy": robust != "" and plain_equal(robust, gold),
             "answer_extractable": 0 < len(box) <= 100, "robust_answer_extractable": 0 < len(robust) <= 120, "hit_length_cap": (r["response_length"] or 0) >= 127, "unclosed_think": "<think>" in t and "</think>" not in t,
             "missing_boxed_answer": box == "", "prompt_contamination": bool(marker.search(t)), "repetition": repeats_badly(t)}
        v["truncation"] = v["hit_length_cap"] or v["unclosed_think"]
        v["invalid_output_penalty"] = v["truncation"] or v["repetition"] or v["prompt_contamination"]
        v |= {"extract_failure": not v["answer_extractable"], "robust_extract_failure": not v["robust_answer_extractable"], "verifier_false_negative_candidate": not v["accuracy"] and v["robust_accuracy"]}
        v["train_reward_v1"] = 0.9 * v["accuracy"] + 0.1 * v["format_rate"]
        v["diagnostic_score_v2_lite"] = 0.85 * v["accuracy"] + 0.1 * v["format_rate"] + 0.05 * v["answer_extractable"] - 0.1 * v["invalid_output_penalty"]
        assert set(v) == set(R.DIAGNOSTICS)
        assert {k: round(float(x), 9) for k, x in v.items()} == {k: round(r[k], 9) for k in v} and (r["boxed_answer"], r["robust_answer"]) == (box, robust)
        seen |= {(k, bool(x)) for k, x in v.items()}
    assert len(seen) == 34  # every flag was seen both ways


def test_final_answer(spark):
    got = column(spark, ["x = 5", "\\boxed{\\frac12}", "1,234", "the $7$ dollars", "12\\text{cm}", "\\sqrt2"], A.normalize_final_answer)
    assert got == ["5", "\\frac{1}{2}", "1234", "7", "12", "\\sqrt{2}"]


def repeats_badly(text, n=4, threshold=0.34):
    words = text.split()
    if len(words) < 3 * n:
        return False
    grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    lines = [x.strip() for x in text.splitlines() if len(x.strip()) >= 12]
    return 1 - len(set(grams)) / len(grams) >= threshold or any(lines.count(x) >= 3 for x in lines)


def test_repetition(spark):
    assert repeats_badly("a b c d " * 6) and not repeats_badly("a b c d " * 2)
    assert repeats_badly("this is a long line\n" * 3 + " ".join(map(str, range(60))))
    assert not repeats_badly(" ".join(map(str, range(40))))
    rng = random.Random(4)
    texts = ["", "a", "a b c d " * 6, "a b c d " * 2, "this is a long line\n" * 3 + " ".join(map(str, range(60))), " ".join(map(str, range(40))), "\u2003wide\x1cline of words\x85wide\x1cline of words\r\n" * 3 + "x " * 3]
    texts += ["".join(rng.choice("ab cd é\n\t\r\x0b\x1d\u2028\u00a0") for _ in range(rng.randrange(120))) for _ in range(200)]
    texts += ["\r".join(rng.choice(["a line of some words", " a line of some words ", "short", "another line " + str(rng.random())]) for _ in range(rng.randrange(12))) + " 1 2 3 4 5 6 7 8 9 10 11 12" for _ in range(60)]
    assert column(spark, texts, A.severe_repetition) == [repeats_badly(t) for t in texts]
    assert len({repeats_badly(t) for t in texts}) == 2 and column(spark, [None], A.severe_repetition) == [False]


def test_normalize_any_white_space(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB é  \n\t\r\x0b\x85\xa0   　") for _ in range(rng.randrange(40))) for _ in range(300)]
    assert column(spark, texts, T.normalize_text) == [" ".join(t.split()).lower() for t in texts]
