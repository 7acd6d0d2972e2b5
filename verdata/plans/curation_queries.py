"""Queries over ``examples``, ``messages`` and the plain tables: sources, preparation, profiling and curation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdata.functions import text as T
from verdata.operators import curate as C
from verdata.operators import prepare as P
from verdata.plans.fixtures import sequences, view, with_views
from verdata.plans.storage import shared_dir
from verdata.sources import files as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return fn
    return add


# The manifest's expressions in SQL, for texts whose white space is spaces and line ends only.
_NORM = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
_NP, _NA = _NORM.format(c="problem"), _NORM.format(c="answer")
_COMPACT = "replace(trim(answer), ' ', '')"


def _answer_sql(variant: str) -> str:
    none = f"WHEN lower({_COMPACT}) IN ('none', 'no solution', 'undefined', 'does not exist') THEN 'none_or_no_solution'" if variant == "profile" else ""
    last = f"contains({_COMPACT}, 'degree')" if variant == "profile" else f"contains({_COMPACT}, '°')"
    return f"""CASE WHEN trim(answer) = '' THEN 'empty' {none}
 WHEN regexp_full_match({_COMPACT}, '[-+]?\\d+') THEN 'integer' WHEN regexp_full_match({_COMPACT}, '[-+]?\\d+\\.\\d+') THEN 'decimal'
 WHEN regexp_full_match({_COMPACT}, '[-+]?\\d+/\\d+') THEN 'plain_fraction' WHEN contains({_COMPACT}, chr(92) || 'frac') THEN 'latex_fraction'
 WHEN contains({_COMPACT}, 'sqrt') THEN 'sqrt_expression' WHEN contains({_COMPACT}, '^') OR contains({_COMPACT}, '**') THEN 'power_expression'
 WHEN contains({_COMPACT}, 'pi') OR contains({_COMPACT}, '^' || chr(92) || 'circ') OR {last} THEN 'symbolic_constant'
 WHEN regexp_matches({_COMPACT}, '[a-zA-Z]') THEN 'text_or_symbolic' ELSE 'other_expression' END"""


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(np, '{w}') AS INT)" for w in words)


_TOPIC = "CASE " + " ".join(f"WHEN h{k} > 0 AND h{k} = greatest({', '.join(f'h{j}' for j in range(len(T.TOPICS)))}) THEN '{t}'" for k, (t, _) in enumerate(T.TOPICS)) + " ELSE 'other' END"
_MANIFEST = f"""
base AS (SELECT *, {_NP} AS np, {_NA} AS na, {_answer_sql('profile')} AS answer_type, CAST(length(problem) AS BIGINT) AS prompt_chars FROM examples),
hits AS (SELECT *, {', '.join(f'{_hits(w)} AS h{k}' for k, (_, w) in enumerate(T.TOPICS))},
 len(regexp_extract_all(np, '\\\\frac|sqrt|\\\\sqrt|\\^')) + len(regexp_extract_all(problem, '\\$[^$]+\\$')) + CAST(answer_type IN {T.HARD_TYPES} AS INT)
 + CAST({' OR '.join(f"contains(np, '{w}')" for w in T.COMPLEX_WORDS)} AS INT) AS complexity FROM base),
manifest AS (SELECT split, idx, answer, answer_type, prompt_chars, CAST(length(trim(answer)) AS BIGINT) AS answer_chars, left(sha1(np), 16) AS problem_hash,
 left(sha1(np || chr(10) || na), 16) AS pair_hash, {_TOPIC} AS topic, np,
 CASE WHEN prompt_chars >= 900 OR complexity >= 5 THEN 'hard' WHEN prompt_chars >= 500 OR complexity >= 3 THEN 'medium' ELSE 'easy' END AS difficulty,
 list_filter([CASE WHEN trim(answer) = '' THEN 'empty_gold_answer' END,
  CASE WHEN lower({_COMPACT}) IN ('none', 'nosolution', 'undefined', 'doesnotexist') THEN 'none_or_no_solution_gold' END,
  CASE WHEN answer_type IN ('text_or_symbolic', 'other_expression', 'symbolic_constant') THEN 'symbolic_or_text_gold' END,
  CASE WHEN contains(answer, ',') OR contains(lower(answer), ' or ') THEN 'possible_multi_answer' END,
  CASE WHEN length(trim(answer)) > 50 THEN 'long_gold_answer' END,
  CASE WHEN contains(answer, chr(92) || 'begin') OR contains(answer, chr(92) || 'left') OR contains(answer, chr(92) || 'right') THEN 'complex_latex_gold' END,
  CASE WHEN prompt_chars > 4 * 512 THEN 'possibly_overlong_prompt' END], lambda t: t IS NOT NULL) AS raw_tags FROM hits),
m AS (SELECT *, CASE WHEN len(raw_tags) = 0 THEN ['clean'] ELSE raw_tags END AS tags FROM manifest)
"""


def _m(sql: str) -> str:
    return with_views("", "examples").rstrip() + ", " + _MANIFEST.strip() + " " + sql


def _manifest(spark, sf_dir):
    return C.build_manifest(view(spark, sf_dir, "examples"))


def _tags():
    return F.array_join("tags", ",").alias("tags")


@query("entry_profile", _m("SELECT split, tag, count(*) AS n, round(any_value(rate), 6) AS verifier_ready_rate FROM (SELECT split, unnest(tags) AS tag, avg(CAST(list_contains(tags, 'clean') AS DOUBLE)) OVER (PARTITION BY split) AS rate FROM m) GROUP BY split, tag"))
def entry_profile(spark, sf_dir):
    out = C.risk_distribution(_manifest(spark, sf_dir))
    return out.withColumn("verifier_ready_rate", F.round("verifier_ready_rate", 6))


@query("a1_load_examples", "SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS n_chars, 'train' AS split FROM documents")
def a1(spark, sf_dir):
    return S.load_examples(spark, f"{sf_dir}/documents.parquet@train").select("doc_id", "lang", "n_chars", "split")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/sources/{uuid.uuid4().hex}"


_KEPT = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


@query("a2_read_jsonl", _KEPT)
def a2(spark, sf_dir):
    """All documents as JSON lines, among blank and malformed lines."""
    at, docs = _folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    line = F.to_json(F.struct(*docs.columns))
    broken = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""), F.substring(line, 1, 12), line)).otherwise(F.array(line))
    docs.select(F.explode(broken).alias("value")).write.text(at)
    return S.read_jsonl(spark, at, docs.schema, strict=False).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("a3_write_jsonl", "SELECT doc_id, md5(text) AS text_md5, CAST(3 AS BIGINT) AS n_keys FROM documents")
def a3(spark, sf_dir):
    """Each line read as plain text again: it holds all keys, nulls too."""
    at = _folder(spark)
    S.write_jsonl(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), at)
    line = F.col("value")
    return spark.read.text(at).select(F.get_json_object(line, "$.doc_id").cast("long").alias("doc_id"), F.md5(F.get_json_object(line, "$.text")).alias("text_md5"), F.size(F.json_object_keys(line)).cast("long").alias("n_keys"))


@query("a4_named_runs", "SELECT 'even' AS run, count(*) FILTER (doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 'odd', count(*) FILTER (doc_id % 2 = 1) FROM documents UNION ALL SELECT 'missing', 0")
def a4(spark, sf_dir):
    at, docs = _folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    for k, name in enumerate(("even", "odd")):
        S.write_jsonl(docs.where(F.col("doc_id") % 2 == k), f"{at}/{name}")
    return S.read_runs(spark, {n: f"{at}/{n}" for n in ("even", "odd", "missing")}, docs.schema)[1].select("run", "n")


@query("a5_report_files", "SELECT coalesce(lang, 'none') AS run, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY coalesce(lang, 'none')")
def a5(spark, sf_dir):
    """A report of each language in a folder of its own, among unreadable ones, found by a pattern."""
    at = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    docs.write.partitionBy("lang").json(at)
    docs.select("lang", F.lit("{\"n\": ").alias("value")).write.mode("append").partitionBy("lang").option("compression", "none").text(f"{at}/broken")
    reports = S.read_reports(spark, [f"{at}/lang=*/*", f"{at}/broken/lang=*/*"], "n long, mean_chars double")
    return reports.select(F.regexp_extract("source_file", "lang=([^/]+)/", 1).alias("run"), "n", F.round("mean_chars", 6).alias("mean_chars"))


@query("a6_row_id", "SELECT doc_id, printf('train-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS row_id FROM documents")
def a6(spark, sf_dir):
    return S.with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), ["doc_id"], "train").select("doc_id", "row_id")


# Files of consecutive ids: file order is the order of the ids.
@query("a6_file_row_id", "SELECT doc_id, printf('train-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS row_id FROM documents")
def a6f(spark, sf_dir):
    at = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.json(at)
    return S.with_file_row_id(spark.read.schema("doc_id long, text string").json(at), "train").select("doc_id", "row_id")


@query("b1_render_prompt", "SELECT idx, md5('Solve: ' || trim(problem, ' ' || chr(10)) || ' End') AS prompt_md5 FROM examples", "examples")
def b1(spark, sf_dir):
    return view(spark, sf_dir, "examples").select("idx", F.md5(T.render_prompt(F.col("problem"), "Solve: {{ content | trim }} End")).alias("prompt_md5"))


@query("b2_build_messages", """SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, 'image' AS type, CAST(NULL AS VARCHAR) AS text FROM messages WHERE turn % 3 = 0
UNION ALL SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END, 'text', replace(prompt, '<image>', '') FROM messages WHERE replace(prompt, '<image>', '') <> ''""", "messages")
def b2(spark, sf_dir):
    rows = P.build_messages(view(spark, sf_dir, "messages"), "prompt").select("conv_id", "turn", F.posexplode("content").alias("part", "c"))
    return rows.select("conv_id", "turn", F.col("part").cast("long").alias("part"), "c.type", "c.text")


@query("b2_mixed_media", """SELECT conv_id, turn, CAST(p AS BIGINT) AS part, type, CASE WHEN type <> 'text' THEN NULL WHEN conv_id % 3 = 0 AND p = 0 THEN 'see ' WHEN conv_id % 3 = 0 THEN ' and ' || text ELSE text END AS text
FROM (SELECT *, unnest(CASE conv_id % 3 WHEN 0 THEN ['text', 'image', 'text', 'video'] WHEN 1 THEN ['video', 'image', 'text'] ELSE ['text'] END) AS type, unnest(CASE conv_id % 3 WHEN 0 THEN [0, 1, 2, 3] WHEN 1 THEN [0, 1, 2] ELSE [0] END) AS p FROM conversations)
WHERE text IS NOT NULL AND (type <> 'text' OR text <> '' OR conv_id % 3 = 0)""")
def b2m(spark, sf_dir):
    prompt = F.expr("CASE conv_id % 3 WHEN 0 THEN concat('see <image> and ', text, '<video>') WHEN 1 THEN concat('<video><image>', text) ELSE text END")
    rows = P.build_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", prompt.alias("prompt")), "prompt").select("conv_id", "turn", F.posexplode("content").alias("part", "c"))
    return rows.select("conv_id", "turn", F.col("part").cast("long").alias("part"), "c.type", "c.text")


@query("b3_filter_overlong", "SELECT idx, CAST(len(list_filter(regexp_split_to_array(problem, '\\s+'), lambda x: x <> '')) AS BIGINT) AS prompt_tokens FROM examples WHERE len(list_filter(regexp_split_to_array(problem, '\\s+'), lambda x: x <> '')) <= 200", "examples")
def b3(spark, sf_dir):
    return P.filter_overlong(view(spark, sf_dir, "examples"), "problem", 200).select("idx", "prompt_tokens")


@query("b4_pad_or_truncate", """SELECT seq_id, CAST(sum(CASE WHEN pos < n THEN pos + 1 ELSE 0 END) FILTER (pos < 32) AS BIGINT) AS right_sum, CAST(sum(CASE WHEN pos < n AND pos >= n - 32 THEN pos + 1 ELSE 0 END) AS BIGINT) AS left_sum, CAST(32 AS BIGINT) AS size
FROM (SELECT seq_id, pos, 8 + seq_id % 57 AS n FROM tokens) GROUP BY seq_id""", "tokens")
def b4(spark, sf_dir):
    s = sequences(spark, sf_dir).select("seq_id", F.expr("transform(sequence(1, int(n_tokens)), v -> bigint(v))").alias("ids"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    right, left = (P.pad_or_truncate(F.col("ids"), 32, F.lit(0).cast("long"), "left", t) for t in ("right", "left"))
    return s.select("seq_id", total(right).alias("right_sum"), total(left).alias("left_sum"), F.size(right).cast("long").alias("size"))


@query("b5_response_mask", """SELECT seq_id, CAST(sum(CASE WHEN first IS NULL OR pos <= first THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM (SELECT seq_id, pos, min(CASE WHEN (pos * 7 + seq_id) % 23 IN (3, 5) THEN pos END) OVER (PARTITION BY seq_id) AS first FROM tokens) GROUP BY seq_id""", "tokens")
def b5(spark, sf_dir):
    ids = F.expr("transform(x, (v, i) -> bigint((i * 7 + seq_id) % 23))")
    mask = P.response_mask(F.col("ids"), (3, 5))
    return sequences(spark, sf_dir).withColumn("ids", ids).select("seq_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


@query("b6_position_ids", """SELECT seq_id, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS positions FROM (SELECT seq_id, sum(CASE WHEN pos >= seq_id % 57 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS c FROM tokens) GROUP BY seq_id""", "tokens")
def b6(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("m", F.expr("transform(x, (v, i) -> CASE WHEN i >= seq_id % 57 THEN 1 ELSE 0 END)"))
    return s.select("seq_id", F.aggregate(P.position_ids(F.col("m")), F.lit(0).cast("long"), lambda a, x: a + x).alias("positions"))


@query("b7_extract_gold", "SELECT idx, CASE WHEN idx % 2 = 0 THEN answer ELSE CAST(idx AS VARCHAR) END AS gold FROM (SELECT idx, trim(answer) AS answer FROM examples)", "examples")
def b7(spark, sf_dir):
    e = view(spark, sf_dir, "examples").withColumn("answer", F.expr("CASE WHEN idx % 2 = 0 THEN answer ELSE concat(problem, ' #### ', answer, '#### ', idx, ' ') END"))
    return P.coalesce_gold(e).select("idx", T.extract_gold(F.col("gold")).alias("gold"))


@query("b8_assign_batches", """SELECT idx, CAST(floor(p / 32) AS BIGINT) AS batch FROM (SELECT idx, row_number() OVER (ORDER BY md5('1|' || CAST(idx AS VARCHAR)), idx) - 1 AS p, count(*) OVER () AS n FROM examples) WHERE floor(p / 32) < floor(n / 32)""", "examples")
def b8(spark, sf_dir):
    return P.assign_batches(view(spark, sf_dir, "examples").select("idx"), "idx", 32, seed=1).select("idx", "batch")


@query("b9_collate", "SELECT batch, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS ids, string_agg(split, ',' ORDER BY idx) AS splits FROM (SELECT idx, split, CAST(floor(idx / 16) AS BIGINT) AS batch FROM examples) GROUP BY batch", "examples")
def b9(spark, sf_dir):
    e = view(spark, sf_dir, "examples").withColumn("batch", F.expr("bigint(floor(idx / 16))"))
    out = P.collate(e.select("batch", "idx", "split"), "batch", "idx", ["split"])
    ids = P.collate(e.select("batch", "idx", F.col("idx").alias("i")), "batch", "idx", ["i"])
    return ids.join(out, "batch").select("batch", F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"), F.array_join("split", ",").alias("splits"))


@query("c1_normalize_text", f"SELECT idx, md5({_NP}) AS norm_md5 FROM examples", "examples")
def c1(spark, sf_dir):
    return view(spark, sf_dir, "examples").select("idx", F.md5(T.normalize_text(F.col("problem"))).alias("norm_md5"))


@query("c2_stable_hash", _m("SELECT idx, problem_hash, pair_hash FROM m"))
def c2(spark, sf_dir):
    return _manifest(spark, sf_dir).select("idx", "problem_hash", "pair_hash")


@query("c3_classify_answer", f"SELECT idx, {_answer_sql('profile')} AS profile, {_answer_sql('inspect')} AS inspect FROM examples", "examples")
def c3(spark, sf_dir):
    a = F.col("answer")
    return view(spark, sf_dir, "examples").select("idx", T.classify_answer(a).alias("profile"), T.classify_answer(a, "inspect").alias("inspect"))


@query("c4_classify_topic", _m("SELECT idx, topic FROM m"))
def c4(spark, sf_dir):
    return _manifest(spark, sf_dir).select("idx", "topic")


@query("c5_classify_difficulty", _m("SELECT idx, difficulty FROM m"))
def c5(spark, sf_dir):
    return _manifest(spark, sf_dir).select("idx", "difficulty")


@query("c6_verifier_risk_tags", _m("SELECT idx, array_to_string(tags, ',') AS tags FROM m"))
def c6(spark, sf_dir):
    return _manifest(spark, sf_dir).select("idx", _tags())


@query("e1_manifest", _m("SELECT split, idx, problem_hash, pair_hash, topic, difficulty, answer_type, prompt_chars, answer_chars, array_to_string(tags, ',') AS tags FROM m"))
def e1(spark, sf_dir):
    return _manifest(spark, sf_dir).select("split", "idx", "problem_hash", "pair_hash", "topic", "difficulty", "answer_type", "prompt_chars", "answer_chars", _tags())


@query("e2_distributions", _m(" UNION ALL ".join(f"SELECT split, '{f}' AS field, {f} AS value, count(*) AS n FROM m GROUP BY split, {f}" for f in ("topic", "difficulty", "answer_type"))))
def e2(spark, sf_dir):
    return C.distributions(_manifest(spark, sf_dir))


# A shorter limit than the profile's, at which many prompts may be too long.
@query("e3_risk_distribution", ORACLE["entry_profile"].replace("4 * 512", "4 * 64"))
def e3(spark, sf_dir):
    out = C.risk_distribution(C.build_manifest(view(spark, sf_dir, "examples"), max_prompt_length=64))
    return out.withColumn("verifier_ready_rate", F.round("verifier_ready_rate", 6))


@query("e4_length_stats", _m("SELECT split, count(*) AS n, min(prompt_chars) AS min, round(quantile_cont(prompt_chars, 0.5), 6) AS p50, round(quantile_cont(prompt_chars, 0.9), 6) AS p90, round(quantile_cont(prompt_chars, 0.95), 6) AS p95, round(quantile_cont(prompt_chars, 0.99), 6) AS p99, max(prompt_chars) AS max, round(avg(prompt_chars), 6) AS mean, count(*) FILTER (prompt_chars > 2048) AS n_over FROM m GROUP BY split"))
def e4(spark, sf_dir):
    out = C.length_stats(_manifest(spark, sf_dir), "prompt_chars", "split", 2048)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p95", "p99", "mean")})


_E = "round(quantile_cont(l_extendedprice * (1 - l_discount), {}), 6)"


@query("e4_exact_quantiles", f"SELECT mode, count(*) AS n, {_E.format(0.5)} AS p50, {_E.format(0.9)} AS p90, {_E.format(0.95)} AS p95, {_E.format(0.99)} AS p99 FROM (SELECT l_linestatus AS mode, l_extendedprice, l_discount FROM lineitem) x GROUP BY mode")
def e4q(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linestatus").alias("mode"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("x"))
    out = C.length_stats(rows, "x", "mode")
    return out.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


@query("e5_field_checks", f"SELECT split, count(*) AS n, count(*) FILTER (problem IS NULL) AS missing_prompt, count(*) FILTER (answer IS NULL) AS missing_answer, count(*) FILTER ({_NP} = '') AS empty_prompt, count(*) FILTER ({_NA} = '') AS empty_answer FROM examples GROUP BY split", "examples")
def e5(spark, sf_dir):
    return C.field_checks(view(spark, sf_dir, "examples"))


def _dups(c: str) -> str:
    return f"SELECT split, CAST(sum(n - 1) AS BIGINT) AS d FROM (SELECT split, {c}, count(*) AS n FROM m GROUP BY split, {c} HAVING count(*) > 1) GROUP BY split"


@query("e6_duplicate_summary", _m(f"SELECT s.split, coalesce(p.d, 0) AS duplicate_problem_rows, coalesce(q.d, 0) AS duplicate_pair_rows FROM (SELECT DISTINCT split FROM m) s LEFT JOIN ({_dups('problem_hash')}) p ON s.split = p.split LEFT JOIN ({_dups('pair_hash')}) q ON s.split = q.split"))
def e6(spark, sf_dir):
    return C.duplicate_summary(_manifest(spark, sf_dir))


@query("e6_duplicate_examples", _m("SELECT split, problem_hash AS hash, count(*) AS n FROM m GROUP BY split, problem_hash HAVING count(*) > 1 ORDER BY n DESC, hash, split LIMIT 20"))
def e6x(spark, sf_dir):
    return C.duplicate_examples(_manifest(spark, sf_dir))


def _sides(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return m.where("split = 'train'"), m.where("split = 'test'")


_SHARED = "(SELECT problem_hash FROM m WHERE split = 'train' INTERSECT SELECT problem_hash FROM m WHERE split = 'test')"


@query("e7_leakage", _m(f"SELECT (SELECT count(DISTINCT problem_hash) FROM m WHERE split = 'train') AS train_distinct, (SELECT count(DISTINCT problem_hash) FROM m WHERE split = 'test') AS val_distinct, (SELECT count(*) FROM {_SHARED} x) AS overlap"))
def e7(spark, sf_dir):
    return C.leakage(*_sides(spark, sf_dir))


@query("e7_overlap_sample", _m(f"SELECT problem_hash FROM {_SHARED} x ORDER BY problem_hash LIMIT 50"))
def e7s(spark, sf_dir):
    return C.overlap_sample(*_sides(spark, sf_dir))


@query("e8_leakage_examples", _m(f"SELECT problem_hash, min(idx) AS idx, arg_min(answer, idx) AS answer FROM m WHERE split = 'test' AND problem_hash IN (SELECT problem_hash FROM m WHERE split = 'train') GROUP BY problem_hash ORDER BY problem_hash LIMIT 20"))
def e8(spark, sf_dir):
    return C.leakage_examples(*_sides(spark, sf_dir))


@query("e9_clean_split", _m("SELECT idx, tags = ['clean'] AS strict, NOT list_has_any(tags, ['empty_gold_answer', 'long_gold_answer']) AS lenient FROM m"))
def e9(spark, sf_dir):
    m = C.clean_split(_manifest(spark, sf_dir)).withColumnRenamed("kept", "strict")
    return C.clean_split(m, "drop_high_risk", ("empty_gold_answer", "long_gold_answer")).select("idx", "strict", F.col("kept").alias("lenient"))


@query("e10_clean_report", _m("SELECT split, count(*) AS original_rows, count(*) FILTER (tags = ['clean']) AS kept_rows, count(*) FILTER (tags <> ['clean']) AS dropped_rows, round(avg(CAST(tags = ['clean'] AS DOUBLE)), 6) AS keep_rate FROM m GROUP BY split"))
def e10(spark, sf_dir):
    return C.clean_report(C.clean_split(_manifest(spark, sf_dir))).withColumn("keep_rate", F.round("keep_rate", 6))


@query("e10_dropped_counts", _m("SELECT split, 'risk' AS field, tag AS value, count(*) AS n FROM (SELECT split, unnest(tags) AS tag FROM m WHERE tags <> ['clean']) GROUP BY split, tag UNION ALL SELECT split, 'answer_type', answer_type, count(*) FROM m WHERE tags <> ['clean'] GROUP BY split, answer_type"))
def e10d(spark, sf_dir):
    return C.dropped_counts(C.clean_split(_manifest(spark, sf_dir)))


@query("e11_stratified_sample", _m("SELECT bucket, idx FROM (SELECT bucket, idx, row_number() OVER (PARTITION BY bucket ORDER BY md5('3|' || CAST(idx AS VARCHAR)), idx) AS p FROM (SELECT idx, unnest(list_concat(['topic:' || topic, 'difficulty:' || difficulty], list_transform(list_filter(tags, lambda t: t <> 'clean'), lambda t: 'risk:' || t))) AS bucket FROM m)) WHERE p <= 5"))
def e11(spark, sf_dir):
    return C.stratified_sample(_manifest(spark, sf_dir), 5, 3).select("bucket", "idx")


@query("e12_sample_rows", "SELECT idx FROM examples ORDER BY md5('5|' || CAST(idx AS VARCHAR)), idx LIMIT 50", "examples")
def e12(spark, sf_dir):
    return C.sample_rows(view(spark, sf_dir, "examples").select("idx"), 50, 5)


@query("e13_eval_subset", _m("SELECT idx, topic, difficulty FROM m WHERE split = 'test' ORDER BY idx LIMIT 20"))
def e13(spark, sf_dir):
    return C.eval_subset(_sides(spark, sf_dir)[1], 20).select("idx", "topic", "difficulty")
