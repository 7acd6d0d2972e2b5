"""Thin queries over the given tables, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdata.llm import archives, licenses, lines, nearduplicates, negatives, neighbours, packing, private, quality, repair, repeats, segment, sharding
from verdata.sources.files import read_spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.TEMPLATES + licenses.SHORT, required=licenses.REQUIRED + licenses.SHORT_REQUIRED, ordered=0.8).drop("blocks")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.near_duplicates(_table(spark, sf_dir, "documents")).drop("row")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read_spread(spark, f"{sf_dir}/documents.parquet"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(read_spread(spark, f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "id")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind, _ in private.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_recurring_lines(read_spread(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_tokens=1, similarity=0.75)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment.sample_segmentations(read_spread(spark, f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), k=2, seed=1, digest=True)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damage(_table(spark, sf_dir, "conversations")), lost="lost")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_table(spark, sf_dir, "pages"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring, op2_packing, op3_licenses, op4_neighbours, op5_sharding, op6_minhash, op7_quality, op8_pii, op9_lines, op10_segmentations, op11_conversations, op12_warc, op13_negatives, pipeline)}


#: Lines whose template (tokens with a digit as <*>), or a merged template of the tree, is in 4 texts or more go, but from the first document.
#: once: templates by text. able: those with a piece that recurs. s1 to s3: how often a leading token stands below its path; s4: a token at a position of the leaf.
#: kept: tokens that stay, ``loose`` where others stand there too. v: merged templates, with all tokens that stay or one loose one less.
OP9 = """
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS h, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, h, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM d),
t AS (SELECT *, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l),
j AS (SELECT doc_id, h, k, line, toks, len(toks) AS n, array_to_string(toks, ' ') AS tpl FROM t),
once AS (SELECT tpl, toks, n, least(4, CAST(floor(n * 0.25 + 1e-9) AS BIGINT)) AS f, h, min(doc_id) AS first FROM j WHERE n >= 1 GROUP BY tpl, toks, n, h),
pieces AS (SELECT tpl, h, concat(n, '|', k, '|', array_to_string(list_slice(toks, k * n // (f + 1) + 1, (k + 1) * n // (f + 1)), ' ')) AS piece FROM (SELECT *, unnest(generate_series(0, f)) AS k FROM once WHERE f > 0)),
likely AS (SELECT DISTINCT tpl FROM pieces WHERE piece IN (SELECT piece FROM pieces GROUP BY piece HAVING count(*) >= 4)),
held AS (SELECT once.* FROM once JOIN likely USING (tpl)),
able AS (SELECT tpl, toks, n, f, count(*) AS c, CAST(n AS VARCHAR) AS p0 FROM held GROUP BY tpl, toks, n, f),
s1 AS (SELECT p0, toks[1] AS w, sum(c) >= 4 AS stays, count(*) OVER (PARTITION BY p0) > 1 AS loose FROM able WHERE n >= 1 GROUP BY p0, toks[1]),
a1 AS (SELECT able.*, s1.stays AS stays1, s1.loose AS loose1, concat(able.p0, chr(1), CASE WHEN s1.stays THEN 'w' || toks[1] ELSE '*' END) AS p1 FROM able LEFT JOIN s1 ON able.p0 = s1.p0 AND toks[1] = w),
s2 AS (SELECT p1, toks[2] AS w, sum(c) >= 4 AS stays, count(*) OVER (PARTITION BY p1) > 1 AS loose FROM a1 WHERE n >= 2 GROUP BY p1, toks[2]),
a2 AS (SELECT a1.*, s2.stays AS stays2, s2.loose AS loose2, concat(a1.p1, chr(1), CASE WHEN s2.stays THEN 'w' || toks[2] ELSE '*' END) AS p2 FROM a1 LEFT JOIN s2 ON a1.p1 = s2.p1 AND toks[2] = w),
s3 AS (SELECT p2, toks[3] AS w, sum(c) >= 4 AS stays, count(*) OVER (PARTITION BY p2) > 1 AS loose FROM a2 WHERE n >= 3 GROUP BY p2, toks[3]),
a3 AS (SELECT a2.*, s3.stays AS stays3, s3.loose AS loose3, concat(a2.p2, chr(1), CASE WHEN s3.stays THEN 'w' || toks[3] ELSE '*' END) AS p3 FROM a2 LEFT JOIN s3 ON a2.p2 = s3.p2 AND toks[3] = w),
e AS (SELECT tpl, p3, c, k, toks[k] AS w FROM (SELECT *, unnest(generate_series(4, n)) AS k FROM a3)),
s4 AS (SELECT p3, k, w, sum(c) >= 4 AS stays, count(*) OVER (PARTITION BY p3, k) > 1 AS loose FROM e GROUP BY p3, k, w),
kept AS (SELECT tpl, 1 AS k, toks[1] AS w, loose1 AS loose FROM a3 WHERE stays1 UNION ALL SELECT tpl, 2, toks[2], loose2 FROM a3 WHERE stays2 UNION ALL SELECT tpl, 3, toks[3], loose3 FROM a3 WHERE stays3
         UNION ALL SELECT e.tpl, e.k, e.w, s4.loose FROM e JOIN s4 ON e.p3 = s4.p3 AND e.k = s4.k AND e.w = s4.w WHERE s4.stays),
spare AS (SELECT kept.tpl, any_value(n) AS n, count(*) - (any_value(n) - any_value(f)) AS spare FROM kept JOIN able USING (tpl) GROUP BY kept.tpl),
v AS (SELECT tpl, n, string_agg(concat(k, ':', w), chr(2) ORDER BY k) AS key FROM kept JOIN spare USING (tpl) WHERE spare >= 0 GROUP BY tpl, n
      UNION ALL SELECT a.tpl, n, string_agg(concat(b.k, ':', b.w), chr(2) ORDER BY b.k) FROM kept a JOIN spare ON a.tpl = spare.tpl JOIN kept b ON a.tpl = b.tpl AND a.k <> b.k WHERE spare > 0 AND a.loose GROUP BY a.tpl, n, a.k),
vt AS (SELECT v.n, key, h, min(first) AS first FROM v JOIN held USING (tpl) GROUP BY v.n, key, h),
vr AS (SELECT n, key, min(first) AS first FROM vt GROUP BY n, key HAVING count(*) >= 4),
r AS (SELECT tpl, min(first) AS first FROM (SELECT tpl, min(first) AS first FROM once GROUP BY tpl HAVING count(*) >= 4 UNION ALL SELECT tpl, vr.first FROM v JOIN vr ON v.n = vr.n AND v.key = vr.key) x GROUP BY tpl),
o AS (SELECT h, min(doc_id) AS own FROM d GROUP BY h),
m AS (SELECT j.doc_id, k, line, coalesce(n >= 1 AND r.first < o.own, false) AS gone FROM j LEFT JOIN r ON j.tpl = r.tpl JOIN o ON j.h = o.h),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


#: crc: 32-bit check sum of ``conv_id:turn`` bit by bit. s0 to s3: the cheapest cost (six digits) and audit that reach each state of s?(ua)+ after k rows, row by row
#: from the left instead of by spans. o: how many turns stand before an edit, n: how many there are, r: its row.
OP11 = """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hit FROM c),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
      CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS k FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lead(role) OVER (PARTITION BY conv_id ORDER BY k) AS next FROM p),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (k + 1 < n AND concat(left(role, 1), left(next, 1)) NOT IN ('su', 'ua', 'au')) AS illegal,
      list(left(role, 1) ORDER BY k) AS roles, list(fault ORDER BY k) AS faults FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM f) x GROUP BY conv_id),
w AS (SELECT conv_id, 0 AS k, roles, faults, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000002I' AS s2, '000004II' AS s3 FROM m
 UNION ALL SELECT conv_id, k + 1, roles, faults, s0,
  s1, least(s2, CASE WHEN s0 IS NOT NULL THEN printf('%06d%s', CAST(left(s0, 6) AS BIGINT) + 2, s0[7:] || 'I') END, CASE WHEN s1 IS NOT NULL THEN printf('%06d%s', CAST(left(s1, 6) AS BIGINT) + 2, s1[7:] || 'I') END, printf('%06d%s', CAST(left(s3, 6) AS BIGINT) + 2, s3[7:] || 'I')),
  least(s3, printf('%06d%s', CAST(left(t2, 6) AS BIGINT) + 2, t2[7:] || 'I')) FROM (
   SELECT *, least(s2, CASE WHEN s0 IS NOT NULL THEN printf('%06d%s', CAST(left(s0, 6) AS BIGINT) + 2, s0[7:] || 'I') END, CASE WHEN s1 IS NOT NULL THEN printf('%06d%s', CAST(left(s1, 6) AS BIGINT) + 2, s1[7:] || 'I') END) AS t2 FROM (
    SELECT conv_id, k, roles, faults, del0 AS s0, least(del1, keep01) AS s1, least(del2, in2) AS s2, least(del3, in3) AS s3 FROM (
     SELECT w.*, f, printf('%06d%sD', CAST(left(s0, 6) AS BIGINT) + 3, s0[7:]) AS del0, CASE WHEN s1 IS NOT NULL THEN printf('%06d%sD', CAST(left(s1, 6) AS BIGINT) + 3, s1[7:]) END AS del1,
      printf('%06d%sD', CAST(left(s2, 6) AS BIGINT) + 3, s2[7:]) AS del2, printf('%06d%sD', CAST(left(s3, 6) AS BIGINT) + 3, s3[7:]) AS del3,
      CASE WHEN f IN (0, 3) AND r = 's' THEN printf('%06d%sK', CAST(left(s0, 6) AS BIGINT) + f // 3, s0[7:]) END AS keep01,
      CASE WHEN f IN (0, 3) THEN least(printf('%06d%s%s', CAST(left(s0, 6) AS BIGINT) + f // 3 + CASE WHEN r = 'u' THEN 0 ELSE 2 END, s0[7:], CASE WHEN r = 'u' THEN 'K' ELSE 'R' END),
       CASE WHEN s1 IS NOT NULL THEN printf('%06d%s%s', CAST(left(s1, 6) AS BIGINT) + f // 3 + CASE WHEN r = 'u' THEN 0 ELSE 2 END, s1[7:], CASE WHEN r = 'u' THEN 'K' ELSE 'R' END) END,
       printf('%06d%s%s', CAST(left(s3, 6) AS BIGINT) + f // 3 + CASE WHEN r = 'u' THEN 0 ELSE 2 END, s3[7:], CASE WHEN r = 'u' THEN 'K' ELSE 'R' END)) END AS in2,
      CASE WHEN f IN (0, 3) THEN printf('%06d%s%s', CAST(left(s2, 6) AS BIGINT) + f // 3 + CASE WHEN r = 'a' THEN 0 ELSE 2 END, s2[7:], CASE WHEN r = 'a' THEN 'K' ELSE 'R' END) END AS in3
     FROM (SELECT *, roles[k + 1] AS r, faults[k + 1] AS f FROM w WHERE k < len(roles)) w) x) y) z),
b AS (SELECT conv_id, CAST(left(best, 6) AS BIGINT) AS cost, best[7:] AS audit FROM (SELECT conv_id, least(s0, s3) AS best FROM w WHERE k = len(roles)) x),
e AS (SELECT conv_id, j, edit, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) - 1 AS o, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS n,
      count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) - 1 AS r FROM (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS j, audit[unnest(range(1, len(audit) + 1))] AS edit FROM b) x),
t AS (SELECT e.conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (o + n) % 2 = 0 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY j) AS lines
      FROM e LEFT JOIN p ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.r = p.k WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN m ON i.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON i.conv_id IS NOT DISTINCT FROM t.conv_id
"""


OP12 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""


#: All anchors against all rows.
OP13 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict:
    return {"op9_lines": OP9, "op11_conversations": OP11, "op12_warc": OP12, "op13_negatives": OP13}
