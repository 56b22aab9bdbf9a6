"""The registered queries of these operators, over whole tables, and their oracle SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hard_negatives, langid, ngram_join, packing, pii, quality, runs, secrets, sharding, toxicity

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Only for test data; a deployment passes its own secret key.
DEMO_KEY = b"leakloom demo key, not secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.secret_findings(docs, secrets.scan_ledger(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    kinds = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.BASE]
    return found.withColumn("base", base).select("doc_id", *kinds, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24, groups=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.prefix_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep_table=False, budget=1024)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_bytes")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.predict(docs, model).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_repeats(_table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label=shifted)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_nearest, op3_secrets, op4_bpe, op5_shards, op6_pii, op7_token_counts, op8_langid, op9_packing, op10_quality, op11_toxicity, op12_periodic_runs, op13_hard_negatives)}

_SPAN_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(kind_no, kind, pattern) AS (VALUES
  (0, 'assign', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), (4, 'hub', 'gh[opsu]_[A-Za-z0-9]{36,}')),
a AS (SELECT doc_id, kind_no, kind, CASE kind_no
    WHEN 0 THEN regexp_extract_all(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]+')
    WHEN 3 THEN regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') ELSE regexp_extract_all(text, 'gh[opsu]_[A-Za-z0-9]{36,}') END AS m,
  CASE kind_no
    WHEN 0 THEN string_split_regex(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN string_split_regex(text, '[0-9a-f]+')
    WHEN 3 THEN string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') ELSE string_split_regex(text, 'gh[opsu]_[A-Za-z0-9]{36,}') END AS g
  FROM d, k),
e AS (SELECT doc_id, kind_no, kind, unnest(m) AS v, generate_subscripts(m, 1) AS i, g, m FROM a),
p AS (SELECT doc_id, kind_no, kind, v,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start FROM e
  WHERE CASE kind_no WHEN 0 THEN length(regexp_extract(v, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
    WHEN 1 THEN length(v) >= 18 WHEN 2 THEN length(v) >= 16 ELSE true END),
s AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(v) AS BIGINT), ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(v) AS BIGINT), ',' ORDER BY start, kind_no) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""

#: CRC-32 of UTF-8 texts: the table by its rule, then a byte after the other.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_SHARD_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: {_CRC_STEP})) AS tab),
b AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
d AS (SELECT doc_id, size, md5(text) AS h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
p AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
g AS (SELECT *, min(upto - size) OVER (PARTITION BY h) AS first, sum(size) OVER (PARTITION BY h) AS bytes, count(*) OVER (PARTITION BY h) AS n FROM p),
s AS (SELECT *, CAST(least((CASE WHEN n > 1 AND bytes * 100 * 24 <= total THEN 2 * first + bytes ELSE 2 * upto - size END) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

ORACLE_SQL = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) c USING (doc_id)
""",
    "op2_nearest": """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 20
""",
    "op3_secrets": _SPAN_SQL,
    "op13_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
""",
    "op5_shards": _SHARD_SQL,
}
