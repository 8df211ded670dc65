"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, html_text, importance, language, neural_lm, packing, passages, pii, prefix_trie, quality, records, secret_scan, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_files(_table(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash_anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_learned_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_table(spark, sf_dir, "documents"))


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op6_tree_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(_table(spark, sf_dir, "documents"))


def op11_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and log-bilinear scores."""
    return neural_lm.report(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards ``benchmark``, its score, and the rank of the drawn tenth."""
    docs = _table(spark, sf_dir, "documents")
    return importance.ranks(docs, importance.fit(docs, _table(spark, sf_dir, "benchmark")))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations``."""
    return prefix_trie.report(_table(spark, sf_dir, "conversations"))


#: CRC-32 of a string's bytes: its table by rule, then a byte at a time.
CRC = """tab AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) r(i)),
 crc AS (SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS c FROM (SELECT DISTINCT w FROM {words}), tab)"""
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op12_importance_resampling": f"""WITH dw AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), bw AS (SELECT unnest({WORDS}) AS w FROM benchmark), every AS (SELECT w FROM dw UNION ALL SELECT w FROM bw),
 {CRC.format(words="every")},
 db AS (SELECT doc_id, c % 10000 AS b FROM dw JOIN crc USING (w)), s AS (SELECT b, count(*) AS s FROM db GROUP BY b), t AS (SELECT c % 10000 AS b, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
 gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS g FROM s FULL JOIN t USING (b)),
 per AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM db JOIN gain USING (b) GROUP BY doc_id),
 sc AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN per USING (doc_id)),
 rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc WHERE n_features >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM rk) // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)""",
    "op13_conversation_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS w FROM t), {CRC.format(words="ids")}, h AS (SELECT conv_id, c % 6 AS h, conv_id - conv_id % 100 AS base FROM ids JOIN crc USING (w)),
 rb AS (SELECT h.conv_id, 0 AS part, p, role, x FROM h JOIN t ON t.conv_id = base AND p <= h UNION ALL SELECT h.conv_id, 1, p, role, x FROM h JOIN t ON t.conv_id = h.conv_id AND p > h),
 sq AS (SELECT conv_id, row_number() OVER w AS d, length(x) AS len, sha256(string_agg(sha256(length(role) || ':' || role || x), '') OVER w) AS k FROM rb WINDOW w AS (PARTITION BY conv_id ORDER BY part, p ROWS UNBOUNDED PRECEDING)),
 every AS (SELECT conv_id, d, len, k FROM sq UNION ALL SELECT conv_id, 0, 0, '' FROM h), up AS (SELECT *, lag(k) OVER w AS pk, max(d) OVER (PARTITION BY conv_id) AS last FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
 node AS (SELECT k, d, max(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(len) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends FROM up GROUP BY k, d),
 kids AS (SELECT pk AS k, count(*) AS c FROM node WHERE d > 0 GROUP BY pk), beneath AS (SELECT DISTINCT a.k, b.k AS bk FROM every a JOIN every b ON a.conv_id = b.conv_id AND a.d <= b.d),
 sums AS (SELECT b.k, count(*) FILTER (WHERE c IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved FROM beneath b JOIN node n ON n.k = bk LEFT JOIN kids ON kids.k = bk GROUP BY b.k)
 SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c, 0) AS n_children, n_leaves, sums.saved AS saved_tokens, n.ends AS ends_sha256 FROM node n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN node p ON p.k = n.pk AND n.d > 0""",
}


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
