"""The operators as registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, fingerprint, langid, mixing, ngram_join, packing, quality, secrets, token_count, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. Null texts have no words, null sources are one source, null ids and repeated rows are drawn one by one;
    other columns are ignored; an empty table gives an empty result."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document's pieces. Null and empty texts are one piece of one id, long texts are cut, repeated rows and null ids are packed each;
    other columns are ignored; an empty table gives an empty result."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, through the lasting ledger of the shared folder. Null texts are empty, repeated rows and equal or null ids give a row each;
    other columns are ignored; an empty table gives an empty result."""
    findings, _ = secrets.scan_versions(_table(spark, sf_dir, "documents"), ["doc_id"], store=secrets.ledger_store(spark))
    base = ("assign", "access", "hex")
    counts = (F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in base)  # noqa: B023
    return findings.select(
        "doc_id", *counts, F.sha2(secrets.span_string(F.col("spans"), base), 256).alias("base_sha256"), secrets.span_string(F.col("spans")).alias("spans")
    )


def op4_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text. Null texts are empty, null ids come last, ids that repeat follow by their texts; other columns
    are ignored; an empty table gives an empty result."""
    return fingerprint.compare_edited(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document. Null and empty texts are scored as zeros, null ids are scored but not learned from, repeated rows give a row each; without
    labels all scores are 0.5; other columns are ignored; an empty table gives an empty result."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document. Null texts and texts without letters are ``und``, null ids aren't held out, repeated rows give a row each; ties go to the first
    language; other columns are ignored; an empty table gives an empty result."""
    docs = _table(spark, sf_dir, "documents")
    langs, tables = langid.learn(docs)
    held = F.coalesce(langid.crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, langs, tables).select("doc_id", held, "lang_pred", "score")


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as read back from its formatted text. Null texts and roles are empty, a null conv_id is a conversation, repeated rows are turns each,
    ordered by turn, role and text; other columns are ignored; an empty table gives conversation -7 alone."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(hard)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document. Null texts are empty, repeated rows and equal or null ids give a row each; other columns are ignored; an empty table gives
    an empty result."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document. Null, empty and blank texts are linked with nothing, repeated rows are equal documents, a null id is smallest only where
    there is no other; other columns are ignored; an empty table gives an empty result."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best for each query row. Null vectors, null or non-finite components and null ids take no part, every other row does, repeated ones too; ties go to
    the smaller id; other columns are ignored; an empty table gives an empty result."""
    vectors = topk.quantise(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pareto_mix, op2_best_two_fit_packing, op3_secret_ledger, op4_one_permutation_minhash, op5_quality_classifier, op6_language_id, op7_chat_round_trip, op8_token_counts, op9_ngram_jaccard, op10_max_score)
}

_OP1 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS tie FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, tie) - 1 AS number, greatest(length(bin(size)) - 3, 0) AS low FROM rows),
docs AS (
  SELECT *, (size >> low) << low AS measure,
    (CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), tie, CAST(number AS VARCHAR))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM numbered),
s AS (
  SELECT source, row_number() OVER (ORDER BY source IS NULL, source) AS no, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
w AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY most / w, no) AS pos,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (
  SELECT source, no, source_size, least(coalesce(w * (SELECT arg_min(level, pos) FROM l WHERE level <= most / w), most), most) AS target FROM l),
r AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
p AS (SELECT *, target - whole * source_size AS rest FROM r),
m AS (
  SELECT p.no, d.measure, any_value(p.rest) AS rest, sum(d.size)::DOUBLE AS words FROM docs d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY p.no, d.measure),
c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY no ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger,
    sum(measure * words) OVER (PARTITION BY no ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM m),
e AS (SELECT *, CASE WHEN others > 0 THEN (rest - larger) / others ELSE 0 END AS rate FROM c),
k AS (SELECT *, max(CASE WHEN rate * measure <= 1 THEN {'a': measure, 'b': rate} END) OVER (PARTITION BY no) AS best FROM e),
i AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(best.b * measure, 1))) AS incl FROM k),
j AS (SELECT no, measure, incl, rest - coalesce(sum(words) FILTER (WHERE incl >= 1) OVER (PARTITION BY no), 0) AS remaining FROM i),
y AS (
  SELECT d.*, p.no, p.source_size, p.target, p.whole, j.incl, j.remaining,
    CASE WHEN incl > 0 AND incl < 1 THEN (u / (1 - u)) / (incl / (1 - incl)) / (1 + (u / (1 - u)) / (incl / (1 - incl))) END AS y
  FROM docs d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN j ON j.no = p.no AND j.measure = d.measure),
f AS (
  SELECT *, sum(CASE WHEN y IS NOT NULL THEN size END) OVER (PARTITION BY no ORDER BY y NULLS LAST, doc_id NULLS FIRST, tie, number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM y)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN incl >= 1 OR (y IS NOT NULL
    AND (upto <= remaining OR (remaining - (upto - size) >= 0 AND upto - remaining < remaining - (upto - size)))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f
"""

_OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[/?INST\]|</?s>|\[ROLE=|\[/ROLE\]')) * regexp_matches(text, '\\(\\|\[/?INST\]|</?s>|\[ROLE=|\[/ROLE\])|\[/?INST\]|</?s>|\[ROLE=|\[/ROLE\]|\\$')::INT AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) + length(regexp_replace(role, '[^\\\]]', '', 'g')) END)::BIGINT AS formatted_chars
FROM marks GROUP BY conv_id
"""

_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS cells FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.cells, c.cells)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
c AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT c.doc_id, l.y FROM c JOIN l ON c.reached = l.x)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, min(reached) AS component_id FROM s JOIN c ON s.doc_id = c.doc_id GROUP BY s.doc_id, grams
"""

ORACLE_SQL: dict[str, str] = {"op1_pareto_mix": _OP1, "op7_chat_round_trip": _OP7, "op9_ngram_jaccard": _OP9, "op10_max_score": _OP10}
