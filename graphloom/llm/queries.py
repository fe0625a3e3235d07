"""The registered query of each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat, common, decontam, fim, flat_graph, hpylm, license_scan, near_dup, phrases, quality, token_counts, topk, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licences(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    wavelet.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return wavelet.documents(spark, path)


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.next_answer_pairs(table(spark, sf_dir, "conversations"))).select(
        "pair_id", "n_common", "prompt", "chosen", F.to_json("chosen_learn").alias("chosen_learn"), "rejected", F.to_json("rejected_learn").alias("rejected_learn")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scores(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_classifier,
        op3_exact_top_k,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_token_id_output,
        op7_byte_level_bpe,
        op8_chat_formatting,
        op9_lm_scoring,
        op10_near_duplicates,
        op11_embedding_near_duplicates,
        op12_fill_in_middle,
        op13_phrase_collocations,
    )
}

ORACLE: dict[str, str] = {
    "op3_exact_top_k": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS size FROM t),
last AS (SELECT conv_id - 1 AS conv_id, role, text FROM n WHERE k = size),
sides AS (
  SELECT conv_id, 'c' AS side, k, size, role, text FROM n
  UNION ALL SELECT conv_id, 'r', k, size, role, text FROM n WHERE k < size
  UNION ALL SELECT n.conv_id, 'r', n.k, n.size, l.role, l.text FROM n JOIN last l USING (conv_id) WHERE n.k = n.size),
differ AS (
  SELECT n.conv_id, CASE WHEN l.conv_id IS NOT NULL AND n.role IS NOT DISTINCT FROM l.role AND n.text IS NOT DISTINCT FROM l.text THEN n.size ELSE n.size - 1 END AS n_common
  FROM n LEFT JOIN last l USING (conv_id) WHERE n.k = n.size),
r AS (
  SELECT s.*, n_common, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS whole
  FROM sides s JOIN differ USING (conv_id)),
p AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY conv_id, side, k > n_common ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT conv_id AS pair_id, CAST(any_value(n_common) AS INTEGER) AS n_common,
       coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n_common), '') AS prompt,
       coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n_common), '') AS chosen,
       '[' || coalesce(string_agg('{"start":' || CAST(before + length(head) AS BIGINT) || ',"end":' || CAST(before + length(whole) AS BIGINT) || '}', ',' ORDER BY k) FILTER (WHERE side = 'c' AND k > n_common AND role = 'assistant'), '') || ']' AS chosen_learn,
       coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n_common), '') AS rejected,
       '[' || coalesce(string_agg('{"start":' || CAST(before + length(head) AS BIGINT) || ',"end":' || CAST(before + length(whole) AS BIGINT) || '}', ',' ORDER BY k) FILTER (WHERE side = 'r' AND k > n_common AND role = 'assistant'), '') || ']' AS rejected_learn
FROM p GROUP BY conv_id
""",
    "op5_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM i),
p AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, p.n FROM p JOIN i USING (win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id IS NOT DISTINCT FROM hit.doc_id LEFT JOIN it ON d.doc_id IS NOT DISTINCT FROM it.doc_id
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || x[1:8] AS UBIGINT) AS h1, CAST('0x' || x[9:16] AS UBIGINT) AS h2, CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4
  FROM d),
k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
c AS (SELECT *, array_to_string(u[1 : i], '') AS p, array_to_string(u[i + 1 : j], '') AS m, array_to_string(u[j + 1 : n], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
""",
    "op13_phrase_collocations": r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)) WHERE len(words) > 0),
f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(words[s : s + m - 1], ' ') AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM p, (VALUES (1), (2), (3)) v(m) WHERE len(words) >= m)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
inner_ AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ x ON c.lang = x.lang AND c.phrase = x.phrase WHERE x.longer IS NULL OR 100 * x.longer < 50 * a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (
  SELECT cut.*, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
""",
}
