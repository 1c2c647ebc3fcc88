"""Registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.clusters import cluster_vectors
from tidemark.llm.common import read_table
from tidemark.llm.conversations import repair
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.html_text import main_text
from tidemark.llm.language_id import language_id
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.lm_scores import score_texts
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import pseudonymize
from tidemark.llm.quality import quality
from tidemark.llm.token_counts import token_counts

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
PSEUDONYM_KEY = "replace-me-per-deployment"  # a caller of the operator passes a secret of its own
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), WORD_MODEL)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts themselves are the operator's; the query returns their digests."""
    done = dedup_lines(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_lines", "n_removed")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))


def op12_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op13_zone_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_probminhash_near_dedup, op2_additive_ann, op3_feistel_pseudonyms, op4_mil_quality, op5_best_fit_packing, op6_line_dedup, op7_template_decontamination,
        op8_language_id, op9_token_counts, op10_wrapper_text, op11_conversation_repair, op12_lattice_scores, op13_zone_map_clusters,
    )
    return {f.__name__: f for f in found}


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REPAIR = f"""
WITH RECURSIVE
-- The 256 steps of CRC-32 by bytes, made from its polynomial.
steps AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM said), steps),
hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM said JOIN keyed USING (k), range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {_SPACES}) AS core FROM hurt),
judged AS (SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
marked AS (SELECT *, NOT blank AND NOT duplicate AND right(core, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY ALL),
-- States: 0 nothing, 1 a system turn, 2 a user turn last, 3 an assistant turn last.
ins AS (
    SELECT f, t, n, letters, CASE WHEN n = 0 THEN '' WHEN t = 2 THEN 'user:' || chr(10) WHEN n = 1 THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS added
    FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'I'), (1, 2, 1, 'I'), (3, 2, 1, 'I'), (2, 3, 1, 'I'), (0, 3, 2, 'II'), (1, 3, 2, 'II')) v(f, t, n, letters)),
edit AS (SELECT f, f AS t, 'D' AS letter, 3 AS price, CAST(NULL AS VARCHAR) AS initial, CAST(NULL AS VARCHAR) AS role FROM range(4) s(f) UNION ALL SELECT f, t, 'K', 0, initial, CAST(NULL AS VARCHAR) FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) v(f, t, initial) UNION ALL SELECT f, t, 'R', 2, CAST(NULL AS VARCHAR), role FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) v(f, t, role)),
path AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM conversations
    UNION ALL
    SELECT p.conv_id, m.pos, e.t, p.cost + 2 * i.n + e.price + CAST(e.letter <> 'D' AND m.truncated AS INTEGER), p.audit || i.letters || e.letter,
        p.body || i.added || CASE WHEN e.letter = 'D' THEN '' ELSE coalesce(e.role, m.role) || ':' || m.text || chr(10) END
    FROM path p JOIN marked m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = p.pos + 1 JOIN ins i ON i.f = p.state JOIN edit e ON e.f = i.t AND (e.letter = 'D' OR NOT m.blank AND NOT m.duplicate AND (e.letter = 'R' OR e.initial = left(m.role, 1)))
    QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.t ORDER BY p.cost + 2 * i.n + e.price + CAST(e.letter <> 'D' AND m.truncated AS INTEGER), p.audit || i.letters || e.letter) = 1),
ended AS (
    SELECT p.conv_id, p.cost + 2 * i.n AS cost, p.audit || i.letters AS audit, p.body || i.added AS body FROM path p LEFT JOIN counted c ON p.conv_id IS NOT DISTINCT FROM c.conv_id JOIN ins i ON i.f = p.state
    WHERE p.pos = coalesce(c.n, 0) AND i.t IN (0, 3) QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 2 * i.n, p.audit || i.letters) = 1)
SELECT e.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(cost AS BIGINT) AS cost, audit, sha256(left(body, greatest(length(body) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_ASSIGN = "a{i} AS (SELECT id, v, min(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 16 + k) AS m FROM kept, c{i} GROUP BY id, v)"
_MOVE = "c{j} AS (SELECT c{i}.k, coalesce(any_value(n.c), any_value(c{i}.c)) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS c FROM (SELECT m % 16 AS k, place, sum(v[place]) AS total, count(*) AS n FROM a{i}, range(1, 65) r(place) GROUP BY ALL) GROUP BY k) n ON n.k = c{i}.k GROUP BY c{i}.k)"
_CLUSTERS = ",\n".join(
    (
        "WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 16)",
        *(x.format(i=i, j=i + 1) for i in range(3) for x in (_ASSIGN, _MOVE)),
        _ASSIGN.format(i=3),
    )
) + """
SELECT vec_id, CAST(m % 16 AS INTEGER) AS cluster, CAST(m // 16 AS BIGINT) AS distance, CAST(sum(m // 16) OVER (PARTITION BY m % 16) AS BIGINT) AS cluster_inertia, CAST(sum(m // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (id) JOIN c3 ON k = m % 16"""


def oracle_sql() -> dict[str, str]:
    """Of conversation repair and clustering; no other operator's whole result can be said in SQL: tests/llm compares them with brute force or the library."""
    return {"op11_conversation_repair": _REPAIR, "op13_zone_map_clusters": _CLUSTERS}
