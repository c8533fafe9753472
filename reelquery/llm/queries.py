"""The operators bound to the standard tables: one query each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chunkdedup, linededup, lmscore, ngramjoin, packing, pii, quality, topk
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_spans(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents")).drop("rid")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_topk": op3_topk,
    "op4_pii": op4_pii,
    "op5_lm_score": op5_lm_score,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
}

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


OP6_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3)) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.r = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT a, min(r) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

OP9_SQL = """
WITH x AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, unnest(p) AS l, unnest(range(1, len(p) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), f AS (SELECT l, any_value(w) AS w, min({'d': doc_id, 'n': line_no}) AS pos FROM x GROUP BY l
), k AS (
  SELECT pos, unnest(list_concat(
    list_transform(range(0, len(w)), lambda i: hash([len(w), i], list_slice(w, 1, i), list_slice(w, i + 2, len(w)))),
    list_transform(range(0, len(w) + 1), lambda i: hash([len(w) + 1, i], list_slice(w, 1, i), list_slice(w, i + 1, len(w)))))) AS key
  FROM f WHERE len(w) >= 8
), g AS (SELECT key, min(pos) AS kept FROM k GROUP BY key HAVING count(DISTINCT pos) > 1
), near AS (SELECT k.pos, min(g.kept) AS kept FROM k JOIN g ON k.key = g.key WHERE g.kept < k.pos GROUP BY k.pos
)
SELECT x.doc_id, x.line_no, coalesce(near.kept, f.pos).d AS kept_doc_id, coalesce(near.kept, f.pos).n AS kept_line_no,
       CASE WHEN near.kept IS NULL THEN 0 ELSE 1 END AS edits
FROM x JOIN f ON x.l = f.l LEFT JOIN near ON near.pos = f.pos
WHERE near.kept IS NOT NULL OR {'d': x.doc_id, 'n': x.line_no} > f.pos
"""


def _op8_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    bounds = []
    for r in quality.RULES:
        value = f"CAST({r.measure} AS DOUBLE)" + (f" / nullif({r.per}, 0)" if r.per else "")
        if r.low is not None:
            bounds.append(f"coalesce({value} >= {r.low}, true)")
        if r.high is not None:
            bounds.append(f"coalesce({value} <= {r.high}, true)")
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered c ON t.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(bounds)} AS kept
FROM b
"""


ORACLES: dict[str, str] = {
    "op3_topk": OP3_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op8_quality": _op8_sql(),
    "op9_line_dedup": OP9_SQL,
}
