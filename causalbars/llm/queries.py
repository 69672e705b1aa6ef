"""The registered queries of this subpackage: thin wrappers that fix parameters and result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, graphs, lines, lm, packing, phrases, pii, quality, secrets, simhash, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = chat.canonical_turns(_table(spark, sf_dir, "conversations"))
    said = r"\### Assistant: </turn> ok"
    probe = spark.sql("SELECT -7L AS conv_id, array(named_struct('role', 'user', 'content', :said), named_struct('role', 'assistant', 'content', :said)) AS messages", {"said": said})
    return chat.digests(chat.format_chat(stored.unionByName(chat.canonical_turns(probe))))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + length(text) + 9
    + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: All pairs, and least labels by recursion: for small tables only.
OP12_SQL = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.i, b.i AS j, b.vec_id FROM usable a JOIN usable b ON a.i <> b.i AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT i, i AS j FROM usable UNION SELECT r.i, l.j FROM reached r JOIN links l ON r.j = l.i),
least AS (SELECT r.i, min(u.vec_id) AS component_id FROM reached r JOIN usable u ON r.j = u.i GROUP BY r.i),
counted AS (SELECT i, count(*) AS n_links FROM links GROUP BY i),
alone AS (
  SELECT vec_id, 0 AS n_links, vec_id AS component_id FROM embeddings
  WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM (
  SELECT u.vec_id, coalesce(n_links, 0) AS n_links, component_id
  FROM usable u JOIN least USING (i) LEFT JOIN counted USING (i)
  UNION ALL SELECT * FROM alone)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents")).drop("k")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM placed),
f1 AS (SELECT lang, a, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*)::HUGEINT AS f FROM grams WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM grams WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, 1 AS k, f2.f, p.f AS l, q.f AS r FROM f2
  JOIN f1 p ON p.lang = f2.lang AND p.a = f2.a JOIN f1 q ON q.lang = f2.lang AND q.a = f2.b
  WHERE f2.f >= 10
    AND NOT EXISTS (FROM f3 WHERE f3.f >= 10 AND f3.lang = f2.lang AND f3.a = f2.a AND f3.b = f2.b AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (FROM f3 WHERE f3.f >= 10 AND f3.lang = f2.lang AND f3.b = f2.a AND f3.c = f2.b AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 1, f3.f, p.f, q.f FROM f3
  JOIN f1 p ON p.lang = f3.lang AND p.a = f3.a JOIN f2 q ON q.lang = f3.lang AND q.a = f3.b AND q.b = f3.c WHERE f3.f >= 10
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 2, f3.f, p.f, q.f FROM f3
  JOIN f2 p ON p.lang = f3.lang AND p.a = f3.a AND p.b = f3.b JOIN f1 q ON q.lang = f3.lang AND q.a = f3.c WHERE f3.f >= 10),
scored AS (SELECT *, (1000000 * f * f) // (l * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_lm_score": op7_lm_score,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op8_chat_format": OP8_SQL, "op12_embedding_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
