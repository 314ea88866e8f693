"""One query for each operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm import jaccard, language, mixing, packing, quality_model, quality_rules, substring_dedup, suffix_dedup, topk, toxicity
from tidemesh.llm.store import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_model": op2_quality_model,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_topk": op5_topk,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_mixing": op7_mixing,
        "op8_packing": op8_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
    }


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


SUFFIX_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, list_transform(range(0, greatest(length(h) // 2 - 199, 0)), lambda i: md5(h[2 * i + 1:2 * i + 400])) AS ks FROM d),
g AS (SELECT doc_id, unnest(range(0, len(ks))) AS i, unnest(ks) AS k FROM w),
often AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM g SEMI JOIN often USING (k)),
island AS (SELECT doc_id, i, count(*) FILTER (step > 200) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
run AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM island GROUP BY 1, 2),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
kept AS (
    SELECT doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS head, max(b) AS last
    FROM cut JOIN d USING (doc_id) GROUP BY 1
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || h[2 * last + 1:] END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


_WORD = r"[^\x20\x09-\x0D]+"
SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) t(i)),
least_id AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT g.doc_id, g.i FROM g JOIN least_id USING (k) WHERE m < g.doc_id) h, unnest(range(i, i + 50)) t(j)),
kept AS (SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.j) AS t, count(*) AS n FROM (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) t(j)) p ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
JACCARD_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": SUFFIX_SQL,
        "op4_substring_dedup": SUBSTRING_SQL,
        "op6_ngram_jaccard": JACCARD_SQL,
        "op5_topk": TOPK_SQL,
    }
