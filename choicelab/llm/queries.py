"""The corpus operators as queries over the given tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from choicelab.llm import (
    embedding_dedup,
    exact_dedup,
    filter_audit,
    html_extract,
    mixing,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality,
    sharding,
    substring_dedup,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWERED = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}')"


@_query("op4_exact_dedup", f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(lowered) AS text_sha256
    FROM (SELECT doc_id, {_LOWERED} AS lowered FROM documents) WINDOW same AS (PARTITION BY lowered)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query("op5_setsketch_near_dedup")
def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component: three-word shingles, similarity 0.85."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=3, percent=85)


@_query("op6_source_mixing", mixing.SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_query("op3_noisy_or_toxicity")
def op3_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity and its offending sentences."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


@_query("op2_contextual_pii")
def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data."""
    return pii.report(_table(spark, sf_dir, "documents"))


@_query("op10_ratio_html_extract")
def op10_ratio_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query("op7_pigeonhole_vectors", """
    WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0
                              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good),
    links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.node),
    least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
    counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON node = vec_id LEFT JOIN counts ON u = vec_id""")
def op7_pigeonhole_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.9 and its component."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op9_chunked_passages")
def op9_chunked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of more than 50 words that documents share."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


@_query("op11_prefix_trie", prefix_trie.SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query("op12_filter_audit", filter_audit.SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, order of the five filters and step with what the step removes."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op13_jump_shards", sharding.sql())
def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there."""
    return sharding.assign(_table(spark, sf_dir, "documents"))
