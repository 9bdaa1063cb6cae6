"""The retrieval engine: scope, then dense and sparse search within it, then fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import bm25, dense, rankings
from larkspur.operators.protocol import RetrievalConfig


def retrieve(
    questions: DataFrame,
    vectors: DataFrame,
    bagged: DataFrame,
    stats: DataFrame,
    avgdl: float,
    scope: DataFrame | None = None,
    config: RetrievalConfig | None = None,
    query: str = "query_id",
    key: str = "chunk_id",
) -> DataFrame:
    """(query, method, key, rank, score) of the methods dense, bm25 and rrf; score is the distance, the BM25 score or the fused one.

    questions has (query, question, embedding), vectors (key, embedding, company), bagged the corpus' bags with company, scope (query,
    company). Both searches look within the companies of a query's scope, below their cuts; a question without a vector is searched for by its
    words only, one without words by its vector only.
    """
    c = config or RetrievalConfig()
    posed = questions.where(F.col("embedding").isNotNull()).select(F.col(query).alias(key), "embedding")
    within = None if scope is None else scope.select(query, "company")
    near = dense.l2_topk(posed, vectors, c.dense_top_k, key, scope=None if within is None else within.withColumnRenamed(query, "query_id"))
    near = near.select(F.col("query_id").alias(query), F.lit("dense").alias("method"), key, "rank", F.col("distance").alias("score"))
    said = bm25.search(questions.where("question is not null").select(query, "question"), bagged, stats, avgdl, c.bm25_top_k, query, key, within)
    both = near.unionByName(said.select(query, F.lit("bm25").alias("method"), key, "rank", "score"))
    fused = rankings.weighted_rrf(both, {"dense": c.dense_rrf_weight, "bm25": c.bm25_rrf_weight}, c.rrf_k, c.fused_top_k, query, key)
    return both.unionByName(fused.select(query, F.lit("rrf").alias("method"), key, "rank", F.round("score", 9).alias("score")))
