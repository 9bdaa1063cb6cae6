"""The batched question pipeline: follow-ups made standalone, routes by cheap rules, then scope, fusion, re-ranking, pages, gate, and outcome.

Re-ranking by a model and answer generation are injected steps; without them, BM25 over a request's own candidates and retrieval answers stand for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import bm25, conversation, finance, grounding, rankings, scope
from larkspur.plans.retrieval import chunks, scored_votes
from larkspur.session import durable, latest, table

CLARIFY, BOUNDARY, FINANCE, LACKING, RAG = "query_clarification", "knowledge_boundary", "structured_finance", "insufficient_evidence", "rag"


def outcome(route: Column, success: Column, supported: Column, retrieval_only: bool, preset: Column | None = None) -> Column:
    """What became of a request; a preset value wins."""
    machine = (
        F.when(~success, "service_error").when(route == CLARIFY, "clarification").when((route == BOUNDARY) | ~supported, "refused").when(F.lit(retrieval_only) & (route == RAG), "retrieval_only").otherwise("answered")
    )
    return F.coalesce(preset, machine) if preset is not None else machine


def scoped_votes(cast: DataFrame, asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(run_id, method, rank, chunk_id, good) of cast within the companies (run_id, companies) that a run names, or all if it names none.

    Places are counted within the scope. Blank chunks then drop out, and a chunk indexed again stands for the first of its identity.
    """
    key = F.sha2(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rankings.chunk_identity())])), 256)
    keyed = corpus.select("chunk_id", "company", F.when(~C.is_blank(F.col("content")), key).alias("_key"))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min("chunk_id").alias("_first"))
    known = keyed.join(first, "_key", "left").select("chunk_id", "company", "_first")
    within = cast.join(asked.select("run_id", "companies"), "run_id").join(known, "chunk_id", "left").where((F.size("companies") == 0) | F.array_contains("companies", F.col("company")))
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "query_id", "method").orderBy("rank")))
    return ranked.where("_first is not null").select("run_id", "method", "rank", F.col("_first").alias("chunk_id"), "good")


def reranked(candidates: DataFrame, client: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """candidates (run_id, chunk_id, rank, question, content, n_pages, n_companies, ...) with score and judged, in the order of the new rank; equal scores keep the old one.

    The client is not asked for runs that want several pages of at most one company. Where it isn't, or gives a run no score, BM25 over
    the run's own candidates decides, and judged is false.
    """
    if client is None:
        scored = bm25.rerank(candidates, "run_id").withColumn("judged", F.lit(False))
    else:
        sent = candidates.where("n_pages <= 1 or n_companies > 1").select("run_id", "chunk_id", "question", "content")
        given = durable(client(sent).where("score is not null and not isnan(score)").select("run_id", "chunk_id", "score"))
        local = bm25.rerank(candidates.join(given.select("run_id").distinct(), "run_id", "left_anti"), "run_id").withColumn("judged", F.lit(False))
        scored = local.unionByName(candidates.join(given, ["run_id", "chunk_id"]).withColumn("judged", F.lit(True)))
    order = Window.partitionBy("run_id").orderBy(F.desc("score"), "rank")
    return scored.drop("question", "content").withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def answer_batch(
    spark: SparkSession,
    d: str,
    top_n: int = 3,
    generate: Callable[[DataFrame], DataFrame] | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """(run_id, route, n_companies, answer, sources, outcome) of every request with a question.

    The routed table is stored once and each branch reads its own rows. Rankings are those recorded for the run; text is joined for candidates to
    re-rank and for the winning pages. history has (run_id, history ARRAY<STRUCT<role, content>>), one row for a run; the tables record none.
    rerank takes (run_id, chunk_id, question, content) and gives (run_id, chunk_id, score), generate takes (run_id, question, context) and gives (run_id, answer).
    A run's pages pass the gate by the re-ranker's best score, else by the best cosine, 1 - distance / 2 of the pages' chunks as recorded; if dense search
    lists none of them, by that of its best result.
    """
    posed = table(spark, d, "query_requests").where(~C.is_blank(F.col("question"))).groupBy("run_id").agg(F.min("question").alias("question"))
    told = posed.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>")) if history is None else posed.join(history.select("run_id", "history"), "run_id", "left")
    known = scope.aliases(table(spark, d, "companies"))
    rewritten = durable(conversation.rewrite_questions(told, known, "run_id").select("run_id", "rewritten_query", "needs_clarification", "clarification_question"))
    asked = rewritten.where("not needs_clarification").select("run_id", F.col("rewritten_query").alias("question"))
    named = scope.mentioned(asked, known, "run_id", "question")
    listed = named.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "company"))), lambda x: x["company"]).alias("companies"))
    corpus = chunks(spark, d, "company", "source_file", "page_number", "start_index", "content")
    covered = corpus.where("company is not null").select("company", F.explode(F.array_distinct(C.years(F.coalesce("content", F.lit(""))))).alias("year")).distinct()
    years_of = named.join(covered, "company").groupBy("run_id").agg(F.collect_set("year").alias("report_years"))
    rows = asked.join(listed, "run_id", "left").join(years_of, "run_id", "left")
    rows = rows.withColumn("companies", F.coalesce("companies", F.array().cast("array<string>")))
    reason = grounding.boundary(F.col("question"), F.when(F.size("companies") > 0, F.coalesce("report_years", F.array().cast("array<string>"))))
    routed = durable(rows.select("run_id", "question", "companies", reason.alias("reason"), grounding.page_limit(F.col("question"), F.size("companies"), top_n).alias("n_pages")))

    open_ = routed.where("reason is null")
    facts = finance.newest_facts(latest(table(spark, d, "structured_financial_data"), ["fact_id"], "received_at"))
    exact = durable(finance.answers(open_.select(F.col("run_id").alias("query_id"), "question", "companies"), facts).withColumnRenamed("query_id", "run_id"))
    left = open_.join(exact.select("run_id"), "run_id", "left_anti")

    place = corpus.select("chunk_id", "company", "source_file", "page_number", "content").where("source_file is not null and page_number is not null")
    cast = durable(scoped_votes(scored_votes(spark, d).where("method in ('dense', 'bm25')"), left, corpus))
    fused = rankings.weighted_rrf(cast, {"dense": 2.0, "bm25": 1.0}).drop("score").join(place, "chunk_id")
    ranked = reranked(fused.join(left.select("run_id", "question", "n_pages", F.size("companies").alias("n_companies")), "run_id"), rerank)
    required = left.select("run_id", F.posexplode("companies").alias("place", "company"))
    chosen = durable(rankings.diverse_pages(ranked, required, top_n, query="run_id").where("rank <= greatest(n_pages, n_companies)"))
    near = cast.where("method = 'dense'").groupBy("run_id", "chunk_id").agg(F.max("good").alias("near"))
    nearest = near.groupBy("run_id").agg(F.max("near").alias("nearest"))
    best = chosen.join(near, ["run_id", "chunk_id"], "left").groupBy("run_id").agg(F.max(F.when(F.col("judged"), F.col("score"))).alias("score"), F.max("near").alias("near")).join(nearest, "run_id", "left")
    pages = chosen.join(best.where(grounding.relevant(F.col("score"), 1 + F.coalesce("near", "nearest") / 2)).select("run_id"), "run_id", "left_semi")
    text = pages.join(corpus.select("chunk_id", "content"), "chunk_id")
    whole = rankings.expand_pages(text, rankings.page_texts(rankings.of_pages(corpus, pages)))
    cite = F.struct("rank", "company", "source_file", "page_number")
    context = whole.groupBy("run_id").agg(F.array_sort(F.collect_list(cite)).alias("cites"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    found = left.join(context, "run_id", "left").withColumn("route", F.when(F.col("cites").isNull(), LACKING).otherwise(RAG))
    if generate is not None:
        said = generate(found.where(F.col("route") == RAG).select("run_id", "question", F.array_join("texts", "\n").alias("context")))
        found = found.join(said.withColumnRenamed("answer", "_said"), "run_id", "left")
        # an answer with a number its context doesn't bear out is withheld
        checked = F.when(grounding.grounded(F.col("_said"), F.concat_ws("\n", "question", F.array_join("texts", "\n"))), F.col("_said")).otherwise("根据现有信息无法回答该问题（检测到未验证数据）")
        found = found.withColumn("answer", F.when(F.col("route") == RAG, checked).otherwise("根据现有信息无法回答该问题"))
    else:
        found = found.withColumn("answer", F.when(F.col("route") == RAG, F.lit("已完成检索。")).otherwise("根据现有信息无法回答该问题"))
    no_sources = F.array().cast("array<struct<company:string,source_file:string,page_number:int>>")
    refs = F.transform("cites", lambda c: F.struct(c["company"].alias("company"), c["source_file"].alias("source_file"), c["page_number"].alias("page_number")))
    retrieved = found.select("run_id", "route", "companies", "answer", F.when(grounding.is_supported(F.col("answer")), F.coalesce(refs, no_sources)).otherwise(no_sources).alias("sources"))
    refused = routed.where("reason is not null").select("run_id", F.lit(BOUNDARY).alias("route"), "companies", F.col("reason").alias("answer"), no_sources.alias("sources"))
    answered = exact.join(routed.select("run_id", "companies"), "run_id").select("run_id", F.lit(FINANCE).alias("route"), "companies", "answer", "sources")
    unclear = rewritten.where("needs_clarification").select("run_id", F.lit(CLARIFY).alias("route"), F.array().cast("array<string>").alias("companies"), F.col("clarification_question").alias("answer"), no_sources.alias("sources"))
    every = retrieved.unionByName(refused).unionByName(answered).unionByName(unclear)
    preset = F.when(F.col("route") == LACKING, F.lit("insufficient_evidence"))
    return every.select("run_id", "route", F.size("companies").alias("n_companies"), "answer", "sources", outcome(F.col("route"), F.lit(True), grounding.is_supported(F.col("answer")), generate is None, preset).alias("outcome"))
