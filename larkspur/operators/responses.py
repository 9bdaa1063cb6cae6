"""Responses of a question-answering service against their cases: one row of measures each, and the summary of a run.

Three-valued throughout: null is not measured. A failed task is neither a right answer nor a refusal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import canonical_digest, checks_pass
from larkspur.operators import grounding

# What a failed generation reports, and the ranked stages of the retrieval route.
FAILED = ("failed", "error", "timeout", "not_configured", "invalid_response")
STAGES = ("dense", "bm25", "fused", "reranked")
PAGE = "array<struct<source_file:string,page_number:int>>"


def pages_of(items: Column) -> Column:
    """Distinct (source_file, page_number) of items that name both, in order."""
    named = F.filter(items, lambda s: (F.coalesce(s["source_file"], F.lit("")) != "") & (F.coalesce(s["page_number"], F.lit(0)) != 0))
    return F.array_distinct(F.transform(named, lambda s: F.struct(s["source_file"].alias("source_file"), s["page_number"].alias("page_number"))))


def gold_of(pages: Column, default_grade: int = 3) -> Column:
    """Distinct gold pages of a positive grade; a missing grade is the highest."""
    return pages_of(F.filter(pages, lambda p: F.coalesce(p["relevance_grade"], F.lit(default_grade)) > 0))


def evaluate(cases: DataFrame, responses: DataFrame, retrieval_only: bool = False) -> DataFrame:
    """One row for each case with a response.

    cases (query_id, answerable, answer_checks, gold_pages); responses (query_id, answer, success, route, outcome, llm_status, source_documents,
    stages MAP<STRING, ARRAY<page>>, latency_seconds). Stage pages count on the retrieval route only.
    """
    j = cases.join(responses, "query_id")
    only = F.lit(retrieval_only)
    failed = F.coalesce(~F.col("success"), F.lit(False)) | F.coalesce(F.col("outcome") == "service_error", F.lit(False)) | F.coalesce(F.col("llm_status").isin(*FAILED), F.lit(False))
    decided = (
        F.when(only | F.col("failed") | F.coalesce(F.col("outcome") == "clarification", F.lit(False)), F.lit(None).cast("boolean"))
        .when(F.col("outcome").isin("refused", "insufficient_evidence"), True)
        .when(F.col("outcome") == "answered", False)
        .otherwise(grounding.is_refusal(F.coalesce("answer", F.lit(""))))
    )
    fields = F.when(only | ~F.col("answerable"), F.lit(None).cast("boolean")).when(F.col("failed"), False).otherwise(checks_pass(F.coalesce("answer", F.lit("")), F.col("answer_checks")))
    none = F.array().cast(PAGE)
    rows = (
        j.withColumn("failed", failed)
        .withColumn("predicted_refusal", decided)
        .withColumn("lexical_field_pass", fields)
        .withColumn("expected", F.coalesce(gold_of(F.col("gold_pages")), none))
        .withColumn("predicted", F.coalesce(pages_of(F.col("source_documents")), none))
        .withColumn("hits", F.array_intersect("expected", "predicted"))
    )
    refused = F.col("predicted_refusal")
    hit = F.size("hits") > 0
    passed = F.when(
        only | (F.col("answerable") & F.col("lexical_field_pass").isNull()), F.lit(None).cast("boolean")
    ).when(F.col("answerable"), ~F.col("failed") & F.coalesce(~refused, F.lit(False)) & F.coalesce("lexical_field_pass", F.lit(False)) & hit).otherwise(
        ~F.col("failed") & F.coalesce(refused, F.lit(False)) & (F.size("predicted") == 0)
    )
    ranked = F.when(F.col("route") == "rag", F.map_from_arrays(F.array(*map(F.lit, STAGES)), F.array(*[pages_of(F.try_element_at("stages", F.lit(s))) for s in STAGES])))
    fused, reranked = F.try_element_at("stage_pages", F.lit("fused")), F.try_element_at("stage_pages", F.lit("reranked"))
    return rows.withColumn("stage_pages", ranked).select(
        "query_id", "answerable", "route", "outcome", "predicted_refusal", "lexical_field_pass",
        F.when(F.col("answerable"), F.col("lexical_field_pass")).otherwise(refused).alias("answer_pass"),
        F.when(F.col("answerable"), ~refused).otherwise(refused).alias("refusal_pass"),
        F.when(F.col("answerable"), hit).alias("citation_hit"),
        F.try_divide(F.size("hits").cast("double"), F.size("expected")).alias("citation_recall"),
        F.coalesce(F.try_divide(F.size("hits").cast("double"), F.size("predicted")), F.lit(0.0)).alias("citation_precision"),
        passed.alias("lexical_end_to_end_pass"), "latency_seconds", "stage_pages", F.size("predicted").alias("n_sources"),
        F.array_sort(F.array_except(F.array_intersect("expected", fused), reranked)).alias("lost_gold_pages"),
        F.array_sort(F.array_except(F.array_intersect("expected", reranked), fused)).alias("gained_gold_pages"),
        F.when(F.col("failed"), "task failure").alias("error"),
        F.when(F.col("llm_status") == "timeout", "timeout").when(F.col("failed"), "task_failure").alias("error_type"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row of a run's means over evaluated responses, each over what was measured."""
    a = F.col("answerable")

    def mean(c: str, where: Column | None = None) -> Column:
        value = F.col(c).cast("double")
        return F.avg(F.when(where, value) if where is not None else value)

    return rows.agg(
        F.count(F.lit(1)).alias("total"), mean("lexical_field_pass", a).alias("lexical_field_pass_rate"),
        F.try_divide(F.count_if(a & F.col("lexical_field_pass").isNotNull()).cast("double"), F.count_if(a)).alias("lexical_field_check_coverage"),
        mean("citation_hit", a).alias("citation_hit_rate"), mean("citation_recall", a).alias("citation_recall"), mean("citation_precision", a).alias("citation_precision"),
        F.avg(F.when(~a, (F.col("error").isNull() & (F.col("n_sources") == 0)).cast("double"))).alias("zero_source_rate_on_unanswerable"), mean("lexical_end_to_end_pass").alias("lexical_end_to_end_pass_rate"),
        F.count("error").alias("errors"),
    )


def performance(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Latency of all and of successful requests, error and timeout rates, overall or by route."""
    ok = F.when(F.col("error").isNull(), F.col("latency_seconds"))
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(
        n.alias("requests"), F.count("error").alias("errors"), F.try_divide(F.count("error").cast("double"), n).alias("error_rate"), F.try_divide(F.count_if(F.col("error_type") == "timeout").cast("double"), n).alias("timeout_rate"),
        F.avg("latency_seconds").alias("mean"), F.percentile("latency_seconds", F.lit(0.5)).alias("p50"), F.percentile("latency_seconds", F.lit(0.95)).alias("p95"), F.avg(ok).alias("mean_successful"),
    )


def report(rows: DataFrame, refusal: DataFrame | None = None, stages: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """One row for a run: its summary, performance and route counts, and as given the refusal measures and review measures (one row each) and stage measures (a row for each stage and cut, as an array)."""
    routes = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("route", F.lit("")), "n")))).alias("route_distribution"))
    # every side is one row
    out = summary(rows).crossJoin(performance(rows).select(F.struct("*").alias("performance"))).crossJoin(routes)
    for name, one in (("refusal", refusal), ("human_review", review)):
        if one is not None:
            out = out.crossJoin(one.select(F.struct("*").alias(name)))
    if stages is not None:
        out = out.crossJoin(stages.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("stage_metrics")))
    return out


def stage_totals(timings: DataFrame, key: str = "trace_id") -> DataFrame:
    """(key, stage, ms): a stage measured repeatedly within one request adds up."""
    return timings.groupBy(key, "stage").agg(F.round(F.sum("ms"), 3).alias("ms"))


def review_template(rows: DataFrame) -> DataFrame:
    """An empty review for each answer, bound to the exact answer by its digest."""
    blank = lambda t: F.lit(None).cast(t)
    return rows.select(
        "query_id", canonical_digest(F.col("answer")).alias("answer_sha256"), F.lit("").alias("reviewer"), F.lit(False).alias("review_complete"), blank("boolean").alias("semantic_answer_correct"),
        blank("int").alias("answer_relevance"), blank("int").alias("completeness"), F.array().cast("array<struct<claim:string,supported:boolean,evidence:array<struct<source_file:string,page_number:int,quote:string>>>>").alias("claims"), F.lit("").alias("notes"),
    )


def rerank_route(n_candidates: Column, n_pages: Column, n_companies: Column, has_client: bool) -> Column:
    """Who re-ranks a request: nobody without candidates, the local method for several pages of at most one company or without a client, else the client."""
    return (
        F.when(n_candidates == 0, F.lit("none")).when((n_pages > 1) & (n_companies <= 1), F.lit("local_bm25_multi_page")).when(F.lit(not has_client), F.lit("local_bm25_no_api_key")).otherwise(F.lit("cloud_reranker"))
    )
