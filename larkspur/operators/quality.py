"""Traces, feedback and reviewed cases: append-only tables with views of their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.io import append

# Stages and dispositions of a reviewed case.
STAGES = ("query_rewrite", "knowledge_boundary", "pdf_parsing", "chunking", "dense_recall", "bm25_recall", "fusion", "reranker", "generation", "citation", "refusal", "unknown")
DISPOSITIONS = ("evaluation_candidate", "few_shot_candidate", "ignore")


def last_traces(traces: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n newest traces, by a top-n plan that never sorts the whole table."""
    if n < 1:
        raise ValueError("at least one trace must be kept")
    return traces.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_by(df: DataFrame, key: list[str], newest: str, tie: str) -> DataFrame:
    """One row for each key: the newest, of equally new ones the first by tie. Maxima are formed before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(newest), -F.col(tie))).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def few_shot(reviewed: DataFrame, question: str, newest: str, tie: str, n: int = 5) -> DataFrame:
    """The newest example of each question, the n newest of them."""
    return latest_by(reviewed, [question], newest, tie).orderBy(F.desc(newest), tie).limit(n)


def with_latest(left: DataFrame, right: DataFrame, key: str, newest: str, tie: str) -> DataFrame:
    """left with the newest row of right of the same key beside it, null where there is none."""
    return left.join(latest_by(right, [key], newest, tie), key, "left")


def case_state(events: DataFrame, case: str = "bad_case_id", at: str = "reviewed_at", seq: str = "seq") -> DataFrame:
    """Latest state of each case from its append-only events."""
    order = Window.partitionBy(case).orderBy(F.desc_nulls_last(at), F.desc(seq))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def review_violations(events: DataFrame, known: DataFrame, case: str = "bad_case_id") -> DataFrame:
    """Review events that may not be appended: unknown case, stage or disposition, with the rule broken."""
    marked = events.join(known.select(case, F.lit(True).alias("_known")).distinct(), case, "left")
    rule = (
        F.when(F.col("_known").isNull(), F.lit("unknown case"))
        .when(~F.coalesce(F.col("failure_stage").isin(*STAGES), F.lit(False)), F.lit("unknown stage"))
        .when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), F.lit("unknown disposition"))
    )
    return marked.withColumn("rule", rule).where("rule is not null").drop("_known")


def append_reviews(events: DataFrame, known: DataFrame, path: str, case: str = "bad_case_id") -> None:
    """Guarded append of review events: one that breaks a rule stops all of them."""
    broken = review_violations(events, known, case).select(case, "rule").limit(5).collect()
    if broken:
        raise ValueError("reviews that may not be appended: " + "; ".join(f"{r[case]}: {r['rule']}" for r in broken))
    append(events, path)


def export_rows(cases: DataFrame) -> DataFrame:
    """Reviewed cases that are not ignored, as lines of compact JSON that keep non-ASCII text."""
    kept = cases.where((F.col("status") == "reviewed") & (F.col("disposition") != "ignore"))
    return kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))


def source_refs(sources: Column) -> Column:
    """Sources without their text."""
    return F.transform(sources, lambda s: F.struct(s["company"].alias("company"), s["source_file"].alias("source_file"), s["page_number"].alias("page_number")))


def pending_cases(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Useless answers as pending cases with their newest trace; useful ones make none."""
    bad = feedback.where(F.col("feedback") == "useless")
    joined = with_latest(bad, traces, "trace_id", "created_at", "seq") if "seq" in traces.columns else bad.join(traces, "trace_id", "left")
    return joined.withColumn("status", F.lit("pending_review"))
