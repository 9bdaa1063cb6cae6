"""Evaluation measures. What was not measured is null, never a success; each says what its denominators are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("hit", "recall", "precision", "mrr", "map", "ndcg")


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discounted(grade: Column, rank: Column) -> Column:
    return gain(grade) / F.log2(rank + 1.0)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...], by: list[str], query: list[str], page: list[str], missing: str = "null", graded_only: bool = True) -> DataFrame:
    """(by, query, k, hit, recall, precision, mrr, map, ndcg) for every row of queries (by, query).

    ranked (by, query, page, rank) holds unique pages; gold (query, page, grade). Precision divides by k, recall and map by
    all relevant pages. missing: 'null' leaves recall, map and ndcg null without relevant pages, 'zero' makes them 0.
    graded_only: pages of grade 0 are not relevant; otherwise every gold page is.
    """
    relevant = gold.withColumn("grade", F.greatest(F.col("grade"), F.lit(0)).cast("int"))
    if graded_only:
        relevant = relevant.where("grade > 0")
    relevant = relevant.groupBy(*query, *page).agg(F.max("grade").alias("grade"))
    ideal = relevant.withColumn("_i", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("grade"))))
    grid = F.explode(F.array(*map(F.lit, ks))).alias("k")
    wanted = queries.select(*by, *query).distinct().select("*", grid)
    best = ideal.select(*query, "_i", "grade", grid).groupBy(*query, "k").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("_i") <= F.col("k"), discounted(F.col("grade"), F.col("_i")))).alias("idcg"))
    hits = ranked.where(F.col("rank") <= max(ks)).join(relevant, [*query, *page])
    so_far = Window.partitionBy(*by, *query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = hits.withColumn("_hits", F.count(F.lit(1)).over(so_far)).select(*by, *query, "rank", "grade", "_hits", grid).where(F.col("rank") <= F.col("k"))
    found = marked.groupBy(*by, *query, "k").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("first"), F.sum(F.col("_hits") / F.col("rank")).alias("precisions"), F.sum(discounted(F.col("grade"), F.col("rank"))).alias("dcg")
    )
    rows = wanted.join(best, [*query, "k"], "left").join(found, [*by, *query, "k"], "left")
    n = F.coalesce("n_hits", F.lit(0))

    def ratio(part: Column, whole: str) -> Column:
        value = F.coalesce(part, F.lit(0.0)) / F.col(whole)
        none = F.lit(None).cast("double") if missing == "null" else F.lit(0.0)
        return F.when(F.col(whole) > 0, value).otherwise(none)

    return rows.select(
        *by,
        *query,
        "k",
        (n > 0).cast("double").alias("hit"),
        ratio(n, "n_relevant").alias("recall"),
        (n / F.col("k")).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio(F.col("precisions"), "n_relevant").alias("map"),
        ratio(F.col("dcg"), "idcg").alias("ndcg"),
    )


def macro_means(rows: DataFrame, by: list[str], empty: float | None = None) -> DataFrame:
    """Mean of each measure over queries, nulls left out; a group without any value gets `empty`."""
    means = [F.avg(m).alias(m) for m in MEASURES]
    out = rows.groupBy(*by, "k").agg(*means, F.count(F.lit(1)).alias("n_queries"))
    return out.fillna(empty, list(MEASURES)) if empty is not None else out


def stage_metrics(rows: DataFrame, eligible: DataFrame, by: str = "method") -> DataFrame:
    """Means of each stage with its coverage: measured by eligible queries. eligible has (by, n_eligible)."""
    means = macro_means(rows, [by])
    return means.join(eligible, by).withColumn("coverage", F.try_divide(F.col("n_queries").cast("double"), F.col("n_eligible")))


def refusal_matrix(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion matrix of (answerable, predicted_refusal nullable, error nullable), positive = refusal.

    Rows with an error or without a decision are unclassified. refusal_success_rate divides by all unanswerable rows, the
    other ratios by measured ones; a ratio over nothing is null.
    """
    measured = F.col("error").isNull() & F.col("predicted_refusal").isNotNull()
    refused, answerable = F.col("predicted_refusal"), F.col("answerable")
    counted = rows.groupBy(*(by or [])).agg(
        F.count_if(measured & ~answerable & refused).alias("tp"),
        F.count_if(measured & ~answerable & ~refused).alias("fn"),
        F.count_if(measured & answerable & refused).alias("fp"),
        F.count_if(measured & answerable & ~refused).alias("tn"),
        F.count_if(~answerable).alias("unanswerable"),
        F.count_if(measured).alias("measured"),
        F.count(F.lit(1)).alias("total"),
    )

    def div(a: str | Column, b: Column) -> Column:
        return F.try_divide((F.col(a) if isinstance(a, str) else a).cast("double"), b)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *(by or []), "tp", "fp", "fn", "tn",
        div("tp", tp + fp).alias("precision"), div("tp", tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tp + tn, F.col("measured")).alias("accuracy_on_measured"), div("fp", fp + tn).alias("false_refusal_rate"),
        div("tp", F.col("unanswerable")).alias("refusal_success_rate"), "measured", (F.col("total") - F.col("measured")).alias("unclassified"),
        div("measured", F.col("total")).alias("coverage"),
    )


def latency_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean and the exact 50th and 95th percentiles, linearly interpolated."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def token_usage(rows: DataFrame, prompt_price: float | None = None, completion_price: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums over rows that report all of prompt_tokens, completion_tokens and total_tokens, and their cost at prices per million; null where nothing or no price is known."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    full = F.lit(True)
    for c in names:
        full = full & F.col(c).isNotNull() & (F.col(c) >= 0)
    sums = rows.groupBy(*(by or [])).agg(*[F.sum(F.when(full, F.col(c))).alias(c) for c in names], F.count_if(full).alias("measured_queries"), F.count(F.lit(1)).alias("total_queries"))
    price = (F.col("prompt_tokens") * F.lit(prompt_price).cast("double") + F.col("completion_tokens") * F.lit(completion_price).cast("double")) / 1_000_000
    return sums.withColumn("cost", price)


def claim_support(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: macro faithfulness (mean over answers) beside pooled support (over claims) of (query_id, supported); answers without claims are left out of the former."""
    per = claims.groupBy("query_id").agg(F.avg(F.col("supported").cast("double")).alias("share"), F.count(F.lit(1)).alias("n"), F.count_if("supported").alias("ok"))
    joined = reviews.select("query_id").distinct().join(per, "query_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("reviewed_queries"), F.avg("share").alias("faithfulness"), F.try_divide(F.sum("ok").cast("double"), F.sum("n")).alias("claim_support"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("reviewed_claims"), F.coalesce(F.sum("ok"), F.lit(0)).alias("supported_claims"),
    )


def paired_lift(before: DataFrame, after: DataFrame, key: list[str], by: list[str], measures: tuple[str, ...] = ("hit", "mrr")) -> DataFrame:
    """Means before and after and their difference, over keys measured on both sides, with coverage of the keys of before."""
    names = [*by, *[k for k in key if k not in by]]
    a = before.select(*names, *[F.col(m).alias(f"{m}_original") for m in measures])
    b = after.select(*names, *[F.col(m).alias(f"{m}_rewritten") for m in measures], F.lit(True).alias("_both"))
    agg = []
    for m in measures:
        x, y = F.when(F.col("_both"), F.col(f"{m}_original")), F.col(f"{m}_rewritten")
        agg += [F.avg(x).alias(f"{m}_original"), F.avg(y).alias(f"{m}_rewritten"), (F.avg(y) - F.avg(x)).alias(f"{m}_lift")]
    return a.join(b, names, "left").groupBy(*by).agg(*agg, F.count_if("_both").alias("paired"), F.try_divide(F.count_if("_both").cast("double"), F.count(F.lit(1))).alias("coverage"))


def matched_pairs(candidate: DataFrame, baseline: DataFrame, key: list[str], measures: tuple[str, ...]) -> DataFrame:
    """(key, measure, baseline, candidate) of a paired comparison. Both sides must have the same keys; one that only one side has raises when its row is read."""
    a = candidate.select(*key, F.struct(*measures).alias("_a"))
    b = baseline.select(*key, F.struct(*measures).alias("_b"))
    lost = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("only one side has "), F.to_json(F.struct(*key)))))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_b.{m}").alias("baseline"), F.col(f"_a.{m}").alias("candidate")) for m in measures])).alias("p")
    return a.join(b, key, "full").where(lost.isNull()).select(*key, each).select(*key, "p.*")


def human_review(reviews: DataFrame, claims: DataFrame, total: int) -> DataFrame:
    """One row over accepted reviews (query_id, semantic_answer_correct, answer_relevance, completeness) and their claims (query_id, supported): coverage of `total` results, means of the judgments, and claim support."""
    judged = reviews.agg(
        F.try_divide(F.count(F.lit(1)).cast("double"), F.lit(total)).alias("coverage"), F.avg(F.col("semantic_answer_correct").cast("double")).alias("semantic_answer_accuracy"),
        F.avg(F.col("answer_relevance") / 2).alias("answer_relevance"), F.avg(F.col("completeness") / 2).alias("completeness"),
    )
    # both sides are one row
    return claim_support(claims, reviews).withColumn("total_queries", F.lit(total)).crossJoin(judged)


def win_tie_loss(pairs: DataFrame, by: list[str], baseline: str, candidate: str, tolerance: float = 1e-12) -> DataFrame:
    """Counts of candidates above, level with and below their baseline."""
    d = F.col(candidate) - F.col(baseline)
    return pairs.groupBy(*by).agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"), F.avg(d).alias("mean_difference"))


def paired_bootstrap(pairs: DataFrame, by: list[str], baseline: str, candidate: str, samples: int = 10_000, seed: int = 20260901) -> DataFrame:
    """(by, mean_difference, ci_low, ci_high): percentile interval at 95 % of the mean difference over resampled pairs.

    Differences are pre-aggregated into (value, count), so a group's size at a task is that of its distinct values; a resample is
    a multinomial draw of the counts. The generator of each group is seeded by seed and the group's name, whatever the partitioning.
    """
    import numpy as np
    import pandas as pd

    d = F.round(F.col(candidate) - F.col(baseline), 9).alias("d")
    counted = pairs.select(*by, d).where("d is not null").groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("d")
        values, n = pdf.d.to_numpy(float), pdf.n.to_numpy(np.int64)
        total = int(n.sum())
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        means = np.empty(samples)
        step = max(1, 2_000_000 // max(1, len(values)))
        for at in range(0, samples, step):
            m = min(step, samples - at)
            means[at : at + m] = rng.multinomial(total, n / total, size=m) @ values / total
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([[*key, float((values * n).sum() / total), float(low), float(high)]], columns=[*by, "mean_difference", "ci_low", "ci_high"])

    inner = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    return counted.groupBy(*by).applyInPandas(run, f"{inner}, mean_difference double, ci_low double, ci_high double")
