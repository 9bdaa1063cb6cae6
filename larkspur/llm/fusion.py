"""One ranking from several differently-scaled scores.

Method: reciprocal rank fusion. Items are ranked separately for each score; an item's total is the sum of
1 / (k + rank) over the scores that list it; items are sorted by the total. Only order enters, so no score's range
counts.

Defined cases: spellings of a method (case, outer spaces, hyphen or space for underscore) are one method; a null method
is a method of its own. Repeated votes of one method for one item count once, by the better score. A score that is
null, NaN or infinite is missing: the row then votes with the rank it came with, and if that is no positive number
either, it takes the place after all scored ones. Ranks that came with scored rows are not used. Equal scores share the
better rank, equal totals are ordered by item. Rows without a run or item are left out. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ranking import rank_within
from larkspur.session import durable

#: Of the reference's defaults.
RRF_K = 5
#: Methods whose smaller score is the better one.
DISTANCES = ("dense",)


def method_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def fuse(df: DataFrame, k: int = RRF_K, distances: tuple[str, ...] = DISTANCES, run: str = "run_id", item: str = "chunk_id") -> DataFrame:
    """(run, item, score DOUBLE, rank BIGINT, method 'rrf', n_methods BIGINT) from votes (run, item, method, rank, score)."""
    score = F.col("score").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    claimed = F.when(F.col("rank") >= 1, F.col("rank").cast("bigint"))
    votes = (
        df.where(F.col(run).isNotNull() & F.col(item).isNotNull())
        .select(F.col(run).alias("_run"), F.col(item).alias("_item"), F.coalesce(method_name(F.col("method")), F.lit("")).alias("_method"), score.alias("_raw"), finite.alias("_ok"), claimed.alias("_claimed"))
        # small is good from here on
        .withColumn("_value", F.when(F.col("_ok"), F.when(F.col("_method").isin(*distances), F.col("_raw")).otherwise(-F.col("_raw"))))
        .groupBy("_run", "_method", "_item")
        .agg(F.min("_value").alias("_value"), F.min("_claimed").alias("_claimed"))
    )
    # read for the sizes of groups and for ranking; stored, so that the source is read once
    votes = durable(votes)
    sizes = votes.groupBy("_run", "_method").agg(F.count(F.lit(1)).alias("n")).groupBy("_run").agg(F.max("n").alias("of_method"), F.sum("n").alias("of_run"))
    of_method, of_run = sizes.agg(F.coalesce(F.max("of_method"), F.lit(0)), F.coalesce(F.max("of_run"), F.lit(0))).first()
    # nulls come last, so a missing score without a claimed rank already stands after the scored ones
    numbered = rank_within(votes, ["_run", "_method"], [("_value", True), ("_item", True)], "_n", ties=True, most=of_method)
    ranked = numbered.withColumn("_rank", F.when(F.col("_value").isNull(), F.coalesce("_claimed", "_n")).otherwise(F.col("_n")))
    total = ranked.groupBy("_run", "_item").agg(F.sum(1.0 / (F.lit(k) + F.col("_rank"))).alias("score"), F.count(F.lit(1)).alias("n_methods"))
    # rounding before the sort: the order in which a sum was formed must not decide a tie
    total = total.withColumn("score", F.round("score", 12))
    out = rank_within(total, ["_run"], [("score", False), ("_item", True)], most=of_run)
    return out.select(F.col("_run").alias(run), F.col("_item").alias(item), "score", "rank", F.lit("rrf").alias("method"), "n_methods")

