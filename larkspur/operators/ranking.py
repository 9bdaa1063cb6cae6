"""Ranks within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import bounded_collect, durable

#: Rows of one group that a single task may sort.
HOT = 2_000_000


def largest(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group; of a source with repeated rows it bounds what is left of them."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def rank_within(df: DataFrame, group: list[str], order: list[tuple[str, bool]], out: str = "rank", ties: bool = False, hot: int = HOT, most: int | None = None) -> DataFrame:
    """df with `out`, 1 for the first row of its group, no two rows alike; order lists (column, ascending), and must end in a unique column.
    With ties, rows that differ in that last column only share the least number.

    While every group has at most `hot` rows this is a window over the groups. Beyond, rows are partitioned by range of
    (group, order), so that a large group lies in several tasks; each partition numbers its own rows, and what earlier
    partitions hold of its first group is added. Only two rows of each partition reach the driver.
    Nulls in the order come last. An empty table stays empty.

    most is a bound of the rows of a group, from whatever the caller knows at less cost; without it the groups are counted, for which
    everything df is made from runs once more.
    """
    by: list[Column] = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    if most is None:
        most = largest(df, group)
    if most <= hot:
        number, keys = (F.rank(), by[:-1]) if ties else (F.row_number(), by)
        return df.withColumn(out, number.over(Window.partitionBy(*group).orderBy(*keys)).cast("bigint"))
    keys = [F.col(c).asc_nulls_first() for c in group]
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = durable(df.repartitionByRange(parts, *keys, *by).withColumn("rank_within_part", F.spark_partition_id()))
    local = cut.withColumn("rank_within_n", F.row_number().over(Window.partitionBy("rank_within_part", *group).orderBy(*by)).cast("bigint"))
    counts = cut.groupBy("rank_within_part", *group).agg(F.count(F.lit(1)).alias("n"))
    span = Window.partitionBy("rank_within_part")
    named = F.struct(*[F.col(c) for c in group])
    ends = counts.withColumn("rank_within_g", named).withColumn("rank_within_lo", F.min("rank_within_g").over(span)).withColumn("rank_within_hi", F.max("rank_within_g").over(span))
    rows = bounded_collect(ends.where("rank_within_g = rank_within_lo or rank_within_g = rank_within_hi").select("rank_within_part", *group, "n"), 2 * parts, "ends of ranges")
    before: dict[tuple, int] = {}
    offsets = []
    for r in sorted(rows, key=lambda r: r["rank_within_part"]):
        key = tuple(r[c] for c in group)
        if key in before:
            offsets.append((r["rank_within_part"], key, before[key]))
        before[key] = before.get(key, 0) + r["n"]

    if offsets:
        schema = "rank_within_part int, " + ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in group) + ", rank_within_off bigint"
        table = df.sparkSession.createDataFrame([(p, *k, n) for p, k, n in offsets], schema).alias("o")
        on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group], F.col("l.rank_within_part") == F.col("o.rank_within_part"))
        # at most one row for each partition
        local = local.alias("l").join(F.broadcast(table), on, "left").select("l.*", "rank_within_off")
    else:
        local = local.withColumn("rank_within_off", F.lit(0))
    ranked = local.withColumn(out, F.col("rank_within_n") + F.coalesce("rank_within_off", F.lit(0))).drop("rank_within_part", "rank_within_n", "rank_within_off")
    if not ties:
        return ranked
    value = [*group, *[c for c, _ in order[:-1]]]
    least = ranked.groupBy(*value).agg(F.min(out).alias("rank_within_least")).alias("v")
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"v.{c}")) for c in value])
    return ranked.alias("r").join(least, on).select(*[F.col(f"r.{c}") for c in df.columns], F.col("v.rank_within_least").alias(out))
