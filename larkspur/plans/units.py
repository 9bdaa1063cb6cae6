"""Queries on quantities in mixed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import units
from larkspur.session import table


def p6_quantities(spark: SparkSession, d: str) -> DataFrame:
    facts = units.fact_quantities(table(spark, d, "structured_financial_data"))
    answers = units.answer_quantities(table(spark, d, "test_set_v2"))
    stated = facts.select(F.lit("fact").alias("place"), F.col("fact_id").alias("ref_id"), "item", "kind", "currency", "value", "unit_size", "power", "status")
    return stated.unionByName(answers.withColumn("status", F.lit("stated")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fact = F.col("status").isin("unit change", "differs", "other currency")
    check = (F.col("place") == "check") & (F.col("power") != 0)
    return p6_quantities(spark, d).where(((F.col("place") == "fact") & fact) | check).select("place", "ref_id", "item").distinct()


QUERIES = {f.__name__: f for f in (p6_quantities, p6_found)}
SQL: dict[str, str] = {}
