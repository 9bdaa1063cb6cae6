"""Exact answers from a table of facts: requested metrics, units, formatting, comparison. All arithmetic is decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import any_contains, years

# Metrics, their names in answers, the words that ask for them, and which are amounts.
LABELS = {
    "revenue": "营业收入", "net_profit": "净利润", "total_assets": "总资产", "total_liabilities": "总负债", "equity": "股东权益", "cash_flow": "现金流量",
    "debt_ratio": "负债比率", "asset_liability_ratio": "资产负债率", "roe": "净资产收益率", "net_margin": "净利率",
}
WORDS = {
    "资产负债率": "asset_liability_ratio", "净资产收益率": "roe", "股东权益": "equity", "所有者权益": "equity", "现金流量": "cash_flow", "负债比率": "debt_ratio", "营业收入": "revenue",
    "总资产": "total_assets", "总负债": "total_liabilities", "净利润": "net_profit", "净利率": "net_margin", "现金流": "cash_flow", "净资产": "equity", "营收": "revenue", "净利": "net_profit", "roe": "roe",
}
AMOUNTS = ("revenue", "net_profit", "total_assets", "total_liabilities", "equity", "cash_flow")
EXPLAIN = ("为什么", "原因", "影响因素", "如何改善", "如何提高", "怎么改善", "怎么提高", "分析", "解释", "趋势", "变化原因")
COMPARE = ("相差", "差多少", "差额", "是否相同", "一样", "谁更高", "谁更大", "谁更多")
UNITS = (("CNY", "亿元", "0.00000001"), ("CNY", "万元", "0.0001"), ("USD", "亿美元", "0.00000001"), ("USD", "万美元", "0.0001"))
EXACT = "decimal(22,4)"


def requested_metrics(question: Column) -> Column:
    """Metrics a question asks for, in order of appearance, the longest word at each place."""
    pattern = "(?i)" + "|".join(sorted(WORDS, key=len, reverse=True))
    lookup = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(0)), lambda w: lookup[F.lower(w)]))


def clean(value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def requested_unit(question: Column, currency: Column) -> Column:
    """The unit a question asks for, 'mismatch' if it is one of another currency, or null."""
    out = F.lit(None).cast("string")
    for code, unit, _ in reversed(UNITS):
        out = F.when(F.contains(question, F.lit(unit)), F.when(currency == code, F.lit(unit)).otherwise(F.lit("mismatch"))).otherwise(out)
    return out


def format_amount(value: Column, currency: Column, unit: Column) -> Column:
    """An amount in the unit asked for, else scaled by its size; any currency but yuan prints as dollars."""
    v = value.cast(EXACT)
    asked = F.lit(None).cast("string")
    for _, name, factor in UNITS:
        asked = F.when(unit == name, F.concat(clean(v * F.lit(factor).cast("decimal(9,8)")), F.lit(name))).otherwise(asked)
    size, yuan = F.abs(v), currency == "CNY"
    scaled = (
        F.when(size >= 100_000_000, F.concat(clean(v * F.lit("0.00000001").cast("decimal(9,8)")), F.when(yuan, "亿元").otherwise("亿美元")))
        .when(size >= 10_000, F.concat(clean(v * F.lit("0.0001").cast("decimal(9,8)")), F.when(yuan, "万元").otherwise("万美元")))
        .otherwise(F.concat(clean(v), F.when(yuan, "元").otherwise("美元")))
    )
    return F.coalesce(asked, scaled)


def flatten_facts(facts: DataFrame) -> DataFrame:
    """(company, report_year, currency, source_file, page_number, metric, value, display), with net_margin derived: profit times 100 over revenue, rounded half up to two places."""
    base = ["company", "report_year", "currency", "source_file", "page_number"]
    flat = facts.select(*base, F.explode("metrics").alias("metric", "m")).select(*base, "metric", F.col("m.value").try_cast(EXACT).alias("value"), F.col("m.display").alias("display"))
    both = flat.where(F.col("metric").isin("revenue", "net_profit")).groupBy(*base).agg(F.max(F.when(F.col("metric") == "revenue", F.col("value"))).alias("r"), F.max(F.when(F.col("metric") == "net_profit", F.col("value"))).alias("p"))
    margin = F.round(F.try_divide(F.col("p").cast("decimal(20,4)") * 100, F.col("r").cast("decimal(20,4)")), 2).cast(EXACT)
    derived = both.select(*base, F.lit("net_margin").alias("metric"), margin.alias("value")).where("value is not null")
    return flat.where("value is not null").unionByName(derived.withColumn("display", F.concat(clean(F.col("value")), F.lit("%"))))


def answers(questions: DataFrame, facts: DataFrame, key: str = "query_id", question: str = "question") -> DataFrame:
    """(key, answer, sources ARRAY<STRUCT<company, source_file, page_number>>) of questions (key, question, companies ARRAY) the facts can answer.

    No answer: no company or metric, an explanation asked for, a company or metric without facts, another year, a unit of another currency,
    or a difference across currencies. A fact without a year answers no question about one, and is told without it. facts has one row for each company.
    """
    rows = questions.select(F.col(key), F.col(question).alias("q"), "companies", requested_metrics(F.col(question)).alias("metrics"))
    open_ = rows.where((F.size("companies") > 0) & (F.size("metrics") > 0) & ~any_contains(F.col("q"), EXPLAIN))
    wanted = open_.select(key, "q", "companies", "metrics", F.posexplode("companies").alias("c_pos", "company")).select("*", F.posexplode("metrics").alias("m_pos", "metric"))
    found = wanted.join(flatten_facts(facts), ["company", "metric"], "left")
    amount = F.col("metric").isin(*AMOUNTS)
    unit = requested_unit(F.col("q"), F.col("currency"))
    fits = F.col("value").isNotNull() & ((F.size(years(F.col("q"))) == 0) | F.array_contains(years(F.col("q")), F.col("report_year").cast("string"))) & ~(amount & F.coalesce(unit == "mismatch", F.lit(False)))
    # a value without a printed form is printed here
    printed = F.coalesce("display", F.when(amount, format_amount(F.col("value"), F.col("currency"), F.lit(None).cast("string"))).otherwise(F.concat(clean(F.col("value")), F.lit("%"))))
    shown = F.when(amount & unit.isNotNull(), format_amount(F.col("value"), F.col("currency"), unit)).otherwise(printed)
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    said = found.withColumn("fact", F.concat(labels[F.col("metric")], F.lit("为"), shown)).withColumn("fits", F.coalesce(fits, F.lit(False)))
    cell = F.struct("c_pos", "m_pos", "company", "report_year", "fact", "value", "currency", "source_file", "page_number", "metric")
    one = said.groupBy(key, "q").agg(F.min("fits").alias("fits"), F.array_sort(F.collect_list(cell)).alias("cells"), F.max("c_pos").alias("last"), F.max("m_pos").alias("last_metric")).where("fits")
    lines = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda i: F.concat(
            F.filter("cells", lambda c: c["c_pos"] == i)[0]["company"], F.coalesce(F.concat(F.filter("cells", lambda c: c["c_pos"] == i)[0]["report_year"].cast("string"), F.lit("年")), F.lit("")),
            F.array_join(F.transform(F.filter("cells", lambda c: c["c_pos"] == i), lambda c: c["fact"]), "，"),
        ),
    )
    a, b = F.col("cells")[0], F.get(F.col("cells"), F.lit(1))
    comparable = (F.col("last") == 1) & (F.col("last_metric") == 0) & any_contains(F.col("q"), COMPARE)
    gap = F.abs(a["value"] - b["value"]).cast(EXACT)
    difference = F.when(~a["metric"].isin(*AMOUNTS), F.concat(F.lit("两者相差"), clean(gap), F.lit("个百分点。"))).when(
        a["currency"] == b["currency"], F.concat(F.lit("两者相差"), format_amount(gap, a["currency"], requested_unit(F.col("q"), a["currency"])), F.lit("。"))
    )
    end = (
        F.when(~comparable, F.lit(""))
        .when(any_contains(F.col("q"), ("相同", "一样")), F.when(a["value"] == b["value"], "两者相同。").otherwise("两者不相同。"))
        .when(any_contains(F.col("q"), ("相差", "差多少", "差额")), difference)
        .when(a["value"] == b["value"], F.lit("两者相同。"))
        .otherwise(F.concat(F.when(a["value"] > b["value"], a["company"]).otherwise(b["company"]), F.lit("更高。")))
    )
    sources = F.array_distinct(F.transform("cells", lambda c: F.struct(c["company"].alias("company"), c["source_file"].alias("source_file"), c["page_number"].alias("page_number"))))
    return one.withColumn("end", end).where("end is not null").select(key, F.concat(F.array_join(lines, "；"), F.lit("。"), "end").alias("answer"), sources.alias("sources"))


def newest_facts(facts: DataFrame) -> DataFrame:
    """The facts of each company's newest report, the last recorded of several. Maxima are formed before the shuffle, however many facts a company has."""
    rest = [c for c in facts.columns if c != "company"]
    best = facts.groupBy("company").agg(F.max_by(F.struct(*rest), F.struct("report_year", "recorded_at", "fact_id")).alias("_f"))
    return best.select("company", *[F.col(f"_f.{c}").alias(c) for c in rest])
