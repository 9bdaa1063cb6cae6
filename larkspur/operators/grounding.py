"""Predicates on questions and answers, and the check that an answer's numbers come from its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.columns import any_contains, is_blank, years

# Patterns of the boundary, refusal and support checks.
SECURITY = ("api key", "api_key", "apikey", "系统提示词", "检索提示词", "打印提示词", "忽略知识库", "假装知道", "必须虚构", "编一个", "手机号", "联系电话并告诉我")
REALTIME = ("今天", "今日", "当前", "实时", "本周", "明天", "收盘价", "涨跌幅")
REFUSALS = ("无法回答", "无法获取答案", "未找到", "没有相关", "知识库中没有", "不包含", "未披露", "无法确定", "信息不足", "没有足够", "不能提供", "不支持查询")
BLOCKED = ("无法回答", "未找到", "无法获取答案", "API 密钥尚未配置", "检测到未验证数据", "检测到未提及实体")
MULTI_PAGE = ("董事会变更", "治理结构", "环境与社会", "环境和社会", "碳抵消", "二氧化碳", "能源消耗", "跨页")
RERANK_LEAST, COSINE_LEAST = 0.15, 0.35


def boundary(question: Column, report_years: Column) -> Column:
    """'security', 'realtime', 'years:…' with the years the reports don't cover, or null; report_years is null without a named company."""
    asked = F.array_distinct(years(question))
    lacking = F.array_sort(F.array_except(asked, report_years))
    return (
        F.when(any_contains(F.lower(question), SECURITY), F.lit("security"))
        .when(any_contains(question, REALTIME), F.lit("realtime"))
        .when(report_years.isNotNull() & (F.size(lacking) > 0), F.concat(F.lit("years:"), F.array_join(lacking, "、")))
    )


def is_refusal(answer: Column) -> Column:
    return any_contains(answer, REFUSALS)


def is_supported(answer: Column) -> Column:
    return ~is_blank(answer) & ~any_contains(answer, BLOCKED)


def page_limit(question: Column, n_companies: Column, top_n: int = 3) -> Column:
    """Pages a question needs: one for each of several companies, two for topics that span pages, else one; at most top_n."""
    return F.when(n_companies >= 2, F.least(F.lit(top_n), n_companies)).when(any_contains(question, MULTI_PAGE), F.lit(min(top_n, 2))).otherwise(F.lit(1)).cast("int")


def relevant(best_rerank: Column, best_cosine: Column) -> Column:
    """Whether a result is relevant: by the best re-ranker score if there is one, else the best cosine, else no."""
    return F.coalesce(best_rerank >= RERANK_LEAST, best_cosine >= COSINE_LEAST, F.lit(False))


def numbers(text: Column) -> Column:
    """The numbers of a text that do not begin within a word, as doubles."""
    plain = F.translate(text, "０１２３４５６７８９", "0123456789")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9])\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda v: v.isNotNull())


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), F.abs(b) * 1e-6)


def grounded(answer: Column, context: Column) -> Column:
    """Whether every number of the answer is a number of the context, one times or over 100 or 10,000, or the difference, sum, ratio or percentage of two of them.

    Each distinct number of a context is held once; contexts are few pages.
    """
    source = F.array_distinct(numbers(context))

    def one(v: Column) -> Column:
        return F.exists(source, lambda s: close(v, s) | close(v, s * 100) | close(v, s / 100) | close(v, s * 10000) | close(v, s / 10000))

    def two(v: Column) -> Column:
        def pair(a: Column, b: Column) -> Column:
            ratio = F.try_divide(a, b)
            return close(v, F.abs(a - b)) | close(v, a + b) | F.coalesce(close(v, ratio) | close(v, ratio * 100), F.lit(False))

        return F.exists(source, lambda a: F.exists(source, lambda b: pair(a, b)))

    return F.forall(F.array_distinct(numbers(answer)), lambda v: one(v) | two(v))
