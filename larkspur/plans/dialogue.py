"""Queries of the question side: follow-ups, scope, boundary, finance answers, grounding, and the batched pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import conversation, finance, grounding, quality, scope
from larkspur.plans import pipeline
from larkspur.plans.retrieval import ALIASES, CH, chunks
from larkspur.session import durable, latest, table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "multiturn_query_rewrite").distinct()


def latest_user_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = _cases(spark, d).select("id", F.posexplode(conversation.user_turns(F.col("history"))).alias("place", "turn"))
    return turns.select("id", F.col("place").cast("bigint").alias("place"), "turn")


def latest_slots(spark: SparkSession, d: str) -> DataFrame:
    s = conversation.latest_slots(_cases(spark, d))
    return s.select("id", F.array_join("years", ",").alias("years"), F.array_join("topics", ",").alias("topics"))


def rewrite_query(spark: SparkSession, d: str) -> DataFrame:
    return conversation.rewrite_questions(_cases(spark, d), scope.aliases(table(spark, d, "companies")))


def slot_accuracy(spark: SparkSession, d: str) -> DataFrame:
    cases, known = _cases(spark, d), scope.aliases(table(spark, d, "companies"))
    acc = conversation.slot_accuracy(conversation.slot_checks(cases, durable(rewrite_query(spark, d)), known))
    return acc.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


def _companies_of(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, question, companies ARRAY in order of alias length) of each request."""
    asked = table(spark, d, "query_requests").where("question is not null").groupBy("run_id").agg(F.min("question").alias("question"))
    named = scope.mentioned(asked, scope.aliases(table(spark, d, "companies")), "run_id", "question")
    listed = named.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "company"))), lambda x: x["company"]).alias("companies"))
    return asked.join(listed, "run_id", "left").withColumn("companies", F.coalesce("companies", F.array().cast("array<string>")))


def boundary_reason(spark: SparkSession, d: str) -> DataFrame:
    """Requests a static report can't answer; the years covered are those in the texts of the named companies' files."""
    asked = _companies_of(spark, d)
    covered = chunks(spark, d, "company", "content").where("company is not null").select("company", F.explode(F.array_distinct(C.years(F.coalesce("content", F.lit(""))))).alias("year")).distinct()
    years_of = asked.select("run_id", F.explode("companies").alias("company")).join(covered, "company").groupBy("run_id").agg(F.collect_set("year").alias("report_years"))
    j = asked.join(years_of, "run_id", "left")
    known = F.when(F.size("companies") > 0, F.coalesce("report_years", F.array().cast("array<string>")))
    return j.select("run_id", grounding.boundary(F.col("question"), known).alias("reason")).where("reason is not null")


def page_limits(spark: SparkSession, d: str) -> DataFrame:
    return _companies_of(spark, d).select("run_id", grounding.page_limit(F.col("question"), F.size("companies")).alias("n_pages"))


def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Runs and whether their best re-ranker score passes; runs without one are judged by 1 - distance / 2 of the best dense result."""
    name = F.regexp_replace(F.lower(F.trim("method")), r"[\s-]+", "_")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    best = table(spark, d, "ranked_documents").where(finite).groupBy("run_id").agg(F.max(F.when(name == "reranker", F.col("score"))).alias("r"), F.min(F.when(name == "dense", F.col("score"))).alias("dist"))
    return best.select("run_id", grounding.relevant(F.col("r"), 1 - F.col("dist") / 2).alias("relevant"))


def numeric_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Answers and whether all their numbers come from the question or the alternatives of their checks."""
    t = table(spark, d, "test_set_v2").where("gold_answer is not null").select("query_id", "question", "gold_answer", "answer_checks").distinct()
    context = F.concat_ws("\n", F.coalesce("question", F.lit("")), F.array_join(F.flatten(F.coalesce(F.col("answer_checks"), F.array().cast("array<array<string>>"))), "\n"))
    return t.select("query_id", grounding.grounded(F.col("gold_answer"), context).alias("grounded"), F.size(grounding.numbers(F.col("gold_answer"))).alias("n_numbers"))


def finance_answer(spark: SparkSession, d: str) -> DataFrame:
    asked = _companies_of(spark, d).withColumnRenamed("run_id", "query_id")
    facts = finance.newest_facts(latest(table(spark, d, "structured_financial_data"), ["fact_id"], "received_at"))
    return finance.answers(asked, facts)


def finance_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = finance.newest_facts(latest(table(spark, d, "structured_financial_data"), ["fact_id"], "received_at"))
    return finance.flatten_facts(facts).select("company", "report_year", "metric", F.col("value").cast("double").alias("value"))


def requested_metrics(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "query_requests").where("question is not null").select("run_id", "question").distinct()
    return asked.select("run_id", F.posexplode(finance.requested_metrics(F.col("question"))).alias("place", "metric"))


def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.answer_batch(spark, d)


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.answer_batch(spark, d).groupBy("route", "outcome").agg(F.count(F.lit(1)).alias("n"))


def trace_ring(spark: SparkSession, d: str) -> DataFrame:
    return quality.last_traces(table(spark, d, "events").select("event_id", "ts", "event_type"), 500, ["ts", "event_id"])


def few_shot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "query_requests").where("question is not null").groupBy("run_id", "question").agg(F.max("asked_at").alias("asked_at"))
    return quality.few_shot(rows, "question", "asked_at", "run_id").select("question", "run_id", "asked_at")


def case_latest(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their newest request beside each of their requests of the web channel."""
    rows = table(spark, d, "query_requests").where("session_id is not null").groupBy("run_id", "session_id", "channel").agg(F.max("asked_at").alias("asked_at"))
    newest = rows.select("session_id", F.col("run_id").alias("latest_run"), F.col("asked_at").alias("latest_at"))
    left = rows.where("channel = 'ui'").select("run_id", "session_id")
    return quality.with_latest(left, newest, "session_id", "latest_at", "latest_run").select("run_id", "session_id", "latest_run")


def trace_ids(spark: SparkSession, d: str) -> DataFrame:
    """The last four events of each user, newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("place", F.row_number().over(order)).where("place <= 4").select("user_id", "event_id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        latest_user_turns, latest_slots, rewrite_query, slot_accuracy, boundary_reason, page_limits, relevance_gate, numeric_grounding, finance_answer, finance_facts, requested_metrics,
        answer_batch, outcome_counts, trace_ring, few_shot, case_latest, trace_ids,
    )
}

_S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_TURNS = rf"""c as (select distinct id, history, question from multiturn_query_rewrite),
u as (select id, list_transform(list_filter(history, lambda h: lower(h.role) = 'user' and regexp_replace(coalesce(h.content, ''), '^{_S}+|{_S}+$', '', 'g') <> ''), lambda h: substring(regexp_replace(h.content, '^{_S}+|{_S}+$', '', 'g'), 1, 500)) as a from c),
t as (select id, case when len(a) > 4 then a[len(a) - 3:] else coalesce(a, []) end as turns from u)"""
_TOPICS = "[" + ", ".join(f"'{t}'" for t in C.TOPICS) + "]"
_ASKED = ALIASES + """,
asked as (select run_id, min(question) as question from query_requests where question is not null group by 1),
named as (select run_id, company from asked join aliases on contains(lower(question), alias) group by 1, 2)"""


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_FACTS = """f0 as (select * exclude (n) from (select *, row_number() over (partition by fact_id order by received_at desc) as n from structured_financial_data) where n = 1),
f1 as (select * exclude (n) from (select *, row_number() over (partition by company order by report_year desc, recorded_at desc, fact_id desc) as n from f0) where n = 1),
flat as (select company, report_year, m.key as metric, try_cast(m.value.value as decimal(22, 4)) as value from (select company, report_year, unnest(map_entries(metrics)) as m from f1))"""
_NUMBERS = r"list_distinct(list_transform(regexp_extract_all(translate({}, '０１２３４５６７８９', '0123456789'), '(?:^|[^A-Za-z0-9])([0-9][0-9,]*(?:\.[0-9]+)?)', 1), lambda x: replace(x, ',', '')::double))"
_CLOSE = "abs({0} - {1}) <= greatest(1e-6, abs({1}) * 1e-6)"
SQL = {
    "numeric_grounding": f"""with t as (select row_number() over () as id, * from (select distinct query_id, question, gold_answer, answer_checks from test_set_v2 where gold_answer is not null)),
r as (select id, query_id, {_NUMBERS.format('gold_answer')} as said, {_NUMBERS.format("coalesce(question, '') || chr(10) || coalesce(array_to_string(flatten(answer_checks), chr(10)), '')")} as known,
  len(regexp_extract_all(translate(gold_answer, '０１２３４５６７８９', '0123456789'), '(?:^|[^A-Za-z0-9])([0-9][0-9,]*(?:\\.[0-9]+)?)', 1))::int as n from t),
a as (select id, unnest(said) as v from r), c as (select id, unnest(known) as s from r),
one as (select distinct a.id, v from a join c using (id) where {_CLOSE.format('v', 's')} or {_CLOSE.format('v', '(s * 100)')} or {_CLOSE.format('v', '(s / 100)')} or {_CLOSE.format('v', '(s * 10000)')} or {_CLOSE.format('v', '(s / 10000)')}),
two as (select distinct a.id, v from a join c x using (id) join c y using (id) where {_CLOSE.format('v', 'abs(x.s - y.s)')} or {_CLOSE.format('v', '(x.s + y.s)')} or {_CLOSE.format('v', '(x.s / nullif(y.s, 0))')} or {_CLOSE.format('v', '(x.s / nullif(y.s, 0) * 100)')}),
lost as (select distinct id from (select id, v from a except select id, v from one except select id, v from two))
select query_id, id not in (select id from lost) as grounded, n as n_numbers from r""",
    "latest_user_turns": f"with {_TURNS} select id, unnest(range(0, len(turns))) as place, unnest(turns) as turn from t",
    "latest_slots": rf"""with {_TURNS}, r as (select id, list_reverse(turns) as turns from t)
select id, coalesce(list_aggregate(list_filter(list_transform(turns, lambda x: regexp_extract_all(x, '(?:19|20)\p{{Nd}}{{2}}')), lambda y: len(y) > 0)[1], 'string_agg', ','), '') as years,
 coalesce(list_aggregate(list_filter(list_transform(turns, lambda x: list_filter({_TOPICS}, lambda k: contains(x, k))), lambda y: len(y) > 0)[1], 'string_agg', ','), '') as topics from r""",
    "boundary_reason": rf"""with {_ASKED}, {CH}, cov as (select distinct company, unnest(regexp_extract_all(coalesce(content, ''), '(?:19|20)\p{{Nd}}{{2}}')) as year from chunks where company is not null),
y as (select run_id, list(distinct year) as ys from named join cov using (company) group by 1),
a as (select run_id, question, run_id in (select run_id from named) as known, list_sort(list_filter(list_distinct(regexp_extract_all(question, '(?:19|20)\p{{Nd}}{{2}}')), lambda q: not coalesce(list_contains(ys, q), false))) as lacking from asked left join y using (run_id))
select run_id, reason from (select run_id, case when {_any("lower(question)", grounding.SECURITY)} then 'security' when {_any("question", grounding.REALTIME)} then 'realtime' when known and len(lacking) > 0 then 'years:' || list_aggregate(lacking, 'string_agg', '、') end as reason from a) where reason is not null""",
    "page_limits": f"""with {_ASKED}, n as (select run_id, count(*) as n from named group by 1)
select run_id, case when coalesce(n, 0) >= 2 then least(3, n) when {_any("question", grounding.MULTI_PAGE)} then 2 else 1 end::int as n_pages from asked left join n using (run_id)""",
    "relevance_gate": r"""with b as (select run_id, max(case when regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g') = 'reranker' then score end) as r, min(case when regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g') = 'dense' then score end) as dist from ranked_documents where isfinite(score) group by 1)
select run_id, coalesce(r >= 0.15, 1 - dist / 2 >= 0.35, false) as relevant from b""",
    "finance_facts": f"""with {_FACTS}, m as (select company, report_year, max(case when metric = 'revenue' then value end) as r, max(case when metric = 'net_profit' then value end) as p from flat where metric in ('revenue', 'net_profit') group by 1, 2)
select company, report_year, metric, value::double as value from flat where value is not null union all
select company, report_year, 'net_margin', (sign(p) * floor(abs(p::decimal(30, 4)) * 10000 / r::double + 0.5) / 100)::double from m where p is not null and r is not null and r <> 0""",
    "requested_metrics": "with a as (select distinct run_id, question from query_requests where question is not null), w as (select * from (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in finance.WORDS.items())
    + ") t(w, metric)), x as (select run_id, question, list_transform(regexp_extract_all(lower(question), '"
    + "|".join(sorted(finance.WORDS, key=len, reverse=True))
    + "'), lambda k: k) as words from a), e as (select run_id, question, unnest(range(0, len(words))) as i, unnest(words) as w from x), m as (select run_id, question, metric, min(i) as i from e join w using (w) group by 1, 2, 3) select run_id, row_number() over (partition by run_id, question order by i) - 1 as place, metric from m",
    "trace_ring": "select event_id, ts, event_type from events order by ts desc, event_id desc limit 500",
    "few_shot": "with r as (select run_id, question, max(asked_at) as asked_at from query_requests where question is not null group by 1, 2), n as (select *, row_number() over (partition by question order by asked_at desc, run_id) as k from r) select question, run_id, asked_at from n where k = 1 order by asked_at desc, run_id limit 5",
    "case_latest": "with r as (select run_id, session_id, channel, max(asked_at) as asked_at from query_requests where session_id is not null group by 1, 2, 3), n as (select session_id, run_id as latest_run, row_number() over (partition by session_id order by asked_at desc, run_id) as k from r) select run_id, session_id, latest_run from r left join (select * from n where k = 1) using (session_id) where channel = 'ui'",
    "trace_ids": "select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place <= 4",
}
