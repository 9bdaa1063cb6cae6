"""Queries of evaluation: ranking, refusal, latency and slot measures, sets of pages, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import grounding, metrics, protocol, rankings, responses
from larkspur.plans.retrieval import CH, VOTES, chunks, labels, votes
from larkspur.session import durable, table

KS = (1, 3, 5, 10)


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unique pages of each run and method, graded pages of each query, and the runs with any grade; stored, since every measure reads them more than once."""
    place = chunks(spark, d, "source_file", "page_number").where("source_file is not null and page_number is not null")
    gold = durable(labels(spark, d).join(place, "chunk_id").groupBy("query_id", "source_file", "page_number").agg(F.max("grade").alias("grade")))
    judged = gold.select("query_id").distinct()
    ranked = durable(rankings.unique_pages(votes(spark, d, judged).join(place, "chunk_id"), ["method", "run_id", "query_id"], ["source_file", "page_number"]))
    return ranked, gold, ranked.select("method", "run_id", "query_id").distinct()


def _measured(spark: SparkSession, d: str, missing: str, graded_only: bool = True) -> DataFrame:
    ranked, gold, runs = _pages(spark, d)
    return metrics.ranking_metrics(ranked, gold, runs, KS, ["method", "run_id"], ["query_id"], ["source_file", "page_number"], missing, graded_only)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def ranking_metrics_k(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.macro_means(_measured(spark, d, "null"), ["method"]), *metrics.MEASURES)


def retrieval_metrics_k(spark: SparkSession, d: str) -> DataFrame:
    """The variant that counts queries without a relevant page as 0."""
    return _rounded(metrics.macro_means(_measured(spark, d, "zero"), ["method"], 0.0), *metrics.MEASURES)


def sweep_metrics_k(spark: SparkSession, d: str) -> DataFrame:
    """The variant that counts every judged page as relevant, grade 0 as well."""
    return _rounded(metrics.macro_means(_measured(spark, d, "zero", False), ["method"], 0.0), *metrics.MEASURES)


def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d, "null")
    runs = table(spark, d, "ranked_documents").join(labels(spark, d).select("query_id").distinct(), "query_id", "left_semi").select(F.countDistinct("run_id").alias("n_eligible"))
    eligible = rows.select("method").distinct().crossJoin(runs)  # one row of counts
    return _rounded(metrics.stage_metrics(rows, eligible), *metrics.MEASURES, "coverage")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_set_v2").distinct().withColumn("split", F.lower(F.trim("split")))


def refusal_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = _cases(spark, d).select("split", "answerable", F.when(F.col("gold_answer").isNull(), "no answer").alias("error"), grounding.is_refusal(F.col("gold_answer")).alias("predicted_refusal"))
    return _rounded(metrics.refusal_matrix(rows, ["split"]), "precision", "recall", "f1", "accuracy_on_measured", "false_refusal_rate", "refusal_success_rate", "coverage")


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Share of answers that pass all groups of their checks, by split and category; unchecked ones are not measured."""
    rows = _cases(spark, d).select("split", "category", C.checks_pass(F.col("gold_answer"), F.col("answer_checks")).alias("passed"))
    return rows.groupBy("split", "category").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.count("passed").alias("measured"), F.count(F.lit(1)).alias("n"))


def slot_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a case's groups with an alternative in the text of one of its gold pages' documents. Documents are tested one by one, and of each only the groups it covers go on."""
    cases = _cases(spark, d).where("size(answer_checks) > 0")
    needles = F.transform("answer_checks", lambda g: F.transform(g, lambda a: F.lower(C.without_space(a))))
    wanted = cases.select("query_id", needles.alias("needles"), F.explode("gold_pages").alias("p")).select("query_id", "needles", "p.source_file", "p.page_number").where("source_file is not null and page_number is not null").distinct()
    pages = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("source_file"), "page_number", F.lower(C.without_space(F.col("text"))).alias("said"))
    hit = F.transform("needles", lambda g, i: F.when(F.exists(g, lambda a: F.contains(F.col("said"), a)), i))
    found = wanted.join(pages, ["source_file", "page_number"]).select("query_id", F.explode(F.array_compact(hit)).alias("group")).distinct().groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("covered"))
    rows = cases.select("query_id", F.size("answer_checks").alias("n")).join(found, "query_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.select("query_id", F.round(F.col("covered") / F.col("n"), 6).alias("ratio"), (F.col("covered") == F.col("n")).alias("complete"))


def latency_by_route(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.latency_statistics(table(spark, d, "events"), ["event_type"], "value"), "mean", "p50", "p95")


def service_performance(spark: SparkSession, d: str) -> DataFrame:
    """Requests, errors and latency by user, events read as requests: errors are events of that type, every seventh of them a timeout."""
    bad = F.col("event_type") == "error"
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("latency_seconds"), F.when(bad, "failed").alias("error"), F.when(bad & (F.col("event_id") % 7 == 0), "timeout").when(bad, "task_failure").alias("error_type"))
    return _rounded(responses.performance(rows, ["user_id"]), "error_rate", "timeout_rate", "mean", "p50", "p95", "mean_successful")


def stage_latency(spark: SparkSession, d: str) -> DataFrame:
    """Latency of each key of the events' JSON properties."""
    flat = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("stage", "ms"))
    return _rounded(metrics.latency_statistics(flat, ["stage"], "ms"), "mean", "p50", "p95")


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Token sums and cost of events read as calls: prompt tokens in the properties, completion tokens in the value of purchases."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("prompt_tokens"), F.when(F.col("event_type") != "error", F.col("event_id") % 97).alias("completion_tokens"))
    full = rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return _rounded(metrics.token_usage(full, 1.0, 2.0, ["event_type"]), "cost")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Measures at 3 of each run by method, methods side by side."""
    rows = _measured(spark, d, "zero").where("k = 3").select("run_id", "query_id", "method", "ndcg", "recall", "mrr", "hit")
    side = lambda m: F.max(F.when(F.col("method") == m, F.struct("ndcg", "recall", "mrr", "hit"))).alias(m)
    return rows.groupBy("run_id", "query_id").agg(side("bm25"), side("dense"), side("rrf"))


def paired_lift(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d, "zero").where("k = 3").withColumn("stage", F.lit("pages"))
    before, after = rows.where("method = 'bm25'"), rows.where("method = 'rrf'")
    return _rounded(metrics.paired_lift(before, after, ["run_id", "query_id"], ["stage"]), "hit_original", "hit_rewritten", "hit_lift", "mrr_original", "mrr_rewritten", "mrr_lift", "coverage")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = _wide(spark, d).where("bm25 is not null and rrf is not null")
    return w.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"bm25.{m}").alias("a"), F.col(f"rrf.{m}").alias("b")) for m in ("ndcg", "recall", "mrr")])).alias("p")).select("run_id", "p.*")


def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.win_tie_loss(_pairs(spark, d), ["measure"], "a", "b", 1e-9), "mean_difference")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.paired_bootstrap(_pairs(spark, d), ["measure"], "a", "b"), "mean_difference", "ci_low", "ci_high")


def citation_sets(spark: SparkSession, d: str) -> DataFrame:
    """Gold pages lost and gained from the fused to the re-ranked list of each run, and citation recall and precision of the latter."""
    ranked, gold, _ = _pages(spark, d)
    name = C.page_name(F.col("source_file"), F.col("page_number"))
    lists = ranked.where("method in ('rrf', 'reranker') and rank <= 5").groupBy("run_id", "query_id").pivot("method", ["rrf", "reranker"]).agg(F.collect_set(name))
    right = gold.where("grade > 0").groupBy("query_id").agg(F.collect_set(name).alias("gold"))
    j = lists.where("rrf is not null and reranker is not null and size(rrf) > 0 and size(reranker) > 0").join(right, "query_id")
    kept = F.array_intersect("gold", "reranker")
    return j.select(
        "run_id", F.array_join(F.array_sort(F.array_except(F.array_intersect("gold", "rrf"), "reranker")), ",").alias("lost"), F.array_join(F.array_sort(F.array_except(kept, "rrf")), ",").alias("gained"),
        F.round(F.size(kept) / F.size("gold"), 6).alias("citation_recall"), F.round(F.size(kept) / F.size("reranker"), 6).alias("citation_precision"),
    )


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each value of five columns, from one pass with grouping sets."""
    names = ("split", "category", "subcategory", "difficulty", "query_style")
    _cases(spark, d).createOrReplaceTempView("larkspur_cases")
    sets = ", ".join(f"({c})" for c in names)
    which = "case " + " ".join(f"when grouping({c}) = 0 then '{c}'" for c in names) + " end"
    value = "case " + " ".join(f"when grouping({c}) = 0 then {c}" for c in names) + " end"
    return spark.sql(f"select {which} as field, {value} as value, count(*) as n from larkspur_cases group by grouping sets ({sets})")


def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    return protocol.split_integrity(table(spark, d, "test_set_v2").select("query_id", "split", "question", "answerable").distinct())


def dataset_violations(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("source").alias("source_file"), "page_number")
    return protocol.dataset_violations(table(spark, d, "test_set_v2").select("query_id", "question", "answerable", "answer_checks", "gold_pages").distinct(), pages)


QUERIES = {
    f.__name__: f
    for f in (
        ranking_metrics_k, retrieval_metrics_k, sweep_metrics_k, stage_metrics, refusal_matrix, answer_checks, slot_coverage, latency_by_route, service_performance, stage_latency, token_cost,
        paired_lift, win_tie_loss, bootstrap_ci, citation_sets, value_counts, split_integrity, dataset_violations,
    )
}

_PAGES = VOTES + ", " + CH + """,
place as (select chunk_id, source_file, page_number from chunks where source_file is not null and page_number is not null),
gold as (select query_id, source_file, page_number, max(greatest(g, 0)) as grade from (select query_id, chunk_id, max(relevance_grade) as g from relevance_labels where relevance_grade is not null group by 1, 2) join place using (chunk_id) group by 1, 2, 3),
ranked as (select *, row_number() over (partition by method, run_id, query_id order by first_rank, source_file, page_number) as rank from (
  select method, run_id, v.query_id, source_file, page_number, min(rank) as first_rank from votes v join place using (chunk_id) where v.query_id in (select query_id from gold) group by 1, 2, 3, 4, 5))"""


def _measures(relevant: str, zero: bool) -> str:
    null = "0" if zero else "null"
    return _PAGES + f""",
rel as (select * from gold where {relevant}),
ks as (select unnest([1, 3, 5, 10])::int as k),
ideal as (select query_id, grade, row_number() over (partition by query_id order by grade desc) as i from rel),
best as (select query_id, k, count(*) as n, sum(case when i <= k then (pow(2, grade) - 1) / log2(i + 1) end) as idcg from ideal, ks group by 1, 2),
hit as (select r.method, r.run_id, r.query_id, rank, grade, count(*) over (partition by r.method, r.run_id, r.query_id order by rank rows unbounded preceding) as h from ranked r join rel using (query_id, source_file, page_number) where rank <= 10),
agg as (select method, run_id, query_id, k, count(*) as n_hits, min(rank) as first_hit, sum(h / rank) as pr, sum((pow(2, grade) - 1) / log2(rank + 1)) as dcg from hit, ks where rank <= k group by 1, 2, 3, 4),
runs as (select distinct method, run_id, query_id from ranked),
rows_ as (select method, run_id, query_id, k, (coalesce(n_hits, 0) > 0)::int::double as hit, case when n > 0 then coalesce(n_hits, 0) / n else {null} end as recall, coalesce(n_hits, 0) / k as precision, coalesce(1 / first_hit, 0) as mrr,
  case when n > 0 then coalesce(pr, 0) / n else {null} end as map, case when idcg > 0 then coalesce(dcg, 0) / idcg else {null} end as ndcg
  from runs cross join ks left join best using (query_id, k) left join agg using (method, run_id, query_id, k))"""


def _means(relevant: str, zero: bool) -> str:
    avg = ", ".join(f"round(coalesce(avg({m}), 0), 6) as {m}" if zero else f"round(avg({m}), 6) as {m}" for m in metrics.MEASURES)
    return f"with {_measures(relevant, zero)} select method, k, {avg}, count(*) as n_queries from rows_ group by 1, 2"


_REFUSED = "(" + " or ".join(f"contains(gold_answer, '{p}')" for p in grounding.REFUSALS) + ")"
_CASES = "cases as (select distinct query_id, question, answerable, gold_answer, answer_checks, gold_pages, category, subcategory, difficulty, query_style, expected_behavior, notes, lower(trim(split)) as split, split as raw_split from test_set_v2)"
_ANS = r"lower(regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}},，]', '', 'g'))"
_BARE = r"lower(regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', '', 'g'))"
_PAIRS = _measures("grade > 0", True) + """,
pairs as (select a.run_id, m.measure, case m.measure when 'ndcg' then a.ndcg when 'recall' then a.recall else a.mrr end as a, case m.measure when 'ndcg' then b.ndcg when 'recall' then b.recall else b.mrr end as b
  from rows_ a join rows_ b using (run_id, query_id), (values ('ndcg'), ('recall'), ('mrr')) m(measure) where a.method = 'bm25' and b.method = 'rrf' and a.k = 3 and b.k = 3)"""
SQL = {
    "ranking_metrics_k": _means("grade > 0", False),
    "retrieval_metrics_k": _means("grade > 0", True),
    "sweep_metrics_k": _means("true", True),
    "stage_metrics": f"with {_measures('grade > 0', False)} select method, k, "
    + ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics.MEASURES)
    + ", count(*) as n_queries, (select count(distinct run_id) from ranked_documents where query_id in (select query_id from relevance_labels where relevance_grade is not null)) as n_eligible, round(count(*) / (select count(distinct run_id) from ranked_documents where query_id in (select query_id from relevance_labels where relevance_grade is not null)), 6) as coverage from rows_ group by 1, 2",
    "refusal_matrix": f"""with {_CASES}, r as (select split, answerable, gold_answer is not null as measured, {_REFUSED} as refused from cases),
c as (select split, count_if(measured and not answerable and refused) as tp, count_if(measured and not answerable and not refused) as fn, count_if(measured and answerable and refused) as fp, count_if(measured and answerable and not refused) as tn,
  count_if(not answerable) as un, count_if(measured) as measured, count(*) as total from r group by 1)
select split, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((tp + tn) / nullif(measured, 0), 6) as accuracy_on_measured,
 round(fp / nullif(fp + tn, 0), 6) as false_refusal_rate, round(tp / nullif(un, 0), 6) as refusal_success_rate, measured, total - measured as unclassified, round(measured / nullif(total, 0), 6) as coverage from c""",
    "answer_checks": f"""with {_CASES}, p as (select split, category, case when len(answer_checks) > 0 then len(list_filter(answer_checks, lambda g: len(list_filter(g, lambda a: contains({_ANS.format('gold_answer')}, {_ANS.format('a')}))) > 0)) = len(answer_checks) end as passed, gold_answer from cases)
select split, category, round(avg(case when gold_answer is not null then passed::int::double end), 6) as pass_rate, count(case when gold_answer is not null then passed end) as measured, count(*) as n from p group by 1, 2""",
    "slot_coverage": f"""with {_CASES}, c as (select distinct query_id, answer_checks, gold_pages from cases where len(answer_checks) > 0),
p as (select distinct query_id, g.source_file as f, g.page_number as n from (select query_id, unnest(gold_pages) as g from c)),
t as (select query_id, {_BARE.format("text")} as said from p join documents on source = f and documents.page_number = n where text is not null),
a as (select query_id, i, {_BARE.format("unnest(answer_checks[i])")} as alt from (select query_id, answer_checks, unnest(range(1, len(answer_checks) + 1)) as i from c)),
hit as (select distinct query_id, i from a join t using (query_id) where contains(said, alt)), n as (select query_id, count(*) as covered from hit group by 1)
select query_id, round(coalesce(covered, 0) / len(answer_checks), 6) as ratio, coalesce(covered, 0) = len(answer_checks) as complete from c left join n using (query_id)""",
    "latency_by_route": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "service_performance": """select user_id, count(*) as requests, count(case when event_type = 'error' then 1 end) as errors, round(count(case when event_type = 'error' then 1 end) / count(*), 6) as error_rate,
 round(count(case when event_type = 'error' and event_id % 7 = 0 then 1 end) / count(*), 6) as timeout_rate, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
 round(avg(case when event_type <> 'error' then value end), 6) as mean_successful from events group by 1""",
    "stage_latency": "with e as (select unnest(map_entries(from_json(props, '\"MAP(VARCHAR, DOUBLE)\"'))) as s from events) select s.key as stage, count(s.value) as n, round(avg(s.value), 6) as mean, round(quantile_cont(s.value, 0.5), 6) as p50, round(quantile_cont(s.value, 0.95), 6) as p95 from e group by 1",
    "token_cost": """with r as (select event_type, (props->>'k')::bigint as p, case when event_type <> 'error' then event_id % 97 end as c from events),
s as (select event_type, sum(case when c is not null and p is not null and p >= 0 then p end)::bigint as prompt_tokens, sum(case when c is not null and p is not null and p >= 0 then c end)::bigint as completion_tokens, sum(case when p >= 0 then p + c end)::bigint as total_tokens, count_if(c is not null and p is not null and p >= 0) as measured_queries, count(*) as total_queries from r group by 1)
select *, round((prompt_tokens * 1.0::double + completion_tokens * 2.0::double) / 1000000, 6) as cost from s""",
    "paired_lift": f"""with {_measures("grade > 0", True)}, j as (select a.hit as ha, a.mrr as ma, b.hit as hb, b.mrr as mb, b.run_id is not null as ok from (select * from rows_ where method = 'bm25' and k = 3) a left join (select * from rows_ where method = 'rrf' and k = 3) b using (run_id, query_id))
select 'pages' as stage, round(avg(case when ok then ha end), 6) as hit_original, round(avg(hb), 6) as hit_rewritten, round(avg(hb) - avg(case when ok then ha end), 6) as hit_lift, round(avg(case when ok then ma end), 6) as mrr_original, round(avg(mb), 6) as mrr_rewritten, round(avg(mb) - avg(case when ok then ma end), 6) as mrr_lift, count_if(ok) as paired, round(count_if(ok) / count(*), 6) as coverage from j""",
    "win_tie_loss": f"with {_PAIRS} select measure, count_if(b - a > 1e-9) as wins, count_if(abs(b - a) <= 1e-9) as ties, count_if(b - a < -1e-9) as losses, round(avg(b - a), 6) as mean_difference from pairs group by 1",
    "citation_sets": f"""with {_PAGES}, l as (select run_id, query_id, method, list(source_file || '#p' || page_number) as p from ranked where rank <= 5 and method in ('rrf', 'reranker') group by 1, 2, 3),
g as (select query_id, list(source_file || '#p' || page_number) as gold from gold where grade > 0 group by 1),
j as (select a.run_id, a.p as f, b.p as r, gold from l a join l b using (run_id, query_id) join g using (query_id) where a.method = 'rrf' and b.method = 'reranker')
select run_id, coalesce(list_aggregate(list_sort(list_filter(gold, lambda x: list_contains(f, x) and not list_contains(r, x))), 'string_agg', ','), '') as lost,
 coalesce(list_aggregate(list_sort(list_filter(gold, lambda x: list_contains(r, x) and not list_contains(f, x))), 'string_agg', ','), '') as gained,
 round(len(list_filter(gold, lambda x: list_contains(r, x))) / len(gold), 6) as citation_recall, round(len(list_filter(gold, lambda x: list_contains(r, x))) / len(r), 6) as citation_precision from j""",
    "value_counts": f"with {_CASES} " + " union all ".join(f"select '{c}' as field, {c} as value, count(*) as n from cases group by 2" for c in ("split", "category", "subcategory", "difficulty", "query_style")),
    "split_integrity": f"""with c as (select distinct query_id, lower(trim(split)) as split, {_BARE.format("coalesce(question, '')")} as q, answerable, split as raw, question from test_set_v2)
select (select count(*) from (select query_id from c group by 1 having count(*) > 1)) as repeated_ids, (select count(*) from (select q from c where q <> '' and split in ('dev', 'test') group by 1 having count(distinct split) = 2)) as shared_questions,
 count_if(not coalesce(split in ('dev', 'test'), false)) as other_splits, count_if(split = 'dev' and answerable) as answerable_a, count_if(split = 'test' and answerable) as answerable_b from c""",
    "dataset_violations": rf"""with c as (select distinct query_id, question, answerable, answer_checks, gold_pages from test_set_v2), p as (select query_id, unnest(gold_pages, recursive := true) from c)
select distinct * from (select query_id, 'repeated id' as rule from c group by 1 having count(*) > 1
 union all select min(query_id), 'repeated question' from c where regexp_replace(question, '^{C.SPACE}+|{C.SPACE}+$', '', 'g') <> '' group by question having count(distinct query_id) > 1
 union all select query_id, case when answerable and coalesce(len(answer_checks), 0) = 0 then 'no checks' when answerable and coalesce(len(gold_pages), 0) = 0 then 'no pages' else 'unanswerable with labels' end from c
   where (answerable and (coalesce(len(answer_checks), 0) = 0 or coalesce(len(gold_pages), 0) = 0)) or (not answerable and (coalesce(len(answer_checks), 0) > 0 or coalesce(len(gold_pages), 0) > 0))
 union all select query_id, 'page not in index' from p where not exists (select 1 from documents d where d.source = p.source_file and d.page_number = p.page_number)
 union all select query_id, 'grade' from p where not coalesce(relevance_grade in (1, 2, 3), false))""",
}
