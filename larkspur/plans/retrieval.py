"""Queries of retrieval: corpus statistics, sparse and dense search, fusion, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import bm25, dense, hybrid, metrics, rankings, scope
from larkspur.operators.ranking import largest, rank_within
from larkspur.session import durable, latest, latest_of_few, table, workers

#: The stated query set of searches: requests whose run is divisible by this.
EVERY = 20


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The named columns of the corpus' chunks, one row each, as last delivered; others, texts above all, are neither read nor shuffled."""
    return latest(table(spark, d, "source_documents").select("chunk_id", *columns, "received_at"), ["chunk_id"], "received_at").drop("received_at")


def all_requests(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, question) of every request with a question."""
    return table(spark, d, "query_requests").where("question is not null").select("run_id", "question").distinct()


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, question) of the stated query set."""
    return all_requests(spark, d).where(f"run_id % {EVERY} = 0")


def _index(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame, float]:
    """Stored bags of the corpus' chunks with the named columns, term statistics, mean length; texts are told apart once, where they are read."""
    source = table(spark, d, "source_documents").select("chunk_id", "content", *columns, "received_at")
    texts = latest_of_few(source, "chunk_id", "received_at").drop("received_at")
    # counted of the scan alone: of what follows it, the shuffles would run
    if source.rdd.getNumPartitions() < (n := spark.sparkContext.defaultParallelism):
        texts = texts.repartition(n)
    bagged = durable(bm25.bags(texts), "zstd")
    return bagged, *bm25.bag_statistics(bagged)


def token_df(spark: SparkSession, d: str) -> DataFrame:
    posted = bm25.postings(chunks(spark, d, "content"))
    return bm25.document_frequencies(posted)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every request with a question."""
    return bm25.search(all_requests(spark, d), *_index(spark, d), query="run_id")


def bm25_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = requests(spark, d)
    aliases = scope.aliases(table(spark, d, "companies"))
    wanted = scope.mentioned(asked, aliases, "run_id", "question").select("run_id", "company")
    return bm25.search(asked, *_index(spark, d, "company"), query="run_id", scope=wanted)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Scope, dense and sparse search and their fusion for the stated query set. There is no embedder here: the vector of a question is the one with its run's number, that of a chunk the one with the chunk's."""
    vectors = table(spark, d, "embeddings")
    asked = requests(spark, d).groupBy("run_id").agg(F.min("question").alias("question")).join(vectors.select(F.col("vec_id").alias("run_id"), "embedding"), "run_id", "left")
    aliases = scope.aliases(table(spark, d, "companies"))
    wanted = scope.mentioned(asked, aliases, "run_id", "question").select("run_id", "company")
    bagged, *rest = _index(spark, d, "company")
    placed = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding").join(bagged.select("chunk_id", "company"), "chunk_id")
    return hybrid.retrieve(asked, placed, bagged, *rest, wanted, query="run_id")


def companies_mentioned(spark: SparkSession, d: str) -> DataFrame:
    aliases = scope.aliases(table(spark, d, "companies"))
    return scope.mentioned(table(spark, d, "query_requests").select("run_id", "question").distinct(), aliases, "run_id", "question")


def company_aliases(spark: SparkSession, d: str) -> DataFrame:
    return scope.aliases(table(spark, d, "companies"))


def dense_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense.l2_topk(vectors.where(f"vec_id % {EVERY} = 0"), vectors)


def dense_cosine_max(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    near = dense_l2_topk(spark, d)
    a = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    pairs = near.where("query_id <> vec_id").join(a, "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    return pairs.groupBy("query_id").agg(F.round(F.max(dense.cosine(F.col("qe"), F.col("embedding"))), 6).alias("max_cosine"))


def scored_votes(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """(run_id, query_id, method, chunk_id, good, rank): rankings of each run and method, by their finite scores; good is the score, of dense less the distance.

    only: the runs or queries wanted, by their column; others are left out before anything is ranked.
    """
    name = F.regexp_replace(F.lower(F.trim("method")), r"[\s-]+", "_")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    source = table(spark, d, "ranked_documents")
    rows = source.where(finite).select("run_id", "query_id", name.alias("method"), "chunk_id", "score")
    if only is not None:
        rows = rows.join(only, only.columns, "left_semi")
    good = F.when(F.col("method") == "dense", -F.col("score")).otherwise(F.col("score"))
    once = rows.groupBy("run_id", "query_id", "method", "chunk_id").agg(F.max(good).alias("good"))
    # a run's rows in the source bound those of any of its methods
    return rank_within(once, ["run_id", "query_id", "method"], [("good", False), ("chunk_id", True)], most=largest(source, ["run_id"]))


def votes(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """(run_id, query_id, method, chunk_id, rank)."""
    return scored_votes(spark, d, only).drop("good")


def rrf_fusion(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    return rankings.weighted_rrf(votes(spark, d, only), {"dense": 2.0, "bm25": 1.0}, extra=["query_id"]).select("run_id", "query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relevance_labels").where("relevance_grade is not null").groupBy("query_id", "chunk_id").agg(F.max("relevance_grade").alias("grade"))


def rrf_grid(spark: SparkSession, d: str) -> DataFrame:
    """Measures of all 42 fusions. A chunk's two places and its grade meet in one row; the rows of a run are brought together once, and the grid is multiplied in after that."""
    gold = labels(spark, d)
    relevant = gold.where("grade > 0")
    cast = votes(spark, d, gold.select("query_id").distinct()).where(F.col("method").isin("dense", "bm25"))
    place = lambda m: F.min(F.when(F.col("method") == m, F.col("rank"))).alias(m)
    graded = cast.groupBy("run_id", "query_id", "chunk_id").agg(place("dense"), place("bm25")).join(relevant, ["query_id", "chunk_id"], "left")
    best = relevant.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_i") <= 3, metrics.discounted(F.col("grade"), F.col("_i")))).alias("idcg"))
    grid = F.array(*[F.struct(F.lit(k).alias("rrf_k"), F.lit(w).alias("dense_weight")) for k in (1, 5, 10, 30, 60, 100) for w in (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)])
    together = graded.join(ideal, "query_id", "left").repartition(workers(graded), "run_id", "query_id")
    each = together.select("*", F.explode(grid).alias("g")).select("run_id", "query_id", "chunk_id", "grade", "n", "idcg", "g.*", "dense", "bm25")
    share = lambda w, m: F.coalesce(w / (F.col("rrf_k") + F.col(m)), F.lit(0.0))
    group = ["run_id", "query_id", "rrf_k", "dense_weight"]
    total = each.withColumn("score", F.round(share(F.col("dense_weight"), "dense") + share(F.lit(1.0), "bm25"), 12))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "chunk_id")
    ranked = total.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.count("grade").over(order)).where("rank <= 10")
    hit, rank = F.col("grade").isNotNull(), F.col("rank")
    runs = ranked.groupBy(*group).agg(
        F.try_divide(F.sum(F.when(hit & (rank <= 3), metrics.discounted(F.col("grade"), rank))), F.first("idcg")).alias("ndcg"),
        F.try_divide(F.count_if(hit & (rank <= 3)), F.first("n")).alias("recall"),
        F.try_divide(F.sum(F.when(hit, F.col("hits") / rank)), F.first("n")).alias("map"),
    )
    mean = lambda m, name: F.round(F.avg(F.coalesce(m, F.lit(0.0))), 6).alias(name)
    return runs.groupBy("rrf_k", "dense_weight").agg(mean("ndcg", "ndcg_3"), mean("recall", "recall_3"), mean("map", "map_10"))


def config_select(spark: SparkSession, d: str) -> DataFrame:
    return rrf_grid(spark, d).orderBy(F.desc("ndcg_3"), F.desc("recall_3"), F.desc("map_10"), "rrf_k", "dense_weight").limit(1)


def _paged(spark: SparkSession, d: str) -> DataFrame:
    place = chunks(spark, d, "source_file", "page_number", "company").where("source_file is not null and page_number is not null")
    return rrf_fusion(spark, d).join(place, "chunk_id")


def page_rank(spark: SparkSession, d: str) -> DataFrame:
    return rankings.unique_pages(_paged(spark, d), ["run_id"], ["source_file", "page_number"])


def diverse_pages(spark: SparkSession, d: str) -> DataFrame:
    aliases = scope.aliases(table(spark, d, "companies"))
    asked = table(spark, d, "query_requests").where("question is not null").groupBy("run_id").agg(F.min("question").alias("question"))
    required = scope.mentioned(asked, aliases, "run_id", "question")
    return rankings.diverse_pages(_paged(spark, d), required, 3, query="run_id").select("run_id", "chunk_id", "source_file", "page_number", "rank")


def page_expand(spark: SparkSession, d: str) -> DataFrame:
    corpus = chunks(spark, d, "source_file", "page_number", "start_index", "content")
    top = rrf_fusion(spark, d).where("rank <= 3").select("run_id", "chunk_id", "rank")
    text = corpus.select("chunk_id", "source_file", "page_number", "content")
    chosen = top.join(text, "chunk_id")
    grown = rankings.expand_pages(chosen, rankings.page_texts(rankings.of_pages(corpus, chosen)))
    return grown.select("run_id", "chunk_id", "rank", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


def _reranked(spark: SparkSession, d: str, posed: DataFrame) -> DataFrame:
    asked = posed.groupBy("run_id").agg(F.min("question").alias("question"))
    text = chunks(spark, d, "content")
    candidates = rrf_fusion(spark, d, asked.select("run_id")).select("run_id", "chunk_id").join(asked, "run_id").join(text, "chunk_id")
    scored = bm25.rerank(candidates, query="run_id")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "chunk_id"))).select("run_id", "chunk_id", "score", "rank")


def local_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Re-ranked candidates of the stated query set; local_rerank_all has those of every run."""
    return _reranked(spark, d, requests(spark, d))


def local_rerank_all(spark: SparkSession, d: str) -> DataFrame:
    """Re-ranked candidates of every run with a question."""
    return _reranked(spark, d, table(spark, d, "query_requests").where("question is not null"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_documents").select("chunk_id", "source_file", "page_number", "start_index", "content").distinct()
    return rankings.dedupe_chunks(rows, ["chunk_id"]).select("chunk_id", F.coalesce("page_number", F.lit(0)).alias("page"))


def dedupe_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_documents").select("chunk_id", "source_file", "page_number", "start_index", "content").distinct()
    return rankings.dedupe_index(rows, ["chunk_id"]).select("chunk_id")


def dedupe_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_documents").select("chunk_id", "company", "content").distinct()
    return rankings.dedupe_sweep(rows, ["chunk_id"]).select("chunk_id")


def debug_items(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", *[c.cast("string") for c in rankings.chunk_identity()])
    items = rrf_fusion(spark, d).where("rank <= 5").join(chunks(spark, d, "company", "source_file", "page_number", "start_index", "content"), "chunk_id")
    return items.select("run_id", "rank", "score", F.coalesce("company", F.lit("未知公司")).alias("company"), "source_file", F.coalesce(F.col("page_number"), F.lit(0)).alias("page_number"), F.substring(F.sha2(key, 256), 1, 16).alias("item_id"))


QUERIES = {
    f.__name__: f
    for f in (
        token_df, bm25_topk, bm25_scoped_topk, hybrid_topk, company_aliases, companies_mentioned, dense_l2_topk, dense_cosine_max, rrf_fusion, rrf_grid, config_select,
        page_rank, diverse_pages, page_expand, local_rerank, local_rerank_all, dedupe_first, dedupe_index, dedupe_sweep, debug_items,
    )
}

TOKENS = r"""list_concat(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[._%-][a-z0-9]+)*'),
  flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_transform(range(1, len(r) + 1), lambda i: substring(r, i, 1))))),
  flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_transform(range(1, len(r)), lambda i: substring(r, i, 2)))))"""
CHUNKS = """chunks as (select * exclude (n) from (select *, row_number() over (partition by chunk_id order by received_at desc) as n from source_documents) where n = 1),
toks as (select chunk_id, """ + TOKENS.format("coalesce(content, '')") + """ as t from chunks),
post as (select chunk_id, dl, tok as token, count(*) as tf from (select chunk_id, len(t) as dl, unnest(t) as tok from toks) group by all)"""
BM25 = CHUNKS + """,
size as (select count(*) as n_docs, avg(len(t)) as avgdl from toks),
df as (select token, count(*) as df, ln((select n_docs from size) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post group by 1),
idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df),
req as (select distinct run_id, question from query_requests where run_id % 20 = 0 and question is not null),
terms as (select run_id, token, count(*) as qtf from (select run_id, unnest(""" + TOKENS.format("question") + """) as token from req) group by 1, 2),
scored as (select run_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avgdl from size)))), 6) as score
  from terms join idf using (token) join post using (token) group by 1, 2 having score > 0)"""
ALIASES = """al as (select distinct lower(trim(a)) as alias, company from (
    select company, unnest(list_concat([company, regexp_replace(company, '(集团有限公司|股份有限公司|有限责任公司)$', ''), regexp_replace(company, '有限公司$', '')], coalesce(aliases, []))) as a from companies where company is not null)
  where len(trim(a)) >= 4),
aliases as (select alias, max(company) as company from al group by 1)"""
MENTIONED = ALIASES + """,
said as (select distinct run_id, question from query_requests where question is not null),
ment0 as (select run_id, question, company, max(len(alias)) as n from said join aliases on contains(lower(question), alias) group by 1, 2, 3)"""
VOTES = r"""once as (select run_id, query_id, regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g') as method, chunk_id,
    max(case when regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g') = 'dense' then -score else score end) as good
  from ranked_documents where isfinite(score) group by 1, 2, 3, 4),
votes as (select run_id, query_id, method, chunk_id, row_number() over (partition by run_id, query_id, method order by good desc, chunk_id) as rank from once)"""
FUSED = VOTES + """,
tot as (select run_id, query_id, chunk_id, round(sum(case method when 'dense' then 2.0 else 1.0 end / (5 + rank)), 12) as score, min(case method when 'dense' then 0 else 1 end) as p from votes where method in ('dense', 'bm25') group by 1, 2, 3),
fst as (select t.*, (select min(v.rank) from votes v where v.run_id = t.run_id and v.query_id = t.query_id and v.chunk_id = t.chunk_id and v.method = case t.p when 0 then 'dense' else 'bm25' end) as r from tot t),
fused as (select run_id, query_id, chunk_id, round(score, 9) as score, rank from (select *, row_number() over (partition by run_id, query_id order by score desc, p, r, chunk_id) as rank from fst) where rank <= 30)"""
CH = "chunks as (select * exclude (n) from (select *, row_number() over (partition by chunk_id order by received_at desc) as n from source_documents) where n = 1)"
PAGED = FUSED + ", " + CH + ", paged as (select f.*, source_file, page_number, company from fused f join chunks using (chunk_id) where source_file is not null and page_number is not null)"
METRIC = """
rel as (select query_id, chunk_id, max(greatest(relevance_grade, 0)) as grade from relevance_labels where relevance_grade is not null group by 1, 2 having max(greatest(relevance_grade, 0)) > 0),
ideal as (select query_id, grade, row_number() over (partition by query_id order by grade desc) as i from rel)"""

SQL = {
    "token_df": f"with {CHUNKS} select token, count(*) as df from post group by 1",
    "bm25_topk": f"with {BM25.replace('run_id % 20 = 0 and ', '')} select * from (select run_id, chunk_id, score, row_number() over (partition by run_id order by score desc, chunk_id) as rank from scored) where rank <= 20",
    "company_aliases": f"with {ALIASES} select alias, company from aliases",
    "companies_mentioned": f"with {MENTIONED} select run_id, company, row_number() over (partition by run_id, question order by n desc, company) as place from ment0",
    "bm25_scoped_topk": f"""with {BM25}, {ALIASES},
ment as (select distinct run_id, a.company from req join aliases a on contains(lower(question), alias)),
ok as (select s.* from scored s join chunks c using (chunk_id) where not exists (select 1 from ment m where m.run_id = s.run_id) or exists (select 1 from ment m where m.run_id = s.run_id and m.company = c.company))
select * from (select run_id, chunk_id, score, row_number() over (partition by run_id order by score desc, chunk_id) as rank from ok) where rank <= 20""",
    "hybrid_topk": f"""with {BM25.replace("select distinct run_id, question from query_requests where run_id % 20 = 0 and question is not null", "select run_id, min(question) as question from query_requests where run_id % 20 = 0 and question is not null group by 1")}, {ALIASES},
ment as (select distinct run_id, a.company from req join aliases a on contains(lower(question), alias)), free as (select run_id from req where run_id not in (select run_id from ment)),
sparse as (select s.* from scored s join chunks c using (chunk_id) left join ment m on m.run_id = s.run_id and m.company = c.company where m.run_id is not null or s.run_id in (select run_id from free)),
dist as (select r.run_id, c.chunk_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2))), 6) as score
  from req r join embeddings a on a.vec_id = r.run_id cross join chunks c join embeddings b on b.vec_id = c.chunk_id left join ment m on m.run_id = r.run_id and m.company = c.company
  where m.run_id is not null or r.run_id in (select run_id from free)),
both_ as (select run_id, 'dense' as method, chunk_id, row_number() over (partition by run_id order by score, chunk_id) as rank, score from dist qualify rank <= 10
  union all select run_id, 'bm25', chunk_id, row_number() over (partition by run_id order by score desc, chunk_id) as rank, score from sparse qualify rank <= 20),
f as (select run_id, chunk_id, round(sum(case method when 'dense' then 2.0::double else 1.0 end / (5 + rank)), 12) as s, min(case method when 'dense' then 0 else 1000 end + rank) as first from both_ group by 1, 2)
select * from both_ union all select run_id, 'rrf', chunk_id, row_number() over (partition by run_id order by s desc, first, chunk_id) as rank, round(s, 9) from f qualify rank <= 30""",
    "dense_l2_topk": """with d as (select q.vec_id as query_id, c.vec_id, round(list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: pow(q.embedding[i]::double - c.embedding[i]::double, 2))), 6) as distance
 from embeddings q, embeddings c where q.vec_id % 20 = 0) select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 10""",
    "dense_cosine_max": """with d as (select q.vec_id as query_id, c.vec_id, q.embedding as a, c.embedding as b, round(list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: pow(q.embedding[i]::double - c.embedding[i]::double, 2))), 6) as distance
 from embeddings q, embeddings c where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, round(max(list_cosine_similarity(a::double[], b::double[])), 6) as max_cosine from r where rank <= 10 and query_id <> vec_id group by 1""",
    "rrf_fusion": f"with {FUSED} select run_id, query_id, chunk_id, score, rank from fused",
    "rrf_grid": f"""with {VOTES}, {METRIC},
g as (select * from (values (1), (5), (10), (30), (60), (100)) a(rrf_k), (values (0.5::double), (0.75), (1.0), (1.25), (1.5), (2.0), (3.0)) b(dense_weight)),
lab as (select distinct query_id from relevance_labels where relevance_grade is not null),
t as (select rrf_k, dense_weight, run_id, query_id, chunk_id, round(sum(case method when 'dense' then dense_weight else 1.0 end / (rrf_k + rank)), 12) as score from votes join lab using (query_id), g where method in ('dense', 'bm25') group by 1, 2, 3, 4, 5),
r as (select * from (select *, row_number() over (partition by rrf_k, dense_weight, run_id, query_id order by score desc, chunk_id) as rank from t) where rank <= 30),
q as (select distinct rrf_k, dense_weight, run_id, query_id from r),
n as (select query_id, count(*) as n, sum(case when i <= 3 then (pow(2, grade) - 1) / log2(i + 1) end) as idcg from ideal group by 1),
h as (select r.*, grade, count(*) over (partition by rrf_k, dense_weight, run_id, r.query_id order by rank rows unbounded preceding) as hits from r join rel using (query_id, chunk_id) where rank <= 10),
a as (select rrf_k, dense_weight, run_id, query_id, count_if(rank <= 3) as h3, sum(case when rank <= 3 then (pow(2, grade) - 1) / log2(rank + 1) end) as dcg, sum(hits / rank) as pr from h group by 1, 2, 3, 4)
select rrf_k, dense_weight, round(avg(case when n.n > 0 then coalesce(dcg, 0) / idcg else 0 end), 6) as ndcg_3, round(avg(case when n.n > 0 then coalesce(h3, 0) / n.n else 0 end), 6) as recall_3, round(avg(case when n.n > 0 then coalesce(pr, 0) / n.n else 0 end), 6) as map_10
from q left join n using (query_id) left join a using (rrf_k, dense_weight, run_id, query_id) group by 1, 2""",
    "page_rank": f"with {PAGED}, f as (select run_id, source_file, page_number, min(rank) as first_rank from paged group by 1, 2, 3) select run_id, source_file, page_number, row_number() over (partition by run_id order by first_rank, source_file, page_number) as rank from f",
    "diverse_pages": f"""with recursive {PAGED}, {ALIASES}, asked as (select run_id, min(question) as question from query_requests where question is not null group by 1),
m0 as (select run_id, company, max(len(alias)) as n from asked join aliases on contains(lower(question), alias) group by 1, 2),
req as (select run_id, company, row_number() over (partition by run_id order by n desc, company) as place from m0),
lists as (select run_id, list(struct_pack(r := rank, c := company, f := source_file, p := page_number, k := chunk_id) order by rank) as items from paged group by 1),
base as (select l.run_id, items, coalesce((select list(company order by place) from req where req.run_id = l.run_id), []) as comps from lists l),
rec as (select run_id, items, comps, 0 as i, items[1:0] as sel from base
  union all select run_id, items, comps, i + 1, list_concat(sel, list_filter(items, lambda x: x.c = comps[i + 1] and not list_contains(list_transform(sel, lambda y: y.f || '|' || y.p), x.f || '|' || x.p))[1:1]) from rec where i < len(comps)),
forced as (select * from rec where i = len(comps)),
other as (select run_id, len(sel) as n, x.k as k, x.f as f, x.p as p, x.r as r from (select run_id, sel, unnest(items) as x from forced) where not list_contains(list_transform(sel, lambda y: y.f || '|' || y.p), x.f || '|' || x.p)
  qualify row_number() over (partition by run_id, x.f, x.p order by x.r) = 1),
allp as (select run_id, sel[j].k as chunk_id, sel[j].f as source_file, sel[j].p as page_number, j as rank from (select run_id, sel, unnest(range(1, len(sel) + 1)) as j from forced)
  union all select run_id, k, f, p, n + row_number() over (partition by run_id order by r) from other)
select a.* from allp a join forced using (run_id) where rank <= greatest(3, len(comps))""",
    "page_expand": f"""with {FUSED}, {CH}, dist as (select distinct source_file, page_number, start_index, coalesce(content, '') as t from chunks where source_file is not null and page_number is not null),
pages as (select source_file, page_number, string_agg(t, chr(10) order by start_index nulls first, t) as full_text from dist group by 1, 2),
g as (select run_id, chunk_id, rank, coalesce(nullif(full_text, ''), content) as content from fused join chunks using (chunk_id) left join pages using (source_file, page_number) where rank <= 3)
select run_id, chunk_id, rank, len(content) as n_chars, sha256(content) as digest from g""",
    "local_rerank": f"""with {FUSED}, {CH},
asked as (select run_id, min(question) as question from query_requests where run_id % 20 = 0 and question is not null group by 1),
cand as (select f.run_id, f.chunk_id, question, content from fused f join asked using (run_id) join chunks using (chunk_id)),
ct as (select run_id, chunk_id, {TOKENS.format("coalesce(content, '')")} as t from cand),
post as (select run_id, chunk_id, dl, tok as token, count(*) as tf from (select run_id, chunk_id, len(t) as dl, unnest(t) as tok from ct) group by all),
size as (select run_id, count(*) as n_docs, avg(len(t)) as avgdl from ct group by 1),
df as (select run_id, token, count(*) as df from post group by 1, 2),
raw as (select run_id, token, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from df join size using (run_id)),
idf as (select run_id, token, avgdl, case when raw < 0 then 0.25 * (avg(raw) over (partition by run_id)) else raw end as idf from raw),
terms as (select run_id, token, count(*) as qtf from (select run_id, unnest({TOKENS.format("question")}) as token from asked) group by 1, 2),
s as (select run_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from terms join idf using (run_id, token) join post using (run_id, token) group by 1, 2),
c as (select run_id, chunk_id, coalesce(score, 0) as score from cand left join s using (run_id, chunk_id))
select run_id, chunk_id, score, row_number() over (partition by run_id order by score desc, chunk_id) as rank from c""",
    "dedupe_first": r"""with k as (select distinct chunk_id, coalesce(source_file, '') as f, coalesce(page_number, 0) as page, coalesce(start_index, -1) as s, lower(regexp_replace(content, '[^\p{L}\p{N}_]', '', 'g')) as t
 from source_documents where regexp_replace(content, '[\s\p{Z}]', '', 'g') <> '') select min(chunk_id) as chunk_id, page from k group by f, page, s, t""",
    "dedupe_index": r"""with k as (select distinct chunk_id, source_file, page_number, start_index, regexp_replace(content, '[\s\p{Z}]', '', 'g') as t from source_documents) select min(chunk_id) as chunk_id from k where t <> '' group by source_file, page_number, start_index, t""",
    "dedupe_sweep": r"""with k as (select distinct chunk_id, coalesce(company, '') as company, lower(regexp_replace(content, '[\s\p{Z}]', '', 'g')) as t from source_documents) select min(chunk_id) as chunk_id from k where t <> '' group by company, t""",
    "debug_items": "with " + FUSED + ", " + CH + r""" select run_id, rank, score, coalesce(company, '未知公司') as company, source_file, coalesce(page_number, 0) as page_number,
 substring(sha256(coalesce(source_file, '') || '|' || coalesce(page_number, 0) || '|' || coalesce(start_index, -1) || '|' || lower(regexp_replace(coalesce(content, ''), '[^\p{L}\p{N}_]', '', 'g'))), 1, 16) as item_id from fused join chunks using (chunk_id) where rank <= 5""",
}
SQL["config_select"] = SQL["rrf_grid"].replace("select rrf_k, dense_weight, round(avg", "select rrf_k, dense_weight, ndcg_3, recall_3, map_10 from (select rrf_k, dense_weight, round(avg", 1) + ") order by ndcg_3 desc, recall_3 desc, map_10 desc, rrf_k, dense_weight limit 1"
SQL["local_rerank_all"] = SQL["local_rerank"].replace("run_id % 20 = 0 and ", "", 1)
