import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import bm25, dense, hybrid, metrics, rankings, scope
from larkspur.plans import retrieval
from larkspur.session import durable, latest, latest_of_few


def tokens(t):
    import re

    out = re.findall(r"[a-z0-9]+(?:[._%-][a-z0-9]+)*", t.lower())
    for run in re.findall("[一-鿿]+", t.lower()):
        out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def okapi(corpus, query):
    docs = [tokens(t or "") for t in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in tokens(query)))
    return out


def test_bm25_equals_plain_reading(spark):
    random.seed(3)
    words = ["营业收入", "净利润", "公司", "研发", "2021", "roe", "增长"]
    corpus = ["".join(random.choices(words, k=random.randrange(1, 9))) + " " + random.choice(words) for _ in range(40)] + [None, ""]
    chunks = spark.createDataFrame(list(enumerate(corpus)), "chunk_id bigint, content string")
    bagged = bm25.bags(chunks)
    stats, avgdl = bm25.bag_statistics(bagged)
    n, mean = bm25.corpus_size(chunks).first()
    assert abs(mean - avgdl) < 1e-12 and sorted(map(tuple, stats.collect())) == sorted(map(tuple, bm25.statistics(bm25.postings(chunks), n).collect()))
    queries = spark.createDataFrame([(1, "公司净利润净利润 roe"), (2, "不存在xyz"), (3, None)], "query_id bigint, question string")
    got = bm25.search(queries, bagged, stats, avgdl, k=10).collect()
    want = okapi(corpus, "公司净利润净利润 roe")
    order = sorted((i for i, s in enumerate(want) if round(s, 6) > 0), key=lambda i: (-round(want[i], 6), i))[:10]
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == order
    assert all(abs(r.score - want[r.chunk_id]) < 1e-5 for r in got)


def test_joined_terms_give_what_blocks_give(spark, monkeypatch):
    random.seed(4)
    corpus = [(i, "".join(random.choices("营业收入净利润公司研发增长", k=random.randrange(0, 30))), random.choice("abc") if i % 5 else None) for i in range(120)]
    bagged = bm25.bags(spark.createDataFrame(corpus, "chunk_id bigint, content string, company string"))
    stats, avgdl = bm25.bag_statistics(bagged)
    queries = spark.createDataFrame([(i, "".join(random.choices("营业收入净利润公司", k=6))) for i in range(9)], "query_id bigint, question string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "zzz")], "query_id bigint, company string")
    for scope in (None, wanted):
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1000)
        blocks = sorted(map(tuple, bm25.search(queries, bagged, stats, avgdl, k=5, scope=scope).collect()))
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
        assert blocks == sorted(map(tuple, bm25.search(queries, bagged, stats, avgdl, k=5, scope=scope).collect())) and len(blocks) > 20


def rows_of_maps(plan):
    """Rows that came back from Python in a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_of_maps(plan.executedPlan())
    if "QueryStage" in name:
        return rows_of_maps(plan.plan())
    own = plan.metrics().apply("pythonNumRowsReceived").value() if name == "MapInArrow" else 0
    return own + sum(rows_of_maps(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def searched(spark):
    """120 chunks of one company in one partition, and 6 questions on it."""
    random.seed(7)
    corpus = [(i, "".join(random.choices("营业收入净利润公司", k=12)), "a") for i in range(120)]
    bagged = bm25.bags(spark.createDataFrame(corpus, "chunk_id bigint, content string, company string").coalesce(1))
    queries = spark.createDataFrame([(i, "营业收入净利" + "润公司营收入"[i]) for i in range(6)], "query_id bigint, question string")
    return queries, bagged, *bm25.bag_statistics(bagged)


def test_only_the_best_of_a_task_leave_a_scoped_search(spark, small_batches, searched):
    wanted = spark.createDataFrame([(i, "a") for i in range(6)], "query_id bigint, company string")
    found = bm25.search(*searched, k=3, scope=wanted)
    assert len(found.collect()) == 18 and rows_of_maps(found._jdf.queryExecution().executedPlan()) == 18


def test_parts_of_the_queries_share_the_cores(spark, monkeypatch, small_batches, searched):
    queries, bagged, stats, avgdl = searched
    whole = sorted(map(tuple, bm25.search(queries, bagged, stats, avgdl, k=3).collect()))
    # 8 parts on 4 cores: one task each, so nothing but the result leaves them, however the chunks are partitioned
    tokens = queries.select(F.sum(F.size(bm25.bm25_tokens(F.col("question"))))).first()[0]
    monkeypatch.setattr(bm25, "SENT", -(-tokens // 8), raising=False)
    found = bm25.search(queries, bagged.repartition(8), stats, avgdl, k=3)
    assert sorted(map(tuple, found.collect())) == whole and rows_of_maps(found._jdf.queryExecution().executedPlan()) == len(whole) == 18


def test_a_search_has_no_more_tasks_than_cores(spark, small_batches, searched):
    queries, bagged, stats, avgdl = searched
    found = bm25.search(queries, bagged.repartition(8), stats, avgdl, k=3)
    # 4 cores, 6 queries: as many times the 3 best of each leave tasks, however the chunks are partitioned
    assert len(found.collect()) == 18 and rows_of_maps(found._jdf.queryExecution().executedPlan()) == 4 * 18


def shuffled_rows(plan):
    """Rows that a plan that has run wrote to shuffles."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if "QueryStage" in name:
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_come_once_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = [(i, f"净利润{i}", "a", 0) for i in range(200)] + [(3, "改", "b", 1), (5, "净利润5", "a", 2), (None, "甲", "a", 0), (None, "乙", "c", 1)]
    df = spark.createDataFrame(rows, "chunk_id bigint, content string, company string, received_at bigint")
    df.repartition(4).write.parquet(f"{tmp_path}/source_documents.parquet")
    stored = []
    monkeypatch.setattr(retrieval, "durable", lambda df, *how: stored.append(df) or durable(df, *how))
    bagged, _, avgdl = retrieval._index(spark, str(tmp_path), "company")
    got = {r.chunk_id: (r.tokens, r.company) for r in bagged.collect()}
    assert len(got) == bagged.count() == 201 and got[3] == (["改"], "b") and got[None] == (["乙"], "c") and "净利" in got[5][0]
    assert abs(avgdl - sum(len(t) for t, _ in got.values()) / 201) < 1e-9
    # the two deliveries of three chunks
    assert len(stored[0].collect()) == 201 and shuffled_rows(stored[0]._jdf.queryExecution().executedPlan()) <= 6


def test_latest_of_few_is_latest(spark):
    random.seed(8)
    rows = [(random.choice([None, *range(30)]), random.choice("abc"), random.choice([None, 1, 2, 3])) for _ in range(60)] + [(99, "z", None)]
    df = spark.createDataFrame(rows, "id bigint, t string, at bigint")
    want = sorted(map(repr, latest(df, ["id"], "at").collect()))
    for most in (2_000_000, 0):
        assert sorted(map(repr, latest_of_few(df, "id", "at", most).collect())) == want
    assert latest_of_few(df.where("false"), "id", "at").count() == 0


def test_scope_is_applied_below_the_cut(spark):
    chunks = spark.createDataFrame([(1, "净利润净利润", "a"), (2, "净利润", "b"), (3, "其他内容", "b"), (4, "别的", "a"), (5, "天气", "a"), (6, "山水", "b")], "chunk_id bigint, content string, company string")
    bagged = bm25.bags(chunks)
    q = spark.createDataFrame([(1, "利润")], "query_id bigint, question string")
    got = bm25.search(q, bagged, *bm25.bag_statistics(bagged), k=1, scope=spark.createDataFrame([(1, "b")], "query_id bigint, company string")).collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [(2, 1)]


def test_only_the_best_of_a_task_leave_the_sparse_search_of_a_hybrid_one(spark, small_batches, searched):
    queries, *index = searched
    vectors = spark.createDataFrame([(0, [0.0], "a")], "chunk_id bigint, embedding array<float>, company string")
    posed = queries.withColumn("embedding", F.when(F.lit(False), F.array(F.lit(0.0).cast("float"))))
    wanted = spark.createDataFrame([(0, "a"), (1, "b")], "query_id bigint, company string")
    found = hybrid.retrieve(posed, vectors, *index, scope=wanted).where("method = 'bm25'")
    # one of the six names a company without chunks
    assert len(found.collect()) == 100 and rows_of_maps(found._jdf.queryExecution().executedPlan()) == 100


def test_bm25_topk_answers_every_request(spark, tmp_path):
    chunks = [(i, t, "a", 0) for i, t in enumerate(["净利润", "净利润增长", "天气", "山水", "别的", "其他"])]
    spark.createDataFrame(chunks, "chunk_id bigint, content string, company string, received_at bigint").write.parquet(f"{tmp_path}/source_documents.parquet")
    asked = [(1, "利润"), (7, "利润"), (20, "利润"), (21, None), (22, "天气"), (22, "山水"), (23, "无xyz"), (None, "利润")]
    spark.createDataFrame(asked, "run_id bigint, question string").write.parquet(f"{tmp_path}/query_requests.parquet")
    got = {}
    for r in sorted(retrieval.bm25_topk(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.run_id, []).append(r.chunk_id)
    assert got == {1: [0, 1], 7: [0, 1], 20: [0, 1], None: [0, 1], 22: [2, 3]}


def test_rerank_uses_candidates_only(spark):
    rows = [(1, 10, "利润", "利润增长"), (1, 11, "利润", "其他"), (1, 12, "利润", None), (2, 10, "无关", "利润增长")]
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.rerank(spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, question string, content string")).collect()}
    want = okapi(["利润增长", "其他", None], "利润")
    assert len(got) == 4 and abs(got[1, 10] - want[0]) < 1e-5 and got[1, 12] == 0 and got[2, 10] == 0


def test_dense_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(100)] + [(100, None)]
    rows[7] = (7, rows[3][1])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in dense.l2_topk(df.where("vec_id % 10 = 3"), df, k=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    brute = {r.vec_id: r.embedding for r in df.where("embedding is not null").collect()}
    for q, ranks in got.items():
        want = sorted(brute, key=lambda i: (round(sum((a - b) ** 2 for a, b in zip(brute[q], brute[i])), 6), i))[:4]
        assert [ranks[i] for i in (1, 2, 3, 4)] == want
    assert len(got) == 10
    near = df.where("vec_id = 3").select(dense.squared_l2(F.col("embedding"), F.col("embedding")), dense.cosine(F.col("embedding"), F.col("embedding"))).first()
    assert near[0] == 0 and abs(near[1] - 1) < 1e-9


def test_dense_scope_is_applied_below_the_cut(spark, monkeypatch):
    rows = [(1, [0.0, 0.0], "a"), (2, [5.0, 5.0], "b"), (3, [6.0, 6.0], "b"), (4, [9.0, 9.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, company string")
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 0.0]), (9, [9.0, 9.0])], "vec_id bigint, embedding array<float>")
    wanted = spark.createDataFrame([(7, "b"), (9, "none of them")], "query_id bigint, company string")
    for sent in (dense.SENT, 2):
        monkeypatch.setattr(dense, "SENT", sent)
        got = {(r.query_id, r["rank"]): r.vec_id for r in dense.l2_topk(q, df, k=2, scope=wanted).collect()}
        assert got == {(7, 1): 2, (7, 2): 3, (8, 1): 1, (8, 2): 2}
    assert dense.l2_topk(q, df.where("false"), k=2).count() == dense.l2_topk(q.where("false"), df, k=2).count() == 0


def test_weighted_rrf(spark):
    votes = spark.createDataFrame([(1, "dense", 1, 1), (1, "dense", 2, 2), (1, "dense", 3, 3), (1, "bm25", 1, 2), (1, "bm25", 2, 2), (1, "other", 1, 9)], "run_id int, method string, rank int, chunk_id int")
    got = rankings.weighted_rrf(votes, {"dense": 1.0, "bm25": 1.0}, limit=2).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [(2, 1), (1, 2)]
    # a route's repeated vote counts once, equal totals go by the first route's order
    alone = rankings.weighted_rrf(votes, {"dense": 2.0, "bm25": 0.0}).orderBy("rank").collect()
    assert [r.chunk_id for r in alone] == [1, 2, 3] and abs(alone[0].score - 2 / 6) < 1e-9
    for bad in ({"dense": float("nan")}, {"dense": -1.0}, {"dense": 0.0}):
        with pytest.raises(ValueError):
            rankings.weighted_rrf(votes, bad)
    with pytest.raises(ValueError):
        rankings.weighted_rrf(votes, {"dense": 1.0}, rrf_k=0)


def test_identity_by_position_and_source(spark):
    rows = [(1, "f", 0, 0, "同 文"), (2, "f", 0, 0, "同文！"), (3, "f", 0, 10, "同文"), (4, "g", 0, 0, "同文"), (5, "f", 1, 0, " "), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id int, source_file string, page_number int, start_index int, content string")
    assert sorted(r.chunk_id for r in rankings.dedupe_chunks(df, ["chunk_id"]).collect()) == [1, 3, 4]
    assert sorted(r.chunk_id for r in rankings.dedupe_index(df, ["chunk_id"]).collect()) == [1, 2, 3, 4]
    named = df.withColumn("company", F.lit("c"))
    assert sorted(r.chunk_id for r in rankings.dedupe_sweep(named, ["chunk_id"]).collect()) == [1, 2]


def test_diverse_pages(spark):
    rows = [(1, 1, "a", "f", 1), (1, 2, "a", "f", 1), (1, 3, "a", "f", 2), (1, 4, "b", "g", 1), (1, 5, "c", "h", 1)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, company string, source_file string, page_number int")
    required = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id int, company string, place int")
    got = rankings.diverse_pages(ranked, required, 3).orderBy("rank").collect()
    assert [(r.company, r.page_number) for r in got] == [("c", 1), ("b", 1), ("a", 1)]
    free = rankings.diverse_pages(ranked, None, 2).orderBy("rank").collect()
    assert [(r.source_file, r.page_number) for r in free] == [("f", 1), ("f", 2)]


def test_page_expansion_falls_back_to_the_chunk(spark):
    chunks = spark.createDataFrame([("f", 1, 0, "甲"), ("f", 1, 5, "乙"), ("g", 1, 0, None)], "source_file string, page_number int, start_index int, content string")
    ranked = spark.createDataFrame([(1, "f", 1, "甲"), (2, "g", 1, "块"), (3, "x", 9, "只有块")], "rank int, source_file string, page_number int, content string")
    got = {r["rank"]: r.content for r in rankings.expand_pages(ranked, rankings.page_texts(chunks)).collect()}
    assert got == {1: "甲\n乙", 2: "块", 3: "只有块"}


def test_ranking_metrics(spark):
    ranked = rankings.unique_pages(spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 1, 2), ("q", "b", 2, 3)], "query_id string, f string, p int, rank int"), ["query_id"], ["f", "p"])
    gold = spark.createDataFrame([("q", "a", 1, 3), ("q", "b", 2, 0), ("q", "c", 1, 1), ("z", "b", 2, 0)], "query_id string, f string, p int, grade int")
    queries = spark.createDataFrame([("q",), ("z",)], "query_id string")
    got = {r.query_id: r for r in metrics.ranking_metrics(ranked, gold, queries, (3,), [], ["query_id"], ["f", "p"]).collect()}
    q, z = got["q"], got["z"]
    assert (q.hit, q.recall, q.mrr, q.map) == (1, 0.5, 1, 0.5) and abs(q.precision - 1 / 3) < 1e-9 and 0 < q.ndcg < 1
    assert z.recall is None and z.ndcg is None and z.hit == 0
    zero = {r.query_id: r for r in metrics.ranking_metrics(ranked, gold, queries, (3,), [], ["query_id"], ["f", "p"], "zero").collect()}
    assert zero["z"].recall == 0 and zero["z"].ndcg == 0
    every = {r.query_id: r for r in metrics.ranking_metrics(ranked, gold, queries, (3,), [], ["query_id"], ["f", "p"], "zero", False).collect()}
    assert abs(every["q"].recall - 2 / 3) < 1e-9


def test_refusal_matrix(spark):
    rows = [(False, True, None), (True, True, None), (False, False, None), (True, False, None), (False, None, "timeout")]
    m = metrics.refusal_matrix(spark.createDataFrame(rows, "answerable boolean, predicted_refusal boolean, error string")).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.unclassified) == (1, 1, 1, 1, 1)
    assert m.precision == m.recall == m.f1 == 0.5 and abs(m.refusal_success_rate - 1 / 3) < 1e-9
    empty = metrics.refusal_matrix(spark.createDataFrame([], "answerable boolean, predicted_refusal boolean, error string")).first()
    assert empty.precision is None and empty.coverage is None


def test_latency_and_cost(spark):
    r = metrics.latency_statistics(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double"), [], "v").first()
    assert (r.n, r.p50) == (3, 2.0) and abs(r.p95 - 2.9) < 1e-9
    use = spark.createDataFrame([(100, 160, 260), (None, 5, 5), (-1, 5, 4)], "prompt_tokens int, completion_tokens int, total_tokens int")
    got = metrics.token_usage(use, 1.0, 2.0).first()
    assert abs(got.cost - 0.00042) < 1e-12 and (got.measured_queries, got.total_queries) == (1, 3)
    assert metrics.token_usage(use).first().cost is None


def test_reviews_support(spark):
    claims = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "query_id string, supported boolean")
    got = metrics.claim_support(claims, spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")).first()
    assert (got.reviewed_queries, got.faithfulness, got.reviewed_claims) == (3, 0.75, 3) and abs(got.claim_support - 2 / 3) < 1e-9


def test_paired(spark):
    a = spark.createDataFrame([("q1", "s", 0.0, 0.0), ("q2", "s", 1.0, 1.0)], "id string, stage string, hit double, mrr double")
    b = spark.createDataFrame([("q1", "s", 1.0, 0.5)], "id string, stage string, hit double, mrr double")
    got = metrics.paired_lift(a, b, ["id"], ["stage"]).first()
    assert (got.hit_lift, got.mrr_lift, got.paired, got.coverage) == (1.0, 0.5, 1, 0.5)
    pairs = spark.createDataFrame([("m", 0.0, 1.0), ("m", 1.0, 1.0), ("m", 1.0, 0.5)], "measure string, a double, b double")
    w = metrics.win_tie_loss(pairs, ["measure"], "a", "b").first()
    assert (w.wins, w.ties, w.losses) == (1, 1, 1)
    ci = metrics.paired_bootstrap(pairs, ["measure"], "a", "b", samples=2000).first()
    assert ci.ci_low <= ci.mean_difference <= ci.ci_high
    assert ci == metrics.paired_bootstrap(pairs.repartition(3), ["measure"], "a", "b", samples=2000).first()


def test_aliases(spark):
    c = spark.createDataFrame([("滨江消费品有限公司", ["滨江"]), ("ACME研发有限公司", ["ACME", None]), (None, None)], "company string, aliases array<string>")
    known = scope.aliases(c)
    assert {r.alias for r in known.collect()} == {"滨江消费品有限公司", "滨江消费品", "acme研发有限公司", "acme研发", "acme"}
    asked = spark.createDataFrame([(1, "Acme研发和滨江消费品谁更高"), (2, None), (3, "无")], "id int, q string")
    got = [(r.id, r.company, r.place) for r in scope.mentioned(asked, known, "id", "q").collect()]
    assert sorted(got) == [(1, "ACME研发有限公司", 1), (1, "滨江消费品有限公司", 2)]
