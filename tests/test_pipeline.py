"""The stages of the batched pipeline on a few requests."""

from datetime import datetime

import pytest

from larkspur.plans import pipeline, retrieval

AT = datetime(2024, 1, 1)
LONG = "蓝天旅游有限公司"
CHUNKS = [
    (1, "游客说明", "蓝天旅游有限公司", "a.pdf", 1), (2, "游客满意度为九成", "蓝天旅游有限公司", "a.pdf", 2), (3, "游客满意度", "澜赋科技有限公司", "b.pdf", 1), (4, " ", "蓝天旅游有限公司", "a.pdf", 3),
    (5, "游客满意度为八成", "滨江消费品有限公司", "c.pdf", 1), (6, "满意度", "拓远科技有限公司", "e.pdf", 1),
]
REQUESTS = [(1, "蓝天旅游游客满意度是多少"), (2, "那它呢？"), (3, "蓝天旅游的游客满意度"), (4, "蓝天旅游、澜赋科技、滨江消费品、拓远科技的满意度"), (5, " ")]
# (run, method, chunk, score): a dense score is a distance
VOTES = [
    (1, "dense", 3, 0.1), (1, "dense", 4, 0.2), (1, "dense", 1, 0.4), (1, "dense", 2, 0.5), (1, "bm25", 1, 9.0),
    (2, "dense", 1, 0.4), (3, "dense", 2, 1.9), (3, "dense", 1, 1.95),
    (4, "dense", 2, 0.3), (4, "dense", 3, 0.4), (4, "dense", 5, 0.5), (4, "dense", 6, 0.6),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save("companies", [(n, []) for n in sorted({c[2] for c in CHUNKS})], "company string, aliases array<string>")
    save("query_requests", REQUESTS, "run_id bigint, question string")
    save("source_documents", [(*c, 0, AT) for c in CHUNKS], "chunk_id bigint, content string, company string, source_file string, page_number int, start_index int, received_at timestamp")
    save("ranked_documents", [(r, f"q{r}", m, s, c) for r, m, c, s in VOTES], "run_id bigint, query_id string, method string, score double, chunk_id bigint")
    save("structured_financial_data", [], "fact_id string, company string, report_year int, currency string, source_file string, page_number int, metrics map<string, struct<value:string, display:string>>, recorded_at timestamp, received_at timestamp")
    return d


def answers(df):
    return {r.run_id: (r.route, r.outcome, [(s.source_file, s.page_number) for s in r.sources]) for r in df.collect()}


def test_stages(spark, folder):
    got = answers(pipeline.answer_batch(spark, folder))
    # another company's chunk is out of scope, a blank one no candidate; re-ranking puts the second chunk first
    assert got[1] == ("rag", "retrieval_only", [("a.pdf", 2)])
    assert got[2] == ("query_clarification", "clarification", [])
    assert got[3] == ("insufficient_evidence", "insufficient_evidence", [])
    assert got[4][0] == "rag" and len(got[4][2]) == 4  # a page for each company that is named
    assert set(got) == {1, 2, 3, 4}


def test_history_completes_a_follow_up(spark, folder):
    turns = spark.createDataFrame([(2, [("user", "蓝天旅游游客满意度是多少")])], "run_id bigint, history array<struct<role:string,content:string>>")
    got = answers(pipeline.answer_batch(spark, folder, history=turns))
    assert got[2] == ("rag", "retrieval_only", [("a.pdf", 1)])


def test_injected_reranker_decides_order_and_gate(spark, folder):
    def client(df):
        return df.selectExpr("run_id", "chunk_id", "case when run_id = 4 then null when chunk_id = 1 then 0.9 else 0.01 end as score")

    got = answers(pipeline.answer_batch(spark, folder, rerank=client))
    assert got[1] == got[3] == ("rag", "retrieval_only", [("a.pdf", 1)])
    assert got[4][0] == "rag" and len(got[4][2]) == 4  # no score for the run: BM25 and the recorded distance

    low = answers(pipeline.answer_batch(spark, folder, rerank=lambda df: df.selectExpr("run_id", "chunk_id", "0.01D as score")))
    assert low[1][0] == "insufficient_evidence"


def test_rerank_of_every_run(spark, folder):
    got = retrieval.local_rerank_all(spark, folder).collect()
    assert {r.run_id for r in got} == {1, 2, 3, 4} and {r.chunk_id for r in got if r.run_id == 1} == {1, 2, 3, 4}
