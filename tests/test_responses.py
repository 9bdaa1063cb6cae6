from pyspark.sql import functions as F

from larkspur import cli
from larkspur.operators import responses, sweep

CASE = "query_id string, answerable boolean, answer_checks array<array<string>>, gold_pages array<struct<source_file:string, page_number:int, relevance_grade:int>>"
PAGES = "array<struct<source_file:string, page_number:int>>"
RESPONSE = f"query_id string, answer string, success boolean, route string, outcome string, llm_status string, source_documents {PAGES}, stages map<string, {PAGES}>, latency_seconds double"


def run(spark, **kw):
    gold = [("f", 1, 3), ("f", 2, None), ("g", 9, 0)]
    cases = [("ok", True, [["8000万元"]], gold), ("to", True, [["x"]], gold), ("un", False, [], []), ("cl", True, [], gold), ("kw", False, None, None), ("se", False, None, None)]
    stages = {"fused": [("f", 1), ("f", 1), ("x", 1)], "reranked": [("f", 2)]}
    rows = [
        ("ok", "营收 8,000 万元", True, "rag", "answered", "ok", [("f", 1), ("z", 3), (None, 1), ("f", 0)], stages, 1.0),
        ("to", "", True, "rag", None, "timeout", [], None, 2.0), ("un", "x", True, "knowledge_boundary", "refused", None, [], stages, 3.0), ("cl", "哪家?", True, "query_clarification", "clarification", None, None, None, None),
        ("kw", "无法回答", True, "rag", None, None, None, None, 4.0), ("se", "", False, "rag", "service_error", None, None, None, 5.0),
    ]
    return responses.evaluate(spark.createDataFrame(cases, CASE), spark.createDataFrame(rows, RESPONSE), **kw)


def test_rows(spark):
    got = {r.query_id: r for r in run(spark).collect()}
    ok = got["ok"]
    assert ok.lexical_field_pass and ok.predicted_refusal is False and ok.citation_recall == 0.5 and ok.citation_precision == 0.5 and ok.lexical_end_to_end_pass
    assert [tuple(p) for p in ok.lost_gold_pages] == [("f", 1)] and [tuple(p) for p in ok.gained_gold_pages] == [("f", 2)]
    assert [tuple(p) for p in ok.stage_pages["fused"]] == [("f", 1), ("x", 1)] and ok.stage_pages["dense"] is None
    to = got["to"]
    assert to.predicted_refusal is None and to.lexical_field_pass is False and to.error_type == "timeout" and to.lexical_end_to_end_pass is False
    assert got["un"].predicted_refusal and got["un"].lexical_end_to_end_pass and got["un"].stage_pages is None and got["un"].citation_hit is None
    assert got["cl"].predicted_refusal is None and got["cl"].lexical_end_to_end_pass is None
    assert got["kw"].predicted_refusal and got["se"].predicted_refusal is None and got["se"].error_type == "task_failure"
    assert all(r.predicted_refusal is None and r.lexical_end_to_end_pass is None for r in run(spark, retrieval_only=True).collect())


def test_summary_and_performance(spark):
    rows = run(spark)
    s = responses.summary(rows).first()
    assert (s.total, s.errors) == (6, 2) and s.lexical_field_pass_rate == 0.5 and abs(s.lexical_field_check_coverage - 2 / 3) < 1e-9
    p = responses.performance(rows).first()
    assert (p.requests, p.errors, p.p50) == (6, 2, 3.0) and abs(p.timeout_rate - 1 / 6) < 1e-9 and abs(p.mean_successful - 8 / 3) < 1e-9
    assert responses.performance(rows, ["route"]).count() == 3
    assert responses.summary(rows.where("false")).first().lexical_field_pass_rate is None


def test_small_ones(spark):
    t = spark.createDataFrame([("t", "dense", 1.0), ("t", "dense", 2.5)], "trace_id string, stage string, ms double")
    assert responses.stage_totals(t).first().ms == 3.5
    template = responses.review_template(spark.createDataFrame([("a", "x")], "query_id string, answer string")).first()
    assert len(template.answer_sha256) == 64 and template.claims == [] and template.review_complete is False
    df = spark.createDataFrame([(0, 2, 0, "none"), (5, 2, 1, "local_bm25_multi_page"), (5, 1, 0, "cloud_reranker"), (5, 2, 2, "cloud_reranker")], "n int, p int, c int, want string")
    assert all(r.got == r.want for r in df.select(responses.rerank_route(F.col("n"), F.col("p"), F.col("c"), True).alias("got"), "want").collect())


def test_sweep(spark, capsys):
    points = sweep.grid()
    assert len(points) == 31 and points[0].strategy == "fixed_chars"
    pages = spark.createDataFrame([(1, "公司营业收入增长。" * 100), (2, None)], "doc_id int, text string")
    stats = {r.label: r for r in sweep.chunk_statistics(pages, [points[0], points[1], points[4]]).collect()}
    assert stats["fixed_chars_500_80"].n_chunks == 2 and stats["adaptive_tokens_256_0"].without_overlap == 1 and stats["adaptive_tokens_256_96"].most <= 257
    results = spark.createDataFrame([("a", 0.5, 0.5, 1.0, 1.0, 1.0, 9), ("b", 0.5, 0.5, 1.0, 1.0, 1.0, 3), ("c", 0.4, 1.0, 1.0, 1.0, 1.0, 1)], "label string, ndcg double, recall double, slot_complete double, slot_coverage double, mrr double, n_chunks int")
    assert sweep.select(results).first().label == "b"
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
