"""Selection of pages over shared pages, guarded appends, reports, strict readers, facts without year or printed form."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import finance, metrics, quality, rankings, responses
from larkspur.sources import io


def test_required_companies_share_a_page(spark):
    rows = [(1, 1, "A", "f", 1), (1, 2, "B", "f", 1), (1, 3, "C", "f", 2), (1, 4, "B", "g", 7), (1, 5, "A", "g", 7), (1, 6, None, None, None), (2, 1, "A", "f", 1), (2, 2, "B", "f", 1)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, company string, source_file string, page_number int")
    required = spark.createDataFrame([(1, "B", 1), (1, "A", 2), (1, "Z", 3)], "query_id int, company string, place int")
    got = rankings.diverse_pages(ranked, required, 2).collect()
    assert sorted((r["rank"], r.company, r.page_number) for r in got if r.query_id == 1) == [(1, "B", 1), (2, "A", 7), (3, "C", 2)]
    assert [(r["rank"], r.company) for r in got if r.query_id == 2] == [(1, "A")]
    assert rankings.diverse_pages(ranked, None, 9).where("query_id = 1").count() == 4
    assert rankings.diverse_pages(ranked.where("false"), required, 2).count() == 0


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"a": 1}, {"a": null}]')
    (tmp_path / "b.json").write_text('{"a": 1}')
    assert [r.a for r in io.read_json_array(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, None]
    with pytest.raises(ValueError, match="no JSON array"):
        io.read_json_array(spark, str(tmp_path / "b.json"), "a int")


def test_vectors_of_one_width(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "chunk_id bigint, embedding array<float>")
    io.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    for i, bad in enumerate(([(3, [1.0])], [(None, [1.0, 2.0])], [(3, None)])):
        with pytest.raises(Exception, match="width"):
            io.write_vectors(df.unionByName(spark.createDataFrame(bad, df.schema)), str(tmp_path / f"w{i}"))


def test_guarded_append(spark, tmp_path):
    known = spark.createDataFrame([("c1",)], "bad_case_id string")
    schema = "bad_case_id string, failure_stage string, disposition string"
    good = spark.createDataFrame([("c1", quality.STAGES[0], quality.DISPOSITIONS[0])], schema)
    quality.append_reviews(good, known, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="unknown case"):
        quality.append_reviews(good.unionByName(spark.createDataFrame([("c2", quality.STAGES[0], quality.DISPOSITIONS[0])], schema)), known, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_matched_pairs(spark):
    a = spark.createDataFrame([("q1", 0.5), ("q2", 1.0)], "query_id string, ndcg double")
    got = metrics.matched_pairs(a, a.withColumn("ndcg", F.col("ndcg") / 2), ["query_id"], ("ndcg",)).collect()
    assert sorted((r.query_id, r.baseline, r.candidate) for r in got) == [("q1", 0.25, 0.5), ("q2", 0.5, 1.0)]
    with pytest.raises(Exception, match="only one side"):
        metrics.matched_pairs(a, a.where("query_id = 'q1'"), ["query_id"], ("ndcg",)).collect()


def test_human_review_and_report(spark):
    reviews = spark.createDataFrame([("a", True, 2, 1), ("b", False, 1, 0)], "query_id string, semantic_answer_correct boolean, answer_relevance int, completeness int")
    claims = spark.createDataFrame([("a", True), ("a", False)], "query_id string, supported boolean")
    r = metrics.human_review(reviews, claims, 4).first()
    assert (r.coverage, r.semantic_answer_accuracy, r.answer_relevance, r.completeness, r.faithfulness, r.claim_support, r.total_queries) == (0.5, 0.5, 0.75, 0.25, 0.5, 0.5, 4)
    names = "answerable boolean, route string, lexical_field_pass boolean, citation_hit boolean, citation_recall double, citation_precision double, error string, error_type string, n_sources int, lexical_end_to_end_pass boolean, latency_seconds double"
    rows = spark.createDataFrame([(True, "rag", True, True, 1.0, 0.5, None, None, 2, True, 1.0), (False, "knowledge_boundary", None, None, None, None, None, None, 0, True, 3.0)], names)
    stages = spark.createDataFrame([("fused", 3, 0.5)], "stage string, k int, ndcg double")
    whole = responses.report(rows, rows.agg(F.lit(1.0).alias("f1")), stages, metrics.human_review(reviews, claims, 4)).first()
    assert whole.total == 2 and whole.route_distribution == {"rag": 1, "knowledge_boundary": 1} and whole.performance.p50 == 2.0 and whole.refusal.f1 == 1.0 and whole.human_review.coverage == 0.5 and whole.stage_metrics[0].stage == "fused"


def test_facts_without_year_or_printed_form(spark):
    schema = "company string, report_year int, currency string, source_file string, page_number int, metrics map<string, struct<value:string, display:string>>"
    rows = [("甲", 2022, "CNY", "a", 1, {"revenue": ("800000000", None), "roe": ("10.5", None)}), ("乙", None, "CNY", "b", 1, {"revenue": ("5", "5元")})]
    asked = spark.createDataFrame([("1", "甲和乙2022年营业收入", ["甲", "乙"]), ("2", "甲2022年营业收入是多少", ["甲"]), ("3", "乙营业收入", ["乙"]), ("4", "甲净资产收益率", ["甲"])], "query_id string, question string, companies array<string>")
    got = {r.query_id: r.answer for r in finance.answers(asked, spark.createDataFrame(rows, schema)).collect()}
    assert "1" not in got and "8亿元" in got["2"] and got["3"].startswith("乙营业收入为5元") and got.get("4", "10.5%").find("10.5%") >= 0
