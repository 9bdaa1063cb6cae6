import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import protocol, quality
from larkspur.sources import io
from larkspur.streaming import traces


def test_config():
    c = protocol.RetrievalConfig()
    assert (c.dense_top_k, c.bm25_top_k, c.fused_top_k, c.rrf_k, c.dense_rrf_weight, c.bm25_rrf_weight, c.bm25_tokenizer) == (10, 20, 30, 5, 2.0, 1.0, "char-bigram")
    assert protocol.RetrievalConfig.from_mapping({"RRF_K": "7", "BM25_RRF_WEIGHT": "0.5"}).rrf_k == 7
    for bad in ({"rrf_k": 0}, {"dense_top_k": -1}, {"dense_top_k": True}, {"dense_rrf_weight": float("nan")}, {"dense_rrf_weight": 0.0, "bm25_rrf_weight": 0.0}, {"bm25_tokenizer": "x"}):
        with pytest.raises(ValueError):
            protocol.RetrievalConfig(**bad)


def test_seal():
    m = protocol.seal({"b": 1, "a": "字"})
    assert protocol.check_seal(m, {"b": 1}) == m
    for changed in ({**m, "b": 2}, {**m, "integrity_sha256": "x"}):
        with pytest.raises(ValueError):
            protocol.check_seal(changed)
    with pytest.raises(ValueError):
        protocol.check_seal(m, {"b": 2})


def test_table_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert protocol.table_digest(df, "k") == protocol.table_digest(df.repartition(3).orderBy(F.desc("k")), "k")
    assert protocol.table_digest(df, "k") != protocol.table_digest(df.where("k < 3"), "k")


def test_split_policy():
    protocol.split_policy({"dev"}, True, sweep=True)
    protocol.split_policy({"test"}, True, frozen=True)
    for args in (({"test"}, True, True), ({"test"}, True), ({"dev", "test"}, True, False, True), (set(), True), ({"dev"}, False)):
        with pytest.raises(ValueError):
            protocol.split_policy(*args)


def test_split_integrity(spark):
    rows = [("a", "dev", "问 题", True), ("b", " TEST", "问题", True), ("b", "test", "x", False), ("c", None, None, None)]
    r = protocol.split_integrity(spark.createDataFrame(rows, "query_id string, split string, question string, answerable boolean")).first()
    assert (r.repeated_ids, r.shared_questions, r.other_splits, r.answerable_a, r.answerable_b) == (1, 1, 1, 1, 1)


def test_third_row(spark):
    got = protocol.nth_row_split(spark.createDataFrame([(i,) for i in range(1, 8)], "n int"), "n").orderBy("n").collect()
    assert [r.split for r in got] == ["dev", "dev", "test", "dev", "dev", "test", "dev"]


REVIEW = (
    "query_id string, answer_sha256 string, reviewer string, review_complete boolean, semantic_answer_correct boolean, answer_relevance int, completeness int,"
    " claims array<struct<claim:string, supported:boolean, evidence:array<struct<source_file:string, page_number:int, quote:string>>>>"
)
RESULT = "query_id string, answer string, error string, source_documents array<struct<content:string, source_file:string, page_number:int>>"


def test_reviews(spark):
    import hashlib

    answer = "营收 8000 万元，增长。"
    sha = hashlib.sha256(answer.encode()).hexdigest()
    results = spark.createDataFrame([("a", answer, None, [("营收为8000万元", "f", 1)]), ("e", "x", "timeout", [])], RESULT)
    good = ("a", sha, "R", True, True, 2, 2, [("营收8000万元", True, [("f", 1, "营收为 8000")])])

    def broken(**change):
        names = [f.name for f in spark.createDataFrame([], REVIEW).schema]
        row = tuple(change.get(n, v) for n, v in zip(names, good))
        return {r.rule for r in protocol.review_violations(spark.createDataFrame([row], REVIEW), results).collect()}

    assert broken() == set()
    assert broken(claims=[]) == set()
    assert broken(query_id="zz") >= {"unknown query"}
    assert broken(answer_sha256="0") == {"another answer"}
    assert broken(reviewer=" ") == {"no reviewer"}
    assert broken(review_complete=None) == {"incomplete"}
    assert broken(answer_relevance=3) == {"grades"}
    assert broken(claims=[("别的", False, None)]) == {"claim is no span"}
    assert broken(claims=[("增长", False, None), ("增 长", False, None)]) == {"repeated claim"}
    assert broken(claims=[("增长", True, None)]) == {"no evidence"}
    assert broken(claims=[("增长", True, [("f", 2, "营收")])]) == {"quote not on page"}
    twice = spark.createDataFrame([good, good], REVIEW)
    assert {r.rule for r in protocol.review_violations(twice, results).collect()} == {"repeated review"}


def test_dataset_violations(spark):
    s = "query_id string, question string, answerable boolean, answer_checks array<array<string>>, gold_pages array<struct<source_file:string, page_number:int, relevance_grade:int>>"
    rows = [("a", "q", True, [["x"]], [("f", 1, 3)]), ("b", "q", True, [], [("f", 1, 3)]), ("c", "r", False, [["x"]], []), ("d", None, True, [["x"]], [("g", 9, 0)])]
    got = {(r.query_id, r.rule) for r in protocol.dataset_violations(spark.createDataFrame(rows, s), spark.createDataFrame([("f", 1)], "source_file string, page_number int")).collect()}
    assert got == {("a", "repeated question"), ("b", "no checks"), ("c", "unanswerable with labels"), ("d", "page not in index"), ("d", "grade")}


def test_quality_loop(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "seq int, created_at double")
    assert [r.seq for r in quality.last_traces(t, 2, ["created_at", "seq"]).collect()] == [3, 2]
    with pytest.raises(ValueError):
        quality.last_traces(t, 0, ["seq"])
    rev = spark.createDataFrame([("q", 5.0, 1, "first"), ("q", 5.0, 2, "tie"), ("q", 1.0, 3, "old"), ("p", 9.0, 4, "p")], "question string, reviewed_at double, seq int, answer string")
    assert [(r.question, r.answer) for r in quality.few_shot(rev, "question", "reviewed_at", "seq").collect()] == [("p", "p"), ("q", "first")]
    events = spark.createDataFrame([("c1", "bm25_recall", "ignore"), ("c1", "none", "ignore"), ("c9", "fusion", "ignore"), ("c1", "fusion", None)], "bad_case_id string, failure_stage string, disposition string")
    rules = sorted(r.rule for r in quality.review_violations(events, spark.createDataFrame([("c1",)], "bad_case_id string")).collect())
    assert rules == ["unknown case", "unknown disposition", "unknown stage"]
    cases = spark.createDataFrame([("a", "reviewed", "ignore"), ("b", "reviewed", "few_shot_candidate"), ("c", "pending_review", None)], "bad_case_id string, status string, disposition string")
    assert [json.loads(r.value)["bad_case_id"] for r in quality.export_rows(cases).collect()] == ["b"]
    fb = spark.createDataFrame([("t1", "useless"), ("t2", "useful")], "trace_id string, feedback string")
    tr = spark.createDataFrame([("t1", 1.0, 1, "old"), ("t1", 2.0, 2, "new")], "trace_id string, created_at double, seq int, answer string")
    got = quality.pending_cases(fb, tr).collect()
    assert [(r.trace_id, r.answer, r.status) for r in got] == [("t1", "new", "pending_review")]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"a": 1, "b": "字"}\n\n  \n{"a": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_jsonl_strict(spark, str(good), "a int, b string").collect()] == [(1, "字"), (2, None)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n{broken\n', encoding="utf-8")
    with pytest.raises(Exception, match="invalid JSON"):
        io.read_jsonl_strict(spark, str(bad), "a int").collect()
    assert io.read_jsonl(spark, str(bad), "a int").count() == 1
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    io.write_new(spark.range(2), str(tmp_path / "new"))
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_new(spark.range(2), str(tmp_path / "new"))
    io.append(spark.range(3), str(tmp_path / "log"))
    io.append(spark.range(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    io.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'


def test_chunk_and_fact_files(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps([{"chunk_id": 0, "content": "x", "metadata": {"company": "c", "source_file": "f"}}]))
    r = io.read_chunks(spark, str(p)).first()
    assert (r.page, r.start_index, r.company) == (0, -1, "c")
    f = tmp_path / "f.json"
    f.write_text(json.dumps({"companies": {"甲": {"report_year": 2021, "currency": "CNY", "metrics": {"revenue": {"value": "1", "display": "1元"}}}}}))
    assert io.read_facts(spark, str(f)).first().company == "甲"
    (tmp_path / "1_x_report.pdf").write_bytes(b"a\x00b")
    (tmp_path / "2_bad_report.pdf").write_bytes(b"!")

    def parse(data):
        if data == b"!":
            raise OSError
        return ["one", None]

    pages = io.read_pages(spark, str(tmp_path), parse).orderBy("page").collect()
    assert [(r.page, r.text, r.company) for r in pages] == [(0, "one", "x"), (1, "", "x")]


def test_connectors(spark):
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"ok": True}

    assert io.with_retries(call, sleep=lambda s: None) == {"ok": True} and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        io.with_retries(lambda: 1 / 0, retry=lambda e: False)
    df = spark.createDataFrame([(1, "q", 1, "aa"), (1, "q", 2, "b"), (2, "fail", 1, "x")], "query_id int, question string, chunk_id int, content string")

    def client(question, texts):
        if question == "fail":
            raise OSError
        return [len(t) for t in texts]

    got = {(r.query_id, r.chunk_id): r.score for r in io.scored_by(df, client, "query_id", "question", "chunk_id", "content").collect()}
    assert got == {(1, 1): 2.0, (1, 2): 1.0, (2, 1): None}
    assert io.embedded_by(df, lambda t: [[float(len(x))] for x in t], "content").first().embedding == [2.0]


def test_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=20 * i), 1, "click", float(i), "{}") for i in range(30)]
    spark.createDataFrame(rows, traces.EVENTS.replace("timestamp_ntz", "timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    stream = traces.windowed_latency(traces.read_events(spark, str(tmp_path / "in")))
    traces.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert out and out[0].n == 3 and out[0].most == 2.0
