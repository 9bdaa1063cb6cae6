"""Column functions against plain Python readings of the same rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.functions.quantities import bare_number, quantities
from larkspur.functions.text import plain

TEXT = st.text(alphabet="公司营收净利润12 3.5%,，。！\tab-C_\n(é　", max_size=40)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()[0]


def test_token_estimate_agrees_with_regular_expressions(spark):
    texts = ["", " ", "公司2021年营收3.5亿元，同比+5%。", "a.b-c d_e", "é à", "x" * 50, "第1页\t第2页"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.token_estimate(F.col("t")).alias("n")).collect()
    for t, n in rows:
        han = len(re.findall(r"[㐀-鿿]", t))
        runs = len(re.findall(r"[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*", t))
        marks = len(re.findall(r"[^\w\s㐀-鿿]", t))
        assert n == max(1, han + runs + marks), t


def test_bm25_tokens(spark):
    assert one(spark, "营收Q1 3.5亿 A", C.bm25_tokens) == ["q1", "3.5", "a", "营", "收", "亿", "营收"]
    assert one(spark, "", C.bm25_tokens) == []


@settings(max_examples=30, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_normal_forms(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.key_text(F.col("t")), C.without_space(F.col("t")), C.answer_text(F.col("t"))).collect()
    for t, key, bare, answer in rows:
        assert key == re.sub(r"[^\w]", "", t).lower()
        assert bare == re.sub(r"\s+", "", t)
        assert answer == re.sub(r"[\s,，]", "", t).lower()


def test_headings_and_tables(spark):
    assert one(spark, "经营情况", C.is_heading)
    assert not one(spark, "说明文字。", C.is_heading)
    assert not one(spark, "  ", C.is_heading)
    assert not one(spark, "1和2", C.is_heading)
    assert one(spark, "营业收入    8000    9200", C.is_table_line)
    assert not one(spark, "营业收入 8000 9200", C.is_table_line)


def test_wrapped_lines(spark):
    df = spark.createDataFrame([(["net", "profit", "", "为", "5"],)], "x array<string>")
    assert df.select(C.join_wrapped(F.col("x"))).first()[0] == "net profit为5"


def test_checks(spark):
    df = spark.createDataFrame([("营收 1,000 元", [["1000元", "x"], ["营收"]]), ("a", [["b"]]), ("a", [])], "a string, g array<array<string>>")
    assert [r[0] for r in df.select(C.checks_pass(F.col("a"), F.col("g"))).collect()] == [True, False, None]


def test_filename_company(spark):
    assert one(spark, "101_yarulin_elec_report.pdf", C.company_from_filename) == "yarulin_elec"


def test_quantities():
    def read(t):
        return [(q.kind, q.currency, float(q.value), float(q.size)) for q in quantities(t)]

    assert read("人民币8000万元") == [("amount", "CNY", 8e7, 1e4)]
    assert read("四千七百万元") == [("amount", "CNY", 4.7e7, 1e4)]
    assert read("US$86.3 million") == [("amount", "USD", 8.63e7, 1e6)]
    assert read("合计￥1,200,000") == [("amount", "CNY", 1.2e6, 1.0)]
    assert read("8416个基点") == [("ratio", None, 0.8416, 1e-4)]
    assert read("产量87.07万吨，容量8.8 MW") == [("mass", None, 870700.0, 1e4), ("power", None, 8800.0, 1e3)]
    assert read("型号M61") == [] and read(None) == [] and read("") == []
    assert float(bare_number("9.93E+7")) == 9.93e7 and bare_number("12元") is None


def test_plain():
    assert plain("ＲΜB​ 92 mіllіοn") == "RMB 92 million"
