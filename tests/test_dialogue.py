import pytest
from pyspark.sql import functions as F

from larkspur.operators import conversation, finance, grounding

NAMES = ["滨江消费品有限公司", "澜赋科技有限公司", "蓝天旅游有限公司"]


def rewritten(spark, turns, question):
    known = spark.createDataFrame([(a, n) for n in NAMES for a in (n, n.removesuffix("有限公司"))], "alias string, company string")
    df = spark.createDataFrame([(1, question, [("user", t) for t in turns])], "id int, question string, history array<struct<role:string,content:string>>")
    return conversation.rewrite_questions(df, known).first()


@pytest.mark.parametrize(
    ("turns", "question", "expected"),
    [
        (["滨江消费品2021年营业收入是多少？"], "那净利润呢？", "滨江消费品有限公司2021年净利润是多少？"),
        (["滨江消费品2021年营业收入是多少？"], "澜赋科技2021年净利润是多少？", "澜赋科技2021年净利润是多少？"),
        (["蓝天旅游2021年净利润是多少？"], "换算成万元呢？", "蓝天旅游有限公司2021年净利润换算成万元是多少？"),
        (["滨江消费品营业收入是多少？", "看2021年的。"], "那净利润呢？", "滨江消费品有限公司2021年净利润是多少？"),
        (["滨江消费品2021年净利润是多少？"], "和澜赋科技相比呢？", "滨江消费品有限公司与澜赋科技有限公司2021年净利润和相比如何？"),
    ],
)
def test_rewrite(spark, turns, question, expected):
    assert rewritten(spark, turns, question).rewritten_query == expected


def test_clarification(spark):
    for turns in ([], ["今天天气"]):
        r = rewritten(spark, turns, "那它呢？")
        assert r.needs_clarification and not r.used_history and r.confidence == 0.25


def test_turns_and_slots(spark):
    h = [("user", "滨江2020年营收"), ("assistant", "2019年净利润"), ("User", "  "), ("user", "毛利率"), (None, "x"), ("user", None)]
    df = spark.createDataFrame([("a", h, "那呢"), ("b", None, None), ("c", [], "x")], "id string, history array<struct<role:string,content:string>>, question string")
    got = {r.id: r for r in conversation.latest_slots(df).collect()}
    assert got["a"].turns == ["滨江2020年营收", "毛利率"] and got["a"].years == ["2020"] and got["a"].topics == ["毛利率"]
    assert got["b"].turns == [] and got["b"].years == []
    many = spark.createDataFrame([("a", [("user", str(i)) for i in range(9)], "q")], df.schema)
    assert conversation.latest_slots(many).first().turns == ["5", "6", "7", "8"]
    names = spark.createDataFrame([("滨江", "滨江公司")], "alias string, company string")
    out = {r.id: r.rewritten_query for r in conversation.rewrite_questions(df, names).collect()}
    assert out["b"] is None and out["c"] == "x"


FACTS = "company string, report_year int, currency string, source_file string, page_number int, metrics map<string, struct<value:string, display:string>>"


def facts(spark):
    m = lambda **k: {x: (v, d) for x, (v, d) in k.items()}
    rows = [
        ("阳光传媒", 2021, "CNY", "a.pdf", 1, m(revenue=("23800000000", "238亿元"), net_profit=("100", "100元"), roe=("10.5", "10.5%"))),
        ("医疗先锋", 2021, "CNY", "b.pdf", 2, m(revenue=("15000000000", "150亿元"), net_profit=("90", "90元"), roe=("10.5", "10.5%"))),
        ("能源巨星", 2021, "USD", "c.pdf", 3, m(revenue=("100000000", "1亿美元"), net_profit=("5000000", "500万美元"), roe=("3", "3%"))),
        ("蓝天旅游", 2021, "CNY", "d.pdf", 4, m(revenue=("100000000", "1亿元"), net_profit=("5000000", "500万元"), roe=("3", "3%"))),
        ("澜赋科技", 2021, "CNY", "e.pdf", 5, m(revenue=("8", "8元"), net_profit=("2", "2元"))),
        ("滨江消费", 2021, "CNY", "f.pdf", 6, m(revenue=("16", "16元"), net_profit=("1", "1元"))),
    ]
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize(
    ("companies", "question", "parts"),
    [
        (["阳光传媒", "医疗先锋"], "营业收入相差多少亿元？", ["营业收入为238亿元", "营业收入为150亿元", "两者相差88亿元。"]),
        (["蓝天旅游"], "2021年营收和净利润换算成万元", ["营业收入为10000万元，净利润为500万元"]),
        (["澜赋科技", "滨江消费"], "净利率谁更高", ["净利率为25%", "净利率为6.25%", "澜赋科技更高。"]),
        (["阳光传媒", "医疗先锋"], "ROE是否相同", ["两者相同。"]),
        (["阳光传媒", "医疗先锋"], "ROE相差多少", ["两者相差0个百分点。"]),
        (["能源巨星", "蓝天旅游"], "营收谁更高", ["两者相同。"]),
        (["能源巨星", "蓝天旅游"], "营业收入相差多少", None),
        (["能源巨星"], "营业收入是多少亿元", None),
        (["阳光传媒"], "2020年营业收入", None),
        (["阳光传媒"], "为什么营业收入下降", None),
        (["阳光传媒"], "治理结构", None),
        (["没有"], "营业收入", None),
        (["澜赋科技"], "ROE", None),
        ([], "营业收入", None),
    ],
)
def test_finance(spark, companies, question, parts):
    q = spark.createDataFrame([(1, question, companies)], "query_id int, question string, companies array<string>")
    got = finance.answers(q, facts(spark)).collect()
    if parts is None:
        assert got == []
    else:
        assert all(p in got[0].answer for p in parts), got[0].answer
        assert [s.company for s in got[0].sources] == companies


def test_grounding(spark):
    rows = [("8,000万元", "收入8000万元", True), ("差88亿", "238与150", True), ("25%", "2和8", True), ("99", "1和2", False), ("Q1无数", "", True), ("3", None, None), ("1.5", "15000", True), ("7", "", False)]
    df = spark.createDataFrame(rows, "a string, c string, want boolean")
    for r in df.select(grounding.grounded(F.col("a"), F.col("c")).alias("g"), "want").collect():
        assert r.g == r.want


def test_boundary_and_predicates(spark):
    rows = [("给我API KEY", None, "security"), ("今天股价", ["2021"], "realtime"), ("2019和2018年营收", ["2021"], "years:2018、2019"), ("2019年营收", None, None), ("2021年营收", ["2021"], None)]
    df = spark.createDataFrame(rows, "q string, y array<string>, want string")
    for r in df.select(grounding.boundary(F.col("q"), F.col("y")).alias("got"), "want").collect():
        assert r.got == r.want
    p = spark.createDataFrame([("根据现有信息无法回答该问题", False), (" ", False), (None, False), ("营收8亿", True)], "a string, want boolean")
    for r in p.select(grounding.is_supported(F.col("a")).alias("got"), "want").collect():
        assert bool(r.got) == r.want
    n = spark.createDataFrame([("治理结构", 0, 2), ("x", 2, 2), ("x", 9, 3), ("x", 1, 1)], "q string, n int, want int")
    assert all(r.got == r.want for r in n.select(grounding.page_limit(F.col("q"), F.col("n")).alias("got"), "want").collect())
    g = spark.createDataFrame([(0.2, 0.0, True), (0.1, 0.9, False), (None, 0.35, True), (None, None, False)], "r double, c double, want boolean")
    assert all(r.got == r.want for r in g.select(grounding.relevant(F.col("r"), F.col("c")).alias("got"), "want").collect())
