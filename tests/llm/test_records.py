import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import fusion, names, overlap, questions

COMPANY = "company_id int, company string, english_name string, aliases array<string>, industry string, place string"
ROWS = [
    (1, "昂麒电子有限责任公司", "Yarulin Electronics Co., Ltd.", ["老昂"], "电子", None),
    (2, "西屏龙铭装备制造集团有限公司", "Mibdaneth Equipment Co., Ltd.", [], "装备制造", "西屏"),
    (3, "龙铭食品集团有限公司", "Mibdaneth Foods Holdings Ltd.", None, "食品", None),
    (4, "齐昕物流集团有限公司", "Zantorulin Logistics Group Co., Ltd.", [None], "物流", None),
    (5, "湘珏教育咨询有限公司", "Danvenemi Education Inc.", ["珏哥家"], "教育咨询", None),
]


@pytest.fixture(scope="module")
def register(spark):
    return names.register(spark.createDataFrame(ROWS, COMPANY))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("昂麒电子有限责任公司", (1,)), ("给麒电子公司", (1,)), ("麒昂·电 子", (1,)), ("「昂麒电子」", (1,)), ("電子昂麒有限責任公司", (1,)), ("昂麒股份", (1,)), ("老昂（电子）", (1,)), ("昂麒子电", (1,)),
        ("龙铭装制集团", (2,)), ("龙铭装备制造集团有限公司-西屏", (2,)), ("龙铭食品（总部）集团有限公司", (3,)), ("龙铭公司", ()), ("龙铭航运有限公司", ()), ("昕齐物流", (4,)), ("湘珏教咨有限公司", (5,)), ("珏哥家", (5,)),
        ("YARULIN ELECTRONICS", (1,)), ("Electronics Yarulin", (1,)), ("Co. Ltd. Yaurlin Elec", (1,)), ("Mibdaneth Equip", (2,)), ("Mibdanet Foods", (3,)), ("Mibdaneth", ()), ("The Danvenemi Edu Group", (5,)), ("Zantorulin-Logistics", (4,)),
        ("杭楷科技有限公司", ()), ("Galtoremi Media", ()), ("未知", ()), ("", ()), (None, ()), ("  ", ()),
        ("对比一下昂麒电子公司与昕齐物流，2018年二季度应收账款相差多少", (1, 4)), ("what was net profit of Yarulin, Electronics Co in Q1 2019?", (1,)),
    ],
)
def test_variants(register, text, ids):
    assert register.value.link(text) == ids


def test_distance_and_assignment():
    assert names.distance("ab", "ba") == 1 and names.distance("abc", "") == 3 and names.distance("kitten", "sitting") == 3
    assert names.token_cost("equip", "equipment") == 0.5 and names.token_cost("sw", "software") == 0.5
    assert names.assign(["b", "a"], ("a", "b")) == (0.0, 2) and names.assign([], ("a",)) == (1.5, 0)
    assert "bc" in names.deletes("abc") and "abc" in names.deletes("abc")


HAN = "昂麒泓锴龙铭瑛禾骞璟玖尧辉茂芙皓跃诺铄曜蓝簇琛振徽缇沅霄宜贤隽萦睿沐贺琳鸢煜霁菱矗浦畅荔锦芸上海新世纪长城东方明珠"
BRAND = st.text(HAN, min_size=1, max_size=8)
LEAD = st.text("abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=9)
ENTRY = st.tuples(BRAND, LEAD, st.sampled_from(["电子", "装备制造", "医疗", "新材料", ""]), st.sampled_from(["Electronics", "New Materials", "Medical", ""]), st.sampled_from([None, "西屏"]), st.sampled_from(["有限公司", "集团股份有限公司"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(ENTRY, min_size=1, max_size=6))
def test_registered_names_of_any_length_link_to_themselves(entries):
    rows, seen = [], set()
    for i, (brand, lead, industry, field, place, form) in enumerate(entries):
        name, english = f"{place or ''}{brand}{industry}{form}", " ".join(x for x in (lead.title(), field, "Co., Ltd.") if x)
        if name not in seen and english not in seen:
            seen |= {name, english}
            rows.append({"company_id": i, "company": name, "english_name": english, "aliases": None, "industry": industry or None, "place": place})
    r = names.Register(rows)
    for row in rows:
        assert r.link(row["company"]) == r.link(row["english_name"]) == (row["company_id"],)
        assert row["company_id"] in r.link(f"请问{row['company']}的净利润是多少？") and row["company_id"] in r.link(f"net profit of {row['english_name']} in 2020?")


def test_long_brands_short_words_and_initials():
    rows = [
        {"company_id": 1, "company": "上海新世纪长城电子有限公司", "english_name": "Newcentury Great Wall Electronics Co., Ltd.", "aliases": None, "industry": "电子", "place": "上海"},
        {"company_id": 2, "company": "东方明珠传媒股份有限公司", "english_name": "BOE Technology Co., Ltd.", "aliases": [""], "industry": "传媒", "place": None},
        {"company_id": 3, "company": "骞科技有限公司", "english_name": "TCL Holdings Ltd.", "aliases": None, "industry": "科技", "place": None},
        {"company_id": 4, "company": "沅霄物流有限公司", "english_name": "Huarong Medical Co., Ltd.", "aliases": None, "industry": "物流", "place": None},
        {"company_id": 5, "company": "沅霄医疗有限公司", "english_name": "Huarong Media Co., Ltd.", "aliases": None, "industry": "医疗", "place": None},
    ]
    r = names.Register(rows)
    for text, ids in [
        ("新世纪长城", (1,)), ("新世己长城电子", (1,)), ("电子新世纪长城", (1,)), ("Newcentury Great Wal Electronics", (1,)), ("东方明珠", (2,)), ("东方明株传媒", (2,)), ("东明方珠传媒", (2,)),
        ("BOE", (2,)), ("boe tech", (2,)), ("the boe constrictor", ()), ("TCL", (3,)), ("TCL Holdings Ltd.", (3,)), ("骞科技", (3,)), ("骞", ()),
        ("Huarong Med", (4,)), ("Huarong Mda", (5,)), ("H. Medical", (4,)), ("h media", (5,)), ("Q. Media", ()), ("沅霄", ()), ("沅霄物流和沅霄医疗", (4, 5)),
    ]:
        assert r.link(text) == ids, text


def test_link_table(spark, register):
    df = spark.createDataFrame([("company", "1", "昂麒电子"), ("company", "1", "昂麒电子"), ("slot", "2", None)], "place string, ref_id string, mention string")
    got = names.link(df, register).collect()
    assert [r.company_ids for r in got] == [[1], [1], []]
    assert names.link(df.where("false"), register).count() == 0
    empty = names.register(spark.createDataFrame([], COMPANY))
    assert names.link(df, empty).where("size(company_ids) > 0").count() == 0


SAME = [
    "查一下昂麒电子有限责任公司“萍楼”门店群2016年二季度在线上渠道的净利润，把营业收入也列出来。",
    "劳驾，２０１６年Q2给麒电子公司“萍楼”门店群在线上渠道的营收和净利分别是多少？谢谢",
    "二〇一六年第二季度昂麒 电子公司\"萍楼\"门店群线上渠道的营业收入、净利润各是多少",
]
OTHER = [SAME[0].replace(*c) for c in (("2016", "2017"), ("二季度", "三季度"), ("线上渠道", "直营渠道"), ("萍楼", "梨池"), ("门店群", "基地"), ("净利润", "总资产"), ("昂麒电子有限责任公司", "齐昕物流集团有限公司"), ("在线上渠道的", "的"))]


def asks(register, text):
    return questions.question_words(text, register.value)


def test_question_words(register):
    want = asks(register, SAME[0])
    assert want == ["company=1", "figure=net profit", "figure=revenue", "name=萍楼", "object=stores", "period=q2", "region=online", "year=2016"]
    assert all(questions.same_question(asks(register, a), asks(register, b)) for a in SAME for b in SAME)
    assert not any(questions.same_question(asks(register, q), want) for q in OTHER)
    a = asks(register, "What ROE did the Barwick Ridge One plant of Yarulin Electronics Co., Ltd. show in H1 2023?")
    assert a == asks(register, "hi, what was the roe of the barwick ridge one plant at YARULIN ELEC for H1 FY2023?")
    assert asks(register, None) == asks(register, "  ") == []


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("昂麒电子2022年员工人数是多少", "昂麒电子2022年商誉是多少", False), ("昂麒电子2022年客户满意度是多少", "昂麒电子2022年续约比例是多少", False), ("昂麒电子2022年客户满意度是多少", "请问昂麒电子公司2022年客户满意度是多少？", True),
        ("昂麒电子2022年10月营业收入是多少", "昂麒电子2022年11月营业收入是多少", False), ("昂麒电子2022与2021年的营业收入", "昂麒电子2022与2023年的营业收入", False), ("昂麒电子2022年市盈率是多少", "昂麒电子2022年市占率是多少", False),
        ("昂麒电子公司2022年净利润是多少", "昂麒电子2022年净利润是多少", True), ("昂麒电子2022年销售费甩是多少", "昂麒电子2022年销售费用是多少", True), ("昂麒电子2022年分部收入是多少", "昂麒电子2022年收入分别是多少", False),
        ("What was the goodwill of Yarulin Electronics in 2020?", "What was the headcount of Yarulin Electronics in 2020?", False), ("Waht was the churn of Yarulin Electronics in 2020", "what was the churn at Yarulin, Electronics Co fo 2020?", True),
        ("Revenue of Yarulin Electronics in 2020 and 2021", "Revenue of Yarulin Electronics in 2020 and 2022", False), ("Revenue of Yarulin Electronics in October 2020", "Revenue of Yarulin Electronics in November 2020", False),
        ("杭楷科技有限公司2016年净利润是多少？", "杭楷科技公司2016年净利是多少", True), ("杭楷科技有限公司2016年净利润是多少？", "沛洵科技有限公司2016年净利润是多少？", False),
    ],
)
def test_what_no_list_knows_counts(register, a, b, same):
    assert questions.same_question(asks(register, a), asks(register, b)) == same


TEST = "query_id string, question string, split string, extra int"


def test_overlaps(spark, register):
    rows = [("V1", SAME[0], " TRAIN", 1), ("V1", SAME[0], " TRAIN", 1), ("V2", SAME[1], "Dev", 1), ("V3", OTHER[0], "test", 1), ("V4", None, "train", 1), ("V5", None, "dev", 1), ("V6", SAME[2], None, 1), ("V7", SAME[2], "train ", 1)]
    golden = spark.createDataFrame([("F1", SAME[2]), ("F2", OTHER[1]), ("F3", " ")], "query_id string, question string")
    pairs, members = overlap.question_overlaps(spark.createDataFrame(rows, TEST), golden, register)
    found = overlap.cross_pairs(pairs, *overlap.sides(members))
    got = sorted((r.train_id, r.eval_id, r.source) for r in found.collect())
    assert got == [("V1", "F1", "golden_test_set"), ("V1", "V2", "test_set_v2"), ("V7", "F1", "golden_test_set"), ("V7", "V2", "test_set_v2")]
    classes = overlap.class_pairs(pairs, members)
    assert sorted((r.source, r.train_id, r.eval_id, r.n_train, r.n_eval) for r in classes.collect()) == [("golden_test_set", "V1", "F1", 2, 1), ("test_set_v2", "V1", "V2", 2, 1)]
    report = {(r.source, r.split): (r.n_pairs, r.n_eval, r.n_train) for r in overlap.overlap_report(classes).collect()}
    assert report == {("golden_test_set", None): (2, 1, 2), ("test_set_v2", "dev"): (2, 1, 2)}
    pairs, members = overlap.question_overlaps(spark.createDataFrame([], TEST), golden.where("false"), register)
    assert pairs.count() == members.count() == 0


def test_question_recall_against_brute_force(spark, register):
    random.seed(5)
    figures = ["净利润", "营业收入", "总资产", "存货余额", "客户满意度", "续约比例", "净利闰", "存活余额"]
    ask = ["请问{c}“{n}”基地{y}年{p}的{f}和{g}分别是多少？", "{y}年{p}，{c}“{n}”基地份别录得多少{g}、{f}", "麻烦问下，投资者想知到{c}{y}年{p}“{n}”基地的{f}与{g}"]
    texts = [
        random.choice(ask).format(c=random.choice(["昂麒电子", "给麒电子公司", "齐昕物流"]), n=random.choice("萍莲"), y=random.choice([2020, 2021]), p=random.choice(["二季度", "Q2", "全年"]), f=random.choice(figures), g=random.choice(figures))
        for _ in range(400)
    ]
    sets = [asks(register, t) for t in texts]
    df = overlap.classed(spark.createDataFrame([(f"r{i}", w, questions.exact(w), i % 2) for i, w in enumerate(sets)], "id string, shingles array<string>, fixed array<string>, side int"))
    left, right = df.where("side = 0"), df.where("side = 1")
    pairs = overlap.cross_classes(left, right, *overlap.QUESTIONS, explained=questions.same_question)
    got = {(r.train_id, r.eval_id) for r in overlap.cross_pairs(pairs, left, right.drop("side")).collect()}
    want = set()
    for i in range(0, 400, 2):
        for j in range(1, 400, 2):
            a, b = set(sets[i]), set(sets[j])
            if 2 * len(a & b) >= len(a | b) and questions.same_question(sets[i], sets[j]):
                want.add((f"r{i}", f"r{j}"))
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100


def test_near_texts_against_brute_force(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(60)]
    base = [[random.choice(words) for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 4, 12):
            t = list(b)
            for _ in range(edits):
                t[random.randrange(60)] = random.choice(words)
            texts.append(" ".join(t))
    rows = [(f"r{i}", t, i % 2) for i, t in enumerate(texts)] + [("e1", "", 0), ("e2", None, 1), ("s1", "Ab, cd", 0), ("s2", "ab CD", 1)]
    df = spark.createDataFrame(rows, "id string, text string, side int").withColumn("shingles", overlap.word_shingles(F.col("text")))
    left, right = (overlap.classed(df.where(f"side = {i}").select("id", "shingles")) for i in (0, 1))
    pairs = overlap.cross_pairs(overlap.cross_classes(left, right, *overlap.TEXTS), left, right)
    got = {(r.train_id, r.eval_id): round(r.similarity, 9) for r in pairs.collect()}
    sets = {r.id: set(r.shingles or []) for r in df.collect()}
    side = {r[0]: r[2] for r in rows}
    want = {}
    for a in sets:
        for b in sets:
            if side[a] == 0 and side[b] == 1 and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.8:
                    want[a, b] = round(j, 9)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and ("s1", "s2") in got


VOTE = "run_id bigint, query_id string, method string, rank int, score double, chunk_id bigint, extra string"


def test_fusion_against_plain_reading(spark):
    random.seed(11)
    rows = []
    for run in range(6):
        for m in ("dense", "bm25", "reranker"):
            for c in random.sample(range(20), 8):
                s = random.choice([None, float("nan"), float("inf"), 1.0, 2.0, random.random()])
                rows.append((run, "q", random.choice([m, m.upper(), f" {m} "]), random.choice([None, 0, -1, 3, 9]), s, c, "x"))
    rows += rows[:9]
    got = {(r.run_id, r.chunk_id): (round(r.score, 9), r["rank"]) for r in fusion.fuse(spark.createDataFrame(rows, VOTE)).collect()}
    votes = {}
    for run, _, m, rank, s, c, _ in rows:
        m = m.strip().lower()
        ok = s is not None and s == s and abs(s) != float("inf")
        v = votes.setdefault((run, m), {}).setdefault(c, [None, None])
        if ok:
            s = s if m == "dense" else -s
            v[0] = s if v[0] is None else min(v[0], s)
        if rank is not None and rank >= 1:
            v[1] = rank if v[1] is None else min(v[1], rank)
    total = {}
    for (run, _), items in votes.items():
        scored = [v[0] for v in items.values() if v[0] is not None]
        for c, (s, claimed) in items.items():
            r = 1 + sum(x < s for x in scored) if s is not None else claimed or len(scored) + 1
            total[run, c] = total.get((run, c), 0) + 1 / (5 + r)
    assert set(got) == set(total) and all(abs(got[k][0] - total[k]) < 1e-8 for k in total)
    for run in range(6):
        order = sorted((c for r, c in total if r == run), key=lambda c: (-round(total[run, c], 12), c))
        assert [got[run, c][1] for c in order] == list(range(1, len(order) + 1))


def test_fusion_edges(spark):
    df = spark.createDataFrame([(None, "q", "bm25", 1, 1.0, 1, None), (1, "q", None, None, None, 7, None), (1, None, "bm25", 1, 2.0, None, None)], VOTE)
    assert [(r.run_id, r.chunk_id, r["rank"], r.method) for r in fusion.fuse(df).collect()] == [(1, 7, 1, "rrf")]
    assert fusion.fuse(df.where("false")).count() == 0
