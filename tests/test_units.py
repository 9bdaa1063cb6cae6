"""Changepoint search against brute force, and unit changes on small histories."""

from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.functions.quantities import quantities
from larkspur.operators import units


def brute(y, noise, penalty):
    n, best = len(y), None
    for k in range(n):
        for cuts in combinations(range(1, n), k):
            edges = [0, *cuts, n]
            cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() / noise**2 + penalty for a, b in zip(edges, edges[1:]))
            if best is None or cost < best:
                best = cost
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 1.0, 3.0, -4.0]), min_size=1, max_size=8), st.sampled_from([0.05, 0.5, 2.0]))
def test_segmentation_is_optimal(values, noise):
    y, penalty = np.array(values), 2.0
    got = units.segments(y, noise, penalty)
    assert got[0][0] == 0 and got[-1][1] == len(y) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() / noise**2 + penalty for a, b, _ in got)
    assert abs(cost - brute(y, noise, penalty)) < 1e-6


def test_empty_history():
    assert units.segments(np.zeros(0)) == []


FACT = "fact_id string, company string, report_year int, currency string, metrics map<string, struct<value:string, display:string>>, received_at timestamp"


def facts(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(f, c, y, cur, m, datetime(2024, 1, 1)) for f, c, y, cur, m in rows], FACT)


def test_unit_changes_are_found_and_reversed(spark):
    rows = [
        ("a", "x", 2020, "CNY", {"revenue": ("8000", "8000万元"), "roe": ("12.5", "12.5%")}),
        ("b", "x", 2021, "CNY", {"revenue": ("90000000", "9000万元"), "roe": ("0.125", "1250bp")}),
        ("c", "x", 2022, "USD", {"revenue": ("5000000", "500万元"), "equity": (None, "5元"), "cash_flow": ("7", None)}),
        ("d", None, 2022, None, {"revenue": ("100000000", "US$100 million"), "debt_ratio": ("50", "0.5")}),
        ("e", "x", 2023, "CNY", None),
        ("e", "x", 2023, "CNY", None),
    ]
    got = {(r.fact_id, r["item"]): r for r in units.fact_quantities(facts(spark, rows)).collect()}
    assert (got["a", "revenue"].status, got["a", "revenue"].power, got["a", "revenue"].value) == ("unit change", -4, 8e7)
    assert got["a", "roe"].status == got["b", "revenue"].status == got["d", "debt_ratio"].status == got["d", "revenue"].status == "as agreed"
    assert (got["b", "roe"].status, got["b", "roe"].power) == ("unit change", -2)
    assert got["c", "revenue"].status == "other currency"
    assert got["c", "equity"].value == 5 and got["c", "cash_flow"].value == 7
    assert len(got) == 9


def test_blocks_change_nothing(spark):
    rows = [(f"f{i:03d}", "hot", 2000 + i % 5, "CNY", {"revenue": (str(10**4 if i % 7 == 0 else 10**8), "1亿元")}) for i in range(60)]
    a = units.fact_quantities(facts(spark, rows))
    b = units.fact_quantities(facts(spark, rows), block=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("status = 'unit change' and power = -4").count() == 9


def test_missing_form_takes_its_segment(spark):
    rows = [(f"f{i}", "x", 2000 + i, "CNY", {"revenue": ("8000", None if i == 2 else "8000万元")}) for i in range(5)]
    got = {r.fact_id: r.value for r in units.fact_quantities(facts(spark, rows)).collect()}
    assert got["f2"] == 8e7


def test_answers():
    rows = units.answer_rows("营收为38390万元，毛利率为12.5%。", [["38390万元", "3.839亿", "38390万", "383900千元", None, "1亿元"], ["0.125", "125‰", "12.5%", "x", ""], None])
    power = {r[1]: r[6] for r in rows if r[0] == "check"}
    assert power["0-0"] == 0 and power["0-1"] == 4 and power["0-2"] == 0 and power["0-3"] == -1 and power["0-5"] is None
    assert power["1-0"] == 2 and power["1-1"] == -1 and power["1-2"] == 0
    assert units.answer_rows(None, None) == [] and units.answer_rows("", [[]]) == []
    # another currency is another quantity; an equal statement in the same size hides none
    assert [r[6] for r in units.answer_rows("RMB 60 million", [["0.6亿美元"]]) if r[0] == "check"] == [None]
    assert [r[6] for r in units.answer_rows("6000万元，即60百万元", [["60百万元"]]) if r[0] == "check"] == [0]


def test_amounts_in_text():
    for text, value, currency in [
        ("三亿五千万元", 350_000_000, "CNY"), ("1亿2000万元", 120_000_000, "CNY"), ("一百二十三万四千元", 1_234_000, "CNY"), ("人民币3亿5000万元", 350_000_000, "CNY"), ("3亿2千万美元", 320_000_000, "USD"), ("1万亿2000亿元", 1_200_000_000_000, "CNY"),
        ("USD 1.2m", 1_200_000, "USD"), ("US$3B", 3_000_000_000, "USD"), ("$5k", 5000, "USD"), ("负3亿元", -300_000_000, "CNY"), ("-3亿元", -300_000_000, "CNY"), ("净利润-3亿元", -300_000_000, "CNY"), ("负三亿五千万元", -350_000_000, "CNY"), ("$-5 million", -5_000_000, "USD"),
        ("HK$5 million", 5_000_000, "HKD"), ("£3m", 3_000_000, "GBP"), ("3亿欧元", 300_000_000, "EUR"), ("5 million yen", 5_000_000, "JPY"), ("20亿日元", 2_000_000_000, "JPY"), ("5000万港元", 50_000_000, "HKD"), ("€2bn", 2_000_000_000, "EUR"), ("六百万", 6_000_000, None),
    ]:
        assert [(q.value, q.currency) for q in quantities(text)] == [(value, currency)], text
    assert [q.value for q in quantities("1亿元-3亿元")] == [10**8, 3 * 10**8]
    assert [q.value for q in quantities("营收3亿元，净利5000万元")] == [3 * 10**8, 5 * 10**7]
    assert [q.value for q in quantities("5000万3亿元")] == [5 * 10**7, 3 * 10**8]
    assert quantities("1.2m") == [] == quantities("5 mm")


def test_a_record_off_by_one_factor_is_repaired_where_nothing_is_printed(spark):
    names = ["cash_flow", "equity", "net_profit", "revenue", "total_assets"]
    rows = [("a", "x", 2020, "CNY", {n: ("80000000", "8000万元") for n in names})]
    rows.append(("b", "x", 2021, "CNY", {n: ("8000", None if n == "net_profit" else "8000万元") for n in names}))
    rows.append(("c", "x", 2022, "CNY", {n: ("80000000", None if n == "revenue" else "8000万元") for n in names}))
    got = {(r.fact_id, r["item"]): r for r in units.fact_quantities(facts(spark, rows)).collect()}
    assert got["b", "net_profit"].value == 8e7 and got["b", "net_profit"].power == -4
    assert got["c", "revenue"].value == 8e7 and got["c", "revenue"].power == 0
    assert all(got["b", n].status == "unit change" for n in names if n != "net_profit")


def test_levels_of_no_known_factor_zero_and_signs(spark):
    rows = [("a", "x", 2020, "CNY", {"revenue": ("81", "80元"), "equity": ("0", "5元"), "cash_flow": ("-5", "5元"), "net_profit": ("-500000000", "负5亿元"), "total_assets": ("5", "5欧元")})]
    got = {r["item"]: r.status for r in units.fact_quantities(facts(spark, rows)).collect()}
    assert got == {"revenue": "differs", "equity": "differs", "cash_flow": "differs", "net_profit": "as agreed", "total_assets": "other currency"}


def test_empty_tables(spark):
    assert units.fact_quantities(facts(spark, [])).count() == 0
    assert units.answer_quantities(spark.createDataFrame([], "query_id string, gold_answer string, answer_checks array<array<string>>, value int")).count() == 0
