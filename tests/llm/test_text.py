import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import language, looks, splitting


def test_looks():
    same = [("RΜB 92 mіlliοn", "RMB 92 million"), ("42‍3.9‰", "423.9‰"), ("Señora", "Señora"), ("39200平⽅米", "39200平方米"), ("５，０％", "5,0%"), ("ﬁ", "fi"), ("a b　c", "a b c"), ("e​́", "é"), ("￥1", "¥1"), ("\u09c7\u09be", "\u09cb"), ("\u0bc6\u0bbe", "\u0bca"), ("\u0cbf\u0cd5", "\u0cc0"), ("\u0dd9\u0dcf\u0dca", "\u0ddd"), ("\u1025\u102e", "\u1026"), ("b\u0131t", "bit"), ("c\u0251t", "cat"), ("r\u0585e", "roe")]
    for a, b in same:
        assert looks.canonical(a) == looks.canonical(b), (a, looks.canonical(a))
    differ = [("ROE", "roe"), ("1,000", "1000"), ("a b", "ab"), ("é", "e"), ("m²", "m2"), ("①", "1"), ("½", "1/2"), ("吨", "t")]
    for a, b in differ:
        assert looks.canonical(a) != looks.canonical(b), (a, b)
    assert looks.canonical(None) is None and looks.canonical("") == "" and looks.canonical("​﻿") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aеοéçñ​‍­ ，。１２Ⅳ⽅ﬃ한글゙́̈か", max_size=30))
def test_canonical_form_is_stable(text):
    once = looks.canonical(text)
    assert looks.canonical(once) == once
    assert looks.canonical(unicodedata.normalize("NFD", text)) == once
    whole = unicodedata.normalize("NFC", "".join(looks._fold(c) for c in text))
    assert once == whole  # splicing segments gives what folding the whole text gives


def test_canonical_columns(spark):
    df = spark.createDataFrame([("a", "５", [["５", None], None, []], 1), ("b", None, None, 2)], "id string, t string, g array<array<string>>, t_x int")
    got = {r.id: r for r in looks.canonical_columns(df, ["t", "g"]).collect()}
    assert got["a"].t_canonical == "5" and got["a"].g_canonical == [["5", None], None, []] and got["a"].t == "５"
    assert got["b"].t_canonical is None and got["b"].g_canonical is None
    assert looks.canonical_columns(df.where("false"), ["t"]).count() == 0


def reference_count(t):
    return reference_size(t) if t.strip() else 0


def reference_size(t):
    return max(1, len(re.findall(r"[㐀-鿿]", t)) + len(re.findall(r"[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*", t)) + len(re.findall(r"[^\w\s㐀-鿿]", t)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["漢", "字。", "，", "a", "b1", ".", "-", "%", " ", "_", "é", "\n", "a.b-c", "xxxxx", "1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6.7.8.9"]), max_size=120).map("".join), st.sampled_from([(5, 2), (14, 6), (40, 8), (3, 0), (1, 0), (2, 1), (20, 19)]))
def test_pieces(text, sizes):
    limit, overlap = sizes
    s = splitting.Splitter(text)
    assert s.size == reference_size(text)
    pieces = s.pieces(limit, overlap)
    assert (len(pieces) > 1) == (s.size > limit)
    assert all(reference_size(text[a:b]) <= limit for a, b, *_ in pieces)
    end = 0
    for i, (a, b, _, shared, _) in enumerate(pieces):
        assert a <= end < b or (i == 0 and a == 0)
        assert shared == (overlap if i else 0) == reference_count(text[a:end])
        assert pieces[i][2] == reference_size(text[a:b])
        end = b
    assert end == len(text)


def test_boundaries_and_overlap():
    text = "第一句话在这里。第二句话也在这里，还有一个分句。" * 5
    pieces = splitting.Splitter(text).pieces(30, 6)
    assert all(cut == "sentence" for *_, cut in pieces[:-1])
    assert all(shared == 6 for *_, shared, _ in pieces[1:])
    assert [c for *_, c in splitting.Splitter("字" * 50).pieces(20, 5)][:2] == ["hard", "hard"]


def test_runs_of_many_marks_are_measured_once():
    text = "1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6.7 " + "字" * 40
    pieces = splitting.Splitter(text).pieces(32, 0)
    assert [n for _, _, n, _, _ in pieces] == [reference_size(text[a:b]) for a, b, *_ in pieces] and pieces[0][1] == 34
    assert len(splitting.Splitter("1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6.7").pieces(32, 0)) == 1


def test_split_elements(spark):
    from datetime import datetime

    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [(1, "字。" * 30, " TABLE", t1), (1, "字。" * 40, "table", t2), (2, None, None, t1), (3, "  ", "x", t1), (4, "短", None, t1), (None, "字" * 99, "text", t1)]
    df = spark.createDataFrame(rows, "element_id bigint, text string, kind string, parsed_at timestamp").selectExpr("*", "1 as config_id")
    configs = spark.createDataFrame([(1, 20, 4), (2, 0, 0), (3, None, 1), (4, 9, 9), (5, 9, -1), (6, 9, None), (7, 1000, 0)], "config_id int, max_tokens int, overlap_tokens int")
    got = splitting.split_elements(df, configs).collect()
    assert {(r.config_id, r.element_id) for r in got} == {(1, 1), (7, 1), (1, 4), (7, 4)}
    one = sorted((r for r in got if (r.config_id, r.element_id) == (1, 1)), key=lambda r: r.piece_no)
    assert one[0].n_pieces == len(one) > 1 and one[-1].end_char == 80 and {r.kind for r in one} == {"table"}
    assert splitting.split_elements(df.where("false"), configs).count() == 0
    assert splitting.split_elements(df, configs.where("false")).count() == 0


SENTENCES = {
    "zh": ["公司营业收入同比增长。", "管理层认为需求保持平稳。", "审计机构出具了无保留意见。"],
    "en": ["The company reported higher revenue. ", "Demand is expected to stay flat. ", "The auditors issued an unqualified opinion. "],
    "de": ["Das Unternehmen meldete einen höheren Umsatz. ", "Die Nachfrage dürfte stabil bleiben. ", "Die Prüfer haben den Abschluss bestätigt. "],
    "fr": ["L'entreprise a annoncé une hausse du chiffre. ", "La demande devrait rester stable. ", "Les commissaires ont certifié les états. "],
    "es": ["La empresa anunció mayores ingresos. ", "Se espera que la demanda sea estable. ", "Los auditores emitieron una opinión. "],
    "ja": ["当社の売上高は増加しました。", "需要は横ばいで推移する見込みです。", "監査人は適正意見を表明しています。"],
}


def corpus(spark):
    rows, i = [], 0
    for lang, parts in SENTENCES.items():
        for k in range(12):
            i += 1
            rows.append((i, "".join(parts[k % 3 :] + parts[: k % 3]) * 2, {0: lang, 1: lang.upper(), 2: f"{lang}-XX"}[k % 3]))
    rows += [
        (901, SENTENCES["de"][0] + SENTENCES["fr"][1], "de"), (902, SENTENCES["zh"][0] + "另见《Marktbericht Einleitung》中的说明。", "zh"), (903, SENTENCES["en"][1], "und"), (904, SENTENCES["es"][2], "fr"),
        (905, None, None), (906, "", ""), (907, " \n", "n/a"), (908, "12 34 %", None), (909, SENTENCES["ja"][1], "Japanese"), (910, SENTENCES["zh"][1] * 400, None), (910, SENTENCES["zh"][1] * 400, None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as language")


def test_languages(spark):
    df = corpus(spark)
    got = language.identify(df, language.fit(df))
    by = {r.doc_id: r for r in got.collect()}
    assert by[901].languages == ["de", "fr"] and [s.lang for s in by[901].segments] == ["de", "fr"]
    assert by[902].languages == ["zh"] and by[903].language == "en" and by[904].language == "es"
    for i in (905, 906, 907, 908):
        assert by[i].language is None and by[i].segments == [] and by[i].confidence == 0
    for r in by.values():
        text = {x.doc_id: x.text for x in df.collect()}[r.doc_id] if r.segments else None
        if text:
            assert r.segments[0].start_char == 0 and r.segments[-1].end_char == len(text) and all(0 <= s.confidence <= 1 for s in r.segments)
    found = {(r.doc_id, r.lang) for r in language.found(got).collect()}
    assert found == {(901, "de"), (901, "fr"), (903, "en"), (904, "es"), (910, "zh")}
    assert language.identify(df.where("false"), language.fit(df)).count() == 0
    assert language.identify(df, language.fit(df.where("false"))).where("size(languages) > 0").count() == 0


def test_held_out_accuracy(spark):
    df = corpus(spark).where("doc_id < 900")
    model = language.fit(df.where("doc_id % 4 <> 0"))
    rows = language.identify(df.where("doc_id % 4 = 0"), model).collect()
    assert sum(r.language == r.label for r in rows) / len(rows) >= 0.95


def test_labels(spark):
    from pyspark.sql import functions as F

    want = {"zh-CN": "zh", " EN ": "en", "Deutsch": "de", "fr_CA": "fr", "spa": "es", "jpn": "ja", "it": "other", "": None, "unknown": None, "N/A": None, "und": None, "Chinese": "zh"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "l string")
    for r in df.select("l", language.label_language(F.col("l")).alias("x")).collect():
        assert r.x == want.get(r.l)


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    df = corpus(spark)
    model = language.fit(df)
    texts = [r.text for r in df.collect() if r.text] + [SENTENCES["de"][0] * 30 + SENTENCES["ja"][0] * 40 + "字" * 500]
    whole = language.classify(model.value, texts)
    texts.append("公司营业收入同比增长，" * 300 + "管理层认为需求保持平稳。" + " ".join(x.strip(". ") for x in SENTENCES["fr"] * 60) + ". " + SENTENCES["en"][0])
    whole = language.classify(model.value, texts)
    for part in (300, 41, 7):
        monkeypatch.setattr(language, "PART", part)
        cut = language.classify(model.value, texts)
        for a, b in zip(whole, cut, strict=True):
            assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] and [s[:3] for s in a[3]] == [s[:3] for s in b[3]]


def test_slices(spark):
    import pyarrow as pa

    from larkspur.functions.batches import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n >= 0 else None for n in (1, 5, -1, 50, 1, 1)])], names=["t"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 0, 6, 2)]
    assert [len(p) for p in parts] == [2, 1, 1, 2] and sum(parts, []) == batch.column(0).to_pylist()
