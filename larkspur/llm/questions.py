"""Questions as the words that carry what they ask for.

A question's normal text has its writing folded (width, case, look-alikes, simplified characters, numerals), the companies
it names replaced by their ids, and words of one meaning by one word (company, year, period, region, object, figure, quoted
name). Turns of phrase drop out. Every other word stays as it is, so what no list knows counts as something asked for.

Two questions whose words overlap enough ask the same if each word that only one of them has is explained: it is a slip of
the pen in a word of the other one, or in a turn of phrase. A word of a list is never a slip of another word of a list, and
numbers have no slips.
"""

from __future__ import annotations

import re
from functools import lru_cache

from larkspur.functions.text import plain
from larkspur.llm.names import FORM, GAP, SIMPLIFIED, Register, distance

# Figures and the words for them.
FIGURES = {
    "revenue": ("营业收入", "营收", "revenue", "sales revenue", "operating revenue", "turnover"),
    "net profit": ("净利润", "净利", "net profit", "net income", "net earnings"),
    "total assets": ("总资产", "资产总额", "total assets", "asset total"),
    "total liabilities": ("总负债", "负债总额", "total liabilities"),
    "equity": ("股东权益", "所有者权益", "shareholders equity", "shareholders' equity", "owners equity", "equity"),
    "cash flow": ("现金流量", "现金流", "cash flow"),
    "debt ratio": ("负债比率", "负债率", "debt ratio"),
    "liability-to-asset ratio": ("资产负债率", "资产负债比", "liability-to-asset ratio", "liability to asset ratio"),
    "return on equity": ("净资产收益率", "权益回报率", "return on equity", "roe"),
    "market share": ("市场占有率", "市占率", "market share"),
    "gross margin": ("毛利率", "毛利水平", "gross margin", "gross profit margin"),
    "research": ("研发投入", "研发支出", "研发费用", "r&d spending", "r&d expenses", "r&d", "research spending"),
    "selling expenses": ("销售费用", "销售开支", "selling expenses", "sales expenses"),
    "receivables": ("应收账款", "应收款", "accounts receivable", "receivables"),
    "inventory": ("存货余额", "库存余额", "存货", "库存", "inventory", "stock on hand"),
    "output": ("产量", "产出量", "output", "production volume"),
    "shipments": ("发货量", "出货量", "shipments", "shipment volume"),
    "capacity": ("装机容量", "装机规模", "installed capacity"),
    "floor area": ("厂房面积", "厂房占地", "floor area", "floor space"),
    "model": ("主打型号", "主推型号", "lead model", "flagship model", "main model"),
    "brand": ("首选供应品牌", "首选品牌", "preferred brand", "preferred supply brand"),
}
# Regions and channels.
REGIONS = {
    "north china": ("华北大区", "华北地区", "华北", "north china"),
    "east china": ("华东大区", "华东地区", "华东", "east china"),
    "south china": ("华南大区", "华南地区", "华南", "south china"),
    "central china": ("华中大区", "华中地区", "华中", "central china"),
    "southwest": ("西南大区", "西南地区", "西南", "southwest", "southwest china"),
    "northwest": ("西北大区", "西北地区", "西北", "northwest", "northwest china"),
    "northeast": ("东北大区", "东北地区", "东北", "northeast", "northeast china"),
    "overseas": ("海外市场", "海外", "overseas markets", "overseas"),
    "europe": ("欧洲市场", "欧洲", "europe", "the european market"),
    "southeast asia": ("东南亚市场", "东南亚", "southeast asia"),
    "online": ("线上渠道", "线上", "online channels", "online"),
    "direct": ("直营渠道", "直营", "direct sales"),
    "dealers": ("经销渠道", "经销", "dealer channels", "dealers"),
    "bonded": ("保税区", "bonded zone", "the bonded zone"),
    "public clients": ("政企客户", "政企", "public clients"),
    "small clients": ("中小客户", "中小", "small clients"),
}
# Kinds of objects.
OBJECTS = {
    "stores": ("门店群", "store group"),
    "subsidiary": ("子公司", "subsidiary"),
    "product line": ("产品线", "product line"),
    "base": ("基地", "site"),
    "plant": ("厂区", "plant"),
    "project": ("项目", "project"),
}
# Periods.
PERIODS = {
    "q1": ("一季度", "第一季度", "1季度", "q1", "first quarter"),
    "q2": ("二季度", "第二季度", "2季度", "q2", "second quarter"),
    "q3": ("三季度", "第三季度", "3季度", "q3", "third quarter"),
    "q4": ("四季度", "第四季度", "4季度", "q4", "fourth quarter"),
    "h1": ("上半年", "上半年度", "前六个月", "前半年", "h1", "first half", "first six months"),
    "h2": ("下半年", "下半年度", "后六个月", "后半年", "h2", "second half", "last six months", "second six months"),
    "year": ("全年", "全年度", "整年", "full year", "whole year", "entire year", "the year"),
}
# Figures that are asked for elsewhere, each a word of its own.
OTHER_FIGURES = (
    "市盈率 市净率 市销率 净利率 毛利润 总利润 利润总额 营业利润 营业成本 每股收益 商誉 分红 股息率 员工人数 流动比率 速动比率 周转率 存货周转率 资本开支 管理费用 财务费用 应付账款 预收账款 市值 "
    "price-earnings ratio|price-to-book ratio|net margin|operating profit|gross profit|earnings per share|goodwill|dividends|headcount|current ratio|quick ratio|operating costs|capital expenditure|"
    "administrative expenses|accounts payable|market capitalisation"
)
_OTHER = {w: (w,) for part in OTHER_FIGURES.split(" price", 1) for w in ((part.split(" ")) if part[0] > "ÿ" else ("price" + part).split("|"))}
# Turns of phrase around what is asked for.
PHRASES_HAN = (
    "投资者想知道 想了解一下 麻烦问下 麻烦问一下 年报披露 在年报中披露的 报告里写的 报告里 报告中 到底有多少呀 到底有多少 达到了什么水平 达到了什么水准 录得多少 分别录得多少 分别录得 分别是多少 各是多少 是多少 为多少 "
    "是什么数 是何数值 也列出来 也一并列出来 也一并列出 一并列出 查一下 查下 请问 请回答 请给出处 谢谢 劳驾 你好 口径 旗下 实现的 数字 截至 截止 把 按 在 和 与 及 的 急 末 年 度 财 、"
).split()
# Customary misspellings of such words.
MISSPELT = {"份别": "分别", "口经": "口径", "多小": "多少", "知到": "知道", "倒底": "到底", "批露": "披露", "数直": "数值", "报高": "报告", "达道": "达到", "查一査": "查一下", "岀": "出", "吿": "告"}
WORDS_LATIN = frozenset(
    "what was were is the of at in on for by did do does show shows showed report reports reported please list give tell me us hi hello hey thanks thank you could can how much many which and as to a an from with during "
    "its their it that or i if compare check pls this there any quick question questions would like know find out look up per over about s fy year years".split()
)
NUMERALS = str.maketrans("〇零一二三四五六七八九", "00123456789")
YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
QUOTED = re.compile(r"[“\"「『”]([^“”\"「」『』]{1,40})[”\"」』“]")
NAMED = re.compile(r"\bthe ((?:[a-z]+ ){1,4}?[a-z]+) (store group|subsidiary|product line|site|plant|project)\b")
SEPARATORS = re.compile(r"[|,，。？?、！!:：；;“”\"（）()·—\s]+")
#: Words of these slots have no slips: another value is another question.
EXACT = ("company", "year", "name")


def _words(table: dict[str, tuple[str, ...]], han: bool) -> list[tuple[str, str]]:
    """(word, canonical) in one script, the longest word first."""
    found = [(w, name) for name, words in table.items() for w in words if (w[-1] > "ÿ") == han]
    return sorted(found, key=lambda x: (-len(x[0]), x[0]))


class _Vocabulary:
    def __init__(self, table: dict[str, tuple[str, ...]], han: bool):
        self.names = dict(_words(table, han))
        # the last character of the trade 电子 and 公司 make no 子公司
        edge = ("(?<!电)", "") if han else (r"(?<![a-z0-9])", r"(?![a-z0-9])")
        self.pattern = re.compile(edge[0] + "(?:" + "|".join(re.escape(w) for w, _ in _words(table, han)) + ")" + edge[1])
        self.spelled: dict[str, list[str]] = {}
        for w, name in self.names.items():
            self.spelled.setdefault(name, []).append(w)

    def take(self, text: str) -> tuple[list[str], str]:
        """Canonical names of the words in a text, and the text with gaps in their places."""
        found = [self.names[m[0]] for m in self.pattern.finditer(text)]
        return (found, self.pattern.sub(GAP, text)) if found else (found, text)


_TABLES = {"figure": FIGURES | _OTHER, "region": REGIONS, "object": OBJECTS, "period": PERIODS}
_VOCABULARIES = {han: {k: _Vocabulary(t, han) for k, t in _TABLES.items()} for han in (True, False)}
_CUT = {p[:i] + p[i + 1 :] for p in PHRASES_HAN if len(p) >= 3 for i in range(len(p))}
_FILLERS = re.compile("|".join(sorted(map(re.escape, _CUT | set(PHRASES_HAN)), key=lambda x: (-len(x), x))))
_MISSPELT = re.compile("|".join(map(re.escape, MISSPELT)))
_SHORT = re.compile("|".join(re.escape(p) for p in PHRASES_HAN if len(p) == 1))
#: Single characters of misspellings.
_WRONG = {a for wrong, right in MISSPELT.items() for a in wrong if a not in right}
#: Turns of phrase as they are left when single characters have gone.
_PHRASES = tuple(sorted({x for p in PHRASES_HAN for x in (p, _SHORT.sub("", p)) if len(x) >= 3}))


def question_words(text: str | None, companies: Register) -> list[str]:
    """The sorted set of the words of a question's normal text, as 'slot=value' or 'word=...'; empty for a null or blank question."""
    if not text or not text.strip():
        return []
    s = plain(text).lower().replace(GAP, " ")
    han = sum("㐀" <= c <= "鿿" for c in s) >= 4
    return sorted(set(_han(s, companies) if han else _latin(s, companies)))


def _han(s: str, companies: Register) -> list[str]:
    s = re.sub(r"\s+", "", s).translate(SIMPLIFIED)
    s = _MISSPELT.sub(lambda m: MISSPELT[m[0]], s)
    s = re.sub(r"[〇零一二三四五六七八九]{4}(?=财?年)", lambda m: m[0].translate(NUMERALS), s)
    v = _VOCABULARIES[True]
    out = []
    for m in list(QUOTED.finditer(s))[::-1]:
        out.append("name=" + m[1])
        kind = v["object"].pattern.match(s, m.end())
        if kind:
            out.append("object=" + v["object"].names[kind[0]])
        s = s[: m.start()] + GAP + s[kind.end() if kind else m.end() :]
    out += ["year=" + y for y in YEAR.findall(s)]
    s = YEAR.sub(GAP, s)
    for slot in ("figure", "region", "period") if any(w.startswith("object=") for w in out) else ("figure", "region", "period", "object"):
        found, s = v[slot].take(s)
        out += [f"{slot}={x}" for x in found]
    s = re.sub(r"(?<![a-z0-9])(q[1-4]|h[12])(?![a-z0-9])", lambda m: out.append("period=" + m[0]) or GAP, s)
    # marks become gaps here, which the words of names don't reach across
    ids, s = companies.apart(SEPARATORS.sub(GAP, s), True)
    out += [f"company={i}" for i in ids]
    return out + ["word=" + w for w in SEPARATORS.split(_FILLERS.sub("|", FORM.sub("|", s))) if w]


def _latin(s: str, companies: Register) -> list[str]:
    s = re.sub(r"\s+", " ", s)
    v = _VOCABULARIES[False]
    out = []
    s = re.sub(r"\bfy ?(?=20\d\d)", "", s)
    out += ["year=" + y for y in YEAR.findall(s)]
    s = YEAR.sub(GAP, s)
    for m in list(NAMED.finditer(s))[::-1]:
        out += ["name=" + m[1], "object=" + v["object"].names[m[2]]]
        s = s[: m.start()] + GAP + s[m.end() :]
    for slot in ("figure", "period"):
        found, s = v[slot].take(s)
        out += [f"{slot}={x}" for x in found]
    # regions come after names: a name may hold the word for one
    ids, s = companies.apart(s, False)
    for slot in ("region", "object"):
        found, s = v[slot].take(s)
        out += [f"{slot}={x}" for x in found]
    out += [f"company={i}" for i in ids]
    return out + ["word=" + w for w in re.findall(r"[a-z]+|\d+", s) if w not in WORDS_LATIN]


def exact(words: list[str]) -> list[str]:
    """Those of a question's words that two questions have to share."""
    return [w for w in words if w.partition("=")[0] in EXACT]


def _slip(said: str, meant: str) -> bool:
    """One edit; no digit is one, and in words of two characters or of three Latin letters none is."""
    return len(meant) >= (3 if meant[-1] > "ÿ" else 4) and not any(c.isdigit() for c in said) and abs(len(said) - len(meant)) <= 1 and distance(said, meant) == 1


def _slips(said: str, phrase: str) -> bool:
    """Two edits in a longer turn of phrase."""
    return len(phrase) >= 6 and abs(len(said) - len(phrase)) <= 2 and not any(c.isdigit() for c in said) and distance(said, phrase) == 2


@lru_cache(maxsize=100_000)
def _phrase_slip(word: str) -> bool:
    if word[-1] > "ÿ":
        return word in _WRONG or any(_slip(word, p) or _slips(word, p) for p in _PHRASES)
    if any(word[:i] in WORDS_LATIN and word[i:] in WORDS_LATIN for i in range(2, len(word) - 1)):
        return True
    # of short words only a letter may be missing, or two neighbours be exchanged
    return any(_slip(word, p) or _slips(word, p) or (len(word) <= len(p) < 4 and distance(word, p) == 1 and set(word) <= set(p)) for p in WORDS_LATIN)


def _spells(word: str, other: str) -> bool:
    """Whether a word of no list is a slip of another question's word."""
    slot, _, value = other.partition("=")
    if slot in EXACT:
        return False
    if slot == "word":
        return _slip(word, value)
    spelled = _VOCABULARIES[word[-1] > "ÿ"][slot].spelled.get(value, ())
    return any(_slip(word, w) or (len(word) > len(w) and any(_slip(word[i : i + n], w) for n in (len(w) - 1, len(w), len(w) + 1) for i in range(len(word) - n + 1)) and _rest(word, w)) for w in spelled)


def _rest(word: str, spelled: str) -> bool:
    """Whether what a piece has beside a slip of a word is wording too."""
    return len(word) - len(spelled) <= 1


def same_question(a: list[str], b: list[str]) -> bool:
    """Whether each word that only one of two questions has is a slip of a word of the other one or of a turn of phrase."""
    for one, other in ((set(a) - set(b), set(b) - set(a)),):
        left, right = sorted(one), sorted(other)
        for mine, yours in ((left, right), (right, left)):
            for w in [w for w in mine if w.startswith("word=")]:
                match = next((o for o in yours if _spells(w[5:], o)), None)
                if match is not None:
                    yours.remove(match)
                    mine.remove(w)
                elif _phrase_slip(w[5:]):
                    mine.remove(w)
        if left or right:
            return False
    return True
