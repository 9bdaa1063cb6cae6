"""Variant spellings of names, linked to the register of companies they mean.

Method: a symmetric-delete neighbourhood index on the register's distinctive tokens finds every token within a small edit
distance of a piece of the text, by the deletions both share. The tokens of a candidate's name are then aligned with the
tokens beside that piece by optimal assignment, permitting initials, abbreviations, exchanged letters and another order.
The best alignment decides; where two companies of one brand fit equally well, the mention means none.

Names in Han characters have the tokens place, brand, industry and legal form, written without spaces; places and forms
are taken out first, wherever they stand, and windows over the rest are looked up. How long windows are, and how far to
look beside one, follows from the register's own brands and industries. Names in Latin letters are taken word by word;
words of fewer than four letters have to stand exactly, and with a further word of the name or alone. Nicknames and names
as registered are looked up as they are, the longest of overlapping ones first.

Defined cases: null, blank and unknown texts link to none; organisations that are not in the register link to none; a
text may link to several companies; a registered name, Chinese or English, links to its company, whatever the length of its tokens
(one that two companies share links to none). The register has a fixed, checked size and goes to the executors; texts are mapped
one by one, and a worker keeps the results of texts it has met. Repeated rows give repeated links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import plain
from larkspur.session import bounded_collect

# Traditional characters of industries, legal forms and questions, and the simplified ones.
SIMPLIFIED = str.maketrans(
    "電醫療裝備製農業軟藥傳築諮詢務紡織遊環費運團責飲產資訊險證進際貿設計開發創術網輸機關龍銘華國東慶圖陽銀萬興豐寶誠達順騰飛億衛藍"
    "別錄報數營淨潤總額負債權現賬帳庫餘貨規廠應與為歐門項線級實準問請謝勞駕號選區陸",
    "电医疗装备制农业软药传筑咨询务纺织游环费运团责饮产资讯险证进际贸设计开发创术网输机关龙铭华国东庆图阳银万兴丰宝诚达顺腾飞亿卫蓝"
    "别录报数营净润总额负债权现账账库余货规厂应与为欧门项线级实准问请谢劳驾号选区陆",
)
# Legal forms and what is said of a seat, also with slips of the pen.
FORM = re.compile(r"(?:集团|股份)?有?[限现]?(?:责任)?公[司可]|(?:集团|股份)?有[限现](?:责任)?公?|集团|股份|有限责任|责任|总部")
FORM_WORDS = frozenset("co ltd limited company inc incorporated corp corporation holdings group the plc llc".split())
# Customary abbreviations that the letters alone would leave open.
ABBREVIATIONS = {"med": "medical", "mda": "media", "elec": "electronics", "tech": "technology", "edu": "education", "svcs": "services", "mfg": "manufacturing", "intl": "international"}
REGISTER_LIMIT = 50_000
#: Letters of a word from which on a slip is allowed.
SLIP_FROM = 4
CACHE = 500_000
NONE = float("inf")


class Company(NamedTuple):
    id: int
    brand: str
    industry: str
    place: str
    words: tuple[str, ...]  # of the name in Latin letters, without legal form
    aliases: tuple[str, ...]


def deletes(token: str) -> set[str]:
    """The token and all it becomes by deleting one character."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token) if len(token) > 1 else 0))}


@lru_cache(maxsize=200_000)
def _word_deletes(word: str) -> tuple[str, ...]:
    return tuple(deletes(word))


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Edits from a to b: insertions, deletions, substitutions and exchanges of neighbours."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


@lru_cache(maxsize=200_000)
def token_cost(said: str, meant: str) -> float:
    """What it costs to read one token as another: 0 the same, below 1 an abbreviation, 1 a slip; NONE if it can't be."""
    if said == meant:
        return 0.0
    if ABBREVIATIONS.get(said) == meant:
        return 0.3
    # abbreviations: the first letter and a part of the others in order; likelier with the last one
    it = iter(meant)
    if 2 <= len(said) < len(meant) and said[0] == meant[0] and all(c in it for c in said):
        return 0.45 if said[-1] == meant[-1] else 0.5
    it = iter(meant)
    if len(meant) > 2 and len(said) == len(meant) - 1 and all(c in it for c in said):
        return 0.7
    if sorted(said) == sorted(meant):
        return 0.8
    allowed = 1 if len(meant) < 8 else 2
    return 1.0 if len(said) > 1 and len(meant) > 1 and abs(len(said) - len(meant)) <= 1 and distance(said, meant) <= allowed and (said[0] == meant[0] or said[-1] == meant[-1]) else NONE


def assign(said: list[str], meant: tuple[str, ...]) -> tuple[float, int]:
    """(cost, number of tokens matched) of the optimal assignment of the meant tokens to different said ones; a token left out costs 1.5."""
    best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
    for m in meant:
        new: dict[int, tuple[float, int]] = {}
        for used, (cost, n) in best.items():
            options = [(used, cost + 1.5, n)]
            options += [(used | 1 << i, cost + c, n + 1) for i, s in enumerate(said) if not used >> i & 1 and (c := token_cost(s, m)) < NONE]
            for u, c, k in options:
                if u not in new or (c, -k) < (new[u][0], -new[u][1]):
                    new[u] = (c, k)
        best = new
    return min(best.values(), key=lambda x: (x[0], -x[1]))


def _bars(m: re.Match) -> str:
    return "|" * len(m[0])


#: Stands in a text for what a caller has taken out; no name goes across it.
GAP = "\ue000"


def _clean(text: str) -> str:
    """Han characters, simplified, letters and digits of a plain text; gaps become bars."""
    return re.sub(r"[^㐀-鿿A-Za-z0-9\ue000]", "", text).translate(SIMPLIFIED).replace(GAP, "|")


class Lookup:
    """Whole strings in a text, the longest of overlapping ones first; a string of two companies is of none."""

    def __init__(self, names: dict[str, set[int]]):
        self.automaton = ahocorasick.Automaton()
        for name, ids in names.items():
            self.automaton.add_word(name, (len(name), min(ids) if len(ids) == 1 else None))
        self.any = bool(names)
        if names:
            self.automaton.make_automaton()

    def take(self, text: str, keep: int = 0) -> tuple[set[int], str]:
        """Ids of the strings in a text, and the text with a bar in the place of each, but for `keep` characters at both ends."""
        out: set[int] = set()
        if not self.any:
            return out, text
        found = sorted(((n, end + 1 - n, i) for end, (n, i) in self.automaton.iter(text)), key=lambda x: (-x[0], x[1]))
        if not found:
            return out, text
        gone = [False] * len(text)
        for n, at, i in found:
            if not any(gone[at + keep : at + n - keep]):
                gone[at + keep : at + n - keep] = [True] * (n - 2 * keep)
                if i is not None:
                    out.add(i)
        return out, "".join(c if not g else "|" for c, g in zip(text, gone, strict=True))


class Register:
    def __init__(self, rows: list):
        self.companies: list[Company] = []
        industries = {r["industry"] for r in rows if r["industry"]}
        full: dict[str, set[int]] = defaultdict(set)
        english: dict[str, set[int]] = defaultdict(set)
        for r in rows:
            place, name, industry, i = r["place"] or "", r["company"], r["industry"] or "", int(r["company_id"])
            rest = name[len(place) :] if name.startswith(place) else name
            at = rest.find(industry, 1) if industry else -1
            brand = rest[:at] if at > 0 else FORM.sub("", rest)
            said = re.findall(r"[a-z]+", plain(r["english_name"] or "").lower())
            words = tuple(w for w in said if w not in FORM_WORDS)
            self.companies.append(Company(i, _clean(plain(brand)), industry, place, words, tuple(a for a in r["aliases"] or () if a)))
            if c := _clean(plain(name)):
                full[c].add(i)
            if said:
                english[" " + " ".join(said) + " "].add(i)
        self.industries = sorted(industries, key=len, reverse=True)
        self.places = re.compile("(?:" + "|".join(sorted(map(re.escape, {c.place for c in self.companies if c.place}), key=len, reverse=True)) + ")市?") if any(c.place for c in self.companies) else None
        self.brands: dict[str, list[Company]] = defaultdict(list)
        self.leads: dict[str, list[Company]] = defaultdict(list)
        self.initials: dict[tuple[str, ...], list[Company]] = defaultdict(list)
        nicknames: dict[str, set[int]] = defaultdict(set)
        for c in self.companies:
            if c.brand:
                self.brands[c.brand].append(c)
            if c.words:
                self.leads[c.words[0]].append(c)
                if len(c.words) > 1:
                    self.initials[c.words[0][0], *c.words[1:]].append(c)
            for a in c.aliases:
                nicknames[_clean(plain(a))].add(c.id)
        nicknames.pop("", None)
        self.full, self.english, self.nicknames = Lookup(full), Lookup(english), Lookup(nicknames)
        self.letters = {c for b in self.brands for c in b}
        self.near_brand, self.near_lead = self._index(self.brands), self._index(w for w in self.leads if len(w) >= SLIP_FROM)
        self.fields = {c.words[1:] for c in self.companies if len(c.words) > 1}
        self.most_words = max((len(f) for f in self.fields), default=1)
        lengths = {len(b) for b in self.brands}
        # windows as long as a brand first, longer ones before shorter
        self.windows = sorted(lengths, reverse=True) + sorted({n + k for n in lengths for k in (-1, 1) if n + k > 0} - lengths, reverse=True)
        self.beside = max(map(len, industries), default=0) + 2
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _index(tokens) -> dict[str, set[str]]:
        out: dict[str, set[str]] = defaultdict(set)
        for t in tokens:
            for d in deletes(t):
                out[d].add(t)
        return out

    def link(self, text: str | None) -> tuple[int, ...]:
        """Ids of the companies a text names, in order of id."""
        if not text:
            return ()
        known = self.cache.get(text)
        if known is None:
            s = plain(text)
            known = tuple(sorted(self._han(s)[0] | self._latin(s)[0]))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[text] = known
        return known

    def apart(self, text: str, han: bool) -> tuple[set[int], str]:
        """Ids of the companies a plain text names in one script, and the text without their names: its Han characters, or its words, a bar for what is gone."""
        return self._han(text) if han else self._latin(text)

    # names in Latin letters

    def _latin(self, s: str) -> tuple[set[int], str]:
        words = re.findall(r"[a-z]+|\d+|\ue000", s.lower())
        if not words:
            return set(), ""
        out, left = self.english.take(" " + " ".join(words) + " ", keep=1)
        words = [w for w in left.split(" ") if w]
        alone = sum(w not in FORM_WORDS for w in words) == 1
        gone: set[int] = set()
        # words beside one, legal forms skipped
        reach = self.most_words + 1

        def after(i: int) -> list[int]:
            return list(islice((j for j in range(i + 1, min(len(words), i + 2 + 2 * reach)) if words[j] not in FORM_WORDS), reach))

        def before(i: int) -> list[int]:
            return [j for j in range(max(0, i - 2 * reach), i) if words[j] not in FORM_WORDS][-self.most_words :]

        def said(places: list[int]) -> list[str]:
            return [words[j] for j in places]

        for i, w in enumerate(words):
            if w in FORM_WORDS or not w.isalpha():
                continue
            if len(w) == 1:
                # an initial needs all further words of the name as they are
                here = {c.id: c for n in range(1, self.most_words + 1) for c in self.initials.get((w, *words[i + 1 : i + 1 + n]), ())}
                for c in here.values() if len(here) == 1 else ():
                    out.add(c.id)
                    gone.update(range(i, i + len(c.words)))
            if len(w) < SLIP_FROM:
                exact, near = {w} & self.leads.keys(), set()
            else:
                near = {b for d in _word_deletes(w) for b in self.near_lead.get(d, ()) if distance(w, b) <= 1}
                exact = {b for b in near if b == w}
            for lead in exact or near:
                c = self._choose(self.leads[lead], [said(after(i)), said(before(i))], lambda c: c.words[1:], len(lead) >= SLIP_FROM or alone)
                if c is not None:
                    out.add(c.id)
                    gone.add(i)
                    gone.update(j for j in (*after(i), *before(i)) if any(token_cost(words[j], m) < NONE for m in c.words[1:]))
        return out, " ".join("|" if i in gone or w in FORM_WORDS else w for i, w in enumerate(words))

    def _choose(self, companies: list[Company], sides: list[list[str]], meant, enough: bool) -> Company | None:
        """The company whose further tokens one side spells best; one without rivals needs no further tokens if its own is enough."""
        scored = []
        for c in companies:
            tokens = meant(c)
            cost, n = min((assign(side, tokens) for side in sides), key=lambda x: (x[0], -x[1]))
            scored.append((cost if n else NONE, c))
        scored.sort(key=lambda x: x[0])
        if scored[0][0] < NONE:
            return scored[0][1] if len(scored) == 1 or scored[1][0] > scored[0][0] else None
        if len(companies) > 1 or not enough:
            return None
        # another field of business named in full is another organisation
        own = meant(companies[0])
        other = any(all(t in side for t in f) for side in sides for f in self.fields if f and f != own)
        return None if other else companies[0]

    # names in Han characters

    def _han(self, s: str) -> tuple[set[int], str]:
        out, t = self.full.take(_clean(s))
        if not t:
            return out, t
        nicknamed, bare = self.nicknames.take(t)
        out |= nicknamed
        named = set()
        if self.places:
            named = {m[0].removesuffix("市") for m in self.places.finditer(t)}
            t = self.places.sub(_bars, t)
        t = FORM.sub(_bars, t)
        # all characters of a brand stand together or around one more; then what lacks one of them, with its industry
        taken = [False] * len(t)
        gone = [c == "|" for c in bare]
        weak = []

        def found(c: Company | None, i: int, n: int) -> None:
            if c is not None:
                out.add(c.id)
                a, b = self._span(t, i, i + n, c.industry)
                gone[a:b] = [True] * (b - a)
                # a character said twice, what one character leaves of the industry, and a colloquial ending
                if b < len(t) and t[b] in t[b - 1] + c.industry + "家":
                    gone[b] = True

        # a window without a character of any brand is none
        known = [c in self.letters for c in t]
        longest = max(self.windows, default=0)
        for i in range(len(t)):
            if True not in known[i : i + longest]:
                continue
            for n in self.windows:
                window = t[i : i + n]
                if len(window) < n or "|" in window or True not in known[i : i + n]:
                    continue
                for brand in {b for d in deletes(window) for b in self.near_brand.get(d, ())}:
                    far = distance(window, brand)
                    # a brand of one character has to stand exactly, and a longer window has to begin and end with the brand's characters
                    if far > 1 or (far and len(brand) == 1) or (n > len(brand) and (window[0] not in brand or window[-1] not in brand)):
                        continue
                    if len(brand) > 1 and (far == 0 or (n >= len(brand) and all(c in window for c in brand))):
                        if not any(taken[i : i + n]):
                            found(self._industry(t, i, i + n, self.brands[brand], named, True), i, n)
                            taken[i : i + n] = [True] * n
                    else:
                        weak.append((n != len(brand), i, n, brand))
        for _, i, n, brand in sorted(weak):
            if not any(taken[i : i + n]):
                c = self._industry(t, i, i + n, self.brands[brand], named, False)
                if c is not None:
                    found(c, i, n)
                    taken[i : i + n] = [True] * n
        return out, "".join("|" if g else c for c, g in zip(t, gone, strict=True))

    def _span(self, t: str, i: int, j: int, industry: str) -> tuple[int, int]:
        """t[i:j] widened by what stands beside it for the industry."""
        best = (NONE, 0, i, j)
        n = len(industry)
        for skip in (0, 1):
            right = j + len(t[j:]) - len(t[j:].lstrip("|")) + skip
            left = len(t[:i].rstrip("|")) - skip
            for k in range(max(2, n - 2), n + 2) if n else ():
                for a, b in ((right, right + k), (left - k, left)):
                    if a >= 0 and b <= len(t) and "|" not in t[a:b] and (cost := token_cost(t[a:b], industry)) < NONE:
                        best = min(best, (cost + 0.3 * skip, abs(k - n), min(a, i), max(b, j)))
        return best[2:]

    def _industry(self, t: str, i: int, j: int, companies: list[Company], named: set[str], strong: bool) -> Company | None:
        """The company of a brand whose industry stands beside t[i:j]; of two that fit alike, the one whose place is named."""
        right, left = t[j:].lstrip("|")[: self.beside], t[:i].rstrip("|")[-self.beside :]
        scored = sorted(((self._beside(right, left, c.industry), not (c.place and c.place in named), c) for c in companies), key=lambda x: x[:2])
        if scored[0][0] < NONE:
            if len(scored) > 1 and scored[1][:2] == scored[0][:2]:
                return None
            if strong or scored[0][0] <= 1:
                return scored[0][2]
            return None
        if len(companies) > 1:
            return None
        if strong:
            other = any(right.startswith(x) or left.endswith(x) for x in self.industries if x != companies[0].industry)
            return None if other else companies[0]
        # a brand with a slip and nothing else but a legal form
        alone = t.strip("|") == t[i:j] and "|" in t
        return companies[0] if alone and j - i > 1 and j - i >= len(companies[0].brand) else None

    @staticmethod
    def _beside(right: str, left: str, industry: str) -> float:
        """Cost of assigning the industry to one of the pieces that follow or precede, also after one stray character."""
        n = len(industry)
        if not n:
            return NONE
        best = NONE
        for skip in (0, 1):
            pieces = []
            for k in range(max(2, n - 2), n + 2):
                pieces += [right[skip : skip + k], left[len(left) - k - skip : len(left) - skip] if len(left) >= k + skip else ""]
            said = [p for p in pieces if len(p) >= max(2, n - 2) and "|" not in p]
            cost, matched = _assign_one(tuple(said), industry)
            if matched:
                best = min(best, cost + 0.3 * skip)
        # one character left of an industry of two, at the end of the name
        if best == NONE and n == 2 and (right[:2] in (industry[0] + "|", industry[1] + "|") or right in (industry[0], industry[1])):
            best = 1.0
        return best


@lru_cache(maxsize=200_000)
def _assign_one(said: tuple[str, ...], meant: str) -> tuple[float, int]:
    return assign(list(dict.fromkeys(said)), (meant,))


def register(companies: DataFrame) -> Broadcast:
    rows = bounded_collect(companies.where("company_id is not null and company is not null").select("company_id", "company", "english_name", "aliases", "industry", "place").dropDuplicates(["company_id"]), REGISTER_LIMIT, "register of companies")
    return companies.sparkSession.sparkContext.broadcast(Register(sorted(rows, key=lambda r: r["company_id"])))


def link(mentions: DataFrame, known: Broadcast, text: str = "mention") -> DataFrame:
    """mentions with company_ids ARRAY<INT>, empty where a text names no company of the register, in place of a column of that name. A narrow map."""
    mentions = mentions.drop("company_ids")
    at = mentions.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = known.value
        for batch in batches:
            ids = pa.array([r.link(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], schema=pa.schema([*batch.schema, pa.field("company_ids", pa.list_(pa.int32()))]))

    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mentions.schema.fields)
    return mentions.mapInArrow(run, f"{inner}, company_ids array<int>")


def mentions(source_documents: DataFrame, multiturn: DataFrame, requests: DataFrame) -> DataFrame:
    """(place, ref_id, mention) of the three places where companies are named."""
    company = source_documents.select(F.lit("company").alias("place"), F.col("chunk_id").cast("string").alias("ref_id"), F.col("company").alias("mention"))
    slot = multiturn.select(F.lit("slot").alias("place"), F.col("id").alias("ref_id"), F.explode("gold_slots.companies").alias("mention"))
    question = requests.select(F.lit("question").alias("place"), F.col("run_id").cast("string").alias("ref_id"), F.col("question").alias("mention"))
    return company.unionByName(slot).unionByName(question).where("mention is not null and ref_id is not null")
