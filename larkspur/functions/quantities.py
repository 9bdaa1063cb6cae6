"""Quantities in text: amounts of money, ratios, mass, area and power, read exactly."""

from __future__ import annotations

import re
from decimal import Decimal, localcontext
from typing import NamedTuple

from larkspur.functions.text import plain


class Quantity(NamedTuple):
    kind: str  # amount, ratio, mass, area, power
    currency: str | None  # of amounts; None where the text states none
    value: Decimal  # in the common unit of its kind
    size: Decimal  # of the stated unit, in the common unit
    start: int
    end: int


#: Common units: of amounts one yuan or dollar, of ratios 1.
UNITS = {"amount": "1", "ratio": "1", "mass": "t", "area": "m2", "power": "kW"}
# Names of currencies; each is a currency of its own.
CURRENCY_NAMES = {
    "CNY": "人民币 rmb cny cn¥ ¥ 元 yuan",
    "USD": "us$ usd $ 美元 美金 dollars dollar",
    "HKD": "hk$ hkd 港元 港币",
    "EUR": "€ eur euros euro 欧元",
    "GBP": "£ gbp pounds 英镑",
    "JPY": "jpy yen 日元 日圆",
    "TWD": "nt$ twd 新台币 台币",
    "KRW": "₩ krw 韩元 韩圆",
    "SGD": "s$ sgd 新加坡元 新元",
    "AUD": "a$ aud 澳元",
    "CAD": "c$ cad 加元",
    "CHF": "chf 瑞士法郎",
    "INR": "₹ inr 卢比",
    "RUB": "₽ rub 卢布",
    "MOP": "mop 澳门元",
    "THB": "thb 泰铢",
}
CURRENCIES = {name: code for code, names in CURRENCY_NAMES.items() for name in names.split()}
# Scales of amounts.
SCALES = {"": 1, "千": 10**3, "k": 10**3, "thousand": 10**3, "万": 10**4, "十万": 10**5, "百万": 10**6, "million": 10**6, "mn": 10**6, "千万": 10**7, "亿": 10**8, "bn": 10**9, "billion": 10**9, "十亿": 10**9, "百亿": 10**10, "万亿": 10**12, "trillion": 10**12}
# Units of other kinds, with their size in the common unit.
OTHER = {
    "ratio": {"%": "0.01", "percent": "0.01", "个百分点": "0.01", "百分点": "0.01", "‰": "0.001", "bps": "0.0001", "bp": "0.0001", "个基点": "0.0001", "基点": "0.0001"},
    "mass": {"百万吨": "1000000", "万吨": "10000", "千吨": "1000", "kt": "1000", "吨": "1", "t": "1", "公斤": "0.001", "千克": "0.001", "kg": "0.001", "克": "0.000001"},
    "area": {"平方公里": "1000000", "平方千米": "1000000", "km²": "1000000", "km2": "1000000", "万平方米": "10000", "万平米": "10000", "公顷": "10000", "ha": "10000", "平方米": "1", "平米": "1", "m²": "1", "m2": "1", "㎡": "1"},
    "power": {"吉瓦": "1000000", "gw": "1000000", "万千瓦": "10000", "兆瓦": "1000", "mw": "1000", "千瓦": "1", "kw": "1", "瓦": "0.001", "w": "0.001"},
}
_UNIT = {name: (kind, Decimal(size)) for kind, names in OTHER.items() for name, size in names.items()}
_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
#: Scales that only a currency before the number tells from units of length and the like.
_SHORT = {"m": 10**6, "mm": 10**6, "b": 10**9}
_POWER = {"十": 10, "百": 100, "千": 1000}


def _any(names) -> str:
    return "|".join(re.escape(x) for x in sorted((x for x in names if x), key=len, reverse=True))


NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?"
HAN = r"[零〇一二两三四五六七八九十百千]*[零〇一二两三四五六七八九十][零〇一二两三四五六七八九十百千]*(?:点[零〇一二三四五六七八九]+)?"
_HAN_MONEY = [n for n in CURRENCIES if n[-1] > "\u2e80"]
_BEFORE = _any(n for n in CURRENCIES if n not in _HAN_MONEY and n not in ("yuan", "dollar", "dollars", "euro", "euros", "pounds", "yen")) + "|人民币|港币|新台币"
_AFTER = "元人民币|人民币元|" + _any([*_HAN_MONEY, "yuan", "rmb", "cny", "usd", "dollars", "dollar", "hkd", "eur", "euros", "euro", "gbp", "pounds", "jpy", "yen", "twd", "krw", "sgd", "aud", "cad", "chf"])
_SCALE = _any(SCALES)
# a sign may stand before a number or its currency, but a dash after a number or unit is a range
_SIGN = r"负|(?<![0-9元亿万%％])[-−]"
QUANTITY = re.compile(
    rf"(?<![A-Za-z0-9.])(?P<minus>{_SIGN})?(?P<before>{_BEFORE})\s*(?P<inner>[-−])?(?P<num1>{NUMBER}|{HAN})\s*(?P<scale1>{_any({*SCALES, *_SHORT})})?(?![a-z])\s*(?P<after1>{_AFTER})?"
    rf"|(?<![A-Za-z0-9.,])(?P<sign>[-−+负])?(?P<num2>{NUMBER})\s*(?P<unit>{_any(_UNIT)})(?![a-z0-9])"
    rf"|(?<![A-Za-z0-9.,])(?P<minus3>{_SIGN})?(?P<num3>{NUMBER}|(?<![零〇一二两三四五六七八九十百千]){HAN})\s*(?:(?P<scale3>{_SCALE})\s*(?P<after3>{_AFTER})?|(?P<after4>{_AFTER}))(?![a-z])",
    re.IGNORECASE,
)
_ANY = re.compile(r"\d|[零〇一二两三四五六七八九十]")
BARE = re.compile(rf"\s*([-−+]?{NUMBER})\s*")


def han_number(text: str) -> Decimal:
    whole, _, part = text.partition("点")
    total = digit = 0
    for c in whole:
        if c in _POWER:
            total += (digit or (1 if total == 0 else 0)) * _POWER[c]
            digit = 0
        else:
            digit = digit * 10 + _DIGIT[c] if digit and c not in "零〇" else _DIGIT[c]
    value = Decimal(total + digit)
    return value + Decimal("0." + "".join(str(_DIGIT[c]) for c in part)) if part else value


def number(text: str) -> Decimal:
    return han_number(text) if text[0] in _DIGIT or text[0] in _POWER else Decimal(text.replace(",", "").replace("−", "-"))


def _currency(*names: str | None) -> str | None:
    for n in names:
        if n:
            n = n.lower()
            return CURRENCIES.get(n) or ("CNY" if "元" in n and "美" not in n or "人民币" in n else None)
    return None


def quantities(text: str | None) -> list[Quantity]:
    """All quantities with a unit, in order of place; places are those of the plain text."""
    if not text:
        return []
    s = plain(text)
    if not _ANY.search(s):
        return []
    out: list[Quantity] = []
    with localcontext() as exact:
        exact.prec = 60
        open_end = -1  # where an amount ended in a scale, without a currency after it
        for m in QUANTITY.finditer(s):
            g = m.groupdict()
            if g["num2"]:
                kind, size = _UNIT[g["unit"].lower()]
                value, currency = number(g["num2"]) * size, None
                negative = g["sign"] in ("-", "−", "负")
            else:
                raw, scale, after = g["num1"] or g["num3"], (g["scale1"] or g["scale3"] or "").lower(), g["after1"] or g["after3"] or g["after4"]
                kind, size = "amount", Decimal(SCALES.get(scale) or _SHORT[scale])
                value, currency = number(raw) * size, _currency(g["before"], after)
                negative = bool(g["minus"] or g["inner"] or g["minus3"])
                whole = out[-1] if out and open_end == m.start() and not g["before"] and not negative else None
                if whole and value < whole.size and (whole.currency is None or currency in (None, whole.currency)):
                    # 3亿5000万: parts of falling scales are one amount
                    out[-1] = Quantity(kind, whole.currency or currency, whole.value + value if whole.value >= 0 else whole.value - value, size, whole.start, m.end())
                    open_end = m.end() if scale and not after else -1
                    continue
                open_end = m.end() if scale and not after else -1
            out.append(Quantity(kind, currency, -value if negative else value, size, m.start(), m.end()))
    return out


def bare_number(text: str | None) -> Decimal | None:
    """The number a text consists of, if it has no unit."""
    m = BARE.fullmatch(plain(text)) if text else None
    return number(m[1].lstrip("+")) if m else None


def currency_code(name: str | None) -> str | None:
    """The code of a currency's name, in any case and with outer spaces."""
    return CURRENCIES.get(plain(name).strip().lower()) if name else None
