"""Text functions as column expressions: they stay in generated code and need no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's strip and \s see it, for Java's regular expressions.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
RUN = r"[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*"
HAN_WIDE = r"\x{3400}-\x{9fff}"
HAN = r"\x{4e00}-\x{9fff}"
TERMINAL = r"[。！？；!?]"
# Terms that name what a finance question asks for, in order.
TOPICS = (
    "营业收入", "营业总收入", "净利润", "利润总额", "营业利润", "总资产", "资产总额", "总负债", "负债总额", "负债率", "资产负债率", "所有者权益", "股东权益", "现金流", "经营活动现金流", "研发投入", "研发费用", "毛利率", "同比", "增长率",
)


def regexp_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def token_estimate(c: Column) -> Column:
    """Han characters, runs of Latin letters and digits, and punctuation marks; at least 1."""
    marks = rf"[^\p{{L}}\p{{N}}_\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}{HAN_WIDE}]"
    return F.greatest(F.lit(1), regexp_count(c, f"[{HAN_WIDE}]") + regexp_count(c, RUN) + regexp_count(c, marks)).cast("int")


def key_text(c: Column) -> Column:
    """Letters, digits and underscores only, in lower case: what identifies a chunk's text."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", "")


def answer_text(c: Column) -> Column:
    """An answer without white space and commas, in lower case."""
    return F.lower(F.regexp_replace(c, rf"[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}},，]", ""))


def bm25_tokens(c: Column) -> Column:
    """Runs of Latin letters and digits, then of every Han run all characters and all pairs, repeated as often as they occur."""
    low = F.lower(c)
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+(?:[._%-][a-z0-9]+)*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0))
    singles = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1))))
    pairs = F.transform(
        F.filter(runs, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    )
    return F.concat(latin, F.flatten(singles), F.flatten(pairs))


def space_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), rf"{SPACE}+"), lambda t: t != "")


def years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?:19|20)\p{Nd}{2}"), F.lit(0))


def topics(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(c, t))


def maximal_topics(c: Column) -> Column:
    """Topics without those that are part of another found topic."""
    found = topics(c)
    return F.filter(found, lambda t: ~F.exists(found, lambda o: (o != t) & F.contains(o, t)))


def company_from_filename(c: Column) -> Column:
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"^\p{Nd}+_", ""), r"(?i)_report$", "")


def is_heading(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) > 0) & (F.length(s) <= 40) & ~F.rlike(s, F.lit(TERMINAL + "$")) & (regexp_count(s, r"\p{Nd}+(?:\.\p{Nd}+)?%?") <= 1)


def is_table_line(line: Column) -> Column:
    """Three filled cells or more, cut at tabs or two spaces, two of them with a number."""
    cells = F.filter(F.transform(F.split(line, "\t| {2,}"), strip), lambda x: x != "")
    return (F.size(cells) >= 3) & (F.size(F.filter(cells, lambda x: F.rlike(x, F.lit(r"\p{Nd}")))) >= 2)


def join_wrapped(lines: Column) -> Column:
    """Lines as one text, with a space only between two Latin letters or digits."""

    def add(acc: Column, line: Column) -> Column:
        s = strip(line)
        spaced = F.rlike(acc, F.lit("[A-Za-z0-9]$")) & F.rlike(s, F.lit("^[A-Za-z0-9]"))
        return F.when(s == "", acc).when(acc == "", s).otherwise(F.concat(acc, F.when(spaced, " ").otherwise(""), s))

    return F.aggregate(lines, F.lit(""), add)


def page_name(source_file: Column, page_number: Column) -> Column:
    return F.concat(source_file, F.lit("#p"), page_number.cast("string"))


def any_contains(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def checks_pass(answer: Column, groups: Column) -> Column:
    """Whether every group has an alternative that the answer contains; null without groups."""
    said = answer_text(answer)
    passed = F.forall(groups, lambda g: F.exists(g, lambda a: F.contains(said, answer_text(a))))
    return F.when(F.size(groups) > 0, passed)


def canonical_digest(c: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)
