"""Companies a question names by an alias, and what that limits a search to."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import bounded_collect

# Legal forms an alias may lack.
SUFFIXES = ("集团有限公司", "股份有限公司", "有限责任公司", "有限公司")
SHORTEST = 4
LIMIT = 200_000


class AliasFinder:
    """All aliases in a text in one pass, whatever their number."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton()
        for alias, company in rows:
            self.automaton.add_word(alias, (len(alias), company))
        if rows:
            self.automaton.make_automaton()
        self.any = bool(rows)

    def companies(self, text: str | None) -> list[str]:
        """Companies named, the one with the longest alias first, then by name."""
        best: dict[str, int] = {}
        if text and self.any:
            for _, (n, company) in self.automaton.iter(text.lower()):
                best[company] = max(n, best.get(company, 0))
        return sorted(best, key=lambda c: (-best[c], c))

    def without(self, text: str) -> str:
        """The text without its aliases, the longest of overlapping ones first."""
        found = sorted(((n, end - n + 1) for end, (n, _) in self.automaton.iter(text.lower())), key=lambda x: (-x[0], x[1])) if self.any else []
        gone = bytearray(len(text))
        for n, at in found:
            if not any(gone[at : at + n]):
                gone[at : at + n] = b"\x01" * n
        return "".join(c for c, g in zip(text, gone, strict=False) if not g)


def aliases(companies: DataFrame) -> DataFrame:
    """(alias, company): full name, given aliases and the name without a legal form, in lower case, of 4 characters or more.

    An alias of several companies belongs to the last of them in order of name.
    """
    name = F.col("company")
    bare = [F.when(F.endswith(name, F.lit(s)), F.substring(name, F.lit(1), F.length(name) - len(s))) for s in SUFFIXES]
    every = F.concat(F.array(name, *bare), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    flat = companies.where(name.isNotNull()).select(F.explode(every).alias("a"), "company").select(F.lower(F.trim("a")).alias("alias"), "company")
    return flat.where(F.length("alias") >= SHORTEST).groupBy("alias").agg(F.max("company").alias("company"))


def mentioned(texts: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, company, place) of the companies whose alias a text contains, the longest alias first.

    The aliases are of a checked size and go to the executors once, so a text meets them without a join.
    """
    rows = [(r["alias"], r["company"]) for r in bounded_collect(known.orderBy("alias"), LIMIT, "aliases")]
    spark = texts.sparkSession
    if not rows:
        return texts.select(key, F.lit(None).cast("string").alias("company"), F.lit(1).alias("place")).where("false")
    table = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AliasFinder(table.value)
        for batch in batches:
            keys, names, places = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, c in enumerate(finder.companies(t), 1):
                    keys.append(k)
                    names.append(c)
                    places.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(places, pa.int32())], names=[key, "company", "place"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, company string, place int")
