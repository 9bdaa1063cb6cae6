"""Splitting oversized items at natural boundaries.

Method: the offsets of a text's tokens in order are their own prefix sums: the tokens before a position are found by
binary search. Boundaries (ends of sentences and rows, ends of clauses, spaces) lie in sorted arrays. A piece ends at
the last boundary at which it is within the limit, found by binary search, the next one starts as many tokens before
that end as the overlap says, and where no boundary lies in reach the piece is cut hard between two tokens.

Size is the token estimate: Han characters, runs of Latin letters and digits, and punctuation marks, at least 1. A mark
within a run counts beside the run, so what a cut leaves of a run counts once more.

Defined cases: null and blank texts, and elements without an id, have no pieces; a text within the limit is one piece.
A piece is text[start:end], so the pieces without their overlaps give back the text, and blanks at an end stay with the
piece before. Every piece shares exactly the overlap with the one before; a boundary so early that the first piece would
hold no more than the overlap is none. A run of letters and marks is cut within, at a mark, only where the piece before
it cannot end at its start. Configs the reference refuses (limit null or not positive; overlap null, negative or not below the
limit) are skipped. An unknown, blank or null kind is 'text'. Repeated deliveries count once, by the last. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import bounded_collect, latest

# What the estimate counts.
RUN = r"[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*"
UNIT = re.compile(rf"({RUN})|[㐀-鿿]|[^\w\s㐀-鿿]")
MARK = re.compile(r"[^\w\s㐀-鿿]")
WORD = re.compile(r"[A-Za-z0-9]+")
KINDS = ("heading", "text", "table", "image")

SENTENCE = re.compile(r"[。！？；!?;…]+[”’」』）)\]\"']*|\.+[”’)\]\"']*(?=\s|$)|\n+")
CLAUSE = re.compile(r"[，、：]+|[,:](?!\d)|\t+")
SPACE = re.compile(r"\s+")
BOUNDARIES = ("sentence", "clause", "space")


def units(text: str) -> tuple[array, bytearray]:
    """Offset of each counted token, and whether it is a mark within a run."""
    at, inner = array("i"), bytearray()
    for m in UNIT.finditer(text):
        at.append(m.start())
        inner.append(0)
        if m[1] and not m[1].isalnum():
            marks = [m.start() + x.start() for x in MARK.finditer(m[1])]
            at.extend(marks)
            inner.extend(b"\x01" * len(marks))
    return at, inner


class Splitter:
    """A text with its token offsets and boundaries, to be split for any number of configs."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.inner = units(text)
        self.size = max(1, len(self.at))
        self.levels: list[array] | None = None

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
        """(start, end, tokens, tokens shared with the piece before, kind of cut at the end) of each piece."""
        n, at, inner = len(self.text), self.at, self.inner
        if self.size <= limit:
            return [(0, n, self.size, 0, "end")]
        if self.levels is None:
            # none of these patterns ends within a run
            self.levels = [array("i", [m.end() for m in p.finditer(self.text)]) for p in (SENTENCE, CLAUSE, SPACE)]
        out: list[tuple[int, int, int, int, str]] = []
        # offset, tokens before it, 1 where it lies within a run, tokens of overlap
        start, first, rest, shared = 0, 0, 0, 0
        # what an end has to lie beyond
        least = at[overlap]
        while len(at) - first + rest > limit:
            k = first + limit - rest
            reach = at[k]
            within = 0
            for level, name in zip(self.levels, BOUNDARIES, strict=True):
                i = bisect_right(level, reach) - 1
                if i >= 0 and level[i] > least:
                    end, cut = level[i], name
                    break
            else:
                cut, j = "hard", k
                while inner[j]:
                    j -= 1
                end = at[j]
                if end <= least:
                    # the run fills the piece; at a limit of 1 a mark may stand alone
                    end, within = (reach if reach > start else start + 1), 1
            upto = bisect_left(at, end)
            alone = rest and end == start + 1 and upto > first
            out.append((start, end, upto - first + rest - alone, shared, cut))
            if overlap:
                # a start at a mark within a run would count what is left of the run as well, the place after it counts that instead
                first = upto - overlap
                rest = inner[first]
                start = at[first] + rest
                first += rest
            else:
                start, first, rest = end, upto, within
            # the next piece has one more token at least; what is left of a run is one
            shared, least = overlap, end if within or upto == len(at) else at[upto]
        out.append((start, n, max(1, len(at) - first + rest), shared, "end"))
        return out


def split_elements(df: DataFrame, configs: DataFrame, key: str = "element_id", text: str = "text", kind: str = "kind", by: str | None = "parsed_at") -> DataFrame:
    """(config_id, key, piece_no, n_pieces, text, kind, start_char, end_char, n_tokens, overlap_tokens, cut) for each valid config.

    Elements are mapped one by one; the few configs go along with the function.
    """
    valid = configs.where("max_tokens > 0 and overlap_tokens >= 0 and overlap_tokens < max_tokens and config_id is not null")
    known = [(int(r[0]), int(r[1]), int(r[2])) for r in bounded_collect(valid.select("config_id", "max_tokens", "overlap_tokens").distinct(), 1000, "configs")]
    known.sort()
    kind_of = F.lower(F.trim(F.col(kind)))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(kind_of.isin(*KINDS), kind_of).otherwise("text").alias("kind"), *([F.col(by).alias("_by")] if by else []))
    rows = rows.where(F.col("key").isNotNull())
    if by:
        rows = latest(rows, ["key"], "_by", wide=True).drop("_by")
    type_ = df.schema[key].dataType.simpleString()
    out = "config_id int, key {}, piece_no int, n_pieces int, text string, kind string, start_char int, end_char int, n_tokens int, overlap_tokens int, cut string".format(type_)
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("config_id", pa.int32()), ("key", batch.column(0).type), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("text", pa.string()), ("kind", pa.string()), *[(x, pa.int32()) for x in names[6:10]], ("cut", pa.string())])
            made: list[list] = [[] for _ in names]
            weight = 0
            for k, t, kd in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t is None or not t.strip():
                    continue
                whole = Splitter(t)
                for config, limit, overlap in known:
                    parts = whole.pieces(limit, overlap)
                    for i, (a, b, size, shared, cut) in enumerate(parts):
                        for column, value in zip(made, (config, k, i, len(parts), t[a:b], kd, a, b, size, shared, cut), strict=True):
                            column.append(value)
                        weight += b - a
                if weight > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
                    made, weight = [[] for _ in names], 0
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)
