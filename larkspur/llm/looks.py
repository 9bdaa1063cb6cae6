"""One form for text that looks alike.

Method: each character has quick-check properties, computed once: whether canonical form leaves it as it is, and
whether it is a starter that nothing after it can change. A text of stable characters only is returned as it came.
Otherwise the unstable segments, widened to the starter before and the marks after them, are brought to canonical
form, and the results are spliced into the unchanged rest.

Canonical form: width, ligature and radical variants become their plain characters, invisible characters go, every kind
of space becomes a space, letters of another script that look like Latin ones become those, accents are composed.
Differences one can see stay: case, commas, missing spaces, superscripts, circled and fraction forms, accents.

Defined cases: null stays null, empty text stays empty, a text of invisible characters only becomes empty. Texts have any
length. Applying the operator twice changes nothing more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.functions.text import LOOKALIKES

# Dots and hyphens that look the same.
ALIKE = LOOKALIKES | {"‐": "-", "‑": "-", "‒": "-", "−": "-", "・": "·", "•": "·", "‧": "·", "⋅": "·", "∙": "·"}
#: Compatibility forms one can tell from the plain characters.
VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<fraction>")
#: Characters without a look of their own, beside the format characters.
INVISIBLE = frozenset("͏ᅟᅠㅤﾠ឴឵") | {chr(c) for c in (*range(0xFE00, 0xFE10), *range(0x180B, 0x180F), *range(0xE0100, 0xE01F0))}


@lru_cache(maxsize=200_000)
def _fold(c: str) -> str:
    """A character in decomposed canonical form."""
    kind = unicodedata.category(c)
    if c in INVISIBLE or (kind == "Cf" and not "؀" <= c <= "࣢"):
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0][0] == "<":
        if parts[0] in VISIBLE_FORMS:
            return c
        parts = parts[1:]
    if parts:
        whole = "".join(_fold(chr(int(p, 16))) for p in parts)
        # spacing accents decompose into a space and a mark; they are seen as characters of their own
        return c if whole[:1] == " " and c != " " and len(whole) > 1 else whole
    return ALIKE.get(c, c)


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may compose with what stands before them: the second parts of all canonical compositions, and of Hangul syllables."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0xC0, 0x30000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@lru_cache(maxsize=200_000)
def _stable(c: str) -> bool:
    """Quick check: canonical form keeps the character, and it composes with none before it, be it a mark or a starter."""
    return not unicodedata.combining(c) and c not in _seconds() and unicodedata.normalize("NFC", _fold(c)) == c


def canonical(text: str | None) -> str | None:
    if not text or text.isascii():
        return text
    bad = [i for i, c in enumerate(text) if c > "\x7f" and not _stable(c)]
    if not bad:
        return text
    out, done, i = [], 0, 0
    while i < len(bad):
        start, end = max(done, bad[i] - 1), bad[i] + 1
        i += 1
        # unstable characters in a row, or with one stable character between, are one segment
        while i < len(bad) and bad[i] <= end + 1:
            end = bad[i] + 1
            i += 1
        out.append(text[done:start])
        out.append(unicodedata.normalize("NFC", "".join(map(_fold, text[start:end]))))
        done = end
    out.append(text[done:])
    return "".join(out)


def _deep(x: object) -> object:
    return canonical(x) if isinstance(x, str) else [_deep(y) for y in x] if isinstance(x, list) else x


def canonical_columns(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """df with the canonical form of each named column (text, or arrays of text to any depth) beside it, in place of a column that has its name. A narrow map."""
    df = df.drop(*[c + suffix for c in columns])
    schema = T.StructType([*df.schema.fields, *[T.StructField(c + suffix, df.schema[c].dataType) for c in columns]])
    where = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array([_deep(x) for x in batch.column(i).to_pylist()], batch.schema.field(i).type) for i in where]
            fields = [*batch.schema, *[pa.field(c + suffix, batch.schema.field(i).type) for c, i in zip(columns, where, strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema(fields))

    return df.mapInArrow(run, schema)
