"""Characters that look alike, for every part of the library that compares text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Cyrillic, Greek, Armenian and phonetic letters, and their Latin look-alikes.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮӀѴԌԚԜаеѕіјорсухһѵԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονροսոɡıɑօհցզյ",
        "ABESIJKMHOPCTYXYIVGQWaesijopcyxhvdqwlABEZHIKMNOPTYXovpoungiaohgqj",
        strict=True,
    )
)


@lru_cache(maxsize=100_000)
def _plain(c: str) -> str:
    return "" if unicodedata.category(c) == "Cf" else LOOKALIKES.get(c, c)


def plain(text: str) -> str:
    """Compatibility forms, format characters and look-alike letters brought to plain characters; for reading a text, not for keeping it."""
    if text.isascii():
        return text
    return "".join(map(_plain, unicodedata.normalize("NFKC", text)))
