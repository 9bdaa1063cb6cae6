"""Corpus encoding with a public byte-level BPE vocabulary.

Method: bytes are read as Latin-1 text so that one Aho-Corasick automaton over the vocabulary lists, in one pass,
the longest token at every position. A backtracking walk takes longest matches and shortens or withdraws them
until each adjacent pair is compatible, that is, until merging by rank would have produced that very pair. Pair
compatibility is memoised. The result is exactly that of merging by rank, in time linear in the text.

Defined cases: null and empty texts have the empty list of ids. Strings of special tokens in a text are ordinary
text. Lone surrogates are read as U+FFFD. Equal rows give equal ids; extra columns are kept out of the result.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.batches import slices
from larkspur.session import spread

DEFAULT_VOCABULARY = os.environ.get("LARKSPUR_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: How the published vocabulary cuts a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words kept per worker; the cache starts over when full.
CACHE = 400_000


class BytePairEncoder:
    """Encoder for a vocabulary given as token bytes in order of rank."""

    def __init__(self, tokens: list[bytes]):
        self.text = [t.decode("latin-1") for t in tokens]
        self.size = [len(t) for t in tokens]
        self.rank = {t: i for i, t in enumerate(self.text)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in self.text]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(tokens))]
        self.fits: dict[tuple[int, int], bool] = {}
        self._split()
        self.fits.clear()
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def from_lines(cls, data: bytes) -> BytePairEncoder:
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
        if [r for r, _ in ranks] != list(range(len(ranks))):
            raise ValueError("ranks must count up from 0")
        return cls([t for _, t in ranks])

    def _shorter(self, token: str) -> int:
        """The longest other token that starts this one, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.rank.get(token[:n])) is not None:
                return i
        return -1

    def _split(self) -> None:
        """The last merge of each token, found in order of rank: the only pair of earlier, compatible tokens."""
        for i, token in enumerate(self.text):
            left = self.shorter[i]
            while left >= 0:
                right = self.rank.get(token[self.size[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self.merged[left, right] = i
                    self.halves[i] = (left, right)
                    break
                left = self.shorter[left]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a and b side by side: no earlier merge reaches across their border."""
        merged, halves = self.merged.get, self.halves
        bound = 1 << 30
        while True:
            if merged((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, halves[a][1]
                if a == bound:
                    bound, b = b + 1, halves[b][0]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, halves[b][0]
                if b + 1 == bound:
                    bound, a = a, halves[a][1]
                    if a == bound:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of bytes, given as Latin-1 text."""
        if (whole := self.rank.get(piece)) is not None and self._whole(whole):
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, token) in self.automaton.iter(piece):
            longest[end - size + 1] = token
        size, shorter, fits = self.size, self.shorter, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if open_[end]:
                    if last < 0:
                        ok = True
                    elif (ok := fits.get((last, token))) is None:
                        if len(fits) > 4_000_000:
                            fits.clear()
                        ok = fits[last, token] = self._compatible(last, token)
                    if ok:
                        out.append(token)
                        pos = end
                        break
                token = shorter[token]
                if token < 0:
                    open_[pos] = 0
                    out.pop()
                    pos -= size[last]
                    end = -1
                    token = last
                    break
            if end == n:
                return out
            if end >= 0:
                token = longest[pos]

    def _whole(self, token: int) -> bool:
        """Whether a token is what merging its own bytes gives; a vocabulary may hold tokens no merge reaches."""
        return self.size[token] == 1 or self.halves[token] != (token, token)

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        cache = self.cache
        for m in PIECES.finditer(text):
            word = m[0]
            ids = cache.get(word)
            if ids is None:
                ids = self.encode_piece(word.encode("utf-8", "replace").decode("latin-1"))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(word) <= 200:
                    cache[word] = ids
            out.extend(ids)
        return out


_encoders: dict[int, BytePairEncoder] = {}


def _encoder(data: bytes) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BytePairEncoder.from_lines(data)
    return _encoders[key]


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY, limit: int = 32 << 20) -> Broadcast:
    """The vocabulary file, sent to the executors once; its size does not grow with the corpus and is checked."""
    data = open(path, "rb").read()
    if len(data) > limit:
        raise ValueError(f"{path} has {len(data)} bytes; {limit} may be broadcast")
    return spark.sparkContext.broadcast(data)


def encode_corpus(df: DataFrame, vocab: Broadcast, key: str = "doc_id", text: str = "text", sizes_only: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, or (key, n_tokens INT). A map of each row: no row left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab.value)
        for batch in batches:
            for part in slices(batch, 1):
                lists = [encoder.encode(t) for t in part.column(1).to_pylist()]
                counts = np.fromiter(map(len, lists), np.int32, len(lists))
                if sizes_only:
                    value = pa.array(counts, pa.int32())
                else:
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum(counts, out=offsets[1:])
                    flat = np.concatenate([np.frombuffer(ids, np.int32) for ids in lists])
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=[key, "n_tokens" if sizes_only else "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if sizes_only else "ids array<int>"))
