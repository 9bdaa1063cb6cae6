"""Languages of documents and of their segments, with confidence.

Method: language-bitmask n-gram filters. One bit-sliced Bloom filter holds, in each byte, one bit for each language;
the AND of the bytes at an n-gram's hashed places gives all languages that contain the n-gram at once. The popcounts of
a sentence, one for each language, are corrected for the filter's false positives, and decide.

Fitting: letters' n-grams (three characters; two where Chinese or Japanese script begins them) are counted once a
document over a sample of labelled rows of at most about `sample` documents for each language, chosen by a hash of the
key. A language's bit is set where its share of documents with the n-gram is at least `share` of the largest
language's, so that some wrong labels and mixed texts do no harm. Everything else covers all rows and whole texts.

A sentence counts as whole in a language if its n-grams have enough weight, most of them in the language, clearly more than in
any other; terms of another script between its first and last letters are not counted. Other pieces (headings, numbers, names) take the language of what stands before them, else after them.
Neighbouring sentences of one language are one segment.

Defined cases: null, blank and letterless texts have no language, no segment and confidence 0. A text without a whole
sentence takes the best guess for the text as a whole, and has no whole-sentence languages but that one. Labels are read in any
case, as ISO codes of two or three letters with or without region, or as names; anything else that is not null, blank
or a word for unknown names another language. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.batches import slices
from larkspur.session import durable, spread

LANGUAGES = ("zh", "en", "de", "fr", "es", "ja")
# What labels call each language, in lower case and without region.
LABELS = {
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "chinois", "chinesisch", "chino"),
    "en": ("en", "eng", "english", "英文", "英语", "anglais", "englisch", "inglés", "ingles"),
    "de": ("de", "deu", "ger", "german", "deutsch", "德文", "德语", "allemand", "alemán"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "法文", "法语", "französisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "西班牙文", "西班牙语", "spanisch"),
    "ja": ("ja", "jp", "jpn", "japanese", "日本語", "日文", "日语", "japonais", "japanisch"),
}
# Labels that name no language.
UNKNOWN = ("und", "mul", "mis", "zxx", "unknown", "n/a", "na", "none", "null", "nan", "other", "xx", "auto", "?", "-")

SAMPLE = 3000
SHARE = 0.25
FEWEST = 3
SLOTS = 1 << 21
#: Characters whose n-grams are held at once; sums are carried over the cuts.
PART = 200_000
PROBES = 3
#: Weight of an n-gram by its kind.
WEIGHTS = np.array([0.0, 0.2, 1.0])
EASTERN = np.array([c in ("zh", "ja") for c in LANGUAGES])
#: A whole sentence has n-grams of this weight, this share of it in its language, and leads any other by this share.
LEAST_WEIGHT, LEAST_SHARE, LEAST_LEAD = 3.0, 0.6, 0.12

SENTENCE_END = re.compile(r"[。！？!?]+[”’」』）)\]\"']*\s*|\n\s*|(?<!\bLtd)(?<!\bInc)(?<!\bCo)(?<!\bCorp)\.[”’)\]\"']*\s+(?=[A-ZÀ-ÞŒ¿¡«„“\"'(\d⺀-鿿぀-ヿ])")


def label_language(c: Column) -> Column:
    """The language a label names: one of LANGUAGES, 'other', or null where it names none."""
    plain = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(plain, r"^([^-_ (]*)", 1)
    names = F.create_map(*[F.lit(x) for code, words in LABELS.items() for w in words for x in (w, code)])
    named = F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, head), F.lit("other"))
    return F.when(~(plain.isin("", *UNKNOWN)), named)


def _letters() -> np.ndarray:
    """0 no letter, 1 letter, 2 Chinese or Japanese character, for each code of the basic plane."""
    import unicodedata

    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        if unicodedata.category(chr(i))[0] in "LM":
            out[i] = 1
    for a, b in ((0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3041, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00)):
        out[a:b] = np.where(out[a:b] > 0, 2, 0)
    return out


_kinds: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, kind) of the n-gram that begins at each character of the texts, joined by two spaces; kind 0: none, 1: three letters, 2: two characters of Chinese or Japanese."""
    if not _kinds:
        _kinds.append(_letters())
    small = []
    for t in texts:
        s = t.lower()
        small.append(s if len(s) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t))
    code = np.frombuffer(("  ".join(small) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kind = _kinds[0][np.minimum(code, 0xFFFF).astype(np.int64)]
    kind[code > 0xFFFF] = 0
    code[kind == 0] = 32
    n = len(code) - 3
    a, b, c = code[:n], code[1 : n + 1], code[2 : n + 2]
    ka, kb, kc = kind[:n], kind[1 : n + 1], kind[2 : n + 2]
    two = (ka == 2) & (kb == 2)
    three = (ka != 2) & (kb == 1) & (kc != 2) & ((ka == 1) | (kc == 1))
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(three, c, 0) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, two * np.uint8(2) + three


class Filters:
    """Bit-sliced Bloom filters of the languages: byte i holds bit i of every language's filter."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.false = np.array([((self.bits >> i) & 1).mean() ** PROBES for i in range(len(LANGUAGES))])

    @staticmethod
    def places(hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes >> np.uint64(21 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that contain each n-gram."""
        places = self.places(hashes)
        out = self.bits[places[0]]
        for p in places[1:]:
            out = out & self.bits[p]
        return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, share: float = SHARE) -> Broadcast:
    """Filters from a bounded sample of the labelled rows, to be broadcast: SLOTS bytes, whatever the corpus."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), label_language(F.col(label)).alias("l")).where(F.col("l").isin(*LANGUAGES))
    counts = {r["l"]: r["n"] for r in rows.where("t is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.create_map(*[F.lit(x) for code, n in (counts or {"zh": 1}).items() for x in (code, min(1_000_000, -(-1_000_000 * sample // n)))])
    keep = F.pmod(F.xxhash64(F.lit("language sample"), "k"), F.lit(1_000_000)) < F.try_element_at(part, F.col("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        seen = [0] * len(LANGUAGES)
        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = LANGUAGES.index(l)
                seen[i] += 1
                found = []
                for at in range(0, len(t), PART):
                    # the n-grams that begin in a part; the last of them reach into the next one
                    h, ok = grams([t[at : at + PART + 2]])
                    found.append(np.unique(h[:PART][ok[:PART] > 0]))
                for x in np.unique(np.concatenate(found)).view(np.int64).tolist() if found else ():
                    if (row := total.get(x)) is None:
                        row = total[x] = [0] * len(LANGUAGES)
                    row[i] += 1
        total[0] = seen
        cols = list(zip(*total.values(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), *[pa.array(c, pa.int32()) for c in cols]], names=["h", *LANGUAGES])

    partial = spread(rows.where(keep & F.col("t").isNotNull()).select("t", "l")).mapInArrow(count, "h bigint, " + ", ".join(f"{c} int" for c in LANGUAGES))
    summed = partial.groupBy("h").agg(*[F.sum(c).alias(c) for c in LANGUAGES])
    counted = durable(summed)
    # hash 0 carries the numbers of documents
    docs = next(iter(counted.where("h = 0").select(*LANGUAGES).collect()), None) or [0] * len(LANGUAGES)
    rates = [F.col(c) / F.lit(float(max(n or 0, 1))) for c, n in zip(LANGUAGES, docs, strict=True)]
    most = F.greatest(*rates)
    mask = sum((F.when((r > 0) & (r >= share * most), 1 << i).otherwise(0) for i, r in enumerate(rates)), F.lit(0))
    often = counted.where((F.greatest(*[F.col(c) for c in LANGUAGES]) >= FEWEST) & (F.col("h") != 0)).select("h", mask.alias("mask"))
    # n-grams are folded into the filter where they are; the driver gets the filter's blocks, SLOTS bytes in all
    slots = F.array(*[F.shiftrightunsigned("h", 21 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(PROBES)])
    folded = often.select(F.explode(slots).alias("slot"), "mask").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    blocks = folded.groupBy(F.shiftright("slot", 18).cast("int").alias("block")).applyInArrow(_block, "block int, bits binary").collect()
    bits = np.zeros(SLOTS, np.uint8)
    for r in blocks:
        bits[r["block"] << 18 : (r["block"] + 1) << 18] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Filters(bits))


def _block(rows: pa.Table) -> pa.Table:
    """Slots of one block of the filter as its bytes."""
    slot = rows.column("slot").to_numpy()
    bits = np.zeros(1 << 18, np.uint8)
    bits[slot & (1 << 18) - 1] = rows.column("mask").to_numpy()
    return pa.table({"block": pa.array([int(slot[0]) >> 18], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def sentences(text: str) -> list[int]:
    """Ends of the sentences; the last one is the end of the text."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def _parts(texts: list[str]) -> Iterator[list[tuple[int, int, int, np.ndarray, bool]]]:
    """Texts cut at ends of sentences into parts (text, from, to, ends of sentences, whether the last one goes on), in groups of at most about PART characters."""
    group: list[tuple[int, int, int, np.ndarray, bool]] = []
    size = 0
    for i, t in enumerate(texts):
        ends = sentences(t) if t else []
        at = k = 0
        while at < len(t):
            to = k
            while to < len(ends) and ends[to] - at <= PART:
                to += 1
            last = ends[to - 1] if to > k else at + PART
            if size and size + last - at > PART:
                yield group
                group, size = [], 0
            group.append((i, at, last, np.array(ends[k:to] or [last]), to == k))
            size += last - at
            at, k = last, to
    if group:
        yield group


def classify(filters: Filters, texts: list[str]) -> list[tuple[str | None, float, list[str], list[tuple[int, int, str, float]]]]:
    """(language, confidence, languages with whole sentences, segments) of each text."""
    # of each text: sentence starts, sentence ends, and their sums, in parts; a part may go on with the sentence of the one before
    measured: list[list[list[np.ndarray]]] = [[] for _ in texts]
    goes_on = [False] * len(texts)
    for group in _parts(texts):
        # two characters more, since n-grams reach into the next part
        for (i, at, _, ends, more), sums in zip(group, _measure(filters, [(texts[i][a : b + 2], ends - a) for i, a, b, ends, _ in group]), strict=True):
            new = [np.concatenate([[at], ends[:-1]]), ends, *sums]
            if goes_on[i]:
                for x, y in zip(measured[i][-1][2:], new[2:], strict=True):
                    x[-1] += y[0]
                measured[i][-1][1][-1] = ends[0]
                new = [x[1:] for x in new]
            if len(new[0]):
                measured[i].append(new)
            goes_on[i] = more
    out = []
    for t, rows in zip(texts, measured, strict=True):
        if not rows:
            out.append((None, 0.0, [], []))
        else:
            starts, ends, *sums = (np.concatenate(x) for x in zip(*rows, strict=True))
            out.append(_decide(starts, ends, *_corrected(filters, t, starts, ends, *sums), t))
    return out


def _measure(filters: Filters, parts: list[tuple[str, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of text with its ends of sentences: (weight, weight of each language, number of Chinese or Japanese n-grams) of every sentence."""
    h, ok = grams([t for t, _ in parts])
    mask = filters.languages(h)
    # a word and a character weigh about the same
    weight = WEIGHTS[ok]
    bits = ((mask[:, None] >> np.arange(len(LANGUAGES))) & 1) * weight[:, None]
    sums = np.concatenate([np.zeros((1, len(LANGUAGES))), bits.cumsum(axis=0)])
    number = np.concatenate([[0], weight.cumsum()])
    east = np.concatenate([[0], (ok == 2).cumsum()])
    out = []
    at = 0
    for t, ends in parts:
        starts = np.concatenate([[0], ends[:-1]])
        out.append((number[at + ends] - number[at + starts], sums[at + ends] - sums[at + starts], east[at + ends] - east[at + starts]))
        at += len(t) + 2
    return out


def _corrected(filters: Filters, text: str, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, hits: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, weight of each language less its false positives) of every sentence."""
    true = np.clip((hits - n[:, None] * filters.false) / (1 - filters.false), 0, None)
    # where both scripts occur and one of them opens and closes the sentence, the other one is quoted in it
    for i in np.flatnonzero((two > 0) & (n - two * WEIGHTS[2] > 0.5)).tolist():
        if (frame := _frame(text[starts[i] : ends[i]])) >= 0:
            true[i, ~EASTERN if frame else EASTERN] = 0
            n[i] = two[i] * WEIGHTS[2] if frame else n[i] - two[i] * WEIGHTS[2]
    return n, true


def _frame(sentence: str) -> int:
    """1 if the first and last letters are Chinese or Japanese, 0 if both are not, -1 else."""
    kinds = [k for k in (_kinds[0][min(ord(c), 0xFFFF)] for c in sentence) if k]
    return int(kinds[0] == 2) if kinds and kinds[0] == kinds[-1] else -1


def _best(n: float, true: np.ndarray) -> tuple[int, float, float]:
    order = np.argsort(-true, kind="stable")
    first, second = true[order[0]], true[order[1]]
    return int(order[0]), float(first / n), float((first - second) / n)


def _decide(starts: np.ndarray, ends: np.ndarray, n: np.ndarray, true: np.ndarray, text: str) -> tuple[str | None, float, list[str], list[tuple[int, int, str, float]]]:
    total = float(n.sum())
    if total == 0:
        return None, 0.0, [], []
    found: list[tuple[int, float] | None] = []
    for size, row in zip(n.tolist(), true, strict=True):
        if size < LEAST_WEIGHT:
            found.append(None)
            continue
        lang, part, lead = _best(size, row)
        found.append((lang, min(1.0, part * (0.5 + lead))) if part >= LEAST_SHARE and lead >= LEAST_LEAD else None)
    if not any(found):
        lang, part, lead = _best(total, true.sum(axis=0))
        if part == 0:
            return None, 0.0, [], []
        sure = min(1.0, part * (0.5 + lead))
        return LANGUAGES[lang], sure, [LANGUAGES[lang]], [(0, len(text), LANGUAGES[lang], sure)]
    weight, sure_of = np.zeros(len(LANGUAGES)), np.zeros(len(LANGUAGES))
    for f, size in zip(found, n.tolist(), strict=True):
        if f:
            weight[f[0]] += size
            sure_of[f[0]] += size * f[1]
    # pieces without evidence go with what stands before, at the start with what follows
    current = next(f for f in found if f)
    segments: list[list] = []
    for f, a, b, size in zip(found, starts.tolist(), ends.tolist(), n.tolist(), strict=True):
        current = f or current
        s, c = (size, size * f[1]) if f else (0.0, 0.0)
        if segments and segments[-1][2] == current[0]:
            segments[-1][1] = b
            segments[-1][3] += s
            segments[-1][4] += c
        else:
            segments.append([a, b, current[0], s, c])
    main = int(weight.argmax())
    return (
        LANGUAGES[main],
        float(sure_of[main] / weight[main] * weight[main] / weight.sum()),
        [LANGUAGES[i] for i in np.flatnonzero(weight)],
        [(a, b, LANGUAGES[i], c / s if s else 0.0) for a, b, i, s, c in segments],
    )


SCHEMA = "language string, confidence double, languages array<string>, segments array<struct<start_char:int,end_char:int,lang:string,confidence:double>>"


def identify(df: DataFrame, filters: Broadcast, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, label, language, confidence, languages, segments) of each row."""
    kind = df.schema[key].dataType.simpleString()
    segment = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = filters.value
        for batch in batches:
            for part in slices(batch, 2, PART):
                lang, sure, langs, segs = zip(*classify(model, [t or "" for t in part.column(2).to_pylist()]), strict=True)
                rows = [[dict(zip(("start_char", "end_char", "lang", "confidence"), s, strict=True)) for s in x] for x in segs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(rows, segment)],
                    names=[key, "label", "language", "confidence", "languages", "segments"],
                )

    return spread(df.select(F.col(key), label_language(F.col(label)).alias("label"), F.col(text))).mapInArrow(run, f"`{key}` {kind}, label string, {SCHEMA}")


def found(identified: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang) for each language with whole sentences, of texts whose label is missing or wrong, or that are mixed."""
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~F.col("label").eqNullSafe(F.col("languages")[0]))
    return identified.where(case).select(key, F.explode("languages").alias("lang")).distinct()
