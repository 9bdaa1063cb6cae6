"""Same or near-same records across splits.

Method: records are sets of shingles; minwise hashes of a set are cut into bands, and records that share a band's bucket
are candidates, only ones of the training side against ones of the evaluation side. Exact Jaccard similarity of the sets
confirms a candidate, and confirmed pairs are counted by split and source.

Records with the same set are one class, hashed, joined and compared once. The result is the pairs of classes, each with
a representative and its number of records, beside the membership; members are written out as pairs only where a caller
asks for that, and counts come from the sizes of classes. Buckets carry classes only and are joined by key, never listed
against themselves; a join's hot keys are split at run time, and sets are fetched for distinct candidates.

For questions the shingles are the words of their normal text (see questions), a similarity of 0.5 makes a pair, and
what the two have not in common then has to be explained. Companies, years and names are never explained, so they are the
question's block: a bucket belongs to one block, and the minwise hashes are those of the other words. The bands find a pair
whose other words have a similarity of 0.43 (two slips among eight words) with a probability of 0.99, one of 0.6 with 0.9999. For other text the shingles are five words in a row (a Han character is a word) and the
similarity 0.8, which the bands find with 0.9996.

Defined cases: null and blank texts have no shingles and match nothing; texts of fewer words than a shingle are one shingle.
Splits are read in any case and with outer spaces; a null or other split belongs to no side. Repeated deliveries count once;
a record whose text changed between deliveries is a member of both classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.questions import exact, question_words, same_question
from larkspur.session import durable, workers

TRAIN, EVALUATION = ("train",), ("dev", "test")
#: Similarity, bands and rows of questions, and of other text.
QUESTIONS, TEXTS = (0.5, 24, 2), (0.8, 20, 5)


def split_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def word_shingles(text: Column, n: int = 5) -> Column:
    """The distinct runs of n words of a text; a Han or kana character is a word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[^\s\p{P}\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+)"), F.lit(1))
    last = F.greatest(F.size(words) - n, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def question_shingles(df: DataFrame, register: Broadcast, text: str = "question") -> DataFrame:
    """df with shingles ARRAY<STRING>, the words of its questions' normal text, and fixed ARRAY<STRING>, those of them that are never explained. A narrow map; workers keep what they have met."""
    df = df.drop("shingles", "fixed")
    at = df.columns.index(text)
    kind = T.ArrayType(T.StringType())
    inner = T.StructType([*df.schema.fields, T.StructField("shingles", kind), T.StructField("fixed", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        companies = register.value
        for batch in batches:
            words = [question_words(t, companies) for t in batch.column(at).to_pylist()]
            new = [pa.array(x, pa.list_(pa.string())) for x in (words, [exact(w) for w in words])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *[pa.field(n, pa.list_(pa.string())) for n in ("shingles", "fixed")]]))

    return df.mapInArrow(run, inner)


def signatures(sets: list[np.ndarray] | np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Buckets [band, set] of sets of 64-bit hashes, laid end to end from starts on; none is empty."""
    h = np.asarray(sets, np.uint64)
    seeds = np.random.default_rng(20240229).integers(1, 1 << 63, size=bands * rows, dtype=np.uint64)
    out = np.empty((bands, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            bucket = np.full(len(starts), b + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows):
                z = (h ^ seeds[b * rows + r]) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(31)
                z *= np.uint64(0x94D049BB133111EB)
                bucket = (bucket ^ np.minimum.reduceat(z, starts)) * np.uint64(0xD6E8FEB86659FD93)
                bucket ^= bucket >> np.uint64(32)
            out[b] = bucket
    return out


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(class, bucket) for each band of classes (class, hashed, block); a bucket is the hash of the block, the band's number and its minwise hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sets = batch.column(1)
            words = sets.flatten().dictionary_encode()
            for w in words.dictionary.to_pylist():
                if w not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known[w] = xxhash.xxh64_intdigest(w)
            code = np.array([known.get(w) or xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
            sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            found = signatures(code[words.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), bands, rows)
            with np.errstate(over="ignore"):
                found = (found ^ batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                found ^= found >> np.uint64(33)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sizes) + 1, bands), pa.int32()), pa.array(np.ascontiguousarray(found.T).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["class", "buckets"])

    return classes.select("class", "hashed", "block").mapInArrow(run, "class binary, buckets array<bigint>").select("class", F.explode("buckets").alias("bucket"))


def classed(records: DataFrame) -> DataFrame:
    """records with shingles sorted and class, the digest of their set; records without shingles drop out."""
    return records.where(F.size("shingles") > 0).withColumn("shingles", F.array_sort(F.array_distinct("shingles"))).withColumn("class", F.unhex(F.md5(F.to_json("shingles"))))


def cross_classes(train: DataFrame, evaluation: DataFrame, threshold: float, bands: int, rows: int, explained: Callable[[list[str], list[str]], bool] | None = None) -> DataFrame:
    """(train_class, eval_class, similarity) of classes (class, shingles, perhaps fixed, ...) of either side with Jaccard similarity of at least threshold.

    explained: what two sets that differ have to meet besides; two that differ in their fixed shingles never do.
    """
    a, b = (df.groupBy("class").agg(*[F.first(c).alias(c) for c in df.columns if c in ("shingles", "fixed")]) for df in (train, evaluation))

    def hashed(df: DataFrame) -> DataFrame:
        if "fixed" not in df.columns:
            return df.select("class", F.col("shingles").alias("hashed"), F.lit(0).cast("bigint").alias("block"))
        rest = F.array_except("shingles", "fixed")
        return df.select("class", F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit(""))).alias("hashed"), F.xxhash64("fixed").alias("block"))

    left, right = (_buckets(hashed(df), bands, rows) for df in (a, b))
    both = left.withColumnRenamed("class", "train_class").join(right.withColumnRenamed("class", "eval_class"), "bucket").select("train_class", "eval_class").distinct()
    sets = both.join(a.select(F.col("class").alias("train_class"), F.col("shingles").alias("sa")), "train_class").join(b.select(F.col("class").alias("eval_class"), F.col("shingles").alias("sb")), "eval_class")
    common = F.size(F.array_intersect("sa", "sb"))
    near = sets.withColumn("similarity", common / (F.size("sa") + F.size("sb") - common)).where(F.col("similarity") >= threshold)
    if explained is None:
        return near.select("train_class", "eval_class", "similarity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [x == y or explained(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return near.select("train_class", "eval_class", "similarity", "sa", "sb").mapInArrow(run, "train_class binary, eval_class binary, similarity double")


def cross_pairs(pairs: DataFrame, train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id, similarity, and what else evaluation has): the members of pairs of classes, written out."""
    rest = [c for c in evaluation.columns if c not in ("id", "shingles", "fixed", "class")]
    return (
        pairs.join(train.select(F.col("class").alias("train_class"), F.col("id").alias("train_id")), "train_class")
        .join(evaluation.select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"), *rest), "eval_class")
        .select("train_id", "eval_id", "similarity", *rest)
    )


def records(test_set: DataFrame, golden: DataFrame, text: str = "question") -> DataFrame:
    """(id, text, split, source) of the records of either side, each delivery once; golden has no split."""
    rows = test_set.select(F.col("query_id").alias("id"), text, split_name(F.col("split")).alias("split"), F.lit("test_set_v2").alias("source")).where(F.col("split").isin(*TRAIN, *EVALUATION))
    every = rows.unionByName(golden.select(F.col("query_id").alias("id"), text, F.lit(None).cast("string").alias("split"), F.lit("golden_test_set").alias("source"))).where("id is not null")
    return every.distinct()


def sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = F.coalesce(F.col("split").isin(*TRAIN), F.lit(False))
    return members.where(train), members.where(~train)


def question_overlaps(test_set: DataFrame, golden: DataFrame, register: Broadcast) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members (id, source, split, class, shingles, fixed)) of questions of the training split and of evaluation records that ask the same."""
    every = records(test_set, golden)
    every = every.repartition(workers(every), "id")
    # read for classes, sets and members; stored, so that no question is taken apart twice
    members = durable(classed(question_shingles(every, register).select("id", "source", "split", "shingles", "fixed")))
    return cross_classes(*sides(members), *QUESTIONS, explained=same_question), members


def text_overlaps(test_set: DataFrame, golden: DataFrame, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """The same for near-copies of texts: runs of five words, similarity of 0.8."""
    members = durable(classed(records(test_set, golden, text).select("id", "source", "split", word_shingles(F.col(text)).alias("shingles"))))
    return cross_classes(*sides(members), *TEXTS), members


def class_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(source, split, train_class, eval_class, similarity, train_id, eval_id, n_train, n_eval): pairs of classes by the evaluation side's source and split, with representatives and sizes."""
    train, evaluation = sides(members)

    def sizes(df: DataFrame, side: str, *by: str) -> DataFrame:
        return df.groupBy(F.col("class").alias(f"{side}_class"), *by).agg(F.min("id").alias(f"{side}_id"), F.count(F.lit(1)).alias(f"n_{side}"))

    joined = pairs.join(sizes(train, "train"), "train_class").join(sizes(evaluation, "eval", "source", "split"), "eval_class")
    return joined.select("source", "split", F.lower(F.hex("train_class")).alias("train_class"), F.lower(F.hex("eval_class")).alias("eval_class"), "similarity", "train_id", "eval_id", "n_train", "n_eval")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Confirmed pairs, and records of either side that are in one, by source and split, from pairs of classes with their sizes."""
    total = pairs.groupBy("source", "split").agg(F.sum(F.col("n_train") * F.col("n_eval")).alias("n_pairs"))

    def once(side: str) -> DataFrame:
        return pairs.groupBy("source", "split", f"{side}_class").agg(F.first(f"n_{side}").alias("n")).groupBy("source", "split").agg(F.sum("n").alias(f"n_{side}"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"source": "_source", "split": "_split"})
        return a.join(b, (F.col("source") == F.col("_source")) & F.col("split").eqNullSafe(F.col("_split"))).drop("_source", "_split")

    return joined(joined(total, once("eval")), once("train"))
