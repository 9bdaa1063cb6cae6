"""Evaluation protocol: validated settings, split integrity, digests and frozen manifests, reviews as rows of violations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import canonical_digest, is_blank, without_space
from larkspur.operators.ranking import rank_within


@dataclass(frozen=True)
class RetrievalConfig:
    dense_top_k: int = 10
    bm25_top_k: int = 20
    fused_top_k: int = 30
    rrf_k: int = 5
    dense_rrf_weight: float = 2.0
    bm25_rrf_weight: float = 1.0
    bm25_tokenizer: str = "char-bigram"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (type(value) is not int or value < 1):
                raise ValueError(f"{f.name} must be a positive integer")
            if f.type == "float" and (not isfinite(value) or value < 0):
                raise ValueError(f"{f.name} must be finite and not negative")
        if self.dense_rrf_weight == self.bm25_rrf_weight == 0:
            raise ValueError("one weight must be positive")
        if self.bm25_tokenizer not in ("char-bigram", "current"):
            raise ValueError("unknown tokenizer")

    @classmethod
    def from_mapping(cls, source: Mapping[str, str]) -> RetrievalConfig:
        """Settings by their names in capitals, such as RRF_K; absent ones keep their defaults."""
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](source[f.name.upper()]) for f in fields(cls) if f.name.upper() in source})


def digest(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, non-ASCII kept."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def seal(manifest: dict, name: str = "integrity_sha256") -> dict:
    content = {k: v for k, v in manifest.items() if k != name}
    return {**content, name: digest(content)}


def check_seal(manifest: dict, expected: dict | None = None, name: str = "integrity_sha256") -> dict:
    """The manifest, if its digest is right and it agrees with what is expected; else ValueError."""
    if manifest != seal(manifest, name):
        raise ValueError("manifest integrity mismatch")
    for key, value in (expected or {}).items():
        if manifest.get(key) != value:
            raise ValueError(f"{key} differs from the frozen manifest")
    return manifest


def row_digests(df: DataFrame, key: str) -> DataFrame:
    """(key, digest) of each row's canonical JSON, columns in order of name."""
    return df.select(key, canonical_digest(F.to_json(F.struct(*sorted(df.columns)))).alias("digest"))


def table_digest(df: DataFrame, key: str) -> str:
    """A digest of a table that does not depend on the order or partitioning of its rows, formed by partial sums."""
    parts = [F.sum(F.conv(F.substring("digest", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return digest([*row_digests(df, key).agg(F.count(F.lit(1)), *parts).first()])


def split_policy(splits: set[str | None], answerable: bool, sweep: bool = False, frozen: bool = False) -> None:
    """Sweeps see development rows only; test rows need a frozen configuration and run alone."""
    if not splits or not answerable:
        raise ValueError("answerable rows are needed")
    if sweep and splits != {"dev"}:
        raise ValueError("sweeps are for development rows only")
    if "test" in splits and (not frozen or len(splits) > 1):
        raise ValueError("test rows need a frozen configuration and must run alone")


def split_integrity(cases: DataFrame, a: str = "dev", b: str = "test") -> DataFrame:
    """One row of counts that must be 0: repeated ids, questions in both splits, rows of no split; and answerable rows of each."""
    split = F.lower(F.trim("split"))
    rows = cases.select("query_id", split.alias("split"), F.lower(without_space(F.coalesce("question", F.lit("")))).alias("q"), "answerable")
    ids = rows.groupBy("query_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
    # one row a question with the splits it stands in, instead of a join of the splits
    both = rows.where(F.col("split").isin(a, b) & (F.col("q") != "")).groupBy("q").agg(F.max(F.col("split") == a).alias("a"), F.max(F.col("split") == b).alias("b")).agg(F.count_if(F.col("a") & F.col("b")).alias("shared_questions"))
    rest = rows.agg(
        F.count_if(~F.coalesce(F.col("split").isin(a, b), F.lit(False))).alias("other_splits"),
        F.count_if((F.col("split") == a) & F.col("answerable")).alias("answerable_a"), F.count_if((F.col("split") == b) & F.col("answerable")).alias("answerable_b"),
    )
    # each side is one row
    return ids.crossJoin(both).crossJoin(rest)


def nth_row_split(df: DataFrame, order: str, n: int = 3, last: str = "test", others: str = "dev") -> DataFrame:
    """df with split: every n-th row in order is `last`. The number of a row comes from ranges, not from one sorted task, once the table is large."""
    numbered = rank_within(df.withColumn("_all", F.lit(0)), ["_all"], [(order, True)], "_n").drop("_all")
    return numbered.withColumn("split", F.when(F.col("_n") % n == 0, last).otherwise(others)).drop("_n")


def dataset_violations(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, rule) of cases that break a rule: repeated id or question, answerable without checks or pages, unanswerable with them, pages not in the index, grades outside 1 to 3."""
    repeated = cases.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated id").alias("rule"))
    asked = cases.where(~is_blank(F.col("question"))).groupBy("question").agg(F.min("query_id").alias("query_id"), F.count_distinct("query_id").alias("n")).where("n > 1").select("query_id", F.lit("repeated question").alias("rule"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    shape = F.when(F.col("answerable") & ~some("answer_checks"), "no checks").when(F.col("answerable") & ~some("gold_pages"), "no pages").when(~F.col("answerable") & (some("answer_checks") | some("gold_pages")), "unanswerable with labels")
    shaped = cases.select("query_id", shape.alias("rule")).where("rule is not null")
    named = cases.select("query_id", F.explode("gold_pages").alias("p")).select("query_id", "p.*")
    lost = named.join(pages.select("source_file", "page_number").distinct(), ["source_file", "page_number"], "left_anti").select("query_id", F.lit("page not in index").alias("rule"))
    graded = named.where(~F.coalesce(F.col("relevance_grade").isin(1, 2, 3), F.lit(False))).select("query_id", F.lit("grade").alias("rule"))
    return repeated.unionByName(asked).unionByName(shaped).unionByName(lost).unionByName(graded).distinct()


def review_violations(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, rule) of reviews that can't count: identity, completeness and evidence. No row means all may count.

    A claim must be a literal span of the answer, white space aside, and be named once; a supported claim needs evidence,
    and a quote must stand on a page returned for the answer.
    """
    doubled = reviews.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated review").alias("rule"))
    j = reviews.join(results.select("query_id", "answer", "error", "source_documents", F.lit(True).alias("_known")), "query_id", "left")
    answer = without_space(F.coalesce("answer", F.lit("")))
    claims = F.transform("claims", lambda c: without_space(F.coalesce(c["claim"], F.lit(""))))

    def on_page(e: Column) -> Column:
        quote = without_space(F.coalesce(e["quote"], F.lit("")))
        return (quote != "") & F.exists("source_documents", lambda s: (s["source_file"] == e["source_file"]) & (s["page_number"] == e["page_number"]) & F.contains(without_space(F.coalesce(s["content"], F.lit(""))), quote))

    good = F.coalesce(F.forall("claims", lambda c: F.forall(F.coalesce(c["evidence"], F.array().cast("array<struct<source_file:string,page_number:int,quote:string>>")), on_page)), F.lit(False))
    level = lambda c: F.coalesce(F.col(c).isin(0, 1, 2), F.lit(False))
    rules = {
        "unknown query": F.col("_known").isNull(),
        "failed request": F.col("error").isNotNull(),
        "another answer": ~F.col("answer_sha256").eqNullSafe(canonical_digest(F.col("answer"))),
        "no reviewer": is_blank(F.col("reviewer")),
        "incomplete": ~F.coalesce(F.col("review_complete"), F.lit(False)),
        "no judgment": F.col("semantic_answer_correct").isNull(),
        "grades": ~(level("answer_relevance") & level("completeness")),
        "no claims list": F.col("claims").isNull(),
        "claim is no span": F.coalesce(F.exists(claims, lambda c: (c == "") | ~F.contains(answer, c)), F.lit(False)),
        "repeated claim": F.coalesce(F.size(F.array_distinct(claims)) < F.size(claims), F.lit(False)),
        "claim without judgment": F.coalesce(F.exists("claims", lambda c: c["supported"].isNull()), F.lit(False)),
        "no evidence": F.coalesce(F.exists("claims", lambda c: c["supported"] & (F.coalesce(F.size(c["evidence"]), F.lit(0)) <= 0)), F.lit(False)),
        "quote not on page": F.col("claims").isNotNull() & ~good,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda r: r.isNotNull())
    return j.select("query_id", F.explode(broken).alias("rule")).unionByName(doubled)


def as_dict(config: RetrievalConfig) -> dict:
    return asdict(config)
