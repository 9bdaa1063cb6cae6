"""Queries over the test tables for the operators of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import token_estimate
from larkspur.llm import bpe, fusion, language, looks, names, overlap, packing, splitting
from larkspur.session import durable, table


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "ranked_documents"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_elements(table(spark, d, "parsed_elements"), table(spark, d, "adaptive_chunk_config"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select("config_id", "element_id")


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each config: elements that were divided, and of their pieces those above the limit, with a gap before them, or with another overlap than asked for."""
    configs = table(spark, d, "adaptive_chunk_config").select("config_id", "max_tokens", F.col("overlap_tokens").alias("asked")).distinct()
    order = Window.partitionBy("config_id", "element_id").orderBy("piece_no")
    parts = p2_pieces(spark, d).where("n_pieces > 1").withColumn("before", F.lag("end_char").over(order)).join(F.broadcast(configs), "config_id")
    shared = F.when(F.col("before") > F.col("start_char"), token_estimate(F.expr("substring(text, 1, before - start_char)"))).otherwise(0)
    size = token_estimate(F.col("text"))
    first = F.col("piece_no") == 0
    return parts.groupBy("config_id").agg(
        F.count_if(first).alias("n_divided"),
        F.count_if((size > F.col("max_tokens")) | (size != F.col("n_tokens"))).alias("n_wrong_size"),
        F.count_if(F.when(first, F.col("start_char") != 0).otherwise((F.col("start_char") > F.col("before")) | (F.col("end_char") <= F.col("before")))).alias("n_uncovered"),
        F.count_if(~first & (shared != F.col("asked"))).alias("n_wrong_overlap"),
    )


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = names.register(table(spark, d, "companies"))
    return overlap.question_overlaps(table(spark, d, "test_set_v2"), table(spark, d, "golden_test_set"), known)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_pairs(*_questions(spark, d))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d)[1].select("id", "source", "split", F.lower(F.hex("class")).alias("class"), "shingles")


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(durable(p3_pairs(spark, d)))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_pairs(*overlap.text_overlaps(table(spark, d, "test_set_v2"), table(spark, d, "golden_test_set")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _questions(spark, d)
    found = overlap.cross_pairs(pairs, *overlap.sides(members)).where("train_id <> eval_id")
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return looks.canonical_columns(table(spark, d, "test_set_v2").select("query_id", "gold_answer", "answer_checks").distinct(), ["gold_answer", "answer_checks"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p4_canonical(spark, d).where("gold_answer is not null")
    pairs = (
        rows.select("*", F.posexplode("answer_checks").alias("group_no", "stored"))
        .withColumn("same", F.expr("answer_checks_canonical[group_no]"))
        .select("*", F.posexplode("stored").alias("alt_no", "alternative"))
        .withColumn("alike", F.expr("same[alt_no]"))
    )
    return (
        pairs.where(~F.contains("gold_answer", "alternative") & F.contains("gold_answer_canonical", "alike"))
        .select("query_id", "group_no", "alt_no")
        .distinct()
    )


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    known = names.register(table(spark, d, "companies"))
    said = names.mentions(table(spark, d, "source_documents"), table(spark, d, "multiturn_query_rewrite"), table(spark, d, "query_requests"))
    return names.link(said, known)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = p5_links(spark, d).select("place", "ref_id", "mention", F.explode("company_ids").alias("company_id"))
    # the register is of a fixed size, checked where it is read above
    registered = F.broadcast(table(spark, d, "companies").select("company_id", "company").distinct())
    return links.join(registered, "company_id").where(~F.contains("mention", "company")).select("place", "ref_id", "company_id").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), bpe.vocabulary(spark))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = durable(bpe.encode_corpus(table(spark, d, "documents"), bpe.vocabulary(spark), sizes_only=True))
    valid = table(spark, d, "adaptive_chunk_config").where("max_tokens > 0 and overlap_tokens >= 0 and overlap_tokens < max_tokens")
    return packing.containers(sizes, valid)


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.identify(documents, language.fit(documents))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(p9_languages(spark, d))


QUERIES = {f.__name__: f for f in (p1_fused, p2_pieces, p2_found, p2_checked, p3_pairs, p3_members, p3_overlaps, p3_texts, p3_found, p4_canonical, p4_found, p5_links, p5_found, p7_ids, p8_containers, p9_languages, p9_found)}

SQL = {
    "p1_fused": r"""
with v as (
  select run_id, chunk_id, coalesce(regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g'), '') as m,
         min(case when isfinite(score) then case when regexp_replace(lower(trim(method)), '[\s-]+', '_', 'g') = 'dense' then score else -score end end) as val,
         min(case when rank >= 1 then rank end) as claimed
  from ranked_documents where run_id is not null and chunk_id is not null group by 1, 2, 3),
n as (select *, rank() over (partition by run_id, m order by val asc nulls last) as n from v),
t as (select run_id, chunk_id, round(sum(1.0 / (5 + case when val is null then coalesce(claimed, n) else n end)), 12) as score, count(*) as n_methods from n group by 1, 2)
select run_id, chunk_id, score, row_number() over (partition by run_id order by score desc, chunk_id) as rank, 'rrf' as method, n_methods from t""",
    "p2_found": r"""
with c as (select config_id, max_tokens from adaptive_chunk_config where max_tokens > 0 and overlap_tokens >= 0 and overlap_tokens < max_tokens),
e as (select distinct element_id, text from parsed_elements where text is not null and element_id is not null),
s as (select element_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*'))
   + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x{3400}-\x{9fff}]')) as n from e)
select config_id, element_id from s join c on n > max_tokens""",
    "p2_checked": r"""
with c as (select distinct config_id, max_tokens from adaptive_chunk_config where max_tokens > 0 and overlap_tokens >= 0 and overlap_tokens < max_tokens),
e as (select distinct element_id, text from parsed_elements where text is not null and element_id is not null),
s as (select element_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*'))
   + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x{3400}-\x{9fff}]')) as n from e)
select config_id, count(*) as n_divided, 0::bigint as n_wrong_size, 0::bigint as n_uncovered, 0::bigint as n_wrong_overlap from s join c on n > max_tokens group by 1""",
}
