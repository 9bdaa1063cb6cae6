"""Queries of the corpus: token estimates, line kinds, elements, chunks, the index build, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import chunking, protocol, rankings, sweep
from larkspur.operators.ranking import rank_within
from larkspur.session import spread, table


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.token_estimate(F.col("text")).alias("n_tokens"))


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per document: lines, headings, table lines and their union's rest."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    kind = lines.select("doc_id", C.is_table_line(F.col("line")).alias("t"), C.is_heading(F.col("line")).alias("h"))
    return kind.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("t").alias("n_table"), F.count_if(F.col("h") & ~F.col("t")).alias("n_heading"))


def sentence_elements(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_elements(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])


def adaptive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_pages(spread(table(spark, d, "documents").select("doc_id", "source", "page_number", "text").where("text is not null")), chunking.ChunkConfig(), ["doc_id", "source", "page_number"])


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = adaptive_chunks(spark, d)
    tokens = F.col("token_count")
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(tokens), 6).alias("mean"), F.percentile(tokens, F.lit(0.95)).alias("p95"), F.max(tokens).cast("bigint").alias("most"), F.round(F.avg((F.col("overlap_tokens") == 0).cast("double")), 6).alias("without_overlap"))


def chunk_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Chunk statistics of every point of the declared grid."""
    return sweep.chunk_statistics(spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null")), sweep.grid())


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", F.explode(chunking.fixed_windows(F.col("text"))).alias("w"))
    return cut.select("doc_id", F.col("w.start_index").cast("bigint").alias("start_index"), F.length("w.content").alias("n_chars"))


def build_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages to the chunk table: company from the file's name, dedupe, dense chunk_id by file, page and place.

    The number of a chunk comes from ranges once the table is too large for one sorted task.
    """
    made = adaptive_chunks(spark, d).withColumnRenamed("source", "source_file")
    kept = rankings.dedupe_index(made.select("source_file", "page_number", "doc_id", "chunk_index", "start_index", "content", "token_count"), ["source_file", "page_number", "doc_id", "chunk_index"])
    numbered = rank_within(kept.withColumn("_all", F.lit(0)), ["_all"], [("source_file", True), ("page_number", True), ("doc_id", True), ("chunk_index", True)], "n").drop("_all")
    return numbered.withColumn("chunk_id", F.col("n") - 1).withColumn("company", C.company_from_filename(F.col("source_file"))).drop("n")


def companies_from_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select("source", C.company_from_filename(F.col("source")).alias("company"))


def report_years(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "documents").where("text is not null").select("source", F.explode(F.array_distinct(C.years(F.col("text")))).alias("year"))
    return y.distinct()


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.explode(C.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the three normal forms of each text."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(C.key_text(t), 256).alias("key"), F.sha2(C.without_space(t), 256).alias("bare"), F.sha2(C.answer_text(t), 256).alias("answer"))


def manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.canonical_digest(F.col("text")).alias("digest"), F.substring(C.canonical_digest(F.col("text")), 1, 12).alias("version"))


def third_row_split(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "test_set_v2").select("query_id").distinct()
    return protocol.nth_row_split(cases, "query_id")


QUERIES = {
    f.__name__: f
    for f in (token_estimate, line_flags, sentence_elements, adaptive_chunks, chunk_stats, chunk_sweep, fixed_chunks, build_index, companies_from_files, report_years, topic_counts, normal_forms, manifest_hash, third_row_split)
}

_S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_TOPICS = ", ".join(f"'{t}'" for t in C.TOPICS)
SQL = {
    "token_estimate": r"""select doc_id, greatest(1, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._%-][A-Za-z0-9]+)*'))
 + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}\x{3400}-\x{9fff}]')))::int as n_tokens from documents where text is not null""",
    "line_flags": rf"""with l as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line from documents where text is not null),
c as (select doc_id, regexp_replace(line, '^{_S}+|{_S}+$', '', 'g') as s, list_filter(list_transform(string_split_regex(line, '\t| {{2,}}'), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: x <> '') as cells from l),
k as (select doc_id, len(cells) >= 3 and len(list_filter(cells, lambda x: regexp_matches(x, '\p{{Nd}}'))) >= 2 as t,
  len(s) > 0 and len(s) <= 40 and not regexp_matches(s, '[。！？；!?]$') and len(regexp_extract_all(s, '\p{{Nd}}+(?:\.\p{{Nd}}+)?%?')) <= 1 as h from c)
select doc_id, count(*) as n_lines, count_if(t) as n_table, count_if(h and not t) as n_heading from k group by 1""",
    "sentence_elements": rf"""with l as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) as i from documents where text is not null),
c as (select doc_id, i, regexp_replace(line, '^{_S}+|{_S}+$', '', 'g') as s, list_filter(list_transform(string_split_regex(line, '\t| {{2,}}'), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: x <> '') as cells from l),
k as (select doc_id, i, s, case when s = '' then 'blank' when len(cells) >= 3 and len(list_filter(cells, lambda x: regexp_matches(x, '\p{{Nd}}'))) >= 2 then 'table'
  when len(s) <= 40 and not regexp_matches(s, '[。！？；!?]$') and len(regexp_extract_all(s, '\p{{Nd}}+(?:\.\p{{Nd}}+)?%?')) <= 1 then 'heading' else 'text' end as kind from c),
b as (select *, lag(kind) over w is distinct from kind or kind = 'heading' as opens, lag(s) over w as before from k window w as (partition by doc_id order by i)),
g as (select *, sum(opens::int) over (partition by doc_id order by i) as grp from b),
t as (select doc_id, grp, kind, case kind when 'table' then string_agg(s, chr(10) order by i)
  else string_agg(case when not opens and regexp_matches(before, '[A-Za-z0-9]$') and regexp_matches(s, '^[A-Za-z0-9]') then ' ' else '' end || s, '' order by i) end as whole from g where kind <> 'blank' group by 1, 2, 3),
p as (select doc_id, grp, kind, case kind when 'text' then regexp_extract_all(whole, '[^。！？；!?]*[。！？；!?]|[^。！？；!?]+') else [whole] end as parts from t),
e as (select doc_id, grp, kind, unnest(range(1, len(parts) + 1)) as j, regexp_replace(unnest(parts), '^{_S}+|{_S}+$', '', 'g') as element from p),
f as (select * from e where element <> '')
select doc_id, (row_number() over w - 1)::int as pos, kind, coalesce(sum(len(element)) over (partition by doc_id order by grp, j rows between unbounded preceding and 1 preceding), 0)::int as start, element from f window w as (partition by doc_id order by grp, j)""",
    "fixed_chunks": "with s as (select doc_id, text, unnest(range(0, greatest(ceil((len(text) - 80) / 420.0)::bigint, 1))) as i from documents where len(text) > 0) select doc_id, i * 420 as start_index, len(substring(text, i * 420 + 1, 500)) as n_chars from s",
    "companies_from_files": r"select distinct source, regexp_replace(regexp_replace(regexp_replace(source, '\.[^.]*$', ''), '^\p{Nd}+_', ''), '_report$', '', 'i') as company from documents",
    "report_years": r"select distinct source, unnest(regexp_extract_all(text, '(?:19|20)\p{Nd}{2}')) as year from documents where text is not null",
    "topic_counts": f"with t as (select unnest([{_TOPICS}]) as topic) select topic, count(*) as n from documents join t on contains(text, topic) group by 1",
    "normal_forms": rf"""select doc_id, sha256(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g'))) as key, sha256(regexp_replace(text, '{_S}+', '', 'g')) as bare, sha256(lower(regexp_replace(text, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}},，]', '', 'g'))) as answer from documents where text is not null""",
    "manifest_hash": "select doc_id, sha256(text) as digest, substring(sha256(text), 1, 12) as version from documents where text is not null",
    "third_row_split": "with q as (select distinct query_id from test_set_v2) select query_id, case when row_number() over (order by query_id) % 3 = 0 then 'test' else 'dev' end as split from q",
}
