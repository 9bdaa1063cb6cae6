"""Rankings of chunks and pages: weighted fusion, identities, unique and diverse pages, expansion."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import is_blank, key_text, without_space
from larkspur.session import durable, workers


def chunk_identity(source_file: str = "source_file", page: str = "page_number", start: str = "start_index", text: str = "content") -> list[Column]:
    """File, page (0 where missing), start (-1 where missing) and normalised text of a chunk."""
    return [F.coalesce(F.col(source_file), F.lit("")), F.coalesce(F.col(page), F.lit(0)), F.coalesce(F.col(start), F.lit(-1)), key_text(F.coalesce(F.col(text), F.lit("")))]


def _first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key; keys are hashed to one column, so the shuffle carries no text twice."""
    keyed = df.withColumn("_key", F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), 256))
    names = [c for c in df.columns if c not in order]
    best = keyed.groupBy("_key").agg(F.min(F.struct(*order, *names)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def dedupe_chunks(df: DataFrame, order: list[str], text: str = "content", **names: str) -> DataFrame:
    """First row of each chunk identity; blank chunks drop out."""
    return _first(df.where(~is_blank(F.col(text))), chunk_identity(text=text, **names), order)


def dedupe_index(df: DataFrame, order: list[str], source_file: str = "source_file", page: str = "page_number", start: str = "start_index", text: str = "content") -> DataFrame:
    """First row of each (file, page, start, text without white space): the same text on two pages stays."""
    bare = without_space(F.coalesce(F.col(text), F.lit("")))
    return _first(df.where(bare != ""), [F.col(source_file), F.col(page), F.col(start), bare], order)


def dedupe_sweep(df: DataFrame, order: list[str], company: str = "company", text: str = "content") -> DataFrame:
    """First row of each (company, text without white space, any case), across pages."""
    bare = F.lower(without_space(F.coalesce(F.col(text), F.lit(""))))
    return _first(df.where(bare != ""), [F.coalesce(F.col(company), F.lit("")), bare], order)


def weighted_rrf(votes: DataFrame, weights: dict[str, float], rrf_k: int = 5, limit: int = 30, run: str = "run_id", item: str = "chunk_id", extra: list[str] | None = None) -> DataFrame:
    """(run, item, score, rank) of votes (run, method, rank, item): sum of weight / (rrf_k + rank), one vote of a method for an item, its best.

    Routes are taken in the order of weights: equal totals keep the place of the first route that lists the item.
    """
    if rrf_k < 1 or limit < 1:
        raise ValueError("k and limit must be positive")
    if any(not isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    used = {m: w for m, w in weights.items() if w > 0}
    if not used:
        raise ValueError("one weight must be positive")
    by = [run, *(extra or [])]
    weight = F.create_map(*[x for m, w in used.items() for x in (F.lit(m), F.lit(float(w)))])
    place = F.create_map(*[x for i, m in enumerate(used) for x in (F.lit(m), F.lit(i))])
    once = votes.where(F.col("method").isin(*used) & F.col(item).isNotNull()).groupBy(*by, "method", item).agg(F.min("rank").alias("rank"))
    total = once.groupBy(*by, item).agg(
        F.round(F.sum(weight[F.col("method")] / (F.lit(rrf_k) + F.col("rank"))), 12).alias("score"), F.min(F.struct(place[F.col("method")], F.col("rank"))).alias("_first")
    )
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "_first", item)
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_first")


def unique_pages(ranked: DataFrame, by: list[str], page: list[str]) -> DataFrame:
    """(by, page, rank): pages in the order of their first chunk, renumbered from 1."""
    first = ranked.groupBy(*by, *page).agg(F.min("rank").alias("_at"))
    order = Window.partitionBy(*by).orderBy("_at", *page)
    return first.withColumn("rank", F.row_number().over(order)).drop("_at")


def diverse_pages(ranked: DataFrame, required: DataFrame | None, top_n: int, query: str = "query_id", company: str = "company", page: tuple[str, str] = ("source_file", "page_number")) -> DataFrame:
    """ranked (query, rank, company, page...) cut to one chunk a page: first, for each required company in turn, its best chunk on a page not taken yet, then the best of the other pages.

    required has (query, company, place); a query gets as many pages as it requires companies if that is more than top_n. A page
    may hold chunks of several companies. ranked is a fused list, whose limit bounds what is brought together for a query.

    A query that requires at most one company needs no turns: its best chunk takes its page, the best chunk any other page. Only lists
    of queries that require several are worked off in turn. ranked is stored, since both kinds read it.
    """
    columns = ranked.columns
    if required is None:
        return _one_a_page(ranked.withColumn("_place", F.lit(None).cast("int")).withColumn("_n", F.lit(0)), top_n, query, company, page).select(columns)
    wanted = required.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(company).alias("c")))), lambda x: x["c"]).alias("_required"))
    stored = durable(ranked.join(wanted, query, "left").withColumn("_n", F.greatest(F.size("_required"), F.lit(0))))
    # place of the only required company, where the chunk is one of it
    place = F.when(F.get("_required", F.lit(0)) == F.col(company), 1)
    single = _one_a_page(stored.where("_n <= 1").withColumn("_place", place), top_n, query, company, page)
    return single.select(columns).unionByName(_in_turn(stored.where("_n > 1"), top_n, query, company, page).select(columns))


def _one_a_page(rows: DataFrame, top_n: int, query: str, company: str, page: tuple[str, str]) -> DataFrame:
    together = rows.repartition(workers(rows), query)
    best = F.when(F.col("_place").isNotNull() & (F.row_number().over(Window.partitionBy(query, company).orderBy("rank")) == 1), 1)
    first = together.withColumn("_forced", best).withColumn("_p", F.row_number().over(Window.partitionBy(query, *page).orderBy(F.col("_forced").asc_nulls_last(), "rank"))).where("_p = 1")
    order = Window.partitionBy(query).orderBy(F.col("_forced").asc_nulls_last(), "rank")
    return first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.greatest(F.lit(top_n), F.col("_n"))).withColumn("rank", F.col("_rank"))


def _in_turn(rows: DataFrame, top_n: int, query: str, company: str, page: tuple[str, str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (query, "rank", "_required", "_n")]
    lists = rows.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias("_rows"), F.first("_required").alias("_required"))

    def open_page(taken: Column, row: Column) -> Column:
        return ~F.exists(taken, lambda t: t[page[0]].eqNullSafe(row[page[0]]) & t[page[1]].eqNullSafe(row[page[1]]))

    none = F.slice("_rows", 1, 0)
    forced = F.aggregate("_required", none, lambda taken, c: F.concat(taken, F.slice(F.filter("_rows", lambda r: (r[company] == c) & open_page(taken, r)), 1, 1)))
    lists = lists.withColumn("_forced", forced)
    every = F.aggregate("_rows", F.col("_forced"), lambda taken, r: F.when(open_page(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
    kept = F.slice(every, F.lit(1), F.greatest(F.lit(top_n), F.size("_required")))
    flat = lists.select(query, F.posexplode(kept).alias("_at", "_r"))
    return flat.select(query, *[F.col(f"_r.`{c}`").alias(c) for c in rest], (F.col("_at") + 1).cast("int").alias("rank"))


def expand_pages(ranked: DataFrame, pages: DataFrame, page: tuple[str, str] = ("source_file", "page_number"), text: str = "content", full: str = "page_text") -> DataFrame:
    """ranked with the whole page's text in place of the chunk's, where there is one."""
    known = pages.select(*page, F.col(full).alias("_full")).where("_full <> ''")
    joined = ranked.join(known, list(page), "left")
    return joined.withColumn(text, F.coalesce("_full", F.col(text))).drop("_full").select(*ranked.columns)


def of_pages(chunks: DataFrame, wanted: DataFrame, page: tuple[str, str] = ("source_file", "page_number")) -> DataFrame:
    """The chunks of the pages that wanted names; texts of no other page are brought together."""
    return chunks.join(wanted.select(*page).distinct(), list(page), "left_semi")


def page_texts(chunks: DataFrame, page: tuple[str, str] = ("source_file", "page_number"), text: str = "content", order: str = "start_index") -> DataFrame:
    """(page..., page_text): the chunks of each page in order, as its text; null text is empty. A page of a report bounds its group."""
    parts = chunks.where(F.col(page[0]).isNotNull() & F.col(page[1]).isNotNull()).groupBy(*page).agg(F.sort_array(F.collect_set(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("p"))
    return parts.select(*page, F.array_join(F.transform("p", lambda x: x.t), "\n").alias("page_text"))
