"""BM25 over postings tables: corpus statistics, scoped top-k search, and re-ranking with candidates' own statistics.

Statistics are of the whole corpus, also for a scoped search; a scope filters below the cut. Scores are rounded to six
places before they are compared, so the order in which a sum was formed decides no tie; ties go by chunk.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.columns import bm25_tokens, space_tokens
from larkspur.session import durable, workers

# The defaults of BM25 Okapi.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct tokens of queries that may be sent to all executors, some 30 MB.
BROADCAST_TERMS = 300_000
#: Tokens of queries that go to all executors at once, some 30 MB.
SENT = 2_500_000


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content", tokenizer: str = "char-bigram", group: str | None = None) -> DataFrame:
    """(group, key, token, tf, dl): term frequencies, with the length of the chunk beside them, so that no join has to bring it.

    Chunks are partitioned by key before their tokens are told apart: the shuffle carries texts once, the counting needs none, and a
    chunk's postings stay together.
    """
    chunks = chunks.repartition(workers(chunks), key)
    split = bm25_tokens if tokenizer == "char-bigram" else space_tokens
    by = [group] if group else []
    flat = chunks.select(*by, F.col(key), split(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).select(*by, key, F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("token"))
    return flat.groupBy(*by, key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(chunks: DataFrame, key: str = "chunk_id", text: str = "content", tokenizer: str = "char-bigram") -> DataFrame:
    """One row (n_docs, avgdl); chunks without a token count as well."""
    split = bm25_tokens if tokenizer == "char-bigram" else space_tokens
    return chunks.select(F.size(split(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bags(chunks: DataFrame, key: str = "chunk_id", text: str = "content", tokenizer: str = "char-bigram") -> DataFrame:
    """(key, tokens, dl, and the other columns): what search reads. A narrow map; one row for each chunk, also one without a token."""
    split = bm25_tokens if tokenizer == "char-bigram" else space_tokens
    rest = [c for c in chunks.columns if c not in (key, text)]
    return chunks.select(F.col(key), split(F.coalesce(F.col(text), F.lit(""))).alias("tokens"), *rest).withColumn("dl", F.size("tokens").cast("bigint"))


def bag_postings(bagged: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The postings of bags."""
    return bagged.select(key, "dl", F.explode("tokens").alias("token")).groupBy(key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(posted: DataFrame, by: list[str] | None = None) -> DataFrame:
    return posted.where("token is not null").groupBy(*(by or []), "token").agg(F.count(F.lit(1)).alias("df"))


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def term_score(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weights(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf): negative idf becomes EPSILON of the mean of all tokens' raw idf."""
    raw = durable(frequencies.withColumn("raw", raw_idf(F.lit(float(n_docs)), F.col("df"))))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("token", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def statistics(posted: DataFrame, n_docs: int) -> DataFrame:
    return weights(document_frequencies(posted), n_docs)


def bag_statistics(bagged: DataFrame) -> tuple[DataFrame, float]:
    """((token, df, idf), mean length) of bags."""
    n, avgdl = bagged.agg(F.count(F.lit(1)), F.avg("dl")).first()
    frequencies = bagged.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return weights(frequencies, n), avgdl or 0.0


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "question", tokenizer: str = "char-bigram") -> DataFrame:
    """(key, token, qtf); a token said twice counts twice."""
    split = bm25_tokens if tokenizer == "char-bigram" else space_tokens
    return queries.select(key, F.explode(split(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("qtf"))


def search(queries: DataFrame, bagged: DataFrame, stats: DataFrame, avgdl: float, k: int = 20, query: str = "query_id", key: str = "chunk_id", scope: DataFrame | None = None, company: str = "company") -> DataFrame:
    """(query, key, score, rank) of the k best chunks with a positive score of each query.

    scope (query, company) limits a query to the chunks whose column `company` says so; a query without scope sees all chunks. Queries of the
    same words and scope are searched for once. They go to the chunks, at most SENT tokens at a time, and only every query's k best leave a
    task, however many blocks it reads; the more parts, the fewer tasks share one. If their distinct tokens are too many to be sent, which is counted, terms are joined by token.
    """
    posed = queries.groupBy(query).agg(F.sort_array(F.collect_list("question")).alias("_said"))
    alike = ["_said"]
    if scope is not None:
        posed = posed.join(scope.groupBy(query).agg(F.sort_array(F.collect_set("company")).alias("_companies")), query, "left")
        alike.append("_companies")
    # numbers of rows are only the same once they are stored
    stored = durable(posed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_id", F.min("_row").over(Window.partitionBy(*alike))))
    groups = stored.where("_row = _id").select("_id", bm25_tokens(F.array_join("_said", "\n")).alias("_tokens"), *alike[1:])
    known = stats.join(groups.select(F.explode("_tokens").alias("token")).distinct(), "token", "left_semi").select("token", "idf").limit(BROADCAST_TERMS + 1).collect()
    if len(known) <= BROADCAST_TERMS:
        total = groups.agg(F.sum(F.size("_tokens"))).first()[0] or 0
        parts = max(1, -(-total // SENT))
        tasks = -(-queries.sparkSession.sparkContext.defaultParallelism // parts)
        found = [_best_of_part(groups.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i) if parts > 1 else groups, known, bagged, avgdl, k, key, scope is not None, company, tasks) for i in range(parts)]
        scored = reduce(DataFrame.unionByName, found)
    else:
        terms = groups.select("_id", F.explode("_tokens").alias("token")).groupBy("_id", "token").agg(F.count(F.lit(1)).alias("qtf")).join(stats.select("token", "idf"), "token")
        share = term_score(F.lit(1.0), F.col("tf"), F.col("dl"), F.lit(float(avgdl)))
        scored = terms.join(bag_postings(bagged, key), "token").groupBy("_id", key).agg(F.sum(F.col("qtf") * F.col("idf") * share).alias("score"))
        if scope is not None:
            scored = scored.join(bagged.select(key, F.col(company).alias("_company")), key).join(groups.select("_id", "_companies"), "_id").where(F.col("_companies").isNull() | F.array_contains("_companies", F.col("_company")))
    rounded = scored.select("_id", key, F.round("score", 6).alias("score")).where(~F.isnan("score") & (F.col("score") > 0) & (F.col("score") < float("inf")))
    best = Window.partitionBy("_id").orderBy(F.desc("score"), F.asc_nulls_last(key))
    ranked = rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(stored.select("_id", query), "_id").select(query, key, "score", "rank")


def _best_of_part(groups: DataFrame, known: list, bagged: DataFrame, avgdl: float, k: int, key: str, scoped: bool, company: str, tasks: int) -> DataFrame:
    """(_id, key, score) of each task's k best for every query of a part, from at most so many tasks."""
    asked = groups.toArrow()
    tokens = [r["token"] for r in known]
    lists = asked.column("_tokens").combine_chunks()
    found = pc.index_in(lists.flatten(), value_set=pa.array(tokens, pa.string()))
    hit = found.is_valid().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[hit]
    # a token said twice counts twice
    pair, qtf = np.unique(of * max(1, len(tokens)) + found.drop_null().to_numpy(), return_counts=True)
    term = pair % max(1, len(tokens))
    ends = np.searchsorted(pair // max(1, len(tokens)), np.arange(len(lists) + 1))
    limits = asked.column("_companies").to_pylist() if scoped else [None] * len(lists)
    sent = bagged.sparkSession.sparkContext.broadcast((tokens, np.array([r["idf"] for r in known], float), asked.column("_id").to_numpy(), ends, term.astype(np.int32), qtf.astype(np.int32), limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, idf, ids, ends, term, qtf, limits = sent.value
        vocabulary, best, keys = pa.array(tokens, pa.string()), Best(ends, term, qtf * idf[term], len(tokens), k, limits), []
        step = min(2048, max(64, 8_000_000 // max(1, len(tokens))))
        for batch in batches if len(ids) else ():
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists, n = part.column(1), part.num_rows
                found = pc.index_in(lists.flatten(), value_set=vocabulary)
                chunk = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                # by term, then by chunk
                pair, tf = np.unique(found.drop_null().to_numpy().astype(np.int64) * n + chunk[hit], return_counts=True)
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column(2).to_numpy(zero_copy_only=False)[pair % n] / avgdl))
                best.add(pair // n, pair % n, share, _ordered(part.column(0)), part.column(3).to_pylist() if scoped else None)
                # a copy: a slice would hold its whole batch
                keys.append(part.column(0).take(pa.array(np.arange(n))))
        who, row, score = best.result()
        for at in range(0, len(who), 65_536):
            some = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[some]]), pa.chunked_array(keys).take(pa.array(row[some])).combine_chunks(), pa.array(score[some])], names=["_id", key, "score"])

    columns = [key, "tokens", "dl", *([company] if scoped else [])]
    return bagged.select(*columns).coalesce(tasks).mapInArrow(run, f"_id bigint, `{key}` {dict(bagged.dtypes)[key]}, score double")


def _ordered(keys: pa.Array) -> np.ndarray:
    """Keys as numpy orders them: integers, or texts by code point; null is last."""
    if pa.types.is_integer(keys.type):
        return pc.fill_null(keys.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return np.array(pc.fill_null(keys.cast(pa.string()), "\U0010ffff").to_pylist(), dtype=str)


class Best:
    """The k best chunks of each query over blocks of chunks, one block at a time; exact, ties by key.

    Queries are rows of (ends, term, weight). For a query without limits, the terms that many chunks of a block have are one product of
    matrices in single precision, the others are added posting by posting; whatever may reach the query's k-th best score, by a bound of the
    error of that, is scored in double precision. A query with limits is scored on the chunks of its companies only.
    """

    #: Part of a block's chunks from which a term is in the product; numbers of a product.
    COMMON, PRODUCT = 0.02, 1_000_000

    def __init__(self, ends: np.ndarray, term: np.ndarray, weight: np.ndarray, vocabulary: int, k: int, limits: list):
        self.ends, self.term, self.weight, self.vocabulary, self.k = ends, term, weight, vocabulary, k
        n = len(ends) - 1
        self.terms = np.diff(ends)
        self.row = np.repeat(np.arange(n), self.terms)
        self.free = np.flatnonzero(np.array([x is None for x in limits], bool) & (self.terms > 0))
        self.allowed: dict[str | None, list[int]] = {}
        for i, names in enumerate(limits):
            for name in names or ():
                self.allowed.setdefault(name, []).append(i)
        self.kept = np.zeros(n, np.int64)
        self.score = np.full((n, k), -np.inf)
        self.at = np.zeros((n, k), np.int64)
        self.key: np.ndarray | None = None
        self.seen = 0
        # single precision errs in proportion to a sum as long as no term is negative
        self.kind = np.float32 if (weight >= 0).all() else np.float64
        self.off = 2.4e-7 * (self.terms + 8) if self.kind is np.float32 else np.zeros(n)

    def add(self, term: np.ndarray, chunk: np.ndarray, share: np.ndarray, keys: np.ndarray, companies: list | None) -> None:
        """One block: postings by term and chunk, the keys of its chunks."""
        n = len(keys)
        if self.key is None:
            self.key = np.zeros(self.at.shape, keys.dtype)
        elif keys.dtype.itemsize > self.key.dtype.itemsize:
            self.key = self.key.astype(keys.dtype)
        table = np.zeros((self.vocabulary, n))
        table[term, chunk] = share
        if companies is not None and self.allowed:
            self._limited(table, keys, companies)
        if len(self.free):
            self._free(table, term, chunk, share, keys)
        self.seen += n

    def _limited(self, table: np.ndarray, keys: np.ndarray, companies: list) -> None:
        of: dict[str | None, list[int]] = {}
        for i, name in enumerate(companies):
            if name in self.allowed:
                of.setdefault(name, []).append(i)
        for name, chunks in of.items():
            who = np.array(self.allowed[name])
            for at in range(0, len(who), step := max(1, 100_000 // len(chunks))):
                some = who[at : at + step]
                self._settle(table, np.repeat(some, len(chunks)), np.tile(chunks, len(some)), keys)

    def _free(self, table: np.ndarray, term: np.ndarray, chunk: np.ndarray, share: np.ndarray, keys: np.ndarray) -> None:
        n = len(keys)
        first = np.searchsorted(term, np.arange(self.vocabulary + 1))
        times = np.diff(first)
        common = times > self.COMMON * n
        place = np.cumsum(common) - 1
        dense = table[common].astype(self.kind)
        share = share.astype(self.kind)
        for a in range(0, len(self.free), step := max(1, self.PRODUCT // n)):
            who = self.free[a : a + step]
            lengths = self.terms[who]
            entry = np.repeat(self.ends[who] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            line, t, w = np.repeat(np.arange(len(who)), lengths), self.term[entry], self.weight[entry].astype(self.kind)
            many = common[t]
            left = np.zeros((len(who), len(dense)), self.kind)
            left[line[many], place[t[many]]] = w[many]
            total = left @ dense
            few = ~many & (times[t] > 0)
            line, t, w = line[few], t[few], w[few]
            count = times[t]
            posting = np.repeat(first[t] - np.cumsum(count) + count, count) + np.arange(count.sum())
            np.add.at(total.reshape(-1), np.repeat(line * n, count) + chunk[posting], np.repeat(w, count) * share[posting])
            least = np.where(self.kept[who] >= self.k, self.score[who, -1], 0)
            lacking = np.flatnonzero(self.kept[who] < self.k)
            if len(lacking) and n > self.k:
                least[lacking] = np.partition(total[lacking], n - self.k, axis=1)[:, n - self.k]
            # a score that is rounded to nothing does not count
            least = np.maximum(least * (1 - self.off[who]) - 1e-6, 4e-7).astype(self.kind)
            flat = np.flatnonzero(total >= least[:, None])
            self._settle(table, who[flat // n], flat % n, keys)

    def _settle(self, table: np.ndarray, who: np.ndarray, chunk: np.ndarray, keys: np.ndarray) -> None:
        """Exact scores of pairs of a query and a chunk; those that are among a query's k best are kept."""
        score = np.zeros(len(who))
        bounds = np.searchsorted(np.cumsum(self.terms[who]), np.arange(1_000_000, self.terms[who].sum() + 1_000_000, 1_000_000), "right") + 1
        at = 0
        for to in bounds.tolist():
            lengths = self.terms[who[at:to]]
            entry = np.repeat(self.ends[who[at:to]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            each = self.weight[entry] * table[self.term[entry], np.repeat(chunk[at:to], lengths)]
            score[at:to] = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=each, minlength=len(lengths))
            at = to
        score = np.round(score, 6)
        last = self.score[who, -1]
        good = np.flatnonzero((score > 0) & (score < np.inf) & ((score > last) | ((score == last) & (keys[chunk] < self.key[who, -1]))))
        if not len(good):
            return
        who, chunk, score = who[good], chunk[good], score[good]
        some = np.unique(who)
        held = np.flatnonzero(np.arange(self.k) < self.kept[some][:, None])
        old = some[held // self.k]
        j = held % self.k
        every = np.concatenate([old, who])
        scores = np.concatenate([self.score[old, j], score])
        rows = np.concatenate([self.at[old, j], self.seen + chunk])
        names = np.concatenate([self.key[old, j], keys[chunk]])
        order = np.lexsort((names, -scores, every))
        every, scores, rows, names = every[order], scores[order], rows[order], names[order]
        start = np.searchsorted(every, some)
        place = np.arange(len(every)) - np.repeat(start, np.diff([*start, len(every)]))
        stay = place < self.k
        every, place = every[stay], place[stay]
        self.score[every, place], self.at[every, place], self.key[every, place] = scores[stay], rows[stay], names[stay]
        self.kept[some] = np.minimum(self.k, np.diff([*start, len(order)]))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number of the chunk, score)."""
        who, place = np.nonzero(np.arange(self.k) < self.kept[:, None])
        return who, self.at[who, place], self.score[who, place]


def _tokens(text: str) -> list[str]:
    """bm25_tokens of one text."""
    low = text.lower()
    out = re.findall(r"[a-z0-9]+(?:[._%-][a-z0-9]+)*", low)
    for run in re.findall("[\u4e00-\u9fff]+", low):
        out += run
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def _candidate_scores(asked: str, texts: list[str | None]) -> list[float]:
    """BM25 of the texts of one query, with the statistics of these texts only."""
    docs = [Counter(_tokens(t or "")) for t in texts]
    sizes = [sum(tf.values()) for tf in docs]
    df = Counter(chain.from_iterable(docs))
    if not df:
        return [0.0] * len(docs)
    n, avgdl = len(docs), sum(sizes) / len(docs)
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = EPSILON * math.fsum(raw.values()) / len(raw)
    terms = [(t, qtf * (floor if raw[t] < 0 else raw[t])) for t, qtf in Counter(_tokens(asked)).items() if t in df]
    return [math.fsum(w * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * dl / avgdl)) for t, w in terms if t in tf) for tf, dl in zip(docs, sizes, strict=True)]


def rerank(candidates: DataFrame, query: str = "query_id", key: str = "chunk_id", question: str = "question", text: str = "content") -> DataFrame:
    """candidates (query, key, question, text, ...) with score by BM25 whose statistics are those of the query's own candidates, all kept.

    A query's candidates, which are few, meet in one row and are scored there: their tokens, some hundred times as many, are never shuffled.
    """
    rest = [c for c in candidates.columns if c != query]
    together = candidates.groupBy(query).agg(F.array_join(F.sort_array(F.collect_set(question)), "\n").alias("_asked"), F.collect_list(F.struct(*rest)).alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            texts, at, out = rows.flatten().field(text).to_pylist(), 0, []
            for asked, n in zip(batch.column(1).to_pylist(), rows.value_lengths().to_pylist(), strict=True):
                out.append(_candidate_scores(asked or "", texts[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(out, pa.list_(pa.float64()))], names=[query, "_rows", "_scores"])

    schema = T.StructType([together.schema[query], together.schema["_rows"], T.StructField("_scores", T.ArrayType(T.DoubleType()))])
    flat = together.mapInArrow(run, schema).select(query, F.explode(F.arrays_zip("_rows", "_scores")).alias("_r"))
    return flat.select(query, *[F.col(f"_r._rows.`{c}`").alias(c) for c in rest], F.round("_r._scores", 6).alias("score"))
