"""Exact vector search: squared Euclidean distance and cosine, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the corpus: with 256 queries, one small matrix product.
BLOCK = 2048
#: Numbers of the queries' vectors that go to all executors at once, 64 MB.
SENT = 8_000_000


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance, summed in double; in generated code, for few pairs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _nearest(qi: np.ndarray, qv: np.ndarray, ci: np.ndarray, cv: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[list, list, list]:
    """(query, row, distance) of the k rows nearest to each query, ties by id; seen says which rows a query may see."""
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(ci, kind="stable")
    ci, cv = ci[order], cv[order]
    norms = (cv**2).sum(1)
    for at in range(0, len(qi), 256):
        part = qv[at : at + 256]
        own = (part**2).sum(1)
        # the product may be off in the last places, the more the longer the vectors, so near ties are settled by exact differences
        d = np.maximum(own[:, None] + norms[None, :] - 2 * part @ cv.T, 0)
        if seen is not None:
            d[~seen[at : at + 256][:, order]] = np.inf
        kk = min(k, len(ci))
        cut = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        margin = 1e-5 + 1e-9 * (own + norms.max(initial=0))
        for r in range(len(part)):
            near = np.flatnonzero((d[r] <= cut[r] + margin[r]) & (d[r] < np.inf))
            exact = np.round(((cv[near] - part[r]) ** 2).sum(1), 6)
            best = np.argsort(exact, kind="stable")[:kk]
            out[0].extend([qi[at + r]] * len(best))
            out[1].extend(ci[near[best]].tolist())
            out[2].extend(exact[best].tolist())
    return out


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _visible(companies: list, allowed: dict[str, set[int]], free: np.ndarray) -> np.ndarray:
    """Which rows each query may see: those without scope all, others those of their companies."""
    seen = np.repeat(free[:, None], len(companies), axis=1)
    of: dict[str | None, list[int]] = {}
    for i, c in enumerate(companies):
        of.setdefault(c, []).append(i)
    for c, at in of.items():
        if c in allowed:
            seen[np.ix_(sorted(allowed[c]), at)] = True
    return seen


def l2_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scope: DataFrame | None = None, company: str = "company") -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of the corpus for each query, ties by key; exact.

    A stated query set against all rows. scope (query_id, company) limits a query, below the cut, to the rows whose column `company`
    says so; one without scope sees all. Queries whose numbers stay within SENT go to the corpus, which is then neither grouped nor
    shuffled; a larger set goes there a part at a time. Only every query's best leave a task.
    """
    queries = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    corpus = corpus.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key), F.col(vector).alias("v"), (F.col(company) if scope is not None else F.lit(None).cast("string")).alias("company"))
    n, wide = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    parts = max(1, -(-n * wide // SENT))
    found = [_near_part(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries, corpus, k, key, scope) for i in range(parts)]
    near = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("query_id").orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _near_part(queries: DataFrame, corpus: DataFrame, k: int, key: str, scope: DataFrame | None) -> DataFrame:
    rows = queries.orderBy("query_id").collect()
    ids, vectors = [r["query_id"] for r in rows], np.array([r["q"] for r in rows], float)
    allowed: dict[str, set[int]] = {}
    free = np.ones(len(ids), bool)
    if scope is not None:
        at: dict = {}
        for i, q in enumerate(ids):
            at.setdefault(q, []).append(i)
        # a query names few companies
        for r in scope.join(queries.select("query_id").distinct(), "query_id", "left_semi").distinct().collect():
            allowed.setdefault(r["company"], set()).update(at[r["query_id"]])
            free[at[r["query_id"]]] = False
    known = queries.sparkSession.sparkContext.broadcast((np.array(ids), vectors, allowed, free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, allowed, free = known.value
        for batch in batches:
            for start in range(0, batch.num_rows if len(ids) else 0, BLOCK):
                part = batch.slice(start, BLOCK)
                seen = None if free.all() else _visible(part.column(2).to_pylist(), allowed, free)
                out = _nearest(ids, vectors, part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), part.num_rows), k, seen)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], names=["query_id", key, "distance"])

    kind = dict(corpus.dtypes)[key]
    return corpus.mapInArrow(run, f"query_id {kind}, `{key}` {kind}, distance double")
