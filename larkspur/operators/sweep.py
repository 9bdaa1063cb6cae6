"""Parameter sweeps: the declared grids, chunk statistics of each point, and selection by a key of measures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.chunking import ChunkConfig, chunk_sizes


@dataclass(frozen=True)
class SweepPoint:
    label: str
    strategy: str
    max_size: int
    overlap: int


def grid() -> list[SweepPoint]:
    """One fixed baseline of characters and 30 token-bounded points."""
    sizes, overlaps = (256, 320, 384, 448, 480, 510), (0, 32, 64, 96, 128)
    return [SweepPoint("fixed_chars_500_80", "fixed_chars", 500, 80), *[SweepPoint(f"adaptive_tokens_{m}_{o}", "adaptive_tokens", m, o) for m in sizes for o in overlaps if o < m]]


def chunk_statistics(pages: DataFrame, points: list[SweepPoint], text: str = "text") -> DataFrame:
    """(label, n_chunks, mean, p95, most, without_overlap) of each point: tokens of a chunk, or characters for the baseline.

    One map over the pages: each is parsed once for all points, and of its chunks only counts by point and size leave the task.
    """
    labels = [p.label for p in points]
    adaptive = [(i, ChunkConfig(p.max_size, p.overlap)) for i, p in enumerate(points) if p.strategy != "fixed_chars"]
    fixed = [(i, p.max_size, p.max_size - p.overlap) for i, p in enumerate(points) if p.strategy == "fixed_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                for i, size, step in fixed:
                    # the windows of fixed_windows: all are full but the last one, and the first one is bare
                    n = max(0, -(-(len(t) - (size - step)) // step) - 1)
                    if n:
                        counted[i, size, True] += 1
                        counted[i, size, False] += n - 1
                    counted[i, len(t) - n * step, not n] += 1
                for n, size, bare in chunk_sizes(t, [c for _, c in adaptive]):
                    counted[adaptive[n][0], size, bare] += 1
        rows = [(labels[i], size, bare, n) for (i, size, bare), n in counted.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["label", "size", "bare", "n"])

    sizes = pages.select(text).mapInArrow(run, "label string, size bigint, bare boolean, n bigint").groupBy("label", "size").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bare"), F.col("n")).otherwise(0)).alias("bare"))
    total = F.sum("n")
    return sizes.groupBy("label").agg(total.alias("n_chunks"), (F.sum(F.col("size") * F.col("n")) / total).alias("mean"), F.percentile("size", F.lit(0.95), F.col("n")).alias("p95"), F.max("size").alias("most"), (F.sum("bare") / total).alias("without_overlap"))


def select(results: DataFrame, keys: tuple[str, ...] = ("ndcg", "recall", "slot_complete", "slot_coverage", "mrr"), fewer: str = "n_chunks", name: str = "label") -> DataFrame:
    """The best row by the keys in turn, then by fewer chunks, then by name."""
    return results.orderBy(*[F.desc(k) for k in keys], F.asc(fewer), F.asc(name)).limit(1)
