"""Filling fixed-capacity containers with the texts of a corpus.

Method: Karmarkar-Karp multiway differencing. Every item starts as a partial partition with one used window; the
two partial partitions of the largest imbalance are merged, the fullest windows of one onto the emptiest of the
other, until one partition is left. Its windows are nearly equal, so ceil(total / capacity) windows mostly suffice.
Where windows are above the capacity, single items are exchanged between windows; while that does not bring all of
them down to it, the surplus items get windows of their own or the number of windows rises, whichever needs fewer.

The corpus is cut into blocks of about `windows` containers by a hash of the key, each packed on its own, so a task
never holds more than one block and no block grows with the corpus. A text is divided only if it alone exceeds the
capacity: into full containers and one rest, which is packed like any other item.

Defined cases: null and empty texts have size 0 and go, undivided, into a container of their block. Configs without a
positive capacity are skipped. Every row is an item of its own, repeated keys too. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import bounded_collect

#: Containers a block is planned to fill: more lessen the share of the last, part-filled one, and cost time.
WINDOWS = 512
#: Items of a block at most, on average, however small they are.
ITEMS = 20_000
#: Containers and items of one block have their numbers in these many bits of a container's id.
WINDOW_BITS = 24


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sum of each window) of the multiway differencing of sizes into k windows."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64), np.array([sizes.sum()] + [0] * (k - 1), np.int64)[:k]
    # partial partitions: sums of the used windows, rising, and the node that each window's items hang on (-1: none). Unused windows
    # are at 0; once all are used, sums count from the least one, which stays in the list so that adding an item touches one place.
    left, right = [-1] * n, [-1] * n
    heap: list[tuple[int, int, list[int], list[int]]] = [(-s, i, [s], [i]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tick = n

    def joined(x: int, y: int) -> int:
        if x < 0 or y < 0:
            return max(x, y)
        left.append(x)
        right.append(y)
        return len(left) - 1

    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, hang = heapq.heappop(heap)
        if len(more) > len(sums):
            sums, nodes, more, hang = more, hang, sums, nodes
        if len(more) == 1:
            # one window's items go into an unused window, or else into the emptiest one
            value, node = more[0], hang[0]
            if len(sums) == k:
                value, node = sums.pop(0) + value, joined(nodes.pop(0), node)
            i = bisect_left(sums, value)
            sums.insert(i, value)
            nodes.insert(i, node)
        else:
            both = max(0, len(sums) + len(more) - k)
            base, other = (x[0] if len(x) == k else 0 for x in (sums, more))
            # the emptiest of one take the emptiest of the other in reverse
            rows = [(x - base, c) for x, c in zip(sums[both:], nodes[both:], strict=True)] + [(y - other, c) for y, c in zip(more[both:], hang[both:], strict=True)]
            rows += [(x - base + y - other, joined(c, d)) for x, c, y, d in zip(sums[:both], nodes[:both], more[:both][::-1], hang[:both][::-1], strict=True)]
            rows.sort(key=itemgetter(0))
            sums, nodes = [x for x, _ in rows], [c for _, c in rows]
        heapq.heappush(heap, ((sums[0] if len(sums) == k else 0) - sums[-1], tick, sums, nodes))
        tick += 1
    window, total = np.zeros(n, np.int64), np.zeros(k, np.int64)
    for w, top in enumerate(heap[0][3]):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
                total[w] += sizes[x]
            else:
                stack += (left[x], right[x])
    return window, total


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows); every size is at most the capacity, and so is every window."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64), 0
    k = max(1, -(-int(sizes.sum()) // capacity))
    best: tuple[np.ndarray, int] | None = None
    while best is None or k < best[1]:
        window, total = difference(sizes, k)
        if total.max(initial=0) <= capacity or _level(sizes, window, total, capacity):
            return window, k
        # what is still too much goes to windows of its own, differenced in turn; a higher k may need fewer in all
        loose = _surplus(sizes, window, total, capacity)
        extra, more = pack(sizes[loose], capacity)
        if best is None or k + more < best[1]:
            window[loose] = k + extra
            best = window, k + more
        k += 1
    return best


def _surplus(sizes: np.ndarray, window: np.ndarray, total: np.ndarray, capacity: int) -> np.ndarray:
    """Items to take out of the windows above the capacity: of each the smallest that covers its excess, else its largest ones."""
    loose: list[int] = []
    for w in np.flatnonzero(total > capacity).tolist():
        own = sorted(np.flatnonzero(window == w).tolist(), key=lambda i: int(sizes[i]))
        over = int(total[w]) - capacity
        while over > 0:
            i = own.pop(next((j for j, i in enumerate(own) if sizes[i] >= over), len(own) - 1))
            over -= int(sizes[i])
            loose.append(i)
    return np.array(sorted(loose, key=lambda i: (-int(sizes[i]), i)), np.int64)


def _level(sizes: np.ndarray, window: np.ndarray, total: np.ndarray, capacity: int) -> bool:
    """Bring all windows to the capacity by exchanging single items; False if some stay above it.

    Each step takes the exchange of an item of an overfull window for a smaller item, or for nothing, of another
    window that lowers the sum of all excess most.
    """
    n, k = len(sizes), len(total)
    # a pretended item of size 0 in each window stands for giving nothing back
    size = np.concatenate([sizes, np.zeros(k, np.int64)])
    where = np.concatenate([window, np.arange(k)])
    todo = np.flatnonzero(total > capacity).tolist()
    while todo:
        w = todo.pop()
        over = int(total[w]) - capacity
        if over <= 0:
            continue
        space = (capacity - total)[where]
        best = (0, 0, 0, -1)
        own = np.flatnonzero(where[:n] == w)
        _, firsts = np.unique(size[own], return_index=True)
        for i in own[firsts].tolist():
            d = int(size[i]) - size
            gain = np.minimum(d, over) - np.maximum(d - np.maximum(space, 0), 0)
            gain[(d <= 0) | (where == w) | (space < 0)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0] or (gain[j] == best[0] > 0 and d[j] < best[1]):
                best = (int(gain[j]), int(d[j]), i, j)
        gain, d, i, j = best
        if gain <= 0:
            continue
        other = int(where[j])
        where[i] = other
        if j < n:
            where[j] = w
        total[w] -= d
        total[other] += d
        for x in (w, other):
            if total[x] > capacity:
                todo.append(x)
    window[:] = where[:n]
    return bool((total <= capacity).all())


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "key"], ascending=[False, True], ignore_index=True)
    capacity = int(pdf.capacity.iloc[0])
    n = pdf.n_tokens.to_numpy(np.int64)
    whole = np.where(n > capacity, n // capacity, 0)
    rest = n - whole * capacity
    item = np.flatnonzero((rest > 0) | (whole == 0))
    window, k = pack(rest[item], capacity)
    rows = np.repeat(np.arange(len(n)), whole)
    piece = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)
    base = int(pdf.block.iloc[0]) << WINDOW_BITS
    keys = pdf.key.to_numpy()
    full = pd.DataFrame({"key": keys[rows], "piece_no": piece, "first_token": piece * capacity, "n_tokens": capacity, "container_id": base + k + np.arange(len(rows))})
    part = pd.DataFrame({"key": keys[item], "piece_no": whole[item], "first_token": whole[item] * capacity, "n_tokens": rest[item], "container_id": base + window})
    out = pd.concat([part, full], ignore_index=True)
    return out.assign(config_id=int(pdf.config_id.iloc[0]))


def containers(sizes: DataFrame, configs: DataFrame, key: str = "doc_id", windows: int = WINDOWS) -> DataFrame:
    """(config_id, container_id, key, piece_no, first_token, n_tokens) of sizes (key, n_tokens) for each config (config_id, container_tokens).

    sizes is read twice (its total, its packing); pass a stored table.
    """
    known = bounded_collect(configs.where("container_tokens > 0").select("config_id", "container_tokens").distinct(), 1000, "configs")
    total, rows = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    spark, kind = sizes.sparkSession, sizes.schema[key].dataType.simpleString()
    plan = [(int(c), int(t), max(1, round(total / (t * windows)), -(-rows // ITEMS))) for c, t in known]
    out = f"`{key}` {kind}, config_id int, container_id bigint, piece_no int, first_token bigint, n_tokens bigint"
    if not plan:
        return spark.createDataFrame([], out).select("config_id", "container_id", key, "piece_no", "first_token", "n_tokens")
    # each size once for each config, by generation from a literal of the few configs: no join
    choices = F.array(*[F.struct(F.lit(c).alias("config_id"), F.lit(t).cast("bigint").alias("capacity"), F.lit(b).cast("bigint").alias("blocks")) for c, t, b in plan])
    # a block of empty texts alone could hold any number of items, so they are spread over all blocks like the rest
    spread = (
        sizes.select(F.col(key).alias("key"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.explode(choices).alias("c"))
        .select("key", "n_tokens", "c.*")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .drop("blocks")
    )
    packed = spread.groupBy("config_id", "block").applyInPandas(_pack_block, out.replace(f"`{key}`", "key", 1))
    return packed.select("config_id", "container_id", F.col("key").alias(key), "piece_no", "first_token", "n_tokens")
