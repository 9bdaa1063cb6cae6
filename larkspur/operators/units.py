"""Quantities recorded in different units, brought to one unit for each kind.

Method: the values of a source in the order of its records are its history, one for amounts and one for ratios. What is
looked at is the logarithm of a value against what is stated beside it (a fact's printed form, an answer's own quantities);
it is 0 as long as the unit is the agreed one. An exact penalised changepoint search cuts the history into segments of one
level. A segment off level 0 is where the unit changes; a level that is the logarithm of a known factor is reversed by that
factor, any other is reported. An exact comparison confirms each member. Units stated in text are read exactly first.

A history is cut into blocks of bounded length by its place in the order, so a source that holds a third of all rows
lies in many tasks. Levels are measured from 0, so a cut between blocks changes none of them. Only the filling of gaps
sees a cut: neighbours are those in the block, so a value without a form at the edge of a block stays as recorded.

Defined cases: null, empty or unreadable values and forms give no level and are no case; a value without a form beside
it takes the factor of its segment if both its neighbours in the history lie in that segment (a record whose other values
are off by one factor, say), else stays as recorded. Zero and a change of sign have no logarithm: there the exact
comparison alone decides. An amount without currency takes the row's, or that of the answer; an unknown or null
currency contradicts none. Repeated deliveries count once, by the last. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.quantities import Quantity, bare_number, currency_code, quantities
from larkspur.operators.ranking import rank_within
from larkspur.session import durable, latest, workers

#: Levels of unit changes: powers of ten between units in use, of money, ratios and measures.
KNOWN_LEVELS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
#: Values and forms are exact, so the noise around a level is that of the logarithm.
NOISE = 1e-6
BLOCK = 4096
RATIOS = ("debt_ratio", "asset_liability_ratio", "roe")


def segments(y: np.ndarray | list[float], noise: float = NOISE, penalty: float | None = None) -> list[tuple[int, int, float]]:
    """(from, to, level) of the segmentation of y that minimises squared error / noise² + penalty for each segment, exactly.

    Pruned dynamic programming over runs of equal values; no best segmentation needs a cut within such a run. Neighbouring runs
    that lie g apart are best kept apart where g² > 4 noise² penalty: r runs in one segment leave an error of at least (r - 1) g² / 4.
    """
    n = len(y)
    if n == 0:
        return []
    penalty = 3 * math.log(n + 1) if penalty is None else penalty
    if n <= 64:
        runs: list[list] = []
        for i, v in enumerate(y.tolist() if isinstance(y, np.ndarray) else y):
            if runs and abs(v - last) <= noise / 100:
                runs[-1][1], runs[-1][2] = i + 1, runs[-1][2] + v
            else:
                runs.append([i, i + 1, v])
            last = v
        levels = [(a, b, t / (b - a)) for a, b, t in runs]
        if all((p[2] - q[2]) ** 2 > 4 * noise**2 * penalty for p, q in zip(levels, levels[1:], strict=False)):
            return levels
        y = np.asarray(y, float)
    first = np.concatenate([[0], np.flatnonzero(np.abs(np.diff(y)) > noise / 100) + 1])
    weight = np.diff(np.concatenate([first, [n]])).astype(float)
    value = np.add.reduceat(y, first) / weight
    m = len(first)
    if m == 1 or (np.diff(value) ** 2).min() > 4 * noise**2 * penalty:
        return [(int(a), int(b), float(v)) for a, b, v in zip(first, [*first[1:], n], value, strict=True)]
    w = np.concatenate([[0], np.cumsum(weight)])
    s1 = np.concatenate([[0], np.cumsum(weight * value)])
    s2 = np.concatenate([[0], np.cumsum(weight * value**2)])
    best = np.empty(m + 1)
    best[0] = -penalty
    back = np.zeros(m + 1, np.int64)
    open_ = np.array([0])
    for j in range(1, m + 1):
        k = w[j] - w[open_]
        cost = np.maximum(s2[j] - s2[open_] - (s1[j] - s1[open_]) ** 2 / k, 0) / noise**2
        total = best[open_] + cost + penalty
        i = int(total.argmin())
        best[j], back[j] = total[i], open_[i]
        open_ = np.append(open_[best[open_] + cost <= best[j]], j)
    out, j = [], m
    while j > 0:
        i = int(back[j])
        out.append((int(first[i]), int(first[j]) if j < m else n, float((s1[j] - s1[i]) / (w[j] - w[i]))))
        j = i
    return out[::-1]


def known_level(level: float) -> int:
    """The power of ten of a known change of unit, or 0."""
    near = round(level)
    return near if abs(level - near) < 100 * NOISE and abs(near) in KNOWN_LEVELS else 0


def _log(a: Decimal, b: Decimal) -> float:
    """log10(a / b), exactly 0 for equals, NaN where signs or zeros leave none."""
    if a == b:
        return 0.0
    if a == 0 or b == 0 or (a < 0) != (b < 0):
        return math.nan
    return float((abs(a) / abs(b)).log10())


def _read_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for fact, currency, item, value, display in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
            ratio = item in RATIOS
            with localcontext() as exact:
                exact.prec = 60
                recorded = bare_number(value)
                if recorded is not None and ratio:
                    recorded = recorded / 100
                stated = next(iter(quantities(display)), None)
                if stated is None and (bare := bare_number(display)) is not None:
                    stated = Quantity("ratio" if ratio else "amount", None, bare, Decimal(1), 0, 0)
                if stated is not None and (stated.kind == "ratio") != ratio:
                    stated = None
                row, shown = currency_code(currency), stated.currency if stated else None
                level = _log(recorded, stated.value) if recorded is not None and stated is not None else None
            rows.append(
                (
                    "ratio" if ratio else "amount",
                    None if ratio else shown or row,
                    None if recorded is None else float(recorded),
                    None if stated is None else float(stated.value),
                    None if stated is None else float(stated.size),
                    level,
                    recorded is not None and stated is not None and recorded != stated.value,
                    bool(display) and shown is not None and row is not None and shown != row,
                )
            )
        new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), *new], names=["fact_id", "source", "year", "item", "kind", "currency", "recorded", "stated", "unit_size", "level", "differs", "other_currency"])


def _levels(y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The level of each point's segment; histories begin at starts. A point without a level takes that of both its neighbours, if they share one."""
    out = np.full(len(y), np.nan)
    for a, b in zip(starts, [*starts[1:], len(y)], strict=True):
        seen = a + np.flatnonzero(np.isfinite(y[a:b]))
        if not y[seen].any():
            out[seen] = 0.0
        else:
            for i, j, v in segments(y[seen]):
                out[seen[i:j]] = v
    history = np.zeros(len(y), np.int64)
    history[starts] = 1
    both = pd.Series(out).groupby(history.cumsum())
    before, after = both.ffill().to_numpy(), both.bfill().to_numpy()
    return np.where(np.isnan(out) & (before == after), before, out)


def _segment_histories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments the histories of a partition sorted by them; what is held is a batch and the history that its end cuts."""

    def done(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        y = pdf.level.to_numpy(float)
        level = _levels(y, starts)
        power = np.array([known_level(v) if math.isfinite(v) and v else 0 for v in level], np.int64)
        recorded, stated = pdf.recorded.to_numpy(float), pdf.stated.to_numpy(float)
        value = np.where(np.isfinite(stated), stated, recorded / 10.0**power)
        # the search decides where there is a logarithm, the exact comparison confirms
        off = np.where(np.isfinite(y), level != 0, True) & pdf.differs.to_numpy(bool)
        status = np.select([pdf.other_currency.to_numpy(bool), off & (power != 0), off, np.isfinite(value)], ["other currency", "unit change", "differs", "as agreed"], "unknown")
        return pd.DataFrame({"fact_id": pdf.fact_id, "item": pdf["item"], "kind": pdf.kind, "currency": pdf.currency, "value": value, "power": power, "status": status, "unit_size": pdf.unit_size})

    held: pd.DataFrame | None = None
    for batch in batches:
        pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if pdf.empty:
            continue
        key = pdf[["source", "kind", "block"]]
        starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        last = int(starts[-1])
        if last:
            yield done(pdf.iloc[:last].reset_index(drop=True), starts[:-1])
        held = pdf.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield done(held, np.array([0]))


def fact_quantities(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fact_id, item, kind, currency, value DOUBLE, power INT, status, unit_size) for each metric of facts.

    value is in yuan or dollars, or a plain ratio; power is that of ten by which the record was off and is reversed.
    """
    once = latest(df.select("fact_id", "company", "report_year", "currency", "metrics", "received_at"), ["fact_id"], "received_at", wide=True)
    flat = once.select("fact_id", F.col("company").alias("source"), F.col("report_year").alias("year"), "currency", F.explode("metrics").alias("item", "m"))
    read = flat.select("fact_id", "source", "year", "currency", "item", "m.value", "m.display").mapInArrow(
        _read_facts, "fact_id string, source string, year int, item string, kind string, currency string, recorded double, stated double, unit_size double, level double, differs boolean, other_currency boolean"
    )
    # ranked after it is counted; stored, so that no text is read twice
    keyed = durable(read.withColumn("source", F.coalesce("source", F.lit(""))))
    placed = rank_within(keyed, ["source", "kind"], [("year", True), ("fact_id", True), ("item", True)], "place").withColumn("block", F.floor((F.col("place") - 1) / block))
    history = ["source", "kind", "block"]
    apart = placed.repartition(workers(df), *history).sortWithinPartitions(*history, "place")
    return apart.mapInPandas(_segment_histories, "fact_id string, item string, kind string, currency string, value double, power int, status string, unit_size double")


def _same_kind(a: Quantity, g: Quantity) -> bool:
    return a.kind == g.kind and (a.currency is None or g.currency is None or a.currency == g.currency)


def answer_rows(gold: str | None, checks: list[list[str | None] | None] | None) -> list[tuple]:
    """(place, item, kind, currency, value, unit size, power) of the quantities of an answer and of the alternatives of its checks.

    The answer's quantities open the history at level 0; an alternative that states one of them exactly follows at the
    logarithm of its unit's size against that of the answer's unit. power is null where an alternative equals none.
    """
    with localcontext() as exact:
        exact.prec = 60
        stated = quantities(gold)
        out: list[list] = [["gold", str(i), q.kind, q.currency, float(q.value), float(q.size), 0] for i, q in enumerate(stated)]
        history: list[tuple[int, float]] = []
        for g, group in enumerate(checks or []):
            for j, text in enumerate(group or []):
                found = quantities(text)
                if not found and (bare := bare_number(text)) is not None:
                    found = [Quantity("ratio", None, bare, Decimal(1), 0, 0)]
                if len(found) != 1:
                    continue
                q = found[0]
                equal = [s for s in stated if _same_kind(q, s) and s.value == q.value]
                if not equal and not text.strip("0123456789.,-+ "):
                    continue  # a bare number that is no ratio of the answer says nothing
                currency = q.currency or next((s.currency for s in equal or stated if s.kind == q.kind), None)
                out.append(["check", f"{g}-{j}", q.kind, currency, float(q.value), float(q.size), None])
                if equal:
                    nearest = min(equal, key=lambda s: abs(_log(q.size, s.size)))
                    history.append((len(out) - 1, _log(q.size, nearest.size)))
    if history:
        y = [0.0, *[h for _, h in history]]
        for a, b, level in segments(y):
            for i in range(max(a, 1), b):
                out[history[i - 1][0]][6] = known_level(level)
    return [tuple(r) for r in out]


def answer_quantities(df: DataFrame, key: str = "query_id") -> DataFrame:
    """(place, ref_id, item, kind, currency, value DOUBLE, unit_size DOUBLE, power INT) for answers and their checks. A narrow map over distinct rows."""
    names = ["place", "item", "kind", "currency", "value", "unit_size", "power"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[str] = []
            rows: list[tuple] = []
            for k, gold, checks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                new = answer_rows(gold, checks)
                keys += [k] * len(new)
                rows += new
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["ref_id", *names])

    rows = df.select(F.col(key).cast("string"), "gold_answer", "answer_checks").distinct()
    return rows.mapInArrow(run, "ref_id string, place string, item string, kind string, currency string, value double, unit_size double, power int").select("place", "ref_id", *names[1:])
