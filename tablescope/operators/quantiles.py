"""Exact order statistics without sorting the table or gathering a column.

A sorted array of a column is the fastest way for a bounded number of rows, and
only there: it sits in one task. Beyond that bound the values around each wanted
rank are bracketed by a quantile sketch, and counted histograms of the bracket
close in on the exact value: each pass is one scan of the needed columns and
shuffles a bounded number of bucket counts.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num
from tablescope.functions.workers import ship

SMALL_ROWS = 1_000_000      # up to here one aggregation may hold the values
_BUCKETS = 1024
_WIDTH = _BUCKETS + 3       # with both ends of a run, and what lies before it
_SKETCH_ERROR = 1e-4


def quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float],
              columns: dict[str, Column] | None = None,
              small_rows: int = SMALL_ROWS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, exact, NULL and NaN left out.

    Runs Spark jobs and brings back `len(names) * len(probs)` numbers.
    """
    columns = columns or {}
    if not names:
        return {}
    wide = df.select(*[columns.get(n, num(n)).alias(f"q{i}") for i, n in enumerate(names)])
    if df.select(F.lit(1)).limit(small_rows + 1).count() <= small_rows:
        return _by_sorting(wide, names, probs)
    return _by_refinement(wide, names, probs)


def _by_sorting(wide: DataFrame, names, probs, columns_at_once: int = 8) -> dict[str, list[float | None]]:
    """For a checked number of rows: one sorted array per column, read at the wanted places."""
    found = {}
    wanted = F.array(*map(F.lit, map(float, probs)))
    for lo in range(0, len(names), columns_at_once):
        idx = range(lo, min(lo + columns_at_once, len(names)))
        arrays = wide.agg(*[F.sort_array(F.collect_list(f"q{i}")).alias(f"q{i}") for i in idx])
        row = arrays.select(*[F.transform(wanted, _reader(F.col(f"q{i}"))).alias(f"q{i}")
                              for i in idx]).first()
        found.update({names[i]: list(row[f"q{i}"]) for i in idx})
    return found


def _reader(values: Column):
    """Function from a probability to the interpolated element of a sorted array."""
    last = F.size(values) - 1

    def at(p: Column) -> Column:
        place = p * last
        low = F.floor(place).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, last))
        return a + (b - a) * (place - low)
    return at


def _by_refinement(wide: DataFrame, names, probs) -> dict[str, list[float | None]]:
    edges = sorted({min(1.0, max(0.0, p + s * 2 * _SKETCH_ERROR)) for p in probs for s in (-1, 1)})
    at = {e: k for k, e in enumerate(edges)}
    sketch = {}
    for lo in range(0, len(names), 25):
        aggs = []
        for i in range(lo, min(lo + 25, len(names))):
            aggs += [F.count(f"q{i}").alias(f"n{i}"), F.min(f"q{i}").alias(f"a{i}"),
                     F.max(f"q{i}").alias(f"z{i}"),
                     F.percentile_approx(f"q{i}", edges, int(1 / _SKETCH_ERROR)).alias(f"e{i}")]
        sketch.update(wide.agg(*aggs).first().asDict())

    wanted, open_targets, known = {}, {}, {}
    for i, name in enumerate(names):
        n = sketch[f"n{i}"]
        for p in probs:
            if not n:
                wanted[name, p] = None
                continue
            low = int(p * (n - 1))
            frac = p * (n - 1) - low
            ranks = (low, min(low + 1, n - 1))
            wanted[name, p] = (i, ranks, frac)
            e = sketch[f"e{i}"]
            bracket = (e[at[max(0.0, p - 2 * _SKETCH_ERROR)]], e[at[min(1.0, p + 2 * _SKETCH_ERROR)]])
            for r in ranks:
                open_targets.setdefault((i, r), bracket)
    while open_targets:
        counts = _bracket_counts(wide, sorted({(i, b) for (i, _), b in open_targets.items()}))
        still = {}
        for (i, r), bracket in open_targets.items():
            below, buckets = counts[i, bracket]
            inside = sum(c for c, _, _ in buckets)
            if not below <= r < below + inside:             # the sketch missed: use the full range
                still[i, r] = (sketch[f"a{i}"], sketch[f"z{i}"])
                continue
            for c, lowest, highest in buckets:
                if r < below + c:
                    break
                below += c
            if r == below or lowest == highest:
                known[i, r] = lowest
            elif r == below + c - 1:
                known[i, r] = highest
            else:
                still[i, r] = (lowest, highest)
        open_targets = still

    out = {}
    for name in names:
        out[name] = []
        for p in probs:
            if wanted[name, p] is None:
                out[name].append(None)
                continue
            i, (r0, r1), frac = wanted[name, p]
            a, b = known[i, r0], known[i, r1]
            out[name].append(a if frac == 0 or a == b else a + (b - a) * frac)
    return out


def _bracket_counts(wide: DataFrame, brackets) -> dict:
    """Per bracket: the number of values below it, and (count, min, max) per bucket inside.

    Overlapping brackets of a column are counted as one, so a row gives one count
    per column however many ranks are wanted. Tasks count whole batches and pass on their buckets.
    """
    runs: dict[int, list[list[float]]] = {}
    for i, (lo, hi) in sorted(brackets):
        mine = runs.setdefault(i, [])
        if mine and lo <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], hi)
        else:
            mine.append([lo, hi])
    ship(wide.sparkSession)
    edges = {i: np.array(mine, np.float64).T for i, mine in runs.items()}
    weighted = "w" in wide.columns

    def count(parts):
        held = {i: _Buckets(*e) for i, e in edges.items()}
        for batch in parts:
            w = batch.column(len(held)).to_numpy(zero_copy_only=False) if weighted else None
            for k, found in enumerate(held.values()):
                found.add(batch.column(k).to_numpy(zero_copy_only=False), w)
        for i, found in held.items():
            some = np.flatnonzero(found.c)
            yield pa.record_batch([pa.array(np.full(len(some), i, np.int32)), pa.array((some // _WIDTH).astype(np.int32)),
                                   pa.array((some % _WIDTH - 1).astype(np.int32)), *(pa.array(x[some]) for x in (found.c, found.low, found.high))],
                                  names=["i", "run", "bucket", "c", "a", "z"])

    rows = wide.select(*[F.col(f"q{i}").cast("double") for i in edges], *(["w"] if weighted else []))
    counted: dict[int, list] = {}
    for r in (rows.mapInArrow(count, "i int, run int, bucket int, c bigint, a double, z double").groupBy("i", "run", "bucket")
              .agg(F.sum("c").alias("c"), F.min("a").alias("a"), F.max("z").alias("z")).collect()):     # at most _WIDTH rows per run
        counted.setdefault(r.i, []).append(r)
    out = {}
    for i, (lo, hi) in brackets:
        j = next(j for j, run in enumerate(runs[i]) if run[0] <= lo and hi <= run[1])
        rows = sorted(counted.get(i, []), key=lambda r: (r.run, r.bucket))
        out[i, (lo, hi)] = (sum(r.c for r in rows if r.run < j or (r.run == j and r.bucket == -1)),
                            [(r.c, r.a, r.z) for r in rows if r.run == j and r.bucket >= 0])
    return out


class _Buckets:
    """Count and extremes of each bucket of a column's runs: what lies between the run before and a run is its bucket -1."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi
        size = len(lo) * _WIDTH
        self.c, self.low, self.high = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, v: np.ndarray, w: np.ndarray | None) -> None:
        there = ~np.isnan(v)
        v, w = v[there], None if w is None else w[there]
        run = np.searchsorted(self.lo, v, side="right") - 1
        inside = (run >= 0) & (v <= self.hi[run])
        at = (run + 1) * _WIDTH                             # before the next run, which the last one does not have
        x, of = v[inside], run[inside]
        lo, hi = self.lo[of], self.hi[of]
        with np.errstate(all="ignore"):
            position = np.nan_to_num((x / 2 - lo / 2) / (hi / 2 - lo / 2), nan=0.0)
        bucket = 1 + np.minimum(np.floor(position * _BUCKETS), _BUCKETS - 1).astype(np.int64)
        bucket[x == hi] = _BUCKETS + 1
        bucket[x == lo] = 0
        at[inside] = mine = of * _WIDTH + 1 + bucket
        counts = at < len(self.c)
        if w is None:
            self.c += np.bincount(at[counts], minlength=len(self.c))
        else:
            np.add.at(self.c, at[counts], w[counts])
        np.minimum.at(self.low, mine, x)
        np.maximum.at(self.high, mine, x)


def value_at_rank(df: DataFrame, c: Column, rank: int, weight: Column | None = None) -> float:
    """The value at 0-based `rank` of a numeric expression without nulls.

    With `weight` a row stands for that many equal values.
    """
    weights = [] if weight is None else [weight.cast("bigint").alias("w")]
    wide = df.select(c.cast("double").alias("q0"), *weights)
    bounds = wide.agg(F.min("q0"), F.max("q0")).first()
    bracket = (bounds[0], bounds[1])
    if bounds[0] == bounds[1]:
        return bounds[0]
    while True:
        below, buckets = _bracket_counts(wide, [(0, bracket)])[0, bracket]
        for n, lowest, highest in buckets:
            if rank < below + n:
                break
            below += n
        if rank == below or lowest == highest:
            return lowest
        if rank == below + n - 1:
            return highest
        bracket = (lowest, highest)
