"""The Kolmogorov-Smirnov statistic by branch and bound: exact, and no value reaches the driver.

The largest gap of two cumulative distributions is searched in cells of the value range. A pass over the
table counts both sides in every open cell. The gap at the end of a cell is then exact, and inside it the gap cannot
leave [gap before - share of the second side, gap before + share of the first]. Only cells whose bound beats the best
gap so far, and that hold more than one value, are cut further and counted again, those of the largest bound
first. Cells in which both sides hold the same values in the same proportion are closed as well: their gap does not move.
That is told from sums of 64-bit hashes, which agree by chance with odds of 2**-64.

Cells are cut evenly in the order of the bits of a double, so that a few passes reach small cells in any range. What
reaches the driver are counts of at most LIVE cells of each feature and pass, in at most PASSES passes. Cells still open then
(of nearly equal samples most are) are settled by Spark: their distinct values are grouped, and running sums inside each
cell give the gap at every value. Only the largest gap of each feature comes back.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.schema import num
from tablescope.functions.workers import ship

FIRST_CELLS = 256
LIVE = 1 << 13
PASSES, MAX_PASSES = 2, 12
HELD = 1 << 18
_CELLS = "i int, cell int, n1 bigint, n2 bigint, h1 bigint, h2 bigint, low bigint, high bigint"
_VALUES = "i int, cell int, k bigint, n1 bigint, n2 bigint"


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = np.ascontiguousarray(v, np.float64).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _mixed(k: np.ndarray) -> np.ndarray:
    h = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Counts:
    """Both sides' counts and hash sums, and the extremes, of the cells of one feature."""

    def __init__(self, edges: np.ndarray, live: np.ndarray):
        self.edges, self.live = edges, live
        n = len(edges)
        self.n = np.zeros((2, n), np.int64)
        self.h = np.zeros((2, n), np.uint64)
        self.low, self.high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)

    def add(self, keys: np.ndarray, later: np.ndarray) -> None:
        cell = np.searchsorted(self.edges, keys, side="left")
        inside = cell < len(self.edges)
        inside[inside] = self.live[cell[inside]]
        cell, keys, later = cell[inside], keys[inside], later[inside]
        for side in (0, 1):
            mine = later == side
            self.n[side] += np.bincount(cell[mine], minlength=len(self.edges))
            np.add.at(self.h[side], cell[mine], _mixed(keys[mine]))
        np.minimum.at(self.low, cell, keys)
        np.maximum.at(self.high, cell, keys)


def _count(wide: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, dict]:
    """One pass: arrays cell, n1, n2, h1, h2, low, high of each feature, in order of cells; empty cells are left out."""
    features = sorted(cells)
    known = wide.sparkSession.sparkContext.broadcast(cells)

    def count(parts):
        found = {i: _Counts(*known.value[i]) for i in features}
        for batch in parts:
            later = batch.column(0).to_numpy(zero_copy_only=False)
            for k, i in enumerate(features):
                v = batch.column(k + 1).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                found[i].add(ordered_bits(v[there]), later[there])
        for i, c in found.items():
            some = np.flatnonzero(c.n.sum(axis=0))
            yield pa.record_batch([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(c.n[0, some]), pa.array(c.n[1, some]),
                                   pa.array(c.h[0, some].view(np.int64)), pa.array(c.h[1, some].view(np.int64)), pa.array(c.low[some]), pa.array(c.high[some])],
                                  names=["i", "cell", "n1", "n2", "h1", "h2", "low", "high"])

    rows = wide.select("later", *[f"v{i}" for i in features]).mapInArrow(count, _CELLS)
    # sums of hashes wrap around: they are added in halves of 32 bits
    half = [F.sum(F.col(h).bitwiseAND(0xFFFFFFFF)).alias(f"{h}_low") for h in ("h1", "h2")] \
        + [F.sum(F.shiftrightunsigned(h, 32)).alias(f"{h}_high") for h in ("h1", "h2")]
    counts = rows.groupBy("i", "cell").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), *half,
                                           F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pandas().sort_values(["i", "cell"])
    known.destroy()
    for h in ("h1", "h2"):
        counts[h] = counts[f"{h}_low"].to_numpy(np.int64).view(np.uint64) + (counts[f"{h}_high"].to_numpy(np.int64).view(np.uint64) << np.uint64(32))
    return {i: {c: part[c].to_numpy() for c in ("cell", "n1", "n2", "h1", "h2", "low", "high")} for i, part in counts.groupby("i")}


def _settle(wide: DataFrame, searches: dict[int, "_Search"]) -> None:
    """The best gap of each search over all values of its open cells, whose running sums start at the counts before them."""
    features = sorted(searches)
    cells, before = {}, []
    for i in features:
        order = np.argsort(searches[i].open[1])
        low, high, c1, c2 = (c[order] for c in searches[i].open[1:5])
        cells[i] = low, high
        before += [(i, c, *x) for c, x in enumerate(zip(c1.tolist(), c2.tolist()))]
    known = wide.sparkSession.sparkContext.broadcast(cells)

    def values(parts):
        held, size = {i: [] for i in features}, 0
        for batch in parts:
            later = batch.column(0).to_numpy(zero_copy_only=False)
            for at, i in enumerate(features):
                v = batch.column(at + 1).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                keys, (low, high) = ordered_bits(v[there]), known.value[i]
                cell = np.searchsorted(low, keys, side="right") - 1
                inside = (cell >= 0) & (keys <= high[cell])
                held[i].append((keys[inside], later[there][inside]))
                size += int(inside.sum())
            if size > HELD:
                yield from grouped(held)
                held, size = {i: [] for i in features}, 0
        yield from grouped(held)

    def grouped(held):
        """One row for each different value."""
        for i, found in held.items():
            keys, later = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            k, of = np.unique(keys, return_inverse=True)
            n2 = np.bincount(of[later == 1], minlength=len(k))
            n1 = np.bincount(of, minlength=len(k)) - n2
            cell = np.searchsorted(known.value[i][0], k, side="right") - 1
            yield pa.record_batch([pa.array(np.full(len(k), i, np.int32)), pa.array(cell.astype(np.int32)), pa.array(k), pa.array(n1), pa.array(n2)],
                                  names=["i", "cell", "k", "n1", "n2"])

    rows = wide.select("later", *[f"v{i}" for i in features]).mapInArrow(values, _VALUES)
    # one exchange by cell serves the sums of equal values and the running sums
    rows = rows.repartition("i", "cell").groupBy("i", "cell", "k").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    up_to = Window.partitionBy("i", "cell").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spark = wide.sparkSession
    starts = F.broadcast(spark.createDataFrame(before, "i int, cell int, c1 bigint, c2 bigint"))
    sizes = F.broadcast(spark.createDataFrame([(i, searches[i].n1, searches[i].n2) for i in features], "i int, all1 bigint, all2 bigint"))
    rows = rows.select("i", "cell", F.sum("n1").over(up_to).alias("r1"), F.sum("n2").over(up_to).alias("r2")) \
        .join(starts, ["i", "cell"]).join(sizes, "i").withColumn("e1", F.col("c1") + F.col("r1")).withColumn("e2", F.col("c2") + F.col("r2"))
    # gaps are exact: products of two counts have at most 38 digits
    whole = "bigint" if all(s.whole is np.int64 for s in searches.values()) else "decimal(19,0)"
    gap = F.abs(F.col("e1").cast(whole) * F.col("all2").cast(whole) - F.col("e2").cast(whole) * F.col("all1").cast(whole))
    ks = F.abs(F.col("e1").cast("double") / F.col("all1") - F.col("e2").cast("double") / F.col("all2"))
    for r in rows.groupBy("i").agg(F.max(F.struct(gap.alias("gap"), ks.alias("ks"))).alias("top")).collect():
        searches[r.i].better(int(r.top.gap), r.top.ks)
    known.destroy()


class _Search:
    """The open cells of one feature (bound, least and greatest value, counts before and inside) and the best gap, in whole numbers."""

    def __init__(self, n1: int, n2: int):
        self.n1, self.n2 = n1, n2
        self.whole = np.int64 if n1 * n2 < 1 << 61 else object      # gaps are exact: times both counts
        self.best, self.ks = -1, 0.0
        self.open = [np.zeros(0, self.whole), *[np.zeros(0, np.int64)] * 5]

    def take(self, rows: dict, starts: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        """The counts of cells in order; runs of them begin at `starts`, with c1 and c2 values before."""
        cell, n1, n2 = rows["cell"], rows["n1"], rows["n2"]
        run = np.searchsorted(starts, cell, side="right") - 1
        first = np.searchsorted(cell, starts[run])
        before = []
        for n, c in ((n1, c1), (n2, c2)):
            ahead = np.cumsum(n) - n
            before.append((ahead - ahead[first] + c[run]).astype(self.whole))
        b1, b2 = before
        e1, e2 = b1 + n1, b2 + n2
        gap = np.abs(e1 * self.n2 - e2 * self.n1)
        top = gap.max()
        self.better(top, np.abs(e1.astype(float) / self.n1 - e2.astype(float) / self.n2)[gap == top].max())
        bound = np.maximum(np.abs(e1 * self.n2 - b2 * self.n1), np.abs(b1 * self.n2 - e2 * self.n1))
        of_one, of_two = np.uint64(self.n1 % (1 << 64)), np.uint64(self.n2 % (1 << 64))
        several = (rows["low"] < rows["high"]) & (rows["h1"] * of_two != rows["h2"] * of_one)
        fresh = [x[several] for x in (bound, rows["low"], rows["high"], b1.astype(np.int64), b2.astype(np.int64), n1 + n2)]
        cells = [np.concatenate([a, b]) for a, b in zip(self.open, fresh)]
        self.open = [c[(cells[0] > self.best).astype(bool)] for c in cells]

    def better(self, gap: int, ks: float) -> None:
        if gap >= self.best:
            self.best, self.ks = gap, max(ks, self.ks if gap == self.best else 0.0)

    def small(self) -> bool:
        """Whether no open cell holds more than its share of the rows, so that one task can go through it."""
        return not len(self.open[0]) or int(self.open[5].max()) <= max(2 * (self.n1 + self.n2) // FIRST_CELLS, HELD)

    def cut(self) -> tuple[np.ndarray, np.ndarray, tuple] | None:
        """Edges of the next cells, which of them are counted, and (where runs begin, counts before)."""
        if not len(self.open[0]):
            return None
        order = np.argsort(-self.open[0], kind="stable")
        # a cell is cut into about an eighth as many as it has rows
        pieces = np.minimum(np.maximum(self.open[5][order] // 8, 8), 4 * FIRST_CELLS)
        n_now = max(1, int(np.searchsorted(np.cumsum(pieces), LIVE, side="right")))
        now, later, pieces = order[:n_now], order[n_now:], pieces[:n_now]
        by_value = np.argsort(self.open[1][now])
        now, pieces = now[by_value], pieces[by_value].astype(np.uint64)
        low, high, c1, c2 = (c[now] for c in self.open[1:5])
        self.open = [c[later] for c in self.open]
        width = high.view(np.uint64) - low.view(np.uint64)          # may exceed 63 bits
        step = np.maximum(width // pieces, np.uint64(1))
        of = np.repeat(np.arange(len(low)), pieces.astype(np.int64))
        k = (np.arange(len(of)) - np.repeat(np.cumsum(pieces.astype(np.int64)) - pieces.astype(np.int64), pieces.astype(np.int64))).astype(np.uint64)
        inner = (low.view(np.uint64)[of] + np.minimum(step[of] * k, width[of])).view(np.int64)
        # what lies between the cells is not counted again
        edges = np.unique(np.concatenate([low - 1, high, inner]))
        at = np.searchsorted(low, edges, side="right") - 1
        live = (at >= 0) & (edges <= high[at])
        return edges, live, (np.searchsorted(edges, low), c1, c2)


def ks_statistic(df: DataFrame, names: Sequence[str], second: Column, first_cells: int = FIRST_CELLS) -> DataFrame:
    """`(ordinal, feature, n_first, n_second, ks)`: largest gap of the two cumulative distributions.

    Exact over all values; NULL and NaN are no values, and rows without a side do not count. A feature without any value
    is left out, one without values on a side has no `ks`. Runs Spark jobs: one for rough quantiles, from which the first
    `first_cells` cells are made, a few that count cells, and one for the values of those that stay open.
    """
    ship(df.sparkSession)
    wide = df.select(second.cast("int").alias("later"), *[num(c).alias(f"v{i}") for i, c in enumerate(names)]).filter("later is not null")
    probs = [k / first_cells for k in range(first_cells + 1)]
    searches: dict[int, _Search] = {}
    counted: dict[int, tuple[int, int]] = {}
    cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    starts: dict[int, tuple] = {}
    for i, (n1, n2, rough) in enumerate(_rough_quantiles(wide, len(names), probs)):
        counted[i] = (n1, n2)
        if n1 and n2:
            searches[i] = _Search(n1, n2)
            edges = np.unique(ordered_bits(np.array(rough)))
            cells[i], starts[i] = (edges, np.ones(len(edges), bool)), tuple(np.zeros(1, np.int64) for _ in range(3))
    passes = 0
    while cells:
        rows = _count(wide, cells)
        passes += 1
        for i in cells:
            searches[i].take(rows[i], *starts[i])
        cells = {}
        for i, s in searches.items():
            if passes < (PASSES if s.small() else MAX_PASSES) and (more := s.cut()) is not None:
                cells[i], starts[i] = more[:2], more[2]
    if left := {i: s for i, s in searches.items() if len(s.open[0])}:
        _settle(wide, left)
    out = [(i, c, *counted[i], float(searches[i].ks) if i in searches else None) for i, c in enumerate(names) if any(counted[i])]
    return df.sparkSession.createDataFrame(out, "ordinal int, feature string, n_first bigint, n_second bigint, ks double")


def _rough_quantiles(wide: DataFrame, n_features: int, probs: list[float]) -> list[tuple]:
    """(count of either side, quantiles about right, with the exact extremes) of each feature, in one pass."""
    later = F.col("later") == 1
    aggs = []
    for i in range(n_features):
        v = F.col(f"v{i}")
        aggs += [F.count(F.when(~later, v)).alias(f"a{i}"), F.count(F.when(later, v)).alias(f"b{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
                 F.percentile_approx(v, probs, 4 * len(probs)).alias(f"q{i}")]
    row = wide.agg(*aggs).first() if aggs else None
    return [(row[f"a{i}"], row[f"b{i}"], [*(row[f"q{i}"] or []), row[f"l{i}"], row[f"h{i}"]] if row[f"a{i}"] + row[f"b{i}"] else [])
            for i in range(n_features)]
