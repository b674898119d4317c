"""Moments and co-moments of many columns, per segment, in one pass over the table.

For every pair of columns the pass keeps, over the rows where both have a value: how many
there are, both means, both sums of squared deviations and the sum of products of deviations. Such
blocks merge exactly (Chan, Golub and LeVeque 1983), so each task sends one short row per segment,
and these meet in two steps, first within 64 shares, then per segment. The
number of scans does not depend on the number of columns or segments; what a segment holds is
squared in its columns and independent of its rows.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import quoted
from tablescope.functions.workers import ship

SHARES = 64
#: Bytes of blocks that a task holds before it passes them on.
HELD = 128 << 20

_N, _MEAN, _M2, _CM = range(4)
_PAIRS = "list int, i int, j int, n bigint, mean_i double, mean_j double, m2_i double, m2_j double, cm double"
_SINGLES = "n bigint, mean double, m2 double, m3 double, low double, high double"


def pair_block(x: np.ndarray) -> np.ndarray:
    """[count, mean, m2, cm][i, j] of the columns of a matrix; mean and m2 are of column i where j has a value too."""
    present = ~np.isnan(x)
    m = present.astype(np.float64)
    with np.errstate(all="ignore"):
        low, high = np.nanmin(np.where(present, x, np.inf), axis=0), np.nanmax(np.where(present, x, -np.inf), axis=0)
        seen = present.any(axis=0)
        shift = np.where(seen, np.where(low == high, low, np.where(present, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)), 0.0)
        z = np.where(present, x - shift, 0.0)
        n, s, q = m.T @ m, z.T @ m, (z * z).T @ m
        mean = s / np.maximum(n, 1)
        m2 = q - s * mean
        m2[m2 <= 1e-14 * q] = 0.0                          # a column that is constant on these rows
        cm = z.T @ z - s * mean.T
    return np.stack([n, mean + shift[:, None], m2, cm])


def merge_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[_N] + b[_N]
    both = np.maximum(n, 1)
    d = np.where((a[_N] > 0) & (b[_N] > 0), b[_MEAN] - a[_MEAN], 0.0)
    weight = a[_N] * b[_N] / both
    mean = np.where(a[_N] == 0, b[_MEAN], np.where(d == 0, a[_MEAN], a[_MEAN] + d * (b[_N] / both)))
    return np.stack([n, mean, a[_M2] + b[_M2] + d * d * weight, a[_CM] + b[_CM] + d * d.T * weight])


def single_block(x: np.ndarray) -> np.ndarray:
    """[count, mean, m2, m3, low, high] of each column."""
    present = ~np.isnan(x)
    n = present.sum(axis=0).astype(np.float64)
    low = np.where(present, x, np.inf).min(axis=0, initial=np.inf)
    high = np.where(present, x, -np.inf).max(axis=0, initial=-np.inf)
    mean = np.where(low == high, low, np.where(present, x, 0.0).sum(axis=0) / np.maximum(n, 1))
    mean = np.where(n > 0, mean, 0.0)
    z = np.where(present, x - mean, 0.0)
    s1 = z.sum(axis=0) / np.maximum(n, 1)                   # what rounding left of the mean
    m2 = (z * z).sum(axis=0) - n * s1 * s1
    return np.stack([n, mean, m2, (z ** 3).sum(axis=0), low, high])


def merge_singles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    both = np.maximum(n, 1)
    d = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] == 0, b[1], np.where(d == 0, a[1], a[1] + d * (b[0] / both)))
    m2 = a[2] + b[2] + d * d * a[0] * b[0] / both
    m3 = (a[3] + b[3] + d ** 3 * a[0] * b[0] * (a[0] - b[0]) / both ** 2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / both)
    return np.stack([n, mean, m2, m3, np.minimum(a[4], b[4]), np.maximum(a[5], b[5])])


class _Held:
    """Blocks by segment; the key columns of a segment are kept as one-row batches."""

    def __init__(self, shapes: list[int], singles: int):
        self.shapes, self.singles = shapes, singles
        self.found: dict = {}
        self.size = 8 * (sum(4 * k * k for k in shapes) + 6 * singles) + 500

    def add(self, key, named: pa.RecordBatch, at: int, blocks: list[np.ndarray]) -> None:
        before = self.found.get(key)
        if before is None:
            self.found[key] = (named.take(pa.array([at])), blocks)
            return
        merged = [merge_pairs(a, b) for a, b in zip(before[1], blocks[:-1])]
        self.found[key] = (before[0], merged + [merge_singles(before[1][-1], blocks[-1])])

    def full(self) -> bool:
        return len(self.found) * self.size > HELD

    def flush(self) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
        """(key columns, blocks of each row) in batches."""
        rows = list(self.found.values())
        self.found = {}
        step = max(1, (4 << 20) // self.size)
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            yield pa.Table.from_batches([n for n, _ in some]).combine_chunks().to_batches()[0], [b for _, b in some]

    def pack(self, blocks: list[np.ndarray]) -> bytes:
        return np.concatenate([b.ravel() for b in blocks]).tobytes()

    def unpack(self, raw: bytes) -> list[np.ndarray]:
        flat, out, at = np.frombuffer(raw, np.float64), [], 0
        for k in self.shapes:
            out.append(flat[at:at + 4 * k * k].reshape(4, k, k))
            at += 4 * k * k
        return [*out, flat[at:].reshape(6, self.singles)]


def _key(df: DataFrame, by: Sequence[str]) -> Column:
    """The segment as text: equal for equal segments, also for NULL, NaN and signed zeros."""
    parts = [F.col(quoted(c)) + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(quoted(c))
             for c in by]
    return F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])) if by else F.lit("")


def comoments(df: DataFrame, columns: dict[str, Column], lists: Sequence[Sequence[str]] = (), singles: Sequence[str] = (),
              by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: `by`, `pairs` and `singles`, over named expressions that are read as doubles.

    `pairs` is an array of (list, i, j, n, mean_i, mean_j, m2_i, m2_j, cm) for i <= j within each list of
    names, each pair over the rows where both have a value; `singles` is an array of (n, mean, m2, m3, low,
    high), one for each of those names. NaN and NULL are no values. Without rows there is no segment.
    """
    ship(df.sparkSession)
    by, shapes, n_singles = list(by), [len(x) for x in lists], len(singles)
    keys = [F.col(quoted(c)) for c in by]
    place = {c: i for i, c in enumerate(dict.fromkeys([c for cols in lists for c in cols] + list(singles)))}
    doubles = [columns[c].cast("double").alias(f"_x{i}") for c, i in place.items()]
    at = [[place[c] for c in cols] for cols in lists]
    single_at = [place[c] for c in singles]
    n_keys, n_doubles = len(by), len(doubles)
    plain = df.select(*keys, _key(df, by).alias("_key"), *doubles)
    names = plain.schema.fieldNames()[:n_keys]
    head = T.StructType(plain.schema.fields[:n_keys + 1])
    middle = T.StructType(head.fields + [T.StructField("_blocks", T.BinaryType())])
    last = T.StructType(head.fields[:-1] + [T.StructField("pairs", T.ArrayType(T._parse_datatype_string(_PAIRS))),
                                            T.StructField("singles", T.ArrayType(T._parse_datatype_string(_SINGLES)))])

    def packed(held):
        for named, blocks in held.flush():
            yield pa.RecordBatch.from_arrays([*named.columns, pa.array([held.pack(b) for b in blocks], pa.binary())],
                                             names=[*named.schema.names, "_blocks"])

    def partial(parts):
        held = _Held(shapes, n_singles)
        for batch in parts:
            if not batch.num_rows:
                continue
            named = batch.select(list(range(n_keys + 1)))
            x = np.empty((batch.num_rows, n_doubles))
            for i in range(n_doubles):
                x[:, i] = batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False)
            codes = batch.column(n_keys).dictionary_encode()
            index, labels = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            order = np.argsort(index, kind="stable")
            bounds = np.searchsorted(index[order], np.arange(len(labels) + 1))
            for k, label in enumerate(labels):
                rows = order[bounds[k]:bounds[k + 1]]
                mine = x if len(labels) == 1 else x[rows]
                held.add(label, named, int(rows[0]), [pair_block(mine[:, a]) for a in at] + [single_block(mine[:, single_at])])
            if held.full():
                yield from packed(held)
        yield from packed(held)

    def merged(parts, finish):
        held = _Held(shapes, n_singles)
        for batch in parts:
            named = batch.select(list(range(n_keys + 1)))
            for i, (key, raw) in enumerate(zip(batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist())):
                held.add(key, named, i, held.unpack(raw))
        if not finish:
            yield from packed(held)
            return
        for named, blocks in held.flush():
            rows = [[_pairs_of(b[:-1]), _singles_of(b[-1])] for b in blocks]
            yield pa.RecordBatch.from_arrays([*named.columns[:-1], _nested([r[0] for r in rows], _PAIR_TYPE), _nested([r[1] for r in rows], _SINGLE_TYPE)],
                                             names=[*names, "pairs", "singles"])

    shares = plain.mapInArrow(partial, middle).withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    shares = shares.repartition("_key", "_share").drop("_share").mapInArrow(lambda parts: merged(parts, False), middle)
    return shares.repartition("_key").mapInArrow(lambda parts: merged(parts, True), last)


_PAIR_TYPE = pa.struct([("list", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())]
                       + [(c, pa.float64()) for c in ("mean_i", "mean_j", "m2_i", "m2_j", "cm")])
_SINGLE_TYPE = pa.struct([("n", pa.int64())] + [(c, pa.float64()) for c in ("mean", "m2", "m3", "low", "high")])


def _pairs_of(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of the pairs i <= j of all lists."""
    out = []
    for which, b in enumerate(blocks):
        i, j = np.triu_indices(b.shape[1])
        m2 = np.where(b[_M2] <= b[_N] * (1e-13 * np.abs(b[_MEAN])) ** 2, 0.0, b[_M2])
        out.append([np.full(len(i), which), i, j, b[_N][i, j], b[_MEAN][i, j], b[_MEAN][j, i], m2[i, j], m2[j, i], b[_CM][i, j]])
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 9


def _singles_of(b: np.ndarray) -> list[np.ndarray]:
    return [b[0], b[1], b[2], b[3], np.where(b[0] > 0, b[4], np.nan), np.where(b[0] > 0, b[5], np.nan)]


def _nested(rows: list[list[np.ndarray]], kind: pa.StructType) -> pa.Array:
    """Lists of structs, one for each row, from their columns; NaN becomes NULL."""
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
    columns = []
    for k in range(kind.num_fields):
        values = np.concatenate([r[k] for r in rows])
        columns.append(pa.array(values, pa.float64(), from_pandas=True).cast(kind.field(k).type) if pa.types.is_floating(kind.field(k).type)
                       else pa.array(values.astype(np.int64)).cast(kind.field(k).type))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind)))


def correlation_of(p: Column) -> Column:
    """Pearson correlation of an entry of `pairs`; NULL where a side is constant or has no value."""
    return p["cm"] / F.nullif(F.sqrt(p["m2_i"]) * F.sqrt(p["m2_j"]), F.lit(0.0))


def matrix(df: DataFrame, names: Sequence[str], columns: dict[str, Column]) -> tuple[np.ndarray, ...] | None:
    """(count, means, m2, co-moments) of named columns as matrices on the driver: squared in the columns, whatever the rows."""
    row = comoments(df, columns, [names]).first()
    if row is None:
        return None
    p = len(names)
    out = [np.zeros((p, p)) for _ in range(4)]
    for e in row.pairs:
        out[_N][e.i, e.j] = out[_N][e.j, e.i] = e.n
        out[_MEAN][e.i, e.j], out[_MEAN][e.j, e.i] = e.mean_i, e.mean_j
        out[_M2][e.i, e.j], out[_M2][e.j, e.i] = e.m2_i, e.m2_j
        out[_CM][e.i, e.j] = out[_CM][e.j, e.i] = e.cm
    return tuple(out)

