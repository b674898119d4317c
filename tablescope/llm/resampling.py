"""Importance resampling towards a target: weights from hashed features, winners by distributed quickselect.

Features are runs of 1 to `orders` words, hashed into buckets. The log ratio of a bucket's smoothed share in
the target and in the source is its gain; a document weighs the mean gain of its features. A Gumbel key
for each document turns the weights into a draw without replacement: the k highest keys win.
The k-th key is found without sorting: each round draws pivots among the rows that are still
in question, counts exactly how many rows lie below, at and between them, and goes on in the one
part that holds rank k. Only the winners are then sorted and numbered.

Null and empty texts have no features, weight 0, and are never drawn. A null id is keyed as an
empty one and comes after all others among equal scores. Rows that share an id are documents of
their own; among equal scores and ids fewer features come first, and rows that are alike in all of this
are interchangeable. Empty tables give no rows; an empty target gives gains below or at zero. Ids may be of any type.
"""

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tablescope.llm import hashing, word_runs
from tablescope.llm.storage import written

PIVOTS = 63
#: Rows of a range that one task sorts.
RANGE_ROWS = 1_000_000

_LONG = 64


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def _shift_tables() -> np.ndarray:
    """[n, k, v]: the register v << 8k after n zero bytes; registers add up, so four look-ups shift any."""
    out = np.empty((_LONG + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_LONG):
        out[n + 1] = _CRC[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()


def word_crcs(w: word_runs.Words) -> np.ndarray:
    """crc32 of every word."""
    size = w.ends - w.starts
    order = np.argsort(-size, kind="stable")
    first, sizes = w.starts[order], size[order]
    state = np.full(len(order), _FULL)
    live = len(order) - np.searchsorted(sizes[::-1], np.arange(min(_LONG, sizes[0] if len(sizes) else 0)), side="right")
    for j, n in enumerate(live):
        state[:n] = _CRC[(state[:n] ^ w.bytes[first[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ _FULL
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(w.bytes[w.starts[i]:w.ends[i]])
    return out


def run_crcs(w: word_runs.Words, one: np.ndarray, before: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """crc32 of the runs of `size` words at `at`, given those of the words and of the runs one shorter at `at`."""
    last = at + size - 1
    spaced = before ^ _FULL
    spaced = _CRC[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> np.uint32(8)) ^ _FULL
    n = np.minimum(w.ends[last] - w.starts[last], _LONG)
    out = one[last].copy()
    for k in range(4):
        out ^= _SHIFT[n, k, (spaced >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(w.ends[last] - w.starts[last] > _LONG):
        out[i] = zlib.crc32(w.bytes[w.starts[last[i]]:w.ends[last[i]]], int(spaced[i]))
    return out


def features(texts, buckets: int, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text of each feature, its bucket, size of the runs) over whole texts, in pieces of bounded size."""
    for w in word_runs.words(texts, hashing.ascii_words_table(), orders - 1):
        one = word_crcs(w)
        at = np.arange(len(one))
        crc = one
        for size in range(1, orders + 1):
            if size > 1:
                longer = at[np.isin(at, w.starts_of(size), assume_unique=True)] if size > 2 else w.starts_of(2)
                crc = run_crcs(w, one, crc[np.searchsorted(at, longer)], longer, size)
                at = longer
            mine = w.own[at]
            yield w.owner[at][mine], crc[mine] % np.uint32(buckets), size


def bucket_counts(texts: DataFrame, buckets: int = 10_000, orders: int = 2) -> np.ndarray:
    """How many features of a one-column table fall into each bucket: one short row per bucket reaches the driver."""
    def count(parts):
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for piece in hashing.sliced(part, 0):
                for _, bucket, _ in features(hashing.raw_texts(piece.column(0)), buckets, orders):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of smoothed shares, bucket by bucket."""
    s, t, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets))))
                     for a, b in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_features, weight of every document."""
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def score(parts):
        for part in parts:
            for piece in hashing.sliced(part, 1):
                n = piece.num_rows
                words, total, gained = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for owner, bucket, size in features(hashing.raw_texts(piece.column(1)), len(table.value), orders):
                    here = np.bincount(owner, minlength=n)
                    total += here
                    words += here if size == 1 else 0
                    np.add.at(gained, owner, table.value[bucket])
                weight = np.where(total > 0, gained // np.maximum(total, 1), 0)
                yield pa.record_batch([piece.column(0), pa.array(words), pa.array(total), pa.array(weight)],
                                      names=["id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: Column) -> Column:
    """1000 times a standard Gumbel number, floored, from the first 32 bits of sha256(`seed:id`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _constants(values: list[tuple], kind: StructType) -> Column:
    """An array of structs that the optimiser folds to one literal."""
    rows = [dict(zip(kind.names, v)) for v in values]
    return F.from_json(F.lit(json.dumps(rows, default=str)), ArrayType(kind))


def _constant(value: tuple, kind: StructType) -> Column:
    return F.element_at(_constants([value], kind), 1)


def key_at_rank(rows: DataFrame, key: str, rank: int, pivots: int = PIVOTS) -> tuple | None:
    """The value of that rank (from 1) of a struct column without nulls, in ascending order. None beyond the last row.

    Each round sees only the rows between the two pivots around the rank, and counts them exactly
    on and between up to `pivots` new ones; what reaches the driver is those pivots and counts.
    """
    rows = rows.select(F.col(key).alias("key"))
    kind, left, round_no = rows.schema["key"].dataType, rank, 0
    while True:
        # the keys of least hash are a random draw; equal keys are drawn once
        draw = rows.distinct().select(F.xxhash64(F.lit(round_no), "key").alias("draw"), "key").orderBy("draw", "key").limit(pivots)
        drawn = sorted(tuple(r.key) for r in draw.collect())
        if not drawn:
            return None
        table = _constants(drawn, kind)
        # 2 i: below pivot i and above the one before, 2 i + 1: at pivot i
        part = 2 * F.size(F.filter(table, lambda p: p < F.col("key"))) + F.array_contains(table, F.col("key")).cast("int")
        counts = dict(rows.groupBy(part.alias("part")).count().collect())
        for i in sorted(counts):
            if left <= counts[i]:
                break
            left -= counts[i]
        else:
            return None
        if i % 2:
            return drawn[i // 2]
        if i // 2 < len(drawn):
            rows = rows.where(F.col("key") < _constant(drawn[i // 2], kind))
        if i:
            rows = rows.where(F.col("key") > _constant(drawn[i // 2 - 1], kind))
        round_no += 1


def numbered(rows: DataFrame, order: list[Column], n_rows: int, name: str) -> DataFrame:
    """The rows with their place in the order from 1: sorted in ranges, which know how many rows lie before them."""
    parts = max(1, -(-n_rows // RANGE_ROWS))
    sorted_rows = written(rows.repartitionByRange(max(parts, 8), *order).sortWithinPartitions(*order)
                          .withColumn("_place", F.monotonically_increasing_id()), "ranked")
    at = F.shiftright("_place", 33)
    sizes = {r[0]: r[1] for r in sorted_rows.groupBy(at).count().collect()}
    ahead, total = {}, 0
    for k in sorted(sizes):
        ahead[k] = total
        total += sizes[k]
    offsets = rows.sparkSession.createDataFrame(list(ahead.items()), "_range long, _ahead long")
    return sorted_rows.withColumn("_range", at).join(F.broadcast(offsets), "_range") \
        .withColumn(name, F.col("_ahead") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_range", "_ahead")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = 25, least_words: int = 20, buckets: int = 10_000, orders: int = 2, seed: int = 7) -> DataFrame:
    """id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    floor(percent * N / 100) of the N documents with at least `least_words` words are drawn.
    """
    gain = gains(bucket_counts(docs.select(f"`{text_col}`"), buckets, orders),
                 bucket_counts(target.select(f"`{target_text}`"), buckets, orders))
    scored = weigh(docs, gain, orders, id_col, text_col)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "resampling-scores")
    able = F.col("n_words") >= least_words
    out = lambda df: df.select("id", "n_features", "weight", "score", "rank")
    nothing = F.lit(None).cast("long").alias("rank")
    wanted = percent * scored.where(able).count() // 100
    if wanted == 0:
        return out(scored.select("*", nothing))
    kind = scored.schema["id"].dataType
    stand_in = F.lit("") if kind.simpleString() == "string" else F.lit(0).cast(kind)
    keyed = scored.withColumn("key", F.struct((-F.col("score")).alias("turned"), F.col("id").isNull().alias("unnamed"),
                                              F.coalesce("id", stand_in).alias("id"), "n_features"))
    cut = key_at_rank(keyed.where(able), "key", wanted)
    won = able & (F.col("key") <= _constant(cut, keyed.schema["key"].dataType))
    ranked = numbered(keyed.where(won), [F.col("key")], wanted, "rank") \
        .withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))  # of rows alike in all, some are not drawn
    return out(ranked).unionByName(out(keyed.where(~won).select("*", nothing)))
