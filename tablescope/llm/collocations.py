"""Collocations: all frequent phrases by mergeable Misra-Gries summaries, counted exactly, scored by their weakest cut.

Phrases are runs of 1 to `longest` words inside a piece of a text, per group (language). They are hashed, and
hash cells form hash partitions of known mass (number of occurrences). Partial counts meet in a summary
for each hash partition, which holds fewer keys than its capacity; the capacity exceeds mass / threshold,
so the counts that a summary gives up never add up to the threshold and every frequent phrase survives.
The first summaries cover one and two words. Those of longer phrases take in only runs whose every pair of words
survived: any other run is infrequent, as a run is no more frequent than its parts.
A second pass counts the survivors exactly, by their words.

Survivors are told from others by a bitmap with two probes, of a size that follows their number up to
FILTER_BITS (16 MB). It never misses a survivor; where it lets others pass, these are counted as well, and dropped then
by their exact count. So results do not depend on its size. Two phrases share a hash with odds of about 2**-64 a pair.

Null and empty texts have no words. A null group is `und`. Repeated rows count again. Empty tables give no rows. Ties are
broken as `mine` says. Other columns are not read.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm import hashing, word_runs
from tablescope.llm.storage import written

CELLS = 1 << 16
#: Keys that one summary may hold; more mass means more summaries.
CAPACITY = 1 << 20
FILTER_BITS = 1 << 27
#: Keys that a task gathers before it passes them on.
GATHERED = 1 << 22
#: Hash partitions for each shuffle partition, so that these are about even.
PARTS = 8


def _pieces_table() -> bytes:
    """Lower-cases A-Z, turns the ends of pieces into separators and tabs into blanks."""
    ends = b".,;:!?\n\x0b\x0c\r"
    return bytes(10 if c in ends else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


_TABLE = _pieces_table()


def _salt(group: str) -> int:
    return int.from_bytes(hashlib.blake2b(group.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _buffers(parts, longest: int) -> Iterator[tuple[list[str], word_runs.Words, np.ndarray, np.ndarray]]:
    """(group of each text, words, their hashes, the salt of each word's group) over batches of (group, text)."""
    for part in parts:
        for piece in hashing.sliced(part, 1):
            groups = piece.column(0).to_pylist()
            salts = np.array([_salt(g) for g in groups], np.uint64)
            for w in word_runs.words(hashing.raw_texts(piece.column(1)), _TABLE, longest - 1):
                yield groups, w, hashing.span_hashes(w.bytes, w.starts, w.ends), salts[w.owner]


def _grams(w, hashes, salts, size: int, pairs: "Filter | None" = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the runs of one size; with `pairs`, of those whose every two neighbouring words pass."""
    at = w.starts_of(size)
    if pairs is not None and len(at):
        n = len(w.starts) - 1
        two = np.flatnonzero(w.run[:n] == w.run[1:])
        good = np.zeros(n, bool)
        good[two] = pairs.holds(hashing.run_hashes(hashes, two, 2, salts[two]))
        for k in range(size - 1):
            at = at[good[at + k]]
    return at, hashing.run_hashes(hashes, at, size, salts[at])


class Filter:
    """A bitmap with two probes for each key; it never misses a key."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.probes(keys, self.bits):
            out &= (self.cells[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        return [keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)]


def _filter(survivors: DataFrame, n: int, most: int) -> Filter:
    """The bitmap of all survivors; its words are made in Spark, at most most / 64 of them reach the driver."""
    bits = 1 << 16
    while bits < most and bits < 32 * n:
        bits *= 2

    def cells(parts):
        for part in parts:
            keys = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.concatenate(Filter.probes(keys, bits))
            yield pa.record_batch([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))],
                                  names=["cell", "bit"])

    rows = survivors.mapInArrow(cells, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return Filter(bits, out.view(np.uint64))


def masses(texts: DataFrame, longest: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Words per group, and the number of runs in each hash cell: of one and two words, and of more."""
    def count(parts):
        words: dict[str, int] = {}
        mass = np.zeros((2, CELLS), np.int64)
        for groups, w, hashes, salts in _buffers(parts, longest):
            per = np.bincount(w.owner[w.own], minlength=len(groups))
            for g, n in zip(groups, per):
                words[g] = words.get(g, 0) + int(n)
            for size in range(1, longest + 1):
                cell = _grams(w, hashes, salts, size)[1] & np.uint64(CELLS - 1)
                mass[int(size > 2)] += np.bincount(cell.astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(mass.ravel())
        names = list(words)
        yield pa.record_batch([pa.array([None] * len(some) + names, pa.string()), pa.array(list(some) + [None] * len(names), pa.int64()),
                               pa.array(list(mass.ravel()[some]) + [words[g] for g in names], pa.int64())], names=["grp", "cell", "n"])

    rows = written(texts.mapInArrow(count, "grp string, cell long, n long").groupBy("grp", "cell").agg(F.sum("n").alias("n")), "masses")
    cells = rows.where("cell is not null").toPandas()
    mass = np.zeros(2 * CELLS, np.int64)
    mass[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return rows.where("cell is null").select("grp", "n"), mass[:CELLS], mass[CELLS:]


class Summary:
    """Misra-Gries counts of at most `capacity` keys. A count is too low by no more than `lost`, and lost * (capacity + 1) <= mass."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._waiting: list = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Merge what waits; beyond the capacity, lower every count by the largest one that has no place."""
        self.keys, self.counts = _summed([(self.keys, self.counts), *self._waiting])
        self._waiting, self._size = [], 0
        if len(self.keys) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.lost += least
            stay = self.counts > least
            self.keys, self.counts = self.keys[stay], self.counts[stay] - least

    def may_reach(self, threshold: int) -> np.ndarray:
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def survivors(texts: DataFrame, sizes: range, mass: np.ndarray, threshold: int, longest: int,
              pairs: Filter | None = None) -> DataFrame:
    """Hashes (gram) of all runs of these sizes that may occur `threshold` times, and of few others."""
    spark = texts.sparkSession
    n_parts = _parts(spark, -(-int(mass.sum()) // threshold))
    part_mass = np.bincount(np.arange(CELLS) * n_parts // CELLS, weights=mass, minlength=n_parts).astype(np.int64)
    known = spark.sparkContext.broadcast(pairs)

    def partial(parts):
        waiting, size = [], 0

        def batches():
            keys, counts = _summed(waiting)
            part = (keys.view(np.uint64) & np.uint64(CELLS - 1)).astype(np.int64) * n_parts // CELLS
            order = np.argsort(part, kind="stable")
            yield _packed(part[order], [(keys[order], pa.int64()), (counts[order], pa.int64())], ["gram", "n"])

        for _, w, hashes, salts in _buffers(parts, longest):
            for k in sizes:
                keys = _grams(w, hashes, salts, k, known.value)[1].view(np.int64)
                waiting.append((keys, np.ones(len(keys), np.int64)))
                size += len(keys)
            if size > GATHERED:
                yield from batches()
                waiting, size = [], 0
        if waiting:
            yield from batches()

    def summarise(parts):
        found: dict[int, Summary] = {}
        for batch in parts:
            for p, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p not in found:
                    found[p] = Summary(int(part_mass[p]) // threshold + 1)
                found[p].add(keys.values.to_numpy(), counts.values.to_numpy())
        for s in found.values():
            yield pa.record_batch([pa.array(s.may_reach(threshold))], names=["gram"])

    dealt = texts.mapInArrow(partial, "part int, gram array<long>, n array<long>").repartition("part")
    return written(dealt.mapInArrow(summarise, "gram long"), "surviving-phrases")


def exact_counts(texts: DataFrame, short: Filter, long: Filter, n_survivors: int, threshold: int, longest: int) -> DataFrame:
    """grp, phrase, size, a of every run of 1 to `longest` words that occurs `threshold` times."""
    spark = texts.sparkSession
    known, n_parts = spark.sparkContext.broadcast((short, long)), _parts(spark, n_survivors)

    def count(parts):
        short, long = known.value
        found: dict[tuple, int] = {}

        def batch():
            keys = list(found)
            part = np.array([zlib.crc32(p) % n_parts for _, p, _ in keys], np.int64)
            order = np.argsort(part, kind="stable")
            keys, n = [keys[i] for i in order], [found[keys[i]] for i in order]
            return _packed(part[order], [([g for g, _, _ in keys], pa.string()), ([p for _, p, _ in keys], pa.binary()),
                                         ([s for _, _, s in keys], pa.int32()), (n, pa.int64())], ["grp", "phrase", "size", "n"])

        for groups, w, hashes, salts in _buffers(parts, longest):
            raw = w.bytes.tobytes()
            for size in range(1, longest + 1):
                at, keys = _grams(w, hashes, salts, size, short if size > 2 else None)
                passed = (long if size > 2 else short).holds(keys)
                _, first, n = np.unique(keys[passed], return_index=True, return_counts=True)
                for i, k in zip(at[passed][first].tolist(), n.tolist()):
                    phrase = b" ".join([raw[w.starts[j]:w.ends[j]] for j in range(i, i + size)])
                    key = (groups[w.owner[i]], phrase, size)
                    found[key] = found.get(key, 0) + k
            if len(found) > GATHERED // 16:
                yield batch()
                found.clear()
        if found:
            yield batch()

    def total(parts):
        found: dict[tuple, int] = {}
        for batch in parts:
            for row in range(batch.num_rows):
                for *key, n in zip(*(batch.column(c)[row].as_py() for c in range(1, 5))):
                    key = tuple(key)
                    found[key] = found.get(key, 0) + n
        kept = [(*k, n) for k, n in found.items() if n >= threshold]
        yield pa.record_batch([pa.array([r[c] for r in kept], t) for c, t in enumerate((pa.string(), pa.binary(), pa.int32(), pa.int64()))],
                              names=["grp", "phrase", "size", "a"])

    partial = texts.mapInArrow(count, "part int, grp array<string>, phrase array<binary>, size array<int>, n array<long>")
    return partial.repartition("part").mapInArrow(total, "grp string, phrase binary, size int, a long") \
        .withColumn("phrase", F.col("phrase").cast("string"))


def _parts(spark: SparkSession, keys: int) -> int:
    """How many hash partitions, so that none holds more than about CAPACITY keys."""
    return int(min(CELLS, max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // CAPACITY))))


def _packed(part: np.ndarray, columns: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One row for each hash partition, with lists of its entries; `part` is in order."""
    parts, at = np.unique(part, return_index=True)
    offsets = pa.array(np.append(at, len(part)).astype(np.int32))
    return pa.record_batch([pa.array(parts.astype(np.int32)), *[pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in columns]],
                           names=["part", *names])


def scored(frequent: DataFrame, words: DataFrame) -> DataFrame:
    """Every frequent phrase of two words or more with its weakest cut: l, r, n and score, in exact numbers."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    part = F.split("phrase", " ")
    cuts = frequent.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .withColumn("head", F.array_join(F.slice(part, F.lit(1), F.col("k")), " ")) \
        .withColumn("tail", F.array_join(F.slice(part, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    heads = frequent.select("grp", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = frequent.select("grp", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    rows = cuts.join(heads, ["grp", "head"]).join(tails, ["grp", "tail"]).join(words, "grp")
    for c in ("a", "n", "l", "r"):
        rows = rows.withColumn(f"{c}_", whole(c))
    rows = rows.withColumn("score", F.expr("(1000BD * a_ * n_) div (l_ * r_)"))
    best = F.min(F.struct("score", "k", "l", "r", "n")).alias("best")
    return rows.groupBy("grp", "phrase", "size", "a").agg(best) \
        .select("grp", "phrase", "size", "a", "best.l", "best.r", "best.n", "best.score")


def mine(docs: DataFrame, group_col: str = "lang", text_col: str = "text", threshold: int = 100, longest: int = 5, top: int = 2_000) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score: the first `top` phrases of each group by score, count and (bytes of) phrase.

    A phrase that stands inside a longer frequent one as often as by itself is left out.
    """
    texts = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    words, short_mass, long_mass = masses(texts, longest)
    found = survivors(texts, range(1, 3), short_mass, threshold, longest)
    n_short = found.count()
    short = _filter(found, n_short, FILTER_BITS)
    found = survivors(texts, range(3, longest + 1), long_mass, threshold, longest, short)
    n_long = found.count()
    long = _filter(found, n_long, FILTER_BITS)
    frequent = written(exact_counts(texts, short, long, n_short + n_long, threshold, longest), "frequent-phrases")
    # A part is as frequent as the whole only if every run between them is: one word more is enough to look at.
    part = F.split("phrase", " ")
    inside = frequent.where("size > 2").select("grp", "a", F.explode(F.array(
        F.array_join(F.slice(part, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(part, F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    rows = scored(frequent, words).join(inside, ["grp", "phrase", "a"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of 64 shares of each group first, so that one window holds at most 64 * top rows
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "share").orderBy(*order)))
    rows = rows.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= top).select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
