"""Fuzzy line deduplication.

Lines that are nearly the same anywhere in the corpus are one component, and only its
first line, by document id and place, is kept. Every distinct line gets a MinHash
signature of its character 5-grams. Signatures are cut into bands; lines that agree in a
band are candidates; pairs whose whole signatures agree enough are checked by their
exact Jaccard similarity. Components come from a distributed union-find.

The signature is filled in rounds: each gram throws its hash into one slot per round until
all slots have one, so long lines cost one round and short ones as many as they need.
With 12 bands of 5 slots a pair of similarity 0.8 is found with odds of 0.99, one of 0.9
with odds above 0.9999.

Defined cases: lines are separated by newlines and compared without white space at their
ends. Blank lines are not compared and stay. A line shorter than a gram is one gram. A null
text stays null. Every row is a document of its own, also where rows share an id or have none: rows of one
id come in the order in which they are read. A null id comes first. Lines are identified by 64-bit hashes.
Other columns of the table are kept as they are.
"""

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm import hashing
from tablescope.llm.pairs import link_buckets
from tablescope.llm.storage import dropped, keyed, written

GRAM = 5
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(place, trimmed line) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character grams of all lines (none empty) in order, and the offsets of each line."""
    sizes = np.array([len(s) for s in lines], np.int64)
    gap = "\0" * (GRAM - 1)
    chars = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars += np.uint64(1)
    chars *= _SPREAD
    chars ^= chars >> np.uint64(29)
    begin = np.cumsum(sizes + GRAM - 1) - (sizes + GRAM - 1)
    chars[((begin + sizes)[:, None] + np.arange(GRAM - 1)).reshape(-1)] = 0
    windows = np.zeros(len(chars) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        windows *= _BASE
        windows += chars[k:k + len(windows)]
    n = np.maximum(1, sizes - GRAM + 1)
    offsets = np.append(0, np.cumsum(n))
    return hashing.mix(windows[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], n)]), offsets


def line_keys(lines: list[str]) -> np.ndarray:
    """One 64-bit number per line."""
    return np.frombuffer(b"".join([blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest() for s in lines]),
                         np.int64)


def _distinct(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of distinct grams per line."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    s = np.sort((owner << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.append(True, s[1:] != s[:-1])
    return np.bincount((s[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)


def signatures(h: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Per line, `slots` values of which two lines share each with the odds of their similarity."""
    n = len(offsets) - 1
    table = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    room = np.uint64((1 << 56) - 1)
    for turn in range(2 * slots):
        g = hashing.mix(h + np.uint64(turn * int(_BASE) & (1 << 64) - 1))
        # In the second half each round fills the one slot of its number, so that none stays empty.
        slot = (g >> np.uint64(58)).astype(np.int64) * slots >> 6 if turn < slots else np.full(len(g), turn - slots)
        value = (np.uint64(turn) << np.uint64(56)) | (g & room)
        np.minimum.at(table.reshape(-1), owner * slots + slot, value)
        left = (table == np.iinfo(np.uint64).max).any(axis=1)
        if not left.any():
            break
        keep = left[owner]
        h, owner = h[keep], owner[keep]
    return table


def _found(batch, size: int = 1 << 18):
    """(rows, places, lines) of the lines of a batch, a few hundred thousand characters at a time."""
    rows, places, lines, total = [], [], [], 0
    for row, text in enumerate(batch.column(1).to_pylist()):
        for place, line in lines_of(text):
            rows.append(row)
            places.append(place)
            lines.append(line)
            total += len(line)
            if total >= size:
                yield rows, places, lines
                rows, places, lines, total = [], [], [], 0
    if lines:
        yield rows, places, lines


def _signed(texts: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """(node, n, marks) of the distinct lines: number of distinct grams, a byte of each slot."""

    def rows(parts):
        known: set[int] = set()
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                for _, _, lines in _found(part):
                    lines = list(set(lines))
                    keys = line_keys(lines)
                    fresh = np.array([k not in known for k in keys.tolist()], bool)
                    if len(known) > 1_000_000:
                        known.clear()
                    known.update(keys.tolist())
                    keys = keys[fresh]
                    if not len(keys):
                        continue
                    h, at = _grams([s for s, new in zip(lines, fresh) if new])
                    table = signatures(h, at, bands * rows_per_band)
                    marks = pa.array([row.tobytes() for row in table.astype(np.uint8)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_distinct(h, at), pa.int32()), marks],
                                                     names=["node", "n", "marks"])

    return texts.mapInArrow(rows, "node long, n int, marks binary").dropDuplicates(["node"])


def band_buckets(bands: int, rows_per_band: int) -> Column:
    """One 64-bit number for each band of `marks`. Bands that agree have the same; others by chance, once in 2**40 pairs."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring("marks", 1 + b * rows_per_band, rows_per_band)) for b in range(bands)])


def _occurrences(texts: DataFrame) -> DataFrame:
    """(id, row, place, node) of every line of (id, text, row)."""

    def rows(parts):
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                for owners, places, lines in _found(part):
                    keys = line_keys(lines)
                    owners = pa.array(owners)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(owners), part.column(2).take(owners),
                                                      pa.array(places, pa.int32()), pa.array(keys)],
                                                     names=["id", "row", "place", "node"])

    return texts.mapInArrow(rows, "id long, row long, place int, node long")


def _line_texts(texts: DataFrame, nodes: DataFrame, bits: int = 1 << 20) -> DataFrame:
    """(node, line) of the wanted lines. A fixed bitmap of their hashes spares most others the way back."""
    wanted = np.zeros(bits, bool)
    wanted[nodes.select(F.pmod("node", F.lit(bits)).alias("b")).distinct().toArrow()["b"].to_numpy().astype(np.int64)] = True
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def rows(parts):
        known: set[int] = set()
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                for _, _, lines in _found(part):
                    lines = list(set(lines))
                    keys = line_keys(lines).tolist()
                    chosen = [(k, s) for k, s in zip(keys, lines) if sent.value[k % bits] and k not in known]
                    if len(known) > 1_000_000:
                        known.clear()
                    known.update(k for k, _ in chosen)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], pa.int64()),
                                                      pa.array([s for _, s in chosen], pa.string())], names=["node", "line"])

    return texts.mapInArrow(rows, "node long, line string").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _least_alike(slots: int, percent: int) -> int:
    """In as many of the slots lines that link agree but once in some ten thousand times."""
    p = percent / 100
    return math.ceil(p * slots - 4 * math.sqrt(slots * p * (1 - p)))


def _mark_numbers(slots: int) -> list[Column]:
    """The bytes of `marks` as numbers m0, m1, ... of seven bytes each."""
    return [F.conv(F.hex(F.substring("marks", 1 + k, 7)), 16, 10).cast("long").alias(f"m{k // 7}") for k in range(0, slots, 7)]


def _agreeing(slots: int) -> str:
    """SQL: number of equal bytes in the numbers of `a` and `b`. A byte that differs has its high bit set by the sum or by itself."""
    low, high = int("7F" * 7, 16), int("80" * 7, 16)
    x = [f"(a.m{k} ^ b.m{k})" for k in range(-(-slots // 7))]
    return f"{slots} - (" + " + ".join(f"bit_count(((({d} & {low}L) + {low}L) | {d}) & {high}L)" for d in x) + ")"


def _alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree in `_least_alike` slots or more."""

    def check(parts):
        for batch in parts:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else
                    np.zeros((0, 1), np.uint8) for c in (batch.column(2), batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= _least_alike(a.shape[1], percent)))

    joined = pairs.join(marks.toDF("src", "a"), "src").join(marks.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    return joined.mapInArrow(check, "src long, dst long")


def gram_set(line: str) -> set[str]:
    return {line[i:i + GRAM] for i in range(max(1, len(line) - GRAM + 1))}


def _verified(pairs: DataFrame, lines: DataFrame, percent: int, held: int = 1 << 20) -> DataFrame:
    """Pairs whose gram sets are alike enough. Sets of about `held` characters are kept while lines come again."""

    def check(parts):
        for batch in parts:
            keep, known, size = [], {}, 0
            for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if size > held:
                    known, size = {}, 0
                for line in pair:
                    if line not in known:
                        known[line] = gram_set(line)
                        size += len(line)
                a, b = known[pair[0]], known[pair[1]]
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(lines.toDF("src", "a"), "src").join(lines.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    return joined.mapInArrow(check, "src long, dst long")


def line_components(texts: DataFrame, percent: int = 80, bands: int = 12, rows_per_band: int = 5) -> DataFrame:
    """(node, component) of the lines of (id, text) that have a near copy with another text."""
    signed = written(_signed(texts, bands, rows_per_band), "lines")

    marks = signed.select("node", "marks")

    def verify(pairs: DataFrame) -> DataFrame:
        near = written(_alike(pairs, marks, percent), "alike")
        ends = written(near.selectExpr("src as node").union(near.selectExpr("dst")).distinct(), "line-ends")
        found = written(_line_texts(texts, ends), "line-texts")
        links = written(_verified(near, found, percent), "line-links")
        dropped(near, ends, found)
        return links

    slots = bands * rows_per_band
    fits = f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n)"
    parts = link_buckets(signed.select(F.explode(band_buckets(bands, rows_per_band)).alias("bucket"), "node", "n"), verify, fits, "line",
                         details=marks.select("node", *_mark_numbers(slots)), likely=f"{_agreeing(slots)} >= {_least_alike(slots, percent)}")
    dropped(signed)
    return parts


def repeated_places(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, places): the lines of (id, text, row) that are not the first of their component."""
    seen = _occurrences(texts).join(parts, "node", "left") \
        .select("id", "row", "place", F.coalesce("component", "node").alias("component"))
    seen = written(seen, "occurrences")
    first = seen.groupBy("component").agg(F.min(F.struct("id", "row", "place")).alias("first"), F.count(F.lit(1)).alias("times")) \
        .where("times > 1").select("component", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    late = seen.join(first, "component").where("row <> first_row or place <> first_place")
    places = written(late.groupBy("row").agg(F.collect_set("place").alias("places")), "places")
    dropped(seen)
    return places


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                lines_col: str = "n_lines", kept_col: str = "n_kept") -> DataFrame:
    """All columns of `docs`, the text without its repeated lines, and the numbers of (not blank) lines before and after.

    Existing columns with the names of the two numbers are replaced.
    """
    kept = [c for c in docs.columns if c not in (lines_col, kept_col)]
    rows = keyed(docs.select([F.col(f"`{c}`") for c in kept]), "__row")
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col("__row").alias("row"))
    parts = line_components(texts.select("id", "text"), percent)
    places = repeated_places(texts, parts)
    dropped(parts)

    @F.pandas_udf("text string, n int, kept int")
    def cut(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(text, drop):
            there = {i for i, _ in lines_of(t)}
            gone = set() if d is None else there.intersection(d)
            n = len(there)
            new = t if not gone or t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            out.append((new, n, n - len(gone)))
        return pd.DataFrame(out, columns=["text", "n", "kept"])

    d, p = rows.alias("d"), places.alias("p")
    done = d.join(p, F.col("d.__row") == F.col("p.row"), "left") \
        .withColumn("__cut", cut(F.col(f"d.`{text_col}`").cast("string"), F.col("p.places")))
    return done.select(*[F.col("__cut.text").alias(c) if c == text_col else F.col(f"d.`{c}`") for c in kept],
                       F.col("__cut.n").alias(lines_col), F.col("__cut.kept").alias(kept_col))
