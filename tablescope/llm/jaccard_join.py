"""Jaccard join on word n-grams by grouped prefixes.

All sets are ordered by one global order of the n-grams, rare before frequent. Two sets
of similarity t or more share an n-gram within their prefixes of n - ceil(t n) + 1 members.
Documents with the same prefix and size form one group; groups, not documents, are
paired, and pairs of groups are filtered by size and by what is left of both sets
after the shared n-gram. Only the members of pairs that pass are expanded, and of these only the ones that
no links so far have brought together. A pair of members is first held against the parity bits of both sets (about one bit a
member): as many bits as differ, as many members are in one set only, at least. So no link is lost, and few
other pairs are left to be verified on their whole sets.

The order comes from a count sketch over all documents: n-grams fall into 2**18
counters, a fixed size that is sent to every task. Any function of the n-gram is a
valid order, so counter collisions cost time only, never a link.

Defined cases: words are split at ASCII white space and A-Z is lower-cased. A document
with fewer words than an n-gram has one n-gram, the whole sequence; one without words
(null, empty, blank) has none and links with nothing. Rows with equal sets are one node;
rows that share an id but not the text are separate rows. A null id takes part, but is
never the name of a component unless the component has no other. Sets are compared by
64-bit hashes of their n-grams. Other columns are ignored. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import hashing
from tablescope.llm.components import connected_components
from tablescope.llm.pairs import repeated
from tablescope.llm.storage import dropped, written

WORDS = hashing.spaced_words_table()
SKETCH_BITS = 18


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(batch, size: int):
    """(row of the batch, its distinct n-gram hashes) of a batch of (id, text)."""
    h, at = hashing.word_hashes(hashing.raw_texts(batch.column(1)), WORDS)
    for i in range(len(at) - 1):
        yield i, np.unique(hashing.shingles(h[at[i]:at[i + 1]], size))


def _signature(s: np.ndarray) -> int:
    """One 64-bit number of a whole set, 0 only for the empty one."""
    if not len(s):
        return 0
    both = np.add.reduce(hashing.mix(s)) ^ hashing.mix(np.array([len(s)], np.uint64))[0]
    return int(np.int64(both.view(np.int64))) or 1


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of the n-grams of all documents in the cells of the sketch."""

    def count(parts):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                for _, s in _sets(part, size):
                    np.add.at(total, _cells(s), 1)
        full = np.flatnonzero(total)
        for k in range(0, len(full), 1 << 16):
            at = full[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = (texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))).toArrow().to_pandas()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return sketch


def _parities(s: np.ndarray) -> bytes:
    """Whether an even or odd number of members falls into each of a power of two of cells, at least one a member."""
    cells = 1 << max(6, (len(s) - 1).bit_length())
    at = (hashing.mix(s) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Two sets differ by this many members at least. The longer bits are folded until both have one length."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def grouped_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                     percent: int = 80) -> DataFrame:
    """One row per document: id, n (size of its set), node (signature of the set), grp (signature of its
    prefix and size), the prefix itself in global order, and the parity bits of the set. Runs one job for the sketch."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, size))

    def prefixes(parts):
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                ns, nodes, groups, cut, bits = [], [], [], [], []
                for _, s in _sets(part, size):
                    n = len(s)
                    keep = n - (n * percent + 99) // 100 + 1 if n else 0
                    p = s[np.lexsort((s, sketch.value[_cells(s)]))[:keep]]
                    ns.append(n)
                    nodes.append(_signature(s))
                    groups.append(_signature(np.append(p, np.uint64(n))) if n else 0)
                    cut.append(p.view(np.int64))
                    bits.append(_parities(s))
                at = np.append(0, np.cumsum([len(c) for c in cut]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(groups, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()),
                                              pa.array(np.concatenate(cut) if cut else np.zeros(0, np.int64))),
                     pa.array(bits, pa.binary())],
                    names=["id", "n", "node", "grp", "prefix", "bits"])

    return texts.mapInArrow(prefixes, "id long, n long, node long, grp long, prefix array<long>, bits binary")


def _near(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose parity bits leave room for a link: all that link, and few others."""
    ends = pairs.selectExpr("src as node").union(pairs.selectExpr("dst")).distinct()
    bits = rows.select("node", F.col("n").cast("long").alias("n"), "bits").join(ends, "node", "left_semi").dropDuplicates(["node"])
    a, b = bits.toDF("src", "an", "a"), bits.toDF("dst", "bn", "b")

    def check(parts):
        for batch in parts:
            src, dst, an, bn, x, y = (c.to_pylist() for c in batch.columns)
            keep = [(100 + percent) * (m + n - _apart(p, q)) >= 2 * percent * (m + n) for m, n, p, q in zip(an, bn, x, y)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(a, "src").join(b, "dst").select("src", "dst", "an", "bn", "a", "b")
    return joined.mapInArrow(check, "src long, dst long")


#: Cells of the bitmap of wanted sets: it follows their number up to 8 MB; beyond that more others pass, and are dropped by the join.
MOST_WANTED_BITS = 1 << 26
#: Nodes that a task remembers to have sent.
REMEMBERED = 1 << 20


def _whole_sets(docs: DataFrame, text_col: str, size: int, nodes: DataFrame) -> DataFrame:
    """(node, members) of the wanted nodes. A bitmap of their signatures spares the others the way back; copies
    of a set go once from a task."""
    bits, n = 1 << 16, nodes.count()
    while bits < MOST_WANTED_BITS and bits < 32 * n:
        bits *= 2
    cell = F.pmod("node", F.lit(bits))
    words = nodes.groupBy(F.floor(cell / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(node, {bits}), 64) as int))")).alias("b")).toArrow()
    wanted = np.zeros(bits // 64, np.int64)
    wanted[words.column("w").to_numpy()] = words.column("b").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(parts):
        gone: set[int] = set()
        for batch in parts:
            for part in hashing.sliced(batch, 1):
                nodes, found = [], []
                for _, s in _sets(part, size):
                    node = _signature(s)
                    at = node % bits
                    if node and node not in gone and (int(sent.value[at >> 6]) >> (at & 63)) & 1:
                        gone.add(node)
                        nodes.append(node)
                        found.append(s.tobytes())
                if len(gone) > REMEMBERED:
                    gone.clear()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())],
                                                 names=["node", "members"])

    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(sets, "node long, members binary")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.toDF("src", "a")
    b = sets.toDF("dst", "b")

    def check(parts):
        for batch in parts:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")
    return joined.mapInArrow(check, "src long, dst long")


def _possible(percent: int) -> str:
    """SQL on postings a and b of one n-gram: do the sizes, and what is left of both sets after it, allow a link?"""
    return (f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) and "
            f"cast({percent} as long) * (a.n + b.n) <= cast({100 + percent} as long) * least(a.n - a.pos, b.n - b.pos)")


def _group_pairs(left: DataFrame, right: DataFrame, which, percent: int) -> DataFrame:
    """Distinct pairs (g, h) of groups, g < h, that share an n-gram of their prefixes and pass its filters."""
    met = left.alias("a").join(right.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.grp") != F.col("b.grp"))
                               & which & F.expr(_possible(percent)))
    return met.select(F.least("a.grp", "b.grp").alias("g"), F.greatest("a.grp", "b.grp").alias("h")).distinct()


def _linked(docs: DataFrame, text_col: str, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of all nodes with a link.

    Each group is first compared with one hub group of each n-gram, head with head, and its members with its head. What is
    then still apart is paired again, as groups, and expanded to the members that lie in different components.
    """
    def verify(pairs: DataFrame, name: str) -> DataFrame:
        near = written(_near(pairs, rows, percent), f"{name}-near")
        ends = written(near.selectExpr("src as node").union(near.selectExpr("dst")).distinct(), f"{name}-ends")
        links = written(_verified(near, _whole_sets(docs, text_col, size, ends), percent), f"{name}-links")
        dropped(near, ends)
        return links

    groups = rows.where("n > 0").groupBy("grp").agg(F.min("row").alias("row"), F.min("node").alias("head"), F.max("node").alias("last"))
    groups = written(rows.select("row", F.col("n").cast("int").alias("n"), "prefix").join(groups, "row"), "groups")
    heads = groups.select("grp", "head")
    members = written(rows.join(groups.where("head <> last").select("grp", "head"), "grp").select("grp", "head", "node").distinct(), "members")
    postings = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "bucket"))
    shared = written(repeated(postings), "shared")

    hubs = shared.groupBy("bucket").agg(F.min(F.struct("pos", "grp", "n")).alias("hub")).select("bucket", "hub.*")
    met = _group_pairs(hubs, shared, F.lit(True), percent)
    met = met.join(heads.toDF("g", "src"), "g").join(heads.toDF("h", "dst"), "h").select("src", "dst") \
        .union(members.where("head <> node").selectExpr("head as src", "node as dst"))
    star = written(met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "star")
    links = verify(star, "star")
    parts = connected_components(links, "star")

    named = written(heads.selectExpr("grp", "head as node").union(members.select("grp", "node")).distinct()
                    .join(parts, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("part")), "named")
    spread = named.groupBy("grp").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    known = written(shared.join(spread, "grp"), "known")
    dropped(shared)
    mixed = known.groupBy("bucket").agg(F.min("p").alias("least"), F.max("q").alias("most")).where("least <> most").select("bucket")
    rest = written(known.join(mixed, "bucket"), "rest")
    apart = (F.col("a.grp") < F.col("b.grp")) & ~((F.col("a.p") == F.col("b.q")) & (F.col("a.q") == F.col("b.p")))
    met = _group_pairs(rest, rest, apart, percent).union(spread.where("p <> q").select(F.col("grp").alias("g"), F.col("grp").alias("h")))
    a, b = named.toDF("g", "src", "p"), named.toDF("h", "dst", "q")
    more = met.join(a, "g").join(b, (met["h"] == b["h"]) & (F.col("p") != F.col("q"))) \
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    more = written(more.join(star, ["src", "dst"], "left_anti"), "more")
    dropped(known, rest, named, groups, members)
    late = verify(more, "late")
    if late.take(1):
        known, parts = parts, connected_components(links.union(late), "late")
        dropped(known)
    dropped(star, links, more, late)
    return parts


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links)."""
    rows = written(grouped_prefixes(docs, id_col, text_col, size, percent)
                   .withColumn("row", F.monotonically_increasing_id()), "prefixes")
    parts = _linked(docs, text_col, rows, size, percent)
    named = written(rows.select("id", "n", "node").join(parts, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")), "named-rows")
    dropped(rows, parts)
    least = named.where("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
