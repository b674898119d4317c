"""Benchmark decontamination with a positional inverted index.

`build_index` stores the postings of every token of the training texts. The index is
cut by documents into segments of about a million tokens, one row each, so building
and searching it need no shuffle and no term is ever gathered in one place, however
frequent it is. A phrase is found in a segment by taking the posting list of its rarest
term there, moved back by the term's offset, and intersecting it with the moved lists
of the other terms, rarest first, until it is empty.

Defined cases: a null or empty text has no words and no hits. A row with a null id is
indexed like any other. Rows that share an id are separate documents. Items with the same
id count once; an item with no words never occurs. Other columns are ignored.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import hashing
from tablescope.llm.storage import written

INDEX_SCHEMA = ("segment long, ids array<long>, bounds binary, terms binary, term_bounds binary, postings binary")
WORDS = hashing.ascii_words_table()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_tokens: int = 1_000_000) -> DataFrame:
    """One row per segment: document ids, where each document ends, the sorted terms (64-bit hashes),
    and for each term its sorted token positions within the segment. A document is never split. The index is
    written, as the numbers of segments follow from the tasks that made them."""

    def rows(parts):
        head = TaskContext.get().partitionId() << 32
        ids, hashes, counts, size, made = [], [], [], 0, 0
        for batch in parts:
            for part in hashing.sliced(batch, 1, 1 << 20):
                h, offsets = hashing.word_hashes(hashing.raw_texts(part.column(1)), WORDS)
                ids += part.column(0).to_pylist()
                hashes.append(h)
                counts.append(np.diff(offsets))
                size += len(h)
                if size >= segment_tokens:
                    yield _segment(head + made, ids, np.concatenate(hashes), np.concatenate(counts))
                    ids, hashes, counts, size, made = [], [], [], 0, made + 1
        if ids:
            yield _segment(head + made, ids, np.concatenate(hashes), np.concatenate(counts))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(rows, INDEX_SCHEMA), "postings")


def _segment(number: int, ids: list, h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])) if len(h) else np.zeros(0, np.int64)
    values = [pa.array([number]), pa.array([ids], pa.list_(pa.int64()))]
    values += [pa.array([x.tobytes()], pa.binary()) for x in (
        np.append(0, np.cumsum(counts)).astype(np.int64), sorted_h[first],
        np.append(first, len(h)).astype(np.int64), order.astype(np.int32))]
    return pa.RecordBatch.from_arrays(values, names=["segment", "ids", "bounds", "terms", "term_bounds", "postings"])


class _Segment:
    """One row of the index, opened for searching."""

    def __init__(self, row: dict):
        read = lambda c, t: np.frombuffer(row[c], t)
        self.ids = row["ids"]
        self.bounds, self.terms = read("bounds", np.int64), read("terms", np.uint64)
        self.term_bounds, self.postings = read("term_bounds", np.int64), read("postings", np.int32)

    def local(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words that the segment lacks."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.term_bounds[term]:self.term_bounds[term + 1]]

    def slot(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase, within one document each."""
        sizes = self.term_bounds[terms + 1] - self.term_bounds[terms]
        order = np.argsort(sizes, kind="stable")
        found = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            there = self.positions(terms[k])
            at = np.minimum(np.searchsorted(there, found + k), len(there) - 1)
            found = found[there[at] == found + k]
        found = found[found >= 0]
        return found[self.slot(found) == self.slot(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """(start, end) of the shortest stretches of at most `span` words that hold all terms, in any order.

        Every posting of the rarest term opens a neighbourhood; a stretch must lie in one document."""
        terms = np.unique(terms)
        sizes = self.term_bounds[terms + 1] - self.term_bounds[terms]
        lists = [self.positions(t) for t in terms[np.argsort(sizes, kind="stable")]]
        out = []
        for p in lists[0]:
            slot = self.slot(np.array([p]))[0]
            lo, hi = max(self.bounds[slot], p - span + 1), min(self.bounds[slot + 1], p + span)
            around = [x[np.searchsorted(x, lo):np.searchsorted(x, hi)] for x in lists[1:]]
            if any(not len(x) for x in around):
                continue
            best = None
            for start in np.unique(np.concatenate([[p], *around])):
                if start > p:
                    break
                ends = [x[np.searchsorted(x, start):][:1] for x in around]
                if all(len(e) for e in ends):
                    end = max([p, *(e[0] for e in ends)])
                    if end - start < span and (best is None or end - start < best[1] - best[0]):
                        best = (start, end)
            if best is not None:
                out.append(best)
        return np.array(sorted(set(out)), np.int64).reshape(-1, 2)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The queries as lists of (id, word hashes), block by block.

    Each block holds about `block_bytes` of text, the proven bound of what is sent to the tasks;
    a larger benchmark gives more blocks, each searched by a pass of its own.
    """
    items = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        h, at = hashing.word_hashes([r.text.encode() for r in rows], WORDS)
        yield [(r.id, h[at[i]:at[i + 1]]) for i, r in enumerate(rows) if at[i + 1] > at[i]]


def _find(segment: _Segment, queries, window: int, spans: bool):
    """For each query its found (start, end) stretches of the segment."""
    cache: dict[bytes, np.ndarray] = {}
    for number, (_, words) in enumerate(queries):
        terms = segment.local(words)
        if spans:
            if (terms >= 0).all():
                yield number, segment.near(terms, window)
            continue
        width = min(window, len(terms))
        absent = np.append(0, np.cumsum(terms < 0))
        found = []
        for k in np.flatnonzero(absent[width:] == absent[:len(absent) - width]):
            part = terms[k:k + width]
            key = part.tobytes()
            if key not in cache:
                cache[key] = segment.phrase(part)
            found.append(cache[key])
        if found and any(len(x) for x in found):
            start = np.unique(np.concatenate(found)).astype(np.int64)
            yield number, np.stack([start, start + width - 1], axis=1)


MATCH_SCHEMA = "segment long, slot int, id long, n_words long, items array<string>, starts array<int>, ends array<int>"


def search(index: DataFrame, items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text",
           spans: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per indexed document: its length in words, the items found, and the word stretches they cover.

    An item is found where any `window` of its consecutive words occurs (all its words, when it has fewer).
    With `spans`, it is found where all its words lie, in any order, within `window` words.
    Stretches are (starts, ends) from 0, ends included, sorted, joined where they touch.
    `items` are ids as text, each once. Runs one Spark job per block of items to fetch them.
    """
    spark = index.sparkSession
    parts = []
    for queries in list(item_blocks(items, id_col, text_col, block_bytes)) or [[]]:
        sent = spark.sparkContext.broadcast(queries)

        def rows(batches, sent=sent):
            for batch in batches:
                for row in batch.to_pylist():
                    yield _hits(row, sent.value, window, spans)

        parts.append(index.mapInArrow(rows, MATCH_SCHEMA))
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.union, parts)
    return (every.groupBy("segment", "slot").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("s"))
        .select("segment", "slot", "id", "n_words", "items", _joined("s").alias("s"))
        .select("segment", "slot", "id", "n_words", "items", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends")))


def _joined(stretches: str):
    """Sorted stretches of one document, joined where they overlap or touch."""
    return F.aggregate(
        stretches, F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= s["starts"] - 1),
                               F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                                   F.element_at(done, -1)["starts"].alias("starts"),
                                   F.greatest(F.element_at(done, -1)["ends"], s["ends"]).alias("ends")))))
        .otherwise(F.concat(done, F.array(F.struct(s["starts"].cast("int").alias("starts"),
                                                   s["ends"].cast("int").alias("ends"))))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, items found and the stretches of words that belong to them."""
    return search(build_index(docs, id_col, text_col), items, window, item_id_col, item_text_col).drop("segment", "slot")


def _hits(row: dict, queries, window: int, spans: bool) -> pa.RecordBatch:
    segment = _Segment(row)
    n = len(segment.ids)
    size = int(segment.bounds[-1])
    change = np.zeros(size + 1, np.int32)
    items: list[set] = [set() for _ in range(n)]
    for number, stretch in _find(segment, queries, window, spans):
        np.add.at(change, stretch[:, 0], 1)
        np.add.at(change, stretch[:, 1] + 1, -1)
        for s in np.unique(segment.slot(stretch[:, 0])):
            items[s].add(queries[number][0])
    covered = np.cumsum(change[:-1]) > 0
    fresh = np.zeros(size + 1, bool)
    fresh[segment.bounds] = True  # a stretch ends where its document ends
    edge_in = np.flatnonzero(covered & (fresh[:-1] | ~np.append(False, covered[:-1])))
    edge_out = np.flatnonzero(covered & (fresh[1:] | ~np.append(covered[1:], False)))
    slots = segment.slot(edge_in)
    cut = np.searchsorted(slots, np.arange(n + 1))
    base = segment.bounds[:-1][slots]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(segment.ids, pa.int64()),
         pa.array(np.diff(segment.bounds), pa.int64()), pa.array([sorted(x, key=str) for x in items], pa.list_(pa.string())),
         lists(edge_in - base), lists(edge_out - base)],
        names=["segment", "slot", "id", "n_words", "items", "starts", "ends"])
