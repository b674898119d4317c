"""Brown's class-based bigram model, learned from all training texts.

Words are split at ASCII white space, with A-Z in lower case; the end of a text is a symbol of its own. Every word
of the training texts has a class:

    P(word | before) = P(class | class before) * (c + 1) / (N + V + 1),

with the count c of the word among the N occurrences of the V words of its class. A word that was not seen has the class
of its ending (the last two bytes).

Exchange clustering begins on the driver with the most frequent words, one symbol for each frequent ending
of all other words and one for any other ending: symbols move between classes until a sweep moves none. All other words
begin in the class of their ending. Then sweeps over the whole vocabulary move each of them to the class that
most raises the likelihood of the training bigrams, given the classes of all other words, until a sweep gains less than
a fortieth of a nat a token. For a sweep the tasks count the classes before and after each word;
these counts are grouped by word, and the class totals are sent to the tasks.

Counts of all words come from one grouped sum over the corpus. The most frequent 2**18
(a fixed bound) are sent to the tasks with their classes; counts and classes of the rest meet the texts in joins.

Defined cases: a null or empty text is the end alone. Without training texts every count
is zero and scores follow from the smoothing. Rows that share an id are scored on their
own. Other columns are ignored.
"""

from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import blocks, hashing
from tablescope.llm.storage import dropped, written

WORDS = hashing.spaced_words_table()
HOT_WORDS = 1 << 18
LEAST_GAIN = 0.025   # nats a token that a sweep over all words must gain for another one
END = np.uint64(0x5851F42D4C957F2D)   # stands for the end of a text among the hashes of words
PARTS, ENTRIES, ASKED, TABLE, TOTALS = range(5)   # kinds of blocks
TYPES = {PARTS: (np.uint64, np.uint16, np.uint32), ENTRIES: (np.uint64, np.uint16, np.int64, np.uint16), ASKED: (np.uint64, np.uint64, np.uint8), TABLE: (np.uint64, np.uint16, np.int64),
         TOTALS: (np.int64, np.int64)}


@dataclass
class ClassModel:
    """Bounded tables: counts of hot words, symbols and classes."""
    hot: np.ndarray          # sorted hashes of the most frequent words
    hot_counts: np.ndarray
    hot_symbol: np.ndarray   # symbol of a hot word, or -1 if its ending stands for it
    endings: np.ndarray      # symbol of each pair of last bytes
    n_symbols: int           # with the end as the last one
    own: np.ndarray          # sorted hashes of the words with symbols of their own
    classes: np.ndarray | None = None      # of the symbols; the last class is that of the end
    hot_class: np.ndarray | None = None    # of the hot words
    transition: np.ndarray | None = None   # log10 P(class | class before)
    room: np.ndarray | None = None         # log10 (N + V + 1) of each class
    tokens: int = 0
    distinct: int = 0
    ends: int = 0

    @property
    def end(self) -> int:
        return int(self.classes[-1])

    def classed(self, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, that of its ending if it is not hot, and its place among the hot words or -1."""
        symbol, place = self.symbols(h, tails)
        found = self.classes[symbol]
        if self.hot_class is not None and len(self.hot):
            found = np.where(place >= 0, self.hot_class[place], found)
        return found, place

    def symbols(self, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and its place among the hot words or -1."""
        symbol = self.endings[tails]
        place = np.full(len(h), -1)
        if len(self.hot) and len(h):
            at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
            place = np.where(self.hot[at] == h, at, -1)
            own = np.where(place >= 0, self.hot_symbol[place], -1)
            symbol = np.where(own >= 0, own, symbol)
        return symbol, place


def _parts(batch, column: int):
    for part in hashing.sliced(batch, column):
        yield part, *hashing.words_with_ends(hashing.raw_texts(part.column(column)), WORDS)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, tail, n) of all words of (id, text); word is a hash, tail its last two bytes."""

    def rows(parts):
        held, size = [], 0
        for batch in parts:
            for _, h, _, tails in _parts(batch, 1):
                held.append(_counted(h, tails))
                size += len(held[-1][0])
                if size > 2_000_000:
                    yield _batch(_merged(held))
                    held, size = [], 0
        if held:
            yield _batch(_merged(held))

    return texts.mapInArrow(rows, "word long, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _counted(h, tails, weights=None):
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(s))) if weights is None else np.add.reduceat(weights[order], first) if len(s) else first
    return s[first], tails[order][first], n


def _merged(held):
    return _counted(*[np.concatenate(x) for x in zip(*held)])


def _batch(counted):
    h, tails, n = counted
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tails, pa.int32()), pa.array(n.astype(np.int64))],
                                      names=["word", "tail", "n"])


def _most_frequent(counts: DataFrame, limit: int):
    """At most `limit` words whose count passes a threshold, found from the distribution of counts."""
    ranks = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).where("n > 1").withColumn("octave", F.floor(F.log2("n") * 16)) \
        .groupBy("octave").agg(F.sum("words").alias("words"), F.min("n").alias("least")).toArrow().to_pandas().sort_values("least")
    below = ranks["words"][::-1].cumsum()[::-1] <= limit
    if not below.any():
        return counts.limit(0).toArrow().to_pandas()
    return counts.where(F.col("n") >= int(ranks["least"][below].min())).toArrow().to_pandas()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1024, endings: int = 255,
          classes: int = 64, sweeps: int | None = None) -> tuple[ClassModel, DataFrame]:
    """The model, and the table of the words it was learned from (word, n, class). `sweeps`: at most so many, not until the end."""
    texts = _texts(docs, id_col, text_col)
    counts = written(count_words(texts), "word-counts")
    # the words with symbols of their own are taken by count, also where many words share a count and are not hot
    first = counts.where("n > 1").orderBy(F.col("n").desc(), F.col("word").bitwiseXOR(F.lit(-1 << 63))).limit(words).toArrow().to_pandas()
    hot = pd.concat([_most_frequent(counts, HOT_WORDS), first]).drop_duplicates("word")
    hot = hot.assign(h=hot["word"].to_numpy().astype(np.int64).view(np.uint64)).sort_values("h")
    top = hot.sort_values(["n", "h"], ascending=[False, True])["h"].to_numpy()[:words]
    own = {h: i for i, h in enumerate(np.sort(top))}
    rest = counts.join(F.broadcast(_longs(docs, [int(np.uint64(h).view(np.int64)) for h in own])), "word", "left_anti")
    tails = rest.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow().to_pandas()  # at most 2**16 rows
    tails = tails.sort_values(["n", "tail"], ascending=[False, True])
    table = np.full(1 << 16, len(own) + min(endings, len(tails)), np.int32)
    table[tails["tail"].to_numpy()[:endings]] = len(own) + np.arange(min(endings, len(tails)))
    n_symbols = len(own) + min(endings, len(tails)) + 2
    model = ClassModel(hot["h"].to_numpy(), hot["n"].to_numpy(), np.array([own.get(h, -1) for h in hot["h"]], np.int64),
                       table, n_symbols, np.sort(np.array(top, np.uint64)))
    bigrams = _bigrams(texts, model)
    model.ends = int(bigrams[-1].sum())
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model.tokens, model.distinct = int(sums[0]) + model.ends, int(sums[1]) + (model.ends > 0)
    model.classes = exchange(bigrams, classes, sweeps)
    between, sizes, table = _all_words(texts, counts, model, sweeps)
    model.room = np.log10(between.sum(axis=1) + sizes + 1)
    model.room[-1] = 0
    model.transition = np.log10((between + 0.05) / (between + 0.05).sum(axis=1, keepdims=True))
    dropped(counts)
    return model, table.mapInArrow(_table_rows, "word long, n long, class int")


def _all_words(texts: DataFrame, counts: DataFrame, model: ClassModel, sweeps: int | None):
    """Exchange over all words: counts of neighbouring classes, words of each class, and the table of words with count and class."""
    buckets = blocks.buckets_of(texts)
    table, best, done, parts, idle = written(_seeds(counts, model, buckets), "classes"), None, 0, 1, 0
    while True:
        vectors = _vectors(texts, table, model, buckets, seeds=best is None)
        between, sizes = _totals(vectors, model)
        value = _likelihood(between)
        if best is None or value > best[0]:
            gained = np.inf if best is None else value - best[0]
            dropped(*(best[1:3] if best else ()))
            best = value, table, vectors, between, sizes, model.hot_class
            idle = idle + 1 if gained < LEAST_GAIN * model.tokens else 0
        else:   # moves that do not fit together are taken back; from now on fewer words move at once
            dropped(table, vectors)
            model.hot_class, parts, idle = best[5], 2 * parts, 0
        if idle == parts or parts > 4 or done == sweeps:
            dropped(best[2])
            return best[3], best[4], best[1]
        table = written(_moved(best[2], best[3], model, done, parts), "classes")
        model.hot_class = _hot_classes(table, model)
        done += 1


def _seeds(counts: DataFrame, model: ClassModel, buckets: int) -> DataFrame:
    """Blocks of the table of words with the classes of their symbols."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def rows(parts):
        held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "tail", "n")] for batch in parts if batch.num_rows]
        if held:
            word, tail, n = (np.concatenate(c) for c in zip(*held))
            word = word.astype(np.int64).view(np.uint64)
            yield _table_block(word, sent.value.classed(word, tail)[0], n, buckets)

    return counts.mapInArrow(rows, blocks.SCHEMA)


def _table_block(word, found, n, buckets: int) -> pa.RecordBatch:
    order = np.argsort(word)
    return blocks.pack(blocks.bucket(word[order], buckets), TABLE, word[order], found[order].astype(np.uint16), n[order].astype(np.int64))


def _table_rows(parts):
    for batch in parts:
        word, found, n = blocks.unpacked([batch], {TABLE: TYPES[TABLE]})[TABLE]
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(found, pa.int32())], names=["word", "n", "class"])


def _edges(texts: DataFrame, model: ClassModel, buckets: int, seeds: bool) -> DataFrame:
    """Blocks of what stands beside each word: parts (word, class after it or, k higher, before it, number) and, where the class
    of the neighbour is not at hand, what is asked of the table (neighbour, word, 0 after it or 1 before it)."""
    sent, k = texts.sparkSession.sparkContext.broadcast(model), model.end + 1

    def rows(parts):
        for batch in parts:
            for _, h, at, tails in _parts(batch, 1):
                line = np.insert(h, at[1:], END)
                names, word = np.unique(line, return_inverse=True)
                tail, end = np.zeros(len(names), np.int64), int(np.searchsorted(names, END))
                tail[word] = np.insert(tails, at[1:], 0)
                found, place = sent.value.classed(names, tail)
                open_ = (place < 0) & (not seeds)
                found[end], open_[end] = k - 1, False
                after, far = found[word], open_[word]
                first = np.append(end, word[:-1])   # the first word of each pair, `word` is the second
                before, far_before = np.append(k - 1, after[:-1]), np.append(False, far[:-1])
                pairs, n = np.unique(np.concatenate([(first * 2 * k + after)[~far], (word * 2 * k + k + before)[~far_before]]), return_counts=True)
                at_name = pairs // (2 * k)
                yield blocks.pack(blocks.bucket(names, buckets)[at_name], PARTS, names[at_name], (pairs - at_name * 2 * k).astype(np.uint16),
                                  n.astype(np.uint32))
                asked = np.concatenate([word[far], first[far_before]])
                order = np.argsort(asked, kind="stable")
                by, side = np.concatenate([first[far], word[far_before]]), np.repeat([0, 1], [far.sum(), far_before.sum()])
                yield blocks.pack(blocks.bucket(names, buckets)[asked[order]], ASKED, names[asked[order]], names[by[order]],
                                  side[order].astype(np.uint8))

    return texts.mapInArrow(rows, blocks.SCHEMA)


def _looked_up(word: np.ndarray, table_word: np.ndarray, found: np.ndarray, end: int) -> np.ndarray:
    order = np.argsort(table_word)
    at = np.searchsorted(table_word[order], word)
    return np.where(word == END, end, np.append(found[order], end)[at]).astype(np.int64)


def _vectors(texts: DataFrame, table: DataFrame, model: ClassModel, buckets: int, seeds: bool) -> DataFrame:
    """For each bucket of words one block of entries, summed and with the class of the word, and one of totals: words before
    words by class, and words of each class."""
    k = model.end + 1

    def answered(parts):
        got = blocks.unpacked(parts, {ASKED: TYPES[ASKED], TABLE: TYPES[TABLE]})
        asked, word, side = got[ASKED]
        code = _looked_up(asked, *got[TABLE][:2], k - 1) + side * k
        order = np.argsort(word)
        yield blocks.pack(blocks.bucket(word[order], buckets), PARTS, word[order], code[order].astype(np.uint16), np.ones(len(word), np.uint32))

    def summed(parts):
        got = blocks.unpacked(parts, {PARTS: TYPES[PARTS], TABLE: TYPES[TABLE]})
        word, code, n = got[PARTS]
        names, index = np.unique(word, return_inverse=True)
        pairs, place = np.unique(index * 2 * k + code, return_inverse=True)
        n = np.bincount(place, n, len(pairs)).astype(np.int64)
        of = _looked_up(names, *got[TABLE][:2], k - 1)
        at, code = pairs // (2 * k), pairs % (2 * k)
        here = blocks.bucket(names, buckets)
        yield blocks.pack(here[at], ENTRIES, names[at], code.astype(np.uint16), n, of[at].astype(np.uint16))
        total = np.bincount((of[at] * k + code)[code < k], n[code < k], k * k)
        total = np.append(total, np.bincount(of[names != END], minlength=k))
        full = np.flatnonzero(total)
        yield blocks.pack(np.zeros(len(full), np.int64), TOTALS, full, total[full].astype(np.int64))

    edges = _edges(texts, model, buckets, seeds)
    if seeds:
        return written(blocks.dealt(edges.union(table), buckets).mapInArrow(summed, blocks.SCHEMA), "vectors")
    edges = written(edges, "edges")
    answers = blocks.dealt(edges.where(F.col("kind") == ASKED).union(table), buckets).mapInArrow(answered, blocks.SCHEMA)
    whole = edges.where(F.col("kind") == PARTS).union(answers).union(table)
    vectors = written(blocks.dealt(whole, buckets).mapInArrow(summed, blocks.SCHEMA), "vectors")
    dropped(edges)
    return vectors


def _totals(vectors: DataFrame, model: ClassModel) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring classes, and the number of words of each class: as many as classes squared."""
    k = model.end + 1

    def rows(parts):
        pair, n = blocks.unpacked(parts, {TOTALS: TYPES[TOTALS]})[TOTALS]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    found = vectors.where(F.col("kind") == TOTALS).mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(k * k + k)
    out[found["pair"].to_numpy().astype(np.int64)] = found["n"].to_numpy()
    return out[:k * k].reshape(k, k), out[k * k:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _likelihood(between: np.ndarray) -> float:
    """Of the training bigrams, but for a part that depends on the words alone."""
    return float(_xlogx(between).sum() - _xlogx(between.sum(axis=0)).sum() - _xlogx(between.sum(axis=1)).sum())


def best_classes(start: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class of each word that most raises the likelihood, given the counts of neighbouring classes. The entries of a word,
    from its start on, are the numbers of words after it by class and, k higher, before it; `old` is its class."""
    k, out = len(between), old.copy()
    tables = [between.T, between]          # by class of the neighbour and class of the word
    small = np.arange(33.0)[:, None, None]
    more = [_xlogx(t + small) - _xlogx(t) for t in tables]
    sizes = between.sum(axis=1)
    ends = np.append(start[1:], len(code))
    cuts = np.append(np.searchsorted(start, np.arange(0, len(code), 1 << 15)), len(start))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        x, y = start[a], ends[b - 1]
        side, beside, m = code[x:y] // k, code[x:y] % k, n[x:y]
        gain = np.empty((y - x, k))
        for s in (0, 1):
            few = (side == s) & (m <= 32)
            gain[few] = more[s][m[few], beside[few]]
            many = np.flatnonzero((side == s) & (m > 32))
            gain[many] = _xlogx(tables[s][beside[many]] + m[many, None]) - _xlogx(tables[s][beside[many]])
        mine = np.repeat(old[a:b], ends[a:b] - start[a:b])
        here = np.where(side == 0, between[mine, beside], between[beside, mine])
        gain[np.arange(y - x), mine] = _xlogx(here) - _xlogx(here - m)      # it is counted where it is
        total = np.add.reduceat(gain, start[a:b] - x)
        own = np.add.reduceat(np.where(side == 0, m, 0), start[a:b] - x).astype(float)
        lost = 2 * (_xlogx(sizes + own[:, None]) - _xlogx(sizes))
        at = np.arange(b - a)
        lost[at, old[a:b]] = 2 * (_xlogx(sizes[old[a:b]]) - _xlogx(sizes[old[a:b]] - own))
        total -= lost
        total[:, -1] = -np.inf
        best = total.argmax(axis=1)
        out[a:b] = np.where(total[at, best] > total[at, old[a:b]] + 1e-6, best, old[a:b])
    return out


def _moved(vectors: DataFrame, between: np.ndarray, model: ClassModel, sweep: int, parts: int) -> DataFrame:
    """Blocks of the table of words after those whose turn it is have gone to their best classes: one of so many parts of all
    words in each sweep, but none with a symbol of its own."""
    sent, k = vectors.sparkSession.sparkContext.broadcast((between, model.own)), len(between)

    def rows(batches):
        for batch in batches:
            for number, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "data"))):
                word, code, times, of = blocks.unpack(n, data, *TYPES[ENTRIES])
                start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                old, code = of[start].astype(np.int64), code.astype(np.int64)
                table, own = sent.value
                fixed = (old == k - 1) | np.isin(word[start], own) | (word[start] % np.uint64(parts) != np.uint64(sweep % parts))
                new = np.where(fixed, old, best_classes(start, code, times, np.minimum(old, k - 2), table))
                total = np.add.reduceat(np.where(code < k, times, 0), start)
                words = word[start] != END
                yield blocks.pack(np.full(words.sum(), number), TABLE, word[start][words], new[words].astype(np.uint16), total[words])

    return vectors.where(F.col("kind") == ENTRIES).mapInArrow(rows, blocks.SCHEMA)


def _hot_classes(table: DataFrame, model: ClassModel) -> np.ndarray:
    sent = table.sparkSession.sparkContext.broadcast(model.hot)

    def rows(parts):
        for batch in _table_rows(parts):
            word = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(np.isin(word, sent.value)))

    found = table.mapInArrow(rows, "word long, n long, class int").select("word", "class").toArrow()
    out = np.zeros(len(model.hot), np.int64)
    if len(out):
        out[np.searchsorted(model.hot, found["word"].to_numpy().astype(np.int64).view(np.uint64))] = found["class"].to_numpy()
    return out


def _longs(docs: DataFrame, values: list[int]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(v,) for v in values], "word long")


def _bigrams(texts: DataFrame, model: ClassModel) -> np.ndarray:
    """Counts of neighbouring symbols in all texts, from end to end; as many as symbols squared at most."""
    size = model.n_symbols
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def rows(parts):
        total = np.zeros(size * size, np.int64)
        for batch in parts:
            for _, h, at, tails in _parts(batch, 1):
                symbol, _ = sent.value.symbols(h, tails)
                line = np.insert(symbol, at[1:], size - 1).astype(np.int64)
                total += np.bincount(np.append(size - 1, line[:-1]) * size + line, minlength=size * size) if len(line) else 0
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["pair", "n"])

    found = texts.mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy().astype(np.int64)] = found["n"].to_numpy()
    return out.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """Class of each symbol. The last symbol, the end, has a class of its own.

    Symbols are dealt to classes by frequency; then each is moved to the class that most raises
    the sum of N(g, h) log N(g, h) - N(g) log N(g) - N(h) log N(h), until a sweep moves none (or after so many `sweeps`).
    """
    size = len(bigrams)
    classes = max(1, min(classes, size - 1))
    of = np.empty(size, np.int64)
    order = np.argsort(-bigrams[:-1].sum(axis=1), kind="stable")
    of[order] = np.arange(size - 1) % classes
    of[-1] = classes
    member = np.zeros((size, classes + 1))
    member[np.arange(size), of] = 1
    table = member.T @ bigrams @ member
    log = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            out_w, in_w, loop = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            old = of[w]
            table[old] -= out_w
            table[:, old] -= in_w
            table[old, old] += loop
            out_w[old] -= loop
            in_w[old] -= loop
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            entry = log(table)
            # What changes if w joins class g: row g gains out_w, column g gains in_w, the corner both and the loop.
            with_row, with_col = table + out_w[None, :], table + in_w[:, None]
            gain = (log(with_row) - entry).sum(axis=1) + (log(with_col) - entry).sum(axis=0)
            d = np.arange(classes + 1)
            corner = table[d, d]
            gain += (log(corner + out_w + in_w + loop) - log(corner)
                     - (log(corner + out_w) - log(corner)) - (log(corner + in_w) - log(corner)))
            gain -= log(rows + out_w.sum() + loop) - log(rows) + log(cols + in_w.sum() + loop) - log(cols)
            gain[classes] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[new] += out_w
            table[:, new] += in_w
            table[new, new] += loop
            member[w, old], member[w, new] = 0, 1
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model), both log10."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = _texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())

    def local(parts):
        for batch in parts:
            for part, h, at, tails in _parts(batch, 1):
                yield _near(sent.value, part, h, at, tails)

    def whole(parts):
        for batch in parts:
            for part in hashing.sliced(batch, 4, 2 << 20):
                yield _scored(sent.value, part)

    schema = "row long, id long, n_tokens long, n_known long, classes binary, logs double, rare array<long>, places array<array<int>>"
    near = written(rows.select("id", "text", "row").mapInArrow(local, schema), "scores")
    far = near.select("row", F.explode(F.arrays_zip("rare", "places")).alias("w")) \
        .select("row", F.col("w.rare").alias("word"), F.col("w.places").alias("places"))
    met = far.join(counts.select("word", "n", "class"), "word").groupBy("row").agg(F.collect_list(F.struct("n", "class", "places")).alias("met"))
    return near.drop("rare", "places").join(met, "row", "left").select("row", "id", "n_tokens", "n_known", "classes", "logs", "met") \
        .mapInArrow(whole, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _near(model: ClassModel, part, h, at, tails) -> pa.RecordBatch:
    """What the bounded tables tell: the classes of the words of each text, of hot ones the sum of log10 (c + 1); and the places
    of its other words."""
    n = part.num_rows
    found, place = model.classed(h, tails)
    times = np.where(place >= 0, model.hot_counts[place], 0) if len(model.hot) else np.zeros(len(h), np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    logs = np.bincount(owner, np.log10(times + 1.0), n).astype(float)
    known = np.bincount(owner, times > 0, n).astype(np.int64)
    classes = found.astype(np.min_scalar_type(model.end)).tobytes()
    width = np.min_scalar_type(model.end).itemsize
    far = np.flatnonzero(place < 0)
    key = np.lexsort((h[far], owner[far]))
    o, w, spot = owner[far][key], h[far][key], (far - at[owner[far]])[key]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1]))) if len(o) else np.zeros(0, np.int64)
    spots = pa.ListArray.from_arrays(pa.array(np.append(first, len(o)), pa.int32()), pa.array(spot, pa.int32()))
    cut = pa.array(np.searchsorted(o[first], np.arange(n + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [part.column(2), part.column(0), pa.array(np.diff(at) + 1, pa.int64()), pa.array(known),
         pa.array([classes[x * width:y * width] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.array(logs),
         pa.ListArray.from_arrays(cut, pa.array(w[first].view(np.int64), pa.int64())), pa.ListArray.from_arrays(cut, spots)],
        names=["row", "id", "n_tokens", "n_known", "classes", "logs", "rare", "places"])


def _scored(model: ClassModel, part) -> pa.RecordBatch:
    """Scores of texts with the classes of all their words; `met` has number, class and places of the known ones that are not hot."""
    n, lengths = part.num_rows, part.column(2).to_numpy() - 1
    at = np.append(0, np.cumsum(lengths))
    found = np.frombuffer(b"".join(part.column(4).to_pylist()), np.min_scalar_type(model.end)).astype(np.int64)
    logs, known = part.column(5).to_numpy().copy(), part.column(3).to_numpy() + (model.ends > 0)
    met = part.column(6)
    words = met.flatten()
    text = np.repeat(np.arange(n), met.value_lengths().fill_null(0).to_numpy())
    numbers, of, places = (words.field(i) for i in range(3))
    times = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    spot = np.repeat(at[text], times) + places.flatten().to_numpy(zero_copy_only=False)
    found[spot] = np.repeat(of.to_numpy(zero_copy_only=False), times)
    logs += np.bincount(text, times * np.log10(numbers.to_numpy(zero_copy_only=False) + 1.0), n)
    known = known + np.bincount(text, times, n).astype(np.int64)
    owner = np.repeat(np.arange(n), lengths)
    line, whose = np.insert(found, at[1:], model.end), np.insert(owner, at[1:], np.arange(n))
    steps = model.transition[np.append(model.end, line[:-1]), line] - model.room[line]
    base = logs + np.log10(model.ends + 1.0) - (lengths + 1) * np.log10(model.tokens + model.distinct + 1.0)
    return pa.RecordBatch.from_arrays(
        [part.column(1), part.column(2), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(np.bincount(whose, steps, n) + logs)],
        names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
