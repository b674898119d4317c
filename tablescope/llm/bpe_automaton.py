"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state that accepts every sequence of base symbols. Each
merge (a, b), in order, adds a gadget: the states that arcs labelled a lead to lose
their arc labelled b, and a new arc labelled ab takes its place. At the end the paths
of the automaton are exactly the token sequences that the merges produce, so a word
has one path.

A state is known by the token that leads to it, and a gadget changes few arcs, so the
automaton is kept as its gadgets: which arc was cut, when, and when each label came
up. Rows of the transition table are filled from them when they are first read.
Encoding runs over the prefixes of a word; each prefix has one last token, the
longest that the automaton lets follow the last token of what precedes it.
Decoding emits the labels of the arcs.

Defined cases: a null text is empty and has no tokens; an empty result decodes to the
empty text; symbols outside the vocabulary are left out, as the file names no unknown token.
"""

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 60
# White space as Unicode defines it (fixed values of the format).
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges. Tokens are numbered as in the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.word_end = word_end
        self.labels = {i: t for t, i in vocabulary.items()}
        self.number = vocabulary
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for when, (a, b) in enumerate(merges):
            if a in vocabulary and b in vocabulary and a + b in vocabulary:
                self._gadget(vocabulary[a], vocabulary[b], vocabulary[a + b], when)
        self._compile(vocabulary)

    def _compile(self, vocabulary: dict[str, int]) -> None:
        """The labels as a tree of symbols, and an empty row of the transition table for each state."""
        self._base = {t for t in vocabulary if len(t.removesuffix(self.word_end) or t) == 1}
        self._arcs: dict = {}
        for label, token in vocabulary.items():
            if label in self._base or token in self.born:
                text = label.removesuffix(self.word_end) or label
                symbols = [*text[:-1], text[-1] + label[len(text):]]
                arcs = self._arcs
                for s in symbols[:-1]:
                    arcs = arcs.setdefault(s, [{}, None])[0]
                arcs.setdefault(symbols[-1], [{}, None])[1] = token
        self._rows: dict[int | None, dict[int, bool]] = {t: {} for t in [None, *vocabulary.values()]}
        self._spines = {t: list(self._spine(t, 0)) for t in vocabulary.values()}

    def _gadget(self, a: int, b: int, ab: int, when: int) -> None:
        """States behind arcs a lose arc b from now on; arc ab leads on instead."""
        self.cut.setdefault((a, b), when)
        if ab not in self.born:
            self.halves[ab], self.born[ab] = (a, b), when

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The token and its outermost parts, each with the time from which it is hidden inside a larger one."""
        until = NEVER
        while True:
            yield token, until
            if token not in self.halves:
                return
            until, token = self.born[token], self.halves[token][side]

    def allowed(self, before: int, token: int) -> bool:
        """Whether the state behind `before` has an arc `token`."""
        # A cut counts if both its ends were still outermost then; the leftmost of equal merges goes first.
        covered = self._spines[token]
        for r, hidden in self._spine(before, 1):
            for x, until in covered:
                when = self.cut.get((r, x))
                if when is not None and when < hidden and when <= until:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given in byte symbols."""
        symbols = [*word[:-1], word[-1] + self.word_end]
        if not self._base.issuperset(symbols):
            symbols = [s for s in symbols if s in self._base]
        size = len(symbols)
        last, back = [-1] * size, [0] * size
        for start in range(size):
            before = last[start - 1] if start else None
            row = self._rows[before]
            arcs = self._arcs
            for end in range(start, size):
                node = arcs.get(symbols[end])
                if node is None:
                    break
                arcs, token = node
                if token is not None and last[end] < 0:
                    fits = row.get(token)
                    if fits is None:
                        fits = row[token] = before is None or self.allowed(before, token)
                    if fits:
                        last[end], back[end] = token, start
        out, end = [], size
        while end:
            out.append(last[end - 1])
            end = back[end - 1]
        return out[::-1]


class WordTokenizer:
    """A tokenizer file of the word kind: splits special tokens off, normalises, pre-splits, encodes, decodes."""

    REMEMBERED = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = pattern.replace("\\s", SPACE)
        self._splits = None
        self._known: dict[str, tuple[str, str, int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_splits": None, "_known": {}}

    def _prepare(self) -> None:
        special = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self._splits = regex.compile(f"({special})") if special else None
        self._find = regex.compile(self._words).findall
        self._symbols = byte_symbols()

    def _word(self, word: str) -> tuple[str, str, int]:
        """Ids and labels of a word as text, and how many."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) >= self.REMEMBERED:
                self._known.clear()
            ids = self.automaton.encode_word("".join([self._symbols[b] for b in word.encode()]))
            known = " ".join(map(str, ids)), " ".join([self.labels[i] for i in ids]), len(ids)
            self._known[word] = known
        return known

    def pieces(self, text: str | None) -> Iterator[tuple[str, str, int]]:
        """(ids, labels, count) of each word or special token of a text."""
        if self._splits is None:
            self._prepare()
        text = text or ""
        for k, part in enumerate(self._splits.split(text) if "<|" in text else [text]):
            if k % 2:
                yield str(self.special[part]), part, 1
            elif part:
                part = unicodedata.normalize("NFC", part)
                for word in self._find(_lower(part)):
                    found = self._word(word)
                    if found[2]:
                        yield found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by blanks, as the file names no other decoder; unknown ids are left out."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


def _lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma does not depend on its place in the word."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def encode_texts(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens): the token ids of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def rows(parts):
        for batch in parts:
            ids = [sent.value.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "tokens"])

    return _texts(docs, id_col, text_col).mapInArrow(rows, "id long, tokens array<int>")


def decode_tokens(encoded: DataFrame, tokenizer: WordTokenizer) -> DataFrame:
    """(id, text) from (id, tokens); null tokens are none."""
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def rows(parts):
        for batch in parts:
            texts = [sent.value.decode(t or []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "tokens").mapInArrow(rows, "id long, text string")


def digests(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def rows(parts):
        for batch in parts:
            n, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = list(sent.value.pieces(text))
                n.append(sum([p[2] for p in found]))
                ids.append(hashlib.sha256(" ".join([p[0] for p in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([p[1] for p in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(
        rows, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, decoded): token ids of every whole text, and the text that they decode to."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def rows(parts):
        for batch in parts:
            ids = [sent.value.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([sent.value.decode(t) for t in ids], pa.string())],
                names=["id", "tokens", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(rows, "id long, tokens array<int>, decoded string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
