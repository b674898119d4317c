"""Language identification by words first, then ever shorter character n-grams.

A model holds, per language, the log frequency of its most frequent words and of the
character n-grams of all its words. A word of a text that the model knows adds its log
frequency in each language. An unseen word is scored by its longest n-grams that the model
knows, backing off from `sizes[0]` characters to one.

Defined cases: a null text, an empty one, or one without a letter is `und` with score 0.
Without training rows everything is `und`. A text of which nothing is known gets the most
frequent language. Ties go to the language that sorts first. Other columns are ignored.
"""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if there is no letter."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, size: int) -> list[str]:
    """Character n-grams of a word with its borders marked; a single character stands alone."""
    marked = f"<{word}>" if size > 1 else word
    return [marked[i:i + size] for i in range(len(marked) - size + 1)]


@dataclass
class LanguageModel:
    """Log frequencies (rows: words or n-grams, columns: languages). Its size is bounded by the limits of `train`."""
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    sizes: tuple[int, ...]
    remembered: int = 200_000
    _seen: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def _unseen(self, word: str) -> np.ndarray | None:
        for size in self.sizes:
            known = [r for g in grams_of(word, size) if (r := self.grams.get(g)) is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return None

    def _row(self, word: str) -> int:
        """The row of a word; rows of unseen words are kept behind those of known ones."""
        if self._rows is None or len(self._seen) >= self.remembered:
            self._seen = {}
            self._rows = np.zeros((len(self.words) + self.remembered, len(self.languages)))
            self._rows[:len(self.words)] = self.word_logs
        at = len(self.words) + len(self._seen)
        logs = self._unseen(word)
        if logs is not None:
            self._rows[at] = logs
        self._seen[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a whole text, and its share among all languages."""
        counts = Counter(words_of(text))
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        total = self.prior.copy()
        items = list(counts.items())
        for k in range(0, len(items), self.remembered // 2):
            part = items[k:k + self.remembered // 2]
            if self._rows is None or len(self._seen) + len(part) > self.remembered:
                self._rows = None
                self._seen = {}
            known, seen, row = self.words, self._seen, self._row
            rows = [r if (r := known.get(w)) is not None else s if (s := seen.get(w)) is not None else row(w)
                    for w, _ in part]
            if self._rows is None:
                self._rows = self.word_logs
            times = np.fromiter((n for _, n in part), float, len(part))
            total += times @ self._rows[rows]
            if self._rows is self.word_logs:
                self._rows = None
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000,
          words_per_language: int = 50_000, grams_per_language: int = 100_000,
          sizes: tuple[int, ...] = (4, 3, 2, 1), smoothing: float = 0.5) -> LanguageModel:
    """Fit on about `sample_rows` labelled rows, chosen by a hash of text and position-free row content.

    The sample and both limits bound the model, which is sent to every task. Rows without a language are left out.
    Runs four Spark jobs; the counts are made and cut to the limits before they reach the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    total = rows.count()
    part = min(1.0, sample_rows / max(1, total))
    keys = F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith("map")]), F.lit(1 << 30))
    sample = rows.where(keys < int(part * (1 << 30))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def batch_of(found: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()),
             pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    def count(parts):
        for batch in parts:
            found = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(words_of(text)).items():
                    found[lang, word] += n
            yield batch_of(found)

    def cut(parts):
        for batch in parts:
            found = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in sizes:
                    for g in grams_of(word, size):
                        found[lang, g] += n
            yield batch_of(found)

    def most(counts: DataFrame, limit: int) -> pd.DataFrame:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        return (counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
                .select("lang", "word", "n").toArrow().to_pandas())

    schema = "lang string, word string, n long"
    words = sample.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(cut, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    prior = np.log(np.array([sums[x] for x in languages], float) / max(1, sum(sums.values())))
    return LanguageModel(languages, prior, *_logs(most(words, words_per_language), languages, smoothing),
                         *_logs(most(grams, grams_per_language), languages, smoothing), sizes)


def _logs(counts: pd.DataFrame, languages: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    names = {w: i for i, w in enumerate(sorted(set(counts["word"])))}
    table = np.full((len(names), len(languages)), smoothing)
    at = {x: i for i, x in enumerate(languages)}
    table[[names[w] for w in counts["word"]], [at[x] for x in counts["lang"]]] += counts["n"].to_numpy()
    return names, np.log(table) - np.log(table.sum(axis=0, keepdims=True)) if len(names) else table


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score") -> DataFrame:
    """All columns of `docs` with the language and score of every whole text. Existing columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select([F.col(f"`{c}`") for c in kept]).schema.add(lang_out, "string").add(score_out, "double")

    def rows(parts):
        for batch in parts:
            found = [sent.value.predict(t) for t in batch.column(kept.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, lang_out, score_out])

    return docs.select([F.col(f"`{c}`") for c in kept]).mapInArrow(rows, schema)
