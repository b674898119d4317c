"""Toxic passages as maximum-scoring segments of token log-odds.

Each word, and each beginning of words, has a log-odds between toxic and clean training
texts under an informative Dirichlet prior, the corpus' own frequencies; a rare word is
scored by its longest beginning that tells. A text is then a row of scores, less a
drift that makes clean text lose. All maximal segments are found in one pass; the length
of a text and the spread of the best segments of clean texts tell how surprising a
segment is (extreme-value statistics), and the evidence of the significant ones is
calibrated to a probability.

Defined cases: null and empty texts have no passages and get the score of no evidence.
Rows without a label, and labels without a document, teach nothing; a document with
several labels counts as toxic if one says so. Without toxic or without clean training rows
the score is the share of toxic ones (0 without any). Other columns are ignored.
"""

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import hashing
from tablescope.llm.storage import written

WORDS = hashing.ascii_words_table()
SUPPORT = 8  # texts in which a word speaks for itself
STEMS = (4, 5, 6, 7, 8)  # bytes of the beginnings that stand for rare words


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def tokens_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, longest first."""
    return [word, *(b"^" + word[:k] for k in reversed(STEMS) if len(word) >= k)]


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all disjoint maximal-scoring segments, end exclusive, in linear time.

    Each positive score opens a segment. It is put behind the nearest earlier one that begins at a lower
    running sum, and swallows everything since then if that raises the sum. Each segment knows its nearest
    earlier one that begins lower, so those in between are passed over once and never looked at again.
    """
    # start, end, running sum before, running sum behind, place of the nearest that begins lower
    open_: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= before:
                k = open_[k][4]
            if k < 0 or open_[k][3] >= total:
                open_.append((start, i + 1, before, total, k))
                break
            start, before = open_[k][0], open_[k][2]
            del open_[k:]
    return [(a, b, r - l) for a, b, l, r, _ in open_]


@dataclass
class ToxicityModel:
    """Scores of the words that tell, bounded by `words` of `train`, and the calibration."""
    scores: dict[bytes, float]
    drift: float
    location: float  # of the best segment of clean texts, for one word
    scale: float
    weights: np.ndarray  # intercept, then those of `evidence`

    def __post_init__(self):
        self.roots = {w.lstrip(b"^")[:STEMS[0]] for w in self.scores}

    def token(self, word: bytes) -> float | None:
        """Score of a word, or of its longest beginning that tells."""
        for t in tokens_of(word):
            if (s := self.scores.get(t)) is not None:
                return s
        return None

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal segments as (first word, end, sum), and the number of words."""
        words = words_of(text)
        drift, roots = self.drift, self.roots
        telling = [(i, s) for i, w in enumerate(words) if w[:STEMS[0]] in roots and (s := self.token(w)) is not None]
        line, at, run = [], [], 0
        for i, s in telling:  # a run of words that say nothing is one loss
            if i > run:
                line.append(-drift * (i - run))
                at.append((run, i))
            line.append(s - drift)
            at.append((i, i + 1))
            run = i + 1
        return [(at[a][0], at[b - 1][1], total) for a, b, total in maximal_segments(line)], len(words)

    def significant(self, segments: list[tuple[int, int, float]], n_words: int) -> list[tuple[int, int, float]]:
        """Segments that a clean text of this length has by chance in one of twenty cases, with their evidence."""
        chance = self.location + self.scale * np.log(max(1, n_words))
        found = [(a, b, (total - chance) / self.scale) for a, b, total in segments]
        return [f for f in found if f[2] > -np.log(-np.log(0.95))]

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant passages as (first word, end, evidence)."""
        return self.significant(*self.segments(text))

    def score(self, found: list[tuple[int, int, float]]) -> float:
        e = evidence([f[2] for f in found])
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.append(1.0, e), -50, 50))))


def evidence(found: Sequence[float]) -> np.ndarray:
    """The best and the summed evidence of significant passages and their number, damped."""
    top, total, n = max(found, default=0.0), sum(found), len(found)
    return np.array([np.log1p(top), np.log1p(total), np.sqrt(total), np.sqrt(n)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = 20_000, words: int = 50_000, prior_share: float = 0.05, drift: float = 1.0) -> ToxicityModel:
    """Fit on about `sample_rows` labelled rows chosen by a hash of the id: half for word counts, half for calibration.

    A word counts once per text, so one repetitive text teaches little. The prior weighs `prior_share` of all counts.
    """
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("toxic")))
    part = min(1.0, sample_rows / max(1, marks.count()))
    key = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = marks.where(key < int(part * (1 << 30))).withColumn("half", F.pmod(key, F.lit(2)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = written(texts.join(chosen, "id").select("text", "toxic", "half"), "labelled")

    def count(parts):
        for frame in parts:
            both = [Counter(), Counter()]
            for text, toxic in zip(frame["text"], frame["toxic"]):
                both[int(toxic > 0)].update({t for w in set(words_of(text)) for t in tokens_of(w)})
            names = sorted(set(both[0]) | set(both[1]))
            yield pd.DataFrame({"word": names, "clean": [both[0][w] for w in names], "toxic": [both[1][w] for w in names]},
                               columns=["word", "clean", "toxic"]).astype({"clean": "int64", "toxic": "int64"})

    counts = written(sample.where("half = 0").mapInPandas(count, "word binary, clean long, toxic long")
                     .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-labels")
    sums = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    share = sample.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0] or 0.0
    if not sums.clean or not sums.toxic:
        level = float(np.clip(share, 1e-9, 1 - 1e-9))
        return ToxicityModel({}, drift, 0.0, 1.0, np.array([np.log(level / (1 - level)), 0.0, 0.0, 0.0, 0.0]))
    scores = {bytes(r.word): float(r.odds) for r in _log_odds(counts, sums, prior_share, words).itertuples()}
    model = ToxicityModel(scores, drift, 0.0, 1.0, np.zeros(5))
    return _calibrated(sample.where("half = 1"), model)


def _log_odds(counts: DataFrame, sums, prior_share: float, words: int) -> pd.DataFrame:
    """The `words` words furthest from chance, and only those beyond five deviations."""
    prior = prior_share * (sums.clean + sums.toxic)
    mean = F.lit(prior_share) * (F.col("clean") + F.col("toxic"))
    odds = lambda n, size: F.log((n + mean) / (F.lit(float(size)) + prior - n - mean))
    found = counts.withColumn("odds", odds(F.col("toxic"), sums.toxic) - odds(F.col("clean"), sums.clean)) \
        .withColumn("z", F.abs(F.col("odds")) / F.sqrt(1 / (F.col("toxic") + mean) + 1 / (F.col("clean") + mean)))
    telling = found.where("z >= 5").orderBy(F.desc("z"), "word").limit(words).select("word", "odds").toArrow().to_pandas()
    # A word seen often enough speaks for itself and not through its beginning, also if it says nothing.
    roots = counts.sparkSession.createDataFrame(
        [(x,) for x in sorted({bytes(w).lstrip(b"^")[:STEMS[0]] for w in telling["word"]})], "root binary")
    plain = (found.where(f"z < 5 and clean + toxic >= {SUPPORT} and substring(word, 1, 1) <> X'5E'")
             .withColumn("root", F.expr(f"substring(word, 1, {STEMS[0]})")).join(F.broadcast(roots), "root")
             .orderBy(F.desc(F.col("clean") + F.col("toxic")), "word").limit(words)
             .select("word", F.lit(0.0).alias("odds")).toArrow().to_pandas())
    return pd.concat([telling, plain])


def _calibrated(sample: DataFrame, model: ToxicityModel) -> ToxicityModel:
    """The Gumbel law of clean texts' best segments by moments, then a logistic fit of the evidence."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(parts):
        for frame in parts:
            found = [sent.value.segments(t) for t in frame["text"]]
            yield pd.DataFrame({"toxic": (frame["toxic"] > 0).astype(float), "words": [n for _, n in found],
                                "sums": [[float(s[2]) for s in f] for f, _ in found]})

    rows = sample.mapInPandas(measure, "toxic double, words long, sums array<double>").toArrow().to_pandas()
    best = np.array([max(s, default=0.0) for s in rows["sums"]], float)
    logs = np.log(np.maximum(1.0, rows["words"].to_numpy(float)))
    clean = rows["toxic"].to_numpy() == 0
    if clean.any():
        model.scale = max(0.25, float(np.std(best[clean])) * np.sqrt(6) / np.pi)
        model.location = float(np.mean(best[clean] - model.scale * logs[clean])) - 0.5772 * model.scale
    x = [evidence([f[2] for f in model.significant([(0, 0, v) for v in s], n)]) for s, n in zip(rows["sums"], rows["words"])]
    model.weights = _logistic(np.column_stack([np.ones(len(rows)), np.array(x).reshape(-1, 4)]), rows["toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


PASSAGES = "array<struct<first_word:int,end_word:int,evidence:double>>"


def detect(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, score, and its significant passages (word positions from 0, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(parts):
        for batch in parts:
            found = [sent.value.passages(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sent.value.score(f) for f in found], pa.float64()),
                 pa.array([[{"first_word": a, "end_word": b, "evidence": e} for a, b, e in f] for f in found],
                          pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("evidence", pa.float64())])))],
                names=["id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(rows, f"id long, score double, passages {PASSAGES}")
