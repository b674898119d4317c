"""Many logistic regressions at once: every Newton step of all fits is one scan of the rows.

Each row says which fits it trains. A task adds up, for each fit, the loss, the gradient and the Hessian of its rows;
these sums have a size that follows the number of columns, not of rows, and are added across tasks. The
steps themselves are small linear systems on the driver. The loss is the summed log loss plus half
`penalty` times the squared coefficients; intercepts are free. Two classes have one logit, more have one each.

Defined cases: a fit learns only the classes that its rows show. One that shows fewer than two is not fitted. More than
MAX_CLASSES different labels raise ValueError.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num, quoted

MAX_CLASSES = 100


@dataclass
class Fit:
    """`weights`: one row of intercept and coefficients for each logit."""
    classes: tuple[float, ...]
    n_rows: int
    weights: np.ndarray

    @property
    def coefficients(self) -> np.ndarray:
        """Of the second class where there are two, else of the class that moves each feature most."""
        w = self.weights[:, 1:]
        return w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])]


def prepared(df: DataFrame, features: Sequence[str], target: str, trains, tests=None) -> DataFrame:
    """Rows without gaps as x (features), label, trains and tests (arrays of the numbers of fits)."""
    none = F.array().cast("array<int>")
    rows = df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(features)], num(target).cast("double").alias("label"),
                     trains.cast("array<int>").alias("trains"), (none if tests is None else tests.cast("array<int>")).alias("tests"))
    names = [f"x{i}" for i in range(len(features))]
    return rows.dropna(subset=[*names, "label"]).select(
        F.array(*[F.col(quoted(c)).cast("double") for c in names]).cast("array<double>").alias("x"), "label", "trains", "tests")


def _members(lists: pa.Array, n_fits: int) -> np.ndarray:
    """Row by fit: is the row one of the fit's?"""
    lists = lists.fill_null([])
    out = np.zeros((len(lists), n_fits), bool)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def _design(batch, n_features: int) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)
    return np.hstack([np.ones((len(x), 1)), x])


def _logits(x: np.ndarray, fit: Fit) -> np.ndarray:
    z = x @ fit.weights.T
    return np.hstack([np.zeros((len(z), 1)), z]) if len(fit.classes) == 2 else z


def _sums(x: np.ndarray, label: np.ndarray, fit: Fit) -> np.ndarray:
    """Loss, gradient and Hessian of these rows as one vector."""
    z = _logits(x, fit)
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    at = np.searchsorted(fit.classes, label)
    loss = float((np.log(total) + top).sum() - z[np.arange(len(z)), at].sum())
    first = 1 if len(fit.classes) == 2 else 0
    p = (e / total)[:, first:]
    hit = at[:, None] == np.arange(first, len(fit.classes))
    gradient = (p - hit).T @ x
    k, d = p.shape[1], x.shape[1]
    hessian = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            hessian[a, :, b, :] = x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
            hessian[b, :, a, :] = hessian[a, :, b, :].T
    return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])


def _added(rows: DataFrame, fits: dict[int, Fit], n_fits: int, n_features: int) -> dict[int, np.ndarray]:
    """The sums of all fits in one scan."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def partial(parts: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            if not batch.num_rows:
                continue
            x, label = _design(batch, n_features), batch.column("label").to_numpy(zero_copy_only=False)
            member = _members(batch.column("trains"), n_fits)
            for k, fit in sent.value.items():
                mine = member[:, k]
                if mine.any():
                    sums[k] = sums.get(k, 0) + _sums(x[mine], label[mine], fit)
        for k, v in sums.items():
            yield pa.record_batch([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)],
                                  names=["fit", "at", "v"])

    got = rows.select("x", "label", "trains").mapInArrow(partial, "fit int, at int, v double") \
        .groupBy("fit", "at").agg(F.sum("v").alias("v")).toArrow()
    sent.unpersist()
    fit, at, v = (got.column(c).to_numpy() for c in ("fit", "at", "v"))
    out = {}
    for k in fits:
        mine = fit == k
        out[k] = np.zeros(int(mine.sum()))
        out[k][at[mine]] = v[mine]
    return out


def fit_many(rows: DataFrame, n_fits: int, n_features: int, penalty: float = 1.0, max_iter: int = 100,
             tol: float = 1e-9) -> dict[int, Fit]:
    """Fits 0 .. n_fits - 1 of `prepared` rows, in at most max_iter + 1 scans in all. Write or persist the rows first."""
    seen = rows.select(F.explode("trains").alias("fit"), "label").groupBy("fit", "label").agg(F.count(F.lit(1)).alias("n")) \
        .limit(n_fits * MAX_CLASSES + 1).toPandas()
    if len(seen) > n_fits * MAX_CLASSES or seen.groupby("fit")["label"].nunique().gt(MAX_CLASSES).any():
        raise ValueError(f"more than {MAX_CLASSES} classes")
    fits, width = {}, n_features + 1
    for k, part in seen.groupby("fit"):
        classes = tuple(sorted(part["label"]))
        if len(classes) > 1:
            logits = 1 if len(classes) == 2 else len(classes)
            fits[int(k)] = Fit(classes, int(part["n"].sum()), np.zeros((logits, width)))
    shrink = np.full(width, penalty)
    shrink[0] = 0.0
    best = {k: (np.inf, f.weights, np.zeros_like(f.weights)) for k, f in fits.items()}
    step, live = dict.fromkeys(fits, 1.0), set(fits)
    for _ in range(max_iter):
        if not live:
            break
        sums = _added(rows, {k: fits[k] for k in live}, n_fits, n_features)
        for k in sorted(live):
            w = fits[k].weights
            size = w.size
            loss = sums[k][0] + 0.5 * float((shrink * w * w).sum())
            least, at, way = best[k]
            if loss > least + 1e-12 * abs(least):          # too far along the last direction
                step[k] /= 2
                if step[k] < 1e-6:
                    fits[k].weights = at
                    live.discard(k)
                else:
                    fits[k].weights = at + step[k] * way
                continue
            gradient = sums[k][1:1 + size].reshape(w.shape) + shrink * w
            hessian = sums[k][1 + size:].reshape(size, size) + np.diag(np.tile(shrink, len(w)))
            scale = 1.0 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))    # features of very different size
            way = -scale * np.linalg.lstsq(hessian * np.outer(scale, scale), scale * gradient.ravel(), rcond=1e-14)[0]
            way = way.reshape(w.shape)
            best[k], step[k] = (loss, w, way), 1.0
            if np.abs(way).max() <= tol * (1 + np.abs(w).max()):
                live.discard(k)
            else:
                fits[k].weights = w + way
    for k in live:                                          # stopped by max_iter: the best point that was looked at
        fits[k].weights = best[k][1]
    return fits


def accuracies(rows: DataFrame, fits: dict[int, Fit], n_fits: int, n_features: int) -> DataFrame:
    """fit, part (`train`, `test`), n, hits: one scan for all fits. Equal probabilities take the first class."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def partial(parts: Iterator[pa.RecordBatch]):
        count = np.zeros((n_fits, 2, 2), np.int64)
        for batch in parts:
            if not batch.num_rows:
                continue
            x, label = _design(batch, n_features), batch.column("label").to_numpy(zero_copy_only=False)
            roles = [_members(batch.column(c), n_fits) for c in ("trains", "tests")]
            for k, fit in sent.value.items():
                for role, member in enumerate(roles):
                    mine = member[:, k]
                    if mine.any():
                        found = np.array(fit.classes)[_logits(x[mine], fit).argmax(axis=1)]
                        count[k, role] += [int(mine.sum()), int((found == label[mine]).sum())]
        at = [(k, r) for k in sent.value for r in (0, 1) if count[k, r, 0]]
        yield pa.record_batch([pa.array([k for k, _ in at], pa.int32()), pa.array([("train", "test")[r] for _, r in at], pa.string()),
                               *[pa.array([int(count[k, r, c]) for k, r in at], pa.int64()) for c in (0, 1)]],
                              names=["fit", "part", "n", "hits"])

    return rows.mapInArrow(partial, "fit int, part string, n long, hits long") \
        .groupBy("fit", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
