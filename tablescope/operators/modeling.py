"""Baseline models and what their fit says about the data."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.schema import num, quoted
from tablescope.functions.stats import rounded
from tablescope.operators import logistic
from tablescope.operators.ordering import split_at_fraction
from tablescope.sources.sampling import hash_key
from tablescope.sources.tables import materialise

# The published limits of the diagnosis.
OVERFIT_TRAIN, OVERFIT_GAP, UNDERFIT = 0.95, 0.05, 0.75
DOMINANCE = 5
CURVE_FRACTIONS = (0.1, 0.325, 0.55, 0.775, 1.0)
FOLDS = 5
MAX_ITER = 1000


def assembled(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Vector column `features` and double column `label` from rows without gaps."""
    from pyspark.ml.feature import VectorAssembler
    rows = df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(features)],
                     num(target).alias("label"), *[F.col(quoted(c)) for c in keep]).dropna()
    inputs = [f"x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).drop(*inputs)


def baseline_classifier(train: DataFrame, n_rows: int | None = None):
    """Logistic regression on `assembled` rows: unscaled, unit L2 penalty on the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    n = train.count() if n_rows is None else n_rows
    return LogisticRegression(maxIter=MAX_ITER, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                              standardization=False, tol=1e-4).fit(train)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(rounded(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4)
                           .alias("accuracy"))


def fit_diagnosis(train_accuracy: Column, validation_accuracy: Column) -> Column:
    return (F.when((train_accuracy > OVERFIT_TRAIN)
                   & (train_accuracy - validation_accuracy > OVERFIT_GAP), "Overfitting")
            .when((train_accuracy < UNDERFIT) & (validation_accuracy < UNDERFIT), "Underfitting")
            .otherwise("Healthy"))


def baseline_report(split: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Train on the `train` rows of a split table; accuracy on both parts and the diagnosis."""
    rows = assembled(split, features, target, keep=["split"])
    model = baseline_classifier(rows.filter("split = 'train'"))
    hit = (F.col("label") == F.col("prediction")).cast("double")
    scored = model.transform(rows).agg(
        F.avg(F.when(F.col("split") == "train", hit)).alias("t"),
        F.avg(F.when(F.col("split") != "train", hit)).alias("v"))
    return scored.select(rounded(F.col("t"), 4).alias("train_accuracy"),
                         rounded(F.col("v"), 4).alias("validation_accuracy"),
                         rounded(F.col("t") - F.col("v"), 4).alias("accuracy_gap"),
                         fit_diagnosis(F.col("t"), F.col("v")).alias("diagnosis"))


def coefficient_importance(model, features: Sequence[str], spark, k: int | None = 10) -> DataFrame:
    """Coefficients by absolute size (all with `k=None`)."""
    rows = [(c, float(w)) for c, w in zip(features, model.coefficients)]
    table = spark.createDataFrame(rows, "feature string, coefficient double")
    table = table.orderBy(F.abs("coefficient").desc(), "feature")
    return table if k is None else table.limit(k)


def dominance_check(importance: DataFrame) -> DataFrame:
    """Is the largest coefficient more than five times the mean one?"""
    size = F.abs("coefficient")
    one = importance.agg(F.max_by("feature", size).alias("dominant_feature"),
                         F.max(size).alias("strength"), F.avg(size).alias("mean_strength"))
    return one.select("dominant_feature", rounded(F.col("strength"), 4).alias("strength"),
                      rounded(F.col("mean_strength"), 4).alias("mean_strength"),
                      (F.col("strength") > DOMINANCE * F.col("mean_strength")).alias("suspicious"))


def root_causes(of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Diagnosed causes with their remedy, one row each.

    Input rows carry `missing_total, imbalanced, diagnosis, suspicious, n_correlated_pairs`.
    """
    c = F.col
    rules = [(c("missing_total") > 0, "missing values", "impute"),
             (c("imbalanced"), "class imbalance", "class weights or resampling"),
             (c("diagnosis") == "Overfitting", "overfitting", "regularise or simplify"),
             (c("diagnosis") == "Underfitting", "underfitting", "richer model or features"),
             (c("suspicious"), "feature dominance", "check for leakage"),
             (c("n_correlated_pairs") > 0, "correlated features", "select features")]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(cause).alias("root_cause"),
                                                     F.lit(cure).alias("recommendation")))
                               for test, cause, cure in rules]), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("none").alias("root_cause"), F.lit("healthy").alias("recommendation")))
    return of.select(*by, F.inline(F.when(F.size(found) > 0, found).otherwise(none)))


def hash_fold(key: str, folds: int = FOLDS, seed: int = 42) -> Column:
    """Fold number of a row, from the hash of its unique key."""
    return F.pmod(F.conv(F.substring(hash_key(key, seed), 1, 15), 16, 10).cast("bigint"),
                  F.lit(folds)).cast("int")


def learning_curve(df: DataFrame, features: Sequence[str], target: str, key: str,
                   fractions: Sequence[float] = CURVE_FRACTIONS, folds: int = FOLDS) -> DataFrame:
    """Mean train and validation accuracy per share of the training rows used.

    All fits share each scan of the rows (see `logistic`). A fit whose rows show one class only is left out.
    """
    share = F.conv(F.substring(hash_key(key, 7), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    number = [(i, f, fold) for i, f in enumerate(fractions) for fold in range(folds)]
    fold_of = hash_fold(key, folds)
    trains = F.filter(F.array(*[F.when((fold_of != fold) & (share < f), F.lit(i * folds + fold)) for i, f, fold in number]),
                      lambda k: k.isNotNull())
    tests = F.array(*[F.lit(i * folds) + fold_of for i in range(len(fractions))])
    rows = materialise(logistic.prepared(df, features, target, trains, tests), "curve-rows")
    fits = logistic.fit_many(rows, len(number), len(features))
    of = logistic.accuracies(rows, fits, len(number), len(features))
    share_of = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.expr(f"fit div {folds} + 1").cast("int"))
    train, ahead = F.col("part") == "train", F.col("part") == "test"
    rate = F.col("hits") / F.col("n")
    return of.groupBy(share_of.alias("fraction")).agg(
        rounded(F.avg(F.when(train, F.col("n"))), 1).alias("mean_train_rows"),
        rounded(F.avg(F.when(train, rate)), 4).alias("train_accuracy"),
        rounded(F.avg(F.when(ahead, rate)), 4).alias("validation_accuracy"))


def expanding_blocks(df: DataFrame, order_by: Sequence[str], folds: int = FOLDS, out: str = "block") -> DataFrame:
    """The table with its block in key order: `folds` + 1 blocks, of which the k-th ends with row floor(k n / (folds + 1))."""
    if out in df.columns:
        raise ValueError(f"the table has a column {out}")
    later = [f"_later{k}" for k in range(1, folds + 1)]
    cut = df
    for k, name in enumerate(later, 1):
        cut = split_at_fraction(cut, order_by, k / (folds + 1), name)
    return cut.withColumn(out, sum((F.col(c).cast("int") for c in later), F.lit(0))).drop(*later)


def expanding_folds(df: DataFrame, order_by: Sequence[str], target: str, folds: int = FOLDS) -> DataFrame:
    """Fold k learns from blocks 0 to k - 1 and is judged on block k: row counts, and how often the most frequent class
    of the training rows (ties: the least) is right ahead. Rows without a target are left out."""
    counts = expanding_blocks(df.where(F.col(quoted(target)).isNotNull()), order_by, folds) \
        .groupBy("block", F.col(quoted(target)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    fold = F.explode(F.sequence(F.greatest("block", F.lit(1)), F.lit(folds))).alias("fold")
    of = counts.select("block", "label", "n", fold).groupBy("fold", "label").agg(
        F.coalesce(F.sum(F.when(F.col("block") < F.col("fold"), F.col("n"))), F.lit(0)).alias("t"),
        F.coalesce(F.sum(F.when(F.col("block") == F.col("fold"), F.col("n"))), F.lit(0)).alias("v"))
    best = of.groupBy("fold").agg(F.sum("t").alias("train_rows"), F.sum("v").alias("validation_rows"),
                                  F.min(F.when(F.col("t") > 0, F.struct(-F.col("t"), "label", "v"))).alias("best"))
    return best.select("fold", "train_rows", "validation_rows", F.col("best.label").alias("majority"),
                       rounded(F.col("best.v") / F.col("validation_rows"), 4).alias("majority_accuracy"))


def cross_validate(df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str], folds: int = FOLDS) -> DataFrame:
    """Train and validation accuracy of the baseline model in each expanding-window fold; the fits share each scan."""
    ahead = F.col("block")
    trains = F.when(ahead < folds, F.sequence(ahead, F.lit(folds - 1))).otherwise(F.array().cast("array<int>"))
    tests = F.when(ahead > 0, F.array(ahead - 1)).otherwise(F.array().cast("array<int>"))
    rows = materialise(logistic.prepared(expanding_blocks(df, order_by, folds), features, target, trains, tests), "fold-rows")
    of = logistic.accuracies(rows, logistic.fit_many(rows, folds, len(features)), folds, len(features))
    train, test = F.col("part") == "train", F.col("part") == "test"
    rate = F.col("hits") / F.col("n")
    return of.groupBy((F.col("fit") + 1).alias("fold")).agg(
        F.max(F.when(train, F.col("n"))).alias("train_rows"), F.max(F.when(test, F.col("n"))).alias("validation_rows"),
        rounded(F.max(F.when(train, rate)), 4).alias("train_accuracy"),
        rounded(F.max(F.when(test, rate)), 4).alias("validation_accuracy"))


def chronological_split(df: DataFrame, order_by: Sequence[str], train: float = 0.8) -> DataFrame:
    """The table with a column `split`: the first rows in time train, the rest validate."""
    cut = split_at_fraction(df, order_by, train, "_later")
    return cut.withColumn("split", F.when(F.col("_later"), "validation").otherwise("train")).drop("_later")
