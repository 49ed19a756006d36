"""Explainable default model (ML-1..7) on Spark ML.

* ML-1: one-hot grade and purpose with the alphabetically first level dropped
  (``StringIndexer(alphabetDesc)`` + ``OneHotEncoder(dropLast=True)``).
* ML-2: exact stratified split: per label, the first floor(0.8 n) loans in a
  seeded hash order train, the rest test.  Counts by leading hash bits, and by the
  next bits of the one prefix that holds it, find the loan at the boundary.
* ML-3: standardise the numeric columns with the training mean and
  population standard deviation.
* ML-4: L2 logistic regression with balanced class weights n / (2 n_c);
  sklearn's C = 1 objective equals Spark's with regParam = 1 / sum(weights)
  and standardization off.  Fitting is Spark's distributed L-BFGS; Newton steps
  over sufficient statistics then carry its result to full precision.
* ML-5..7: test metrics and signed coefficients.  AUC is a rank sum over the table of
  distinct scores, ties counting half.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_rows
from ..schema import RANDOM_SEED
from . import ranking
from .selection import behind, thresholds

NUMERIC = ("annual_income", "loan_amount", "term_months")
CATEGORICAL = ("grade", "purpose")
LABEL = "is_default"


def model_frame(s: DataFrame) -> DataFrame:
    """Completed loans with the model's input columns."""
    return (s.where(F.col("is_completed") == 1)
             .select("loan_id", *CATEGORICAL,
                     *[F.col(c).cast("double").alias(c) for c in NUMERIC],
                     F.col(LABEL).cast("int").alias(LABEL)))


def split_hash(loan_id, seed: int = RANDOM_SEED):
    ident = F.concat(F.lit(f"split|{seed}|"), loan_id.cast("string"))
    return F.conv(F.substring(F.md5(ident), 1, 15), 16, 10).cast("bigint")


def stratified_split(frame: DataFrame, train_fraction: float = 0.8,
                     seed: int = RANDOM_SEED, label: str = LABEL) -> DataFrame:
    """ML-2: adds ``is_train``: per label, the first floor(fraction x n_label)
    rows in the order of a seeded hash.  The boundary row of each label is found by
    counting; every row is compared with it where it stands, none is ranked or moved."""
    rows = frame.withColumn("_h", split_hash(F.col("loan_id"), seed))
    order = ["_h", "loan_id"]
    counts = rows.groupBy(label).agg(count_rows().alias("n")).collect()  # a row for each label
    keep = {r[0]: int(r.n * train_fraction) for r in counts}
    cut = [(x, keep[x]) for x in keep if keep[x] < dict(counts)[x]]
    at = dict(zip([x for x, _ in cut], thresholds(rows.select(label, *order), label, order, cut))) if cut else {}
    train = F.lit(True)
    for x, threshold in at.items():
        train = F.when(F.col(label).eqNullSafe(F.lit(x)), ~behind(order, threshold)).otherwise(train)
    return rows.withColumn("is_train", train).drop("_h")


def standardise(split: DataFrame, cols: Sequence[str] = NUMERIC) -> DataFrame:
    """ML-3: (x - train mean) / train population sd, for train and test rows.
    The fitted scaler is one summary row (a mean and an sd per column)."""
    train = split.where("is_train")
    moments = train.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols],
                        *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).first()
    return split.select("*", *[
        F.try_divide(F.col(c) - F.lit(moments[f"mu_{c}"]), F.lit(moments[f"sd_{c}"])).alias(f"{c}_z")
        for c in cols])


def _weights(train: DataFrame, label: str = LABEL):
    counts = dict(train.groupBy(label).agg(count_rows().alias("n")).collect())  # two rows
    n = sum(counts.values())
    return {k: n / (len(counts) * v) for k, v in counts.items()}, n


def design_matrix(z: DataFrame):
    """ML-1 (+ the ML-3 columns): one-hot grade and purpose with the
    alphabetically first level dropped, assembled after the standardised
    numerics.  Levels come from all rows (dummies are made before the split).
    Returns (frame with a ``features`` vector, feature names)."""
    # A missing category has no dummy: all zeros, like the first level, whose own is dropped.
    first = z.agg(*[F.min(c).alias(c) for c in CATEGORICAL]).first()
    z = z.fillna({c: first[c] if first[c] is not None else "" for c in CATEGORICAL})
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc")
                for c in CATEGORICAL]
    encoder = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL],
                            outputCols=[f"{c}_oh" for c in CATEGORICAL], dropLast=True)
    assembler = VectorAssembler(inputCols=[f"{c}_z" for c in NUMERIC] + [f"{c}_oh" for c in CATEGORICAL],
                                outputCol="features")
    stages = Pipeline(stages=[*indexers, encoder, assembler]).fit(z)
    names = list(NUMERIC)
    for c, idx_model in zip(CATEGORICAL, stages.stages[:len(CATEGORICAL)]):
        labels = list(idx_model.labels)  # alphabetically descending
        # dropLast removes the last index = the alphabetically first level.
        names += [f"{c}_{v}" for v in labels[:-1]]
    return stages.transform(z), names


def features_long(design: DataFrame, names: Sequence[str]) -> DataFrame:
    """The design matrix in sparse long form: one row per non-zero entry."""
    arr = vector_to_array(F.col("features"))
    names_arr = F.array(*[F.lit(n) for n in names])
    return (design.select("loan_id", F.col("is_train").cast("bigint").alias("is_train"),
                          F.posexplode(arr).alias("_pos", "value"))
                  .where(F.col("value") != 0)
                  .select("loan_id", "is_train", F.element_at(names_arr, F.col("_pos") + 1).alias("feature"),
                          "value"))


def prepared(split: DataFrame):
    """Checkpointed split -> standardised design matrix (shared by the fit
    and the feature report).  The reliable checkpoint in the shared folder
    means the scaler, the class weights and every L-BFGS pass read the split
    back instead of re-ranking the loans."""
    split = split.checkpoint(eager=True)
    return design_matrix(standardise(split))


def fit(split: DataFrame, max_iter: int = 1000, tol: float = 1e-6):
    """ML-4: returns (fitted model, feature names, design matrix)."""
    design, names = prepared(split)
    train = design.where("is_train")
    weights, n_train = _weights(train)
    w_col = F.when(F.col(LABEL) == 1, F.lit(weights.get(1, 0.0))).otherwise(F.lit(weights.get(0, 0.0)))
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="w",
                            regParam=1.0 / n_train, elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=tol)
    return lr.fit(train.withColumn("w", w_col)), names, design


def linear(z: DataFrame, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """``z`` with ``eta``, the linear predictor; the last of ``beta`` is the intercept."""
    eta = F.lit(float(beta[-1]))
    for c, b in zip(NUMERIC, beta):
        eta = eta + F.col(f"{c}_z") * F.lit(float(b))
    for c in CATEGORICAL:  # a level's coefficient; the first level has none
        own = [(n[len(c) + 1:], float(b)) for n, b in zip(names, beta) if n not in NUMERIC and n.startswith(f"{c}_")]
        levels = F.broadcast(z.sparkSession.createDataFrame(own, f"{c} string, w_{c} double"))  # no more rows than coefficients
        z = z.join(levels, c, "left")
        eta = eta + F.coalesce(f"w_{c}", F.lit(0.0))
    return z.withColumn("eta", eta).drop(*[f"w_{c}" for c in CATEGORICAL])


def newton(design: DataFrame, names: Sequence[str], model, most: int = 20, tol: float = 1e-11) -> list[float]:
    """ML-4 to full precision: coefficients and intercept from the fitted model on, by
    Newton's method.  Within a pair of categories the dummies are constant, so a step
    needs, for each pair, only sums of the weights and residuals by the numeric columns:
    one aggregate, whose rows (pairs of levels) make the small system of equations."""
    train = design.where("is_train").select(*CATEGORICAL, *[f"{c}_z" for c in NUMERIC], LABEL)
    weights, _ = _weights(train)
    w = F.when(F.col(LABEL) == 1, F.lit(weights.get(1, 0.0))).otherwise(F.lit(weights.get(0, 0.0)))
    beta = np.array([*model.coefficients.toArray(), model.intercept])
    k, ridge = len(NUMERIC), np.append(np.ones(len(names)), 0.0)
    parts = [F.lit(1.0), *[F.col(f"{c}_z") for c in NUMERIC]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(most):
        mu = 1 / (1 + F.exp(-F.col("eta")))
        sums = (linear(train, names, beta).withColumns({"_r": w * (mu - F.col(LABEL)), "_v": w * mu * (1 - mu)})
                .groupBy(*CATEGORICAL).agg(*[F.sum(F.col("_r") * x) for x in parts], *[F.sum(F.col("_v") * parts[i] * parts[j]) for i, j in pairs]))
        slope, curve = ridge * beta, np.diag(ridge)
        for row in sums.collect():  # a row for each pair of levels
            values = row[len(CATEGORICAL):]
            # Features that are 1 for the whole group, with the intercept last; then the numeric ones.
            ones = [i for i, n in enumerate(names) if n in {f"{c}_{x}" for c, x in zip(CATEGORICAL, row)}] + [len(names)]
            place = [ones, *[[i] for i in range(k)]]
            for part, x in zip(place, values):
                slope[part] += x
            for (i, j), x in zip(pairs, values[k + 1:]):
                for one in place[i]:
                    curve[one, place[j]] += x
                    if i != j:
                        curve[place[j], one] += x
        step = np.linalg.solve(curve, slope)
        beta = beta - step
        if np.abs(step).max() < tol:
            break
    return beta.tolist()


def coefficients(model, names: Sequence[str], spark, beta: Sequence[float] | None = None) -> DataFrame:
    """ML-7: signed coefficients, ascending; of the fitted model or of ``beta``."""
    coef = model.coefficients.toArray().tolist() if beta is None else beta
    rows = [(n, float(v)) for n, v in zip(names, coef)]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy("coefficient")


def top_coefficients(coefs: DataFrame, k: int = 10) -> DataFrame:
    return coefs.orderBy(F.abs("coefficient").desc(), "feature").limit(k)


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve as a rank sum over distinct scores: of all
    pairs of a positive and a negative row, the share in order, ties counting half."""
    pos, neg = (F.count_if(F.col(label) == y) for y in (1, 0))
    table = scored.groupBy(score).agg(pos.alias("_pos"), neg.alias("_neg"))
    table = ranking.running_before(table, [], score, "_neg", "_below", "_negs")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return table.agg(F.try_divide(wins, F.sum("_pos") * F.max("_negs")).alias("auc"))


def evaluate(model, z: DataFrame, names: Sequence[str] | None = None, beta: Sequence[float] | None = None) -> DataFrame:
    """ML-5/6: accuracy, precision, recall and AUC on the test rows, by the fitted
    model or by ``beta``.  Scores are told apart to 12 digits."""
    test = z.where(~F.col("is_train"))
    if beta is None:
        p = vector_to_array(F.col("probability"))[1]
        pred = model.transform(test).select(LABEL, p.alias("_p"))
    else:
        pred = linear(test, names, beta).select(LABEL, (1 / (1 + F.exp(-F.col("eta")))).alias("_p"))
    pred = pred.withColumn("_p", F.round("_p", 12))
    y, yhat = F.col(LABEL), (F.col("_p") > 0.5).cast("int")
    m = pred.agg(count_rows().alias("n"),
                 F.count_if(y == yhat).alias("correct"),
                 F.count_if((y == 1) & (yhat == 1)).alias("tp"),
                 F.count_if((y == 0) & (yhat == 1)).alias("fp"),
                 F.count_if((y == 1) & (yhat == 0)).alias("fn"))
    base_rate = z.agg(F.avg(LABEL)).scalar()
    area = auc(pred, "_p", LABEL).scalar()
    return m.select(
        (F.col("correct") / F.col("n")).alias("accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        area.alias("auc"),
        base_rate.alias("base_default_rate"),
        F.col("n").alias("test_rows"))
