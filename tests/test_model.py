import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanscope.operators import model


def _newton_weighted_l2(X, y, w, C=1.0, iters=50):
    """Independent solver: minimise 0.5||beta||^2 + C sum w_i logloss_i
    (intercept unpenalised), by Newton's method."""
    n, p = X.shape
    Xa = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(p + 1)
    reg = np.eye(p + 1); reg[-1, -1] = 0.0
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-Xa @ beta))
        g = C * Xa.T @ (w * (mu - y)) + reg @ beta
        H = C * (Xa * (w * mu * (1 - mu))[:, None]).T @ Xa + reg
        beta -= np.linalg.solve(H, g)
    return beta


def test_logistic_regression_matches_newton(spark):
    rng = np.random.default_rng(0)
    n = 4000
    grades = rng.choice(list("ABCD"), n)
    purposes = rng.choice(["car", "debt", "home"], n)
    inc = rng.normal(60000, 15000, n)
    amt = rng.normal(12000, 4000, n)
    term = rng.choice([36, 60], n)
    logit = -1.5 + 0.6 * (grades == "C") + 1.0 * (grades == "D") - 0.00001 * (inc - 60000)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, g, p, float(a), float(b), int(t), int(l), 1)
            for i, (g, p, a, b, t, l) in enumerate(zip(grades, purposes, inc, amt, term, y))]
    s = spark.createDataFrame(rows, "loan_id long, grade string, purpose string, annual_income double, "
                                    "loan_amount double, term_months int, is_default int, is_completed int")
    split = model.stratified_split(model.model_frame(s))
    counts = {r[0]: (r[1], r[2]) for r in split.groupBy("is_default").agg(
        F.count("*"), F.sum(F.col("is_train").cast("int"))).collect()}
    for label, (tot, train) in counts.items():
        assert train == int(tot * 0.8)  # exact stratification
    fitted, names, z = model.fit(split)
    coefs = dict(model.coefficients(fitted, names, spark).collect())
    assert "grade_A" not in coefs and "purpose_car" not in coefs  # first level dropped
    tr = z.where("is_train").toPandas()
    cols = ["annual_income_z", "loan_amount_z", "term_months_z"]
    X = np.column_stack([tr[c] for c in cols] +
                        [(tr["grade"] == g).astype(float) for g in "DCB"] +
                        [(tr["purpose"] == p).astype(float) for p in ["home", "debt"]])
    yy = tr["is_default"].to_numpy()
    w = np.where(yy == 1, len(yy) / (2 * yy.sum()), len(yy) / (2 * (len(yy) - yy.sum())))
    beta = _newton_weighted_l2(X, yy, w)
    want = dict(zip(["annual_income", "loan_amount", "term_months", "grade_D", "grade_C", "grade_B",
                     "purpose_home", "purpose_debt"], beta[:-1]))
    for k, v in want.items():
        assert coefs[k] == pytest.approx(v, abs=2e-4), k
    m = model.evaluate(fitted, z).first()
    assert 0.5 < m.auc < 1.0 and m.test_rows == sum(t - tr_ for t, tr_ in counts.values())
    # Brute force on the test rows: rank-sum AUC and confusion counts.
    pred = fitted.transform(z.where("not is_train")).select(
        "is_default", "prediction", vector_to_array("probability")[1].alias("p")).toPandas()
    ranks = pred["p"].rank(method="average")
    pos = pred["is_default"] == 1
    n1, n0 = pos.sum(), (~pos).sum()
    auc = (ranks[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert m.auc == pytest.approx(auc, abs=1e-9)
    yhat = pred["prediction"].astype(int)
    tp = int(((yhat == 1) & pos).sum()); fp = int(((yhat == 1) & ~pos).sum()); fn = int(((yhat == 0) & pos).sum())
    assert m.accuracy == pytest.approx((yhat == pred["is_default"]).mean(), abs=1e-12)
    assert m.precision == pytest.approx(tp / (tp + fp), abs=1e-12)
    assert m.recall == pytest.approx(tp / (tp + fn), abs=1e-12)
