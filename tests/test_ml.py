"""Training, tuning and importances against least squares and plain resampling."""

from __future__ import annotations

import numpy as np

from inkling.operators import ml
from inkling.plans import decision_queries as Q

DATA = "/root/testdata/sf0.001"


def matrix(rows, columns):
    return np.array([[r[c] for c in columns] for r in rows], float)


def test_scaled_regression_is_least_squares(spark):
    rows = Q.order_rows(spark, DATA).collect()
    train, test = ([r for r in rows if r.split == s] for s in ("train", "test"))
    x = np.c_[matrix(train, Q.ORDER_FEATURES), np.ones(len(train))]
    w = np.linalg.lstsq(x, np.array([r.label for r in train]), rcond=None)[0]
    want = {r.req_id: float(v) for r, v in zip(test, np.c_[matrix(test, Q.ORDER_FEATURES), np.ones(len(test))] @ w)}
    got = {r.req_id: r.prediction for r in Q.m1(spark, DATA).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) <= 1e-3 * abs(want[i]) + 1 for i in want)


def test_every_model_and_scaler(spark):
    out = {r.kind: r for r in Q.m1_all(spark, DATA).collect()}
    assert set(out) == {*ml.MODELS, "mlp_classifier"} and {r.scaler for r in out.values()} == {*ml.SCALERS, "none"}
    test = [r for r in Q.order_rows(spark, DATA).collect() if r.split == "test"]
    variance = np.var([r.label for r in test])
    dear = np.mean([r.label > 150000 for r in test])
    assert all(r.rows == len(test) for r in out.values())
    for kind, r in out.items():
        assert r.score >= min(dear, 1 - dear) - 1e-9 if kind in ml.CLASSIFIERS else r.score <= 2 * variance, kind


def test_grid_search_prefers_what_fits(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i + 2) for i in range(200)], "a double, b double, label double")
    out = {r.params: r.metric for r in ml.grid_search(rows, "ridge", ["a", "b"], {"regParam": [0.0, 1000.0], "maxIter": [5, 50]}, folds=5).collect()}
    assert len(out) == 4
    assert max(v for k, v in out.items() if "regParam=0.0" in k) < 1 < min(v for k, v in out.items() if "regParam=1000.0" in k)


def test_importances_find_the_feature_that_counts(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i * 7 % 11), 5.0 * (i % 10)) for i in range(500)], "id long, a double, b double, label double")
    model = ml.make_model("tree", ["a", "b"]).fit(rows)
    own = {r.fname: r.importance for r in ml.importances(model, ["a", "b"]).collect()}
    drop = {r.fname: r["drop"] for r in ml.permutation_importance(model, rows, "id", ["a", "b"], repeats=5).collect()}
    assert abs(sum(own.values()) - 1) < 1e-9 and own["a"] > 0.95
    # Dealing a feature anew loses twice its variance: r2 falls from about 1 to about -1; the other feature loses nothing.
    assert 1.5 < drop["a"] < 2.5 and abs(drop["b"]) < 0.05
    linear = ml.make_model("linear", ["a", "b"]).fit(rows)
    assert abs({r.fname: r.importance for r in ml.importances(linear, ["a", "b"]).collect()}["a"] - 5.0) < 1e-6


def test_ensemble_sweep_against_plain_counts(spark):
    scored = [(r.y, r.s) for r in Q.priority_scores(spark, DATA).collect()]
    assert len(scored) == sum(r.split == "test" for r in Q.order_rows(spark, DATA).collect())

    def f1(pairs):
        tp, fp, fn = (sum(a == x and b == y for a, b in pairs) for x, y in ((1, 1), (0, 1), (1, 0)))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    got = {round(r.th, 2): r.macro_f1 for r in Q.m4_ensemble(spark, DATA).collect()}
    assert len(got) == 41
    for th in (0.4, 0.55, 0.7, 0.8):
        told = [(y, int(s >= th)) for y, s in scored]
        assert abs(got[th] - (f1(told) + f1([(1 - a, 1 - b) for a, b in told])) / 2) < 1e-9
