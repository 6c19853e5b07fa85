"""The permutations of the importances, dealt in one shuffle for all features."""

from __future__ import annotations

from hashlib import md5

import numpy as np

from inkling.operators import ml


def test_one_shuffle_deals_the_same_permutations_to_all_features(spark):
    n, repeats = 2500, 2
    rows = [(i, float(i % 10), float(i * 7 % 11), 5.0 * (i % 10) + i * 7 % 11) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    out = ml.permutation_importance(ml.make_model("linear", ["a", "b"]).fit(df), df, "id", ["a", "b"], repeats=repeats)
    h = lambda *p: int(md5("|".join(map(str, p)).encode()).hexdigest()[:8], 16)
    x = np.array(rows)
    var = x[:, 3].var()
    for r in out.collect():
        f, losses = {"a": 1, "b": 2}[r.fname], []
        for k in range(1, repeats + 1):
            mixed = x.copy()
            for b in range(n // 1000):
                mine = [i for i in range(n) if h("b", k, i) % (n // 1000) == b]
                to, of = (sorted(mine, key=lambda i: (h(tag, k, i), i)) for tag in ("to", "from"))
                mixed[to, f] = x[of, f]
            losses.append((((5 * mixed[:, 1] + mixed[:, 2]) - x[:, 3]) ** 2).mean() / var)
        assert abs(r["drop"] - np.mean(losses)) < 1e-6
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Join" not in text
