"""Direct influence within the row of a request."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkling.functions.hashing import uniform
from inkling.operators import influence as I
from inkling.operators import propagate as U
from inkling.sources.storage import materialize

WEIGHTS, DDL = {"a": 1.0, "b": 0.5}, "req_id long, fname string, fval double, fest double, fdist string"
ROWS = [(1, "a", 10.0, 2.0, "normal"), (1, "b", 3.0, 1.0, "normal"), (2, "a", 5.0, 0.0, "fixed"), (2, "b", 1.0, 0.5, "normal"), (3, "a", 7.0, 1.0, "r-normal"), (3, "other", 7.0, 9.0, "normal"), (4, "b", None, 1.0, "normal")]


@pytest.mark.parametrize("measure", ["pred_conf", "pred_var"])
def test_direct_influence_is_the_gain_of_single_draws(spark, measure):
    """The same numbers as from one row a draw, but only features are shuffled, so memory doesn't follow the draws."""
    f = materialize(spark.createDataFrame(ROWS, DDL))
    base = U.summarise(U.linear(U.draws(f, 40), WEIGHTS, 2.0, ["req_id", "i"]), "error", 1.5)
    v = I.frozen(f, "fname").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("_u", uniform(0, F.col("req_id"), F.col("fname"), F.col("i")))
    x = v.select("req_id", "frozen", "i", "fname", U.draw(F.col("_u"), F.col("fval"), F.col("fest"), F.col("fdist")).alias("x"))
    p = U.linear(x, WEIGHTS, 2.0, ["req_id", "frozen", "i"]).withColumn("req_id", F.struct("req_id", "frozen"))
    want = {(r.req_id, r.frozen): r.qinf for r in I.gain(U.summarise(p, "error", 1.5).select("req_id.*", measure), base, measure).collect()}
    out = I.direct(f, "fname", WEIGHTS, 2.0, 40, 1.5, measure)
    got = {(r.req_id, r.frozen): r.qinf for r in out.collect()}
    assert set(got) == set(want) and len(got) == len(ROWS)
    for k, y in want.items():
        assert got[k] == y or abs(got[k] - y) <= 1e-9 * max(1.0, abs(y)), k
    assert out._jdf.queryExecution().toString().count("Exchange hashpartitioning") <= 2  # one, named in the plan and in its adaptive form
