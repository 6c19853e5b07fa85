"""A feature store refreshed by regret priority, in micro-batches.

Priorities and budgets are settled once a batch, not once a request: feedback that has arrived by the batch's time counts, the
budget is that of the time since the last batch, and refreshed features are as of the batch's time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import capped_regret


def serve(requests: DataFrame, store: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Stored features; unseen keys get zeros stored at the request's time."""
    found = requests.join(store, keys, "left")
    return found.withColumn("stored_at", F.coalesce("stored_at", "req_ts")).fillna(0.0, values)


def arrived(feedback: DataFrame, now: int) -> DataFrame:
    """Squared errors whose label is known by ``now``."""
    return feedback.filter(F.col("label_ts") <= now)


def choose(feedback: DataFrame, key: str, now: int, budget: int, max_regret: float, min_regret: float | None = None, old: DataFrame | None = None) -> DataFrame:
    """The ``budget`` keys with the largest priority; with ``min_regret`` waiting keys gain that much each batch."""
    p = capped_regret(arrived(feedback, now), key, max_regret)
    if min_regret is not None and old is not None:
        p = p.join(old.select(key, F.col("priority").alias("_old")), key, "full").select(key, F.greatest(F.coalesce("_old", F.lit(0.0)) + min_regret, F.coalesce("priority", F.lit(0.0))).alias("priority"))
    return p.orderBy(F.desc("priority"), key).limit(budget)


def refresh(store: DataFrame, chosen: DataFrame, facts: DataFrame, key: str, now: int, ts: str, value: str) -> DataFrame:
    """The store with the chosen keys' count and mean as of ``now``; their priority starts again at zero."""
    new = facts.filter(F.col(ts) < now).join(chosen.select(key), key, "left_semi").groupBy(key).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean")).withColumn("stored_at", F.lit(now).cast("long"))
    return store.join(chosen.select(key), key, "left_anti").select(key, "n", "mean", "stored_at").unionByName(new)


def recommended_budget(requests: DataFrame, ts: str = "req_ts") -> DataFrame:
    """One over the mean gap between requests."""
    return requests.agg(((F.count(F.lit(1)) - 1) / (F.max(ts) - F.min(ts))).alias("budget"))
