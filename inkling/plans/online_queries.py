"""Pipelines answered progressively: windows and histories read by sampling partitions, request by request as far as its target asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkling.operators.spec import FeatureSpec
from inkling.sources.ingest import assign_pid, read
from inkling.sources.storage import materialize

from . import pipeline_queries as PL
from . import progressive as T
from .base import DAY, HOUR, REQ, facts, query

#: A prediction that is read to the end is the exact one: its SQL is that of the features, weighted.
TO_THE_END = {"max_error": 0.0, "min_conf": 1.1, "alpha": 30, "beta": 70, "policy": "uniform", "draws": 16, "replicates": 10}


#: Facts of a file: a round that reads few pids reads some files whole, which are dealt to as many tasks.
FILE = 100_000


def by_pid(rows, key):
    """Facts with their sampling partition, in files ordered by it, so that a round skips what it does not read."""
    return materialize(assign_pid(rows, key).repartitionByRange("pid").sortWithinPartitions("pid"), rows_a_file=FILE)


def event_facts(spark, d):
    return by_pid(facts(read(spark, d, "events")), ["event_id"])


def weighted(weights: dict[str, float], bias: float) -> str:
    return " + ".join([*[f"{w!r} * {n}" for n, w in weights.items()], repr(bias)])


# --- taxi trips: two windows of an hour, the request itself -------------------------------------------------------
FARE_WEIGHTS = {"code": 0.5, "weekend": 2.0, "value": 0.1, "n_1h": 0.3, "avg_1h": 0.2, "n_30m": 0.7}
FARE_DAYS = {"n_7d": ("count", "value"), "avg_7d": ("avg", "value"), "std_7d": ("stdPop", "value")}, {"median_3d": ("median", "value"), "top_3d": ("max", "value"), "users_3d": ("unique", "user_id"), "p90_3d": ("percentile90", "value")}


def fare_specs(spark, d, median: bool = False):
    f = event_facts(spark, d)
    specs = [PL.request_features(), FeatureSpec("trailing", PL.FARE_1H, f, ["event_type"], HOUR), FeatureSpec("trailing", PL.FARE_30M, f, ["event_type"], HOUR // 2)]
    return [s.swapped("avg", "median") for s in specs] if median else specs


def _fare_exact(swap=lambda f: f) -> str:
    a, b = swap(PL.FARE_1H), swap(PL.FARE_30M)
    return f"WITH {REQ}, {PL.REQUEST_SQL}, {PL.sql_trailing('a', ['event_type'], HOUR, a)}, {PL.sql_trailing('b', ['event_type'], HOUR // 2, b)} SELECT req_id, round({weighted(FARE_WEIGHTS, 1.0)} + 1e-8, 5) AS pred_value, true AS met, 1.0::DOUBLE AS qsample FROM q JOIN a USING (req_id) JOIN b USING (req_id)"


def _end(df):
    return df.select("req_id", F.round(F.col("pred_value") + 1e-8, 5).alias("pred_value"), "met", "qsample")


def fare_job(spark, d, median=False, **settings):
    return T.progressive_job(PL.event_requests(spark, d), fare_specs(spark, d, median), T.linear_model(FARE_WEIGHTS, 1.0), **settings)


@query("t2_trip_fare_to_the_end", _fare_exact())
def fare_end(spark, d):
    return _end(fare_job(spark, d, **TO_THE_END))


@query("t2_trip_fare_median_to_the_end", _fare_exact(PL.median_of))
def fare_median_end(spark, d):
    return _end(fare_job(spark, d, median=True, **TO_THE_END))


LONG_WEIGHTS = {"n_7d": 0.01, "avg_7d": 1.0, "std_7d": 0.5, "median_3d": 1.0, "top_3d": 0.2, "users_3d": 0.1, "p90_3d": 0.3}


def long_specs(spark, d):
    f = event_facts(spark, d)
    return [FeatureSpec("trailing", FARE_DAYS[0], f, ["event_type"], 7 * DAY, row_key=["event_id"]), FeatureSpec("trailing", FARE_DAYS[1], f, ["event_type"], 3 * DAY, row_key=["event_id"])]


@query("t2_long_windows")
def long_windows(spark, d):
    """Windows of days with medians, greatest values, distinct users and quantiles, sampled: errors come from resamples that are merged round by round."""
    return T.progressive_job(PL.event_requests(spark, d), long_specs(spark, d), T.linear_model(LONG_WEIGHTS, 0.0), max_error=8.0, min_conf=0.9, alpha=20, beta=20, replicates=30, draws=32)


# --- click fraud: counts over a day and over all the past ---------------------------------------------------------
FRAUD_WEIGHTS = {"code": 0.2, "weekend": 1.0, "value": 0.05, "n_user_1d": 0.4, "n_user": 0.02, "n_user_type": 0.1}


def fraud_job(spark, d, **settings):
    f = event_facts(spark, d)
    specs = [PL.request_features(), *[FeatureSpec(kind, x, f, keys, width or 0) for kind, keys, width, x in PL.FRAUD]]
    return T.progressive_job(PL.event_requests(spark, d), specs, T.linear_model(FRAUD_WEIGHTS, 0.0), **settings)


@query("t2_fraud_to_the_end", f"WITH {REQ}, {PL.REQUEST_SQL}, " + ", ".join(PL.sql_trailing(f"w{k}", keys, width, f) for k, (_, keys, width, f) in enumerate(PL.FRAUD)) + f" SELECT req_id, round({weighted(FRAUD_WEIGHTS, 0.0)} + 1e-8, 5) AS pred_value, true AS met, 1.0::DOUBLE AS qsample FROM q JOIN w0 USING (req_id) JOIN w1 USING (req_id) JOIN w2 USING (req_id)")
def fraud_end(spark, d):
    return _end(fraud_job(spark, d, **TO_THE_END))


# --- card fraud: lookups and long windows of orders ---------------------------------------------------------------
CARD_WEIGHTS = {"status": 1.0, "amount": 0.0001, "balance": 0.001, "nation": 0.05} | {f"sum_{n}d": 1e-6 for n in PL.CARD} | {f"avg_{n}d": 1e-5 for n in PL.CARD} | {f"n_{n}d": 0.5 for n in PL.CARD}


def card_job(spark, d, **settings):
    requests, own, lookup, f = PL.card_parts(spark, d)
    f = by_pid(f.withColumn("o_row", F.xxhash64("*")), ["o_row"])
    windows = [FeatureSpec("trailing", x, f, ["o_custkey"], n * DAY) for n, x in PL.CARD.items()]
    return T.progressive_job(requests, [own, lookup, *windows], T.linear_model(CARD_WEIGHTS, 0.0), **settings)


@query("t2_card_fraud_to_the_end", f"WITH {PL.CARD_SQL}, {PL.sql_trailing('a', ['o_custkey'], 30 * DAY, PL.CARD[30])}, {PL.sql_trailing('b', ['o_custkey'], 360 * DAY, PL.CARD[360])}, q AS (SELECT req_id, {PL.code_sql('o_orderstatus', 'FOP')} AS status, o_totalprice AS amount, coalesce(c_acctbal, 0) AS balance, coalesce(cast(c_nationkey AS DOUBLE), 0) AS nation FROM req LEFT JOIN customer ON c_custkey = o_custkey) SELECT req_id, round({weighted(CARD_WEIGHTS, 0.0)} + 1e-8, 5) AS pred_value, true AS met, 1.0::DOUBLE AS qsample FROM q JOIN a USING (req_id) JOIN b USING (req_id)")
def card_end(spark, d):
    return _end(card_job(spark, d, **TO_THE_END))
