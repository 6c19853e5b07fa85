"""Sources, ingestion, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkling.functions.hashing import hash32
from inkling.functions.scalar import is_weekend, level_group, money, monday_weekday, yes_no
from inkling.sources import ingest as S
from inkling.sources.storage import materialize, shared_dir

from .base import HOUR, REQ, h32, query, requests, rounded

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
#: Spark writes milliseconds by default.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
EVENT_SQL = "SELECT event_id, ts, user_id, event_type, value FROM events"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


def _events(spark, d):
    return S.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("s1_csv_scan", EVENT_SQL)
def s1(spark, d):
    path = shared_dir(spark)
    _events(spark, d).write.option("header", True).option("timestampNTZFormat", MICROS).csv(path)
    return S.read_csv(spark, path, EVENT_SCHEMA)


@query("s2_gzip_tsv_glob", EVENT_SQL)
def s2(spark, d):
    path = shared_dir(spark)
    _events(spark, d).write.option("header", True).option("sep", "\t").option("compression", "gzip").option("timestampNTZFormat", MICROS).csv(path)
    return S.read_csv(spark, f"{path}/*.csv.gz", EVENT_SCHEMA, sep="\t")


@query("s3_headerless_tree", "SELECT event_type, ts, value FROM events")
def s3(spark, d):
    path = shared_dir(spark)
    _events(spark, d).select("event_type", F.date_format("ts", "yyyyMMdd HH:mm:ss.SSSSSS").alias("t"), "value", F.col("event_type").alias("folder")).write.partitionBy("folder").csv(path)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("t", T.StringType()), T.StructField("value", T.DoubleType())])
    return S.read_csv(spark, path, schema, header=False, recursive=True).select("event_type", F.to_timestamp_ntz("t", F.lit("yyyyMMdd HH:mm:ss.SSSSSS")).alias("ts"), "value")


@query("s4_columns_from_path", "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS label FROM events")
def s4(spark, d):
    path = shared_dir(spark)
    _events(spark, d).select("event_id", "event_type").write.partitionBy("event_type").parquet(path)
    names = ["event_type=error", "event_type=click", "event_type=view"]
    return spark.read.option("recursiveFileLookup", True).parquet(path).select("event_id", S.from_path(names)["label"].cast("int").alias("label"))


@query(
    "s5_metadata_ingest",
    """SELECT event_id, event_type AS filename, TIMESTAMP '2010-07-21 15:00:35.25' + to_milliseconds(cast(round(value * 1000) AS BIGINT)) AS Timestamp
    FROM events WHERE event_type IN ('click', 'error')""",
)
def s5(spark, d):
    rows = _events(spark, d).select("event_id", F.col("event_type").alias("filename"), F.col("value").alias("Time"))
    metadata = rows.select("filename").distinct().withColumn("type", F.when(F.col("filename").isin("click", "error"), "charge").otherwise("discharge")).withColumn("start_time", F.lit("[2010. 7. 21. 15. 0. 35.25]"))
    return S.with_metadata(rows, metadata, kind="charge").select("event_id", "filename", F.col("Timestamp").cast("timestamp_ntz").alias("Timestamp"))


@query("s6_block_ids", "SELECT event_id, cast(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 500) AS BIGINT) AS bid FROM events")
def s6(spark, d):
    return S.block_ids(_events(spark, d), "event_type", "event_id", 500).select("event_id", "bid")


@query("s7_derive_and_clean", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_quantity >= 0")
def s7(spark, d):
    both = S.read(spark, d, "lineitem").join(S.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.withColumn("delay", F.datediff("l_shipdate", "o_orderdate").cast("long")).filter((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_quantity") >= 0)).select("l_orderkey", "l_linenumber", "l_partkey", "delay")


@query(
    "s8_cleaning_projections",
    """SELECT o_orderkey, o_totalprice AS amount, cast(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS at,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fraud FROM orders""",
)
def s8(spark, d):
    raw = S.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("amount"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("dd"), F.lit("09:30").alias("time"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("fraud"))
    at = F.to_timestamp_ntz(F.concat_ws(" ", F.concat_ws("-", "y", "m", "dd"), "time"), F.lit("y-M-d HH:mm"))
    return raw.select("o_orderkey", money(F.col("amount")).alias("amount"), at.alias("at"), yes_no(F.col("fraud")).alias("fraud"))


@query("s9_sampling_partition", f"SELECT event_id, cast({h32('7 || chr(124) || event_id')} % 100 AS INTEGER) AS pid FROM events")
def s9(spark, d):
    return S.assign_pid(_events(spark, d), ["event_id"], 100, seed=7).select("event_id", "pid")


@query("s10_incremental_load", f"SELECT event_id, cast({h32('0 || chr(124) || event_id')} % 100 AS INTEGER) AS pid FROM events")
def s10(spark, d):
    events, path = _events(spark, d), shared_dir(spark)
    S.write_sampled(S.assign_pid(events.filter("ts < timestamp_ntz'2024-01-10'").withColumn("day", F.to_date("ts")), ["event_id"]), path, ["event_id"])
    new = materialize(S.missing_days(events, spark.read.parquet(path).select("day"), "ts"))
    S.write_sampled(S.assign_pid(new.select(*events.columns, "day"), ["event_id"]), path, ["event_id"], mode="append")
    return spark.read.parquet(path).select("event_id", "pid")


@query("s11_union_of_files", "SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def s11(spark, d):
    e = S.read(spark, d, "events")
    return e.filter("event_id % 3 = 0").select("event_id", "user_id").unionByName(e.filter("event_id % 3 <> 0").select("user_id", "event_id"))


@query(
    "s12_hourly_store",
    """SELECT event_type, date_trunc('hour', ts) AS hour_ts, count(value) AS count_value, round(avg(value), 6) AS avg_value, round(sum(value), 6) AS sum_value,
    round(var_pop(value), 6) AS varPop_value, round(stddev_pop(value), 6) AS stddevPop_value, round(median(value), 6) AS median_value,
    round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events GROUP BY 1, 2""",
)
def s12(spark, d):
    return rounded(S.hourly_store(_events(spark, d), ["event_type"], "ts", ["value"]))


@query("s13_subset_by_ids", "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 100 = 0)")
def s13(spark, d):
    e = S.read(spark, d, "events").select("event_id", "user_id", "event_type")
    return S.subset(e, e.filter("event_id % 100 = 0"), ["user_id"])


@query("s14_sensors_long", "SELECT l_orderkey, l_linenumber, sensor, signal FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (signal FOR sensor IN (l_quantity, l_discount, l_tax))")
def s14(spark, d):
    return S.sensors_long(S.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("s15_table_statistics", f"SELECT cast({h32('0 || chr(124) || event_id')} % 100 AS INTEGER) AS pid, count(*) AS n FROM events GROUP BY 1")
def s15(spark, d):
    return S.statistics(S.assign_pid(_events(spark, d), ["event_id"]))


@query("s16_dataset_sinks", "SELECT event_id AS req_id, value AS f_value FROM events UNION ALL SELECT event_id, value FROM events")
def s16(spark, d):
    rows, path = _events(spark, d).select(F.col("event_id").alias("req_id"), F.col("value").alias("f_value")), shared_dir(spark)
    S.write_dataset(rows, f"{path}/csv", "csv")
    S.write_dataset(rows, f"{path}/json", "json")
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv").unionByName(spark.read.schema(rows.schema).json(f"{path}/json"))


@query(
    "s17_dataset_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
def s17(spark, d):
    return rounded(S.describe(S.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "p1_request_projection",
    """SELECT event_id, value, (dayofweek(ts) + 6) % 7 AS weekday, cast(hour(ts) AS INTEGER) AS hour, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS weekend,
    cast(dayofyear(ts) AS INTEGER) AS day_of_year, cast(year(ts) AS INTEGER) AS y, cast(month(ts) AS INTEGER) AS m, cast(day(ts) AS INTEGER) AS dd, cast(minute(ts) AS INTEGER) AS mi FROM events""",
)
def p1(spark, d):
    t = F.col("ts")
    return S.read(spark, d, "events").select("event_id", "value", monday_weekday(t).cast("long").alias("weekday"), F.hour(t).alias("hour"), is_weekend(t).alias("weekend"), F.dayofyear(t).alias("day_of_year"), F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("dd"), F.minute(t).alias("mi"))


@query("p2_p6_condition_and_completed", f"WITH {REQ} SELECT req_id, count(*) AS n FROM req JOIN f USING (user_id) WHERE f.ts IS NOT NULL AND f.ts <= req_ts AND f.event_type = 'click' GROUP BY 1")
def p2(spark, d):
    from inkling.operators.matching import expanding

    from .base import facts

    e = S.read(spark, d, "events")
    r = requests(e).select("req_id", "user_id", (F.col("req_ts") + 1).alias("req_ts"))  # up to the request's own time
    return expanding(r, facts(e).filter("event_type = 'click'"), ["user_id"], {"n": F.col("_fact")}).filter("n > 0").select("req_id", F.col("n").cast("long").alias("n"))


@query("p4_sample_range", f"SELECT event_id FROM events WHERE {h32('0 || chr(124) || event_id')} % 100 >= round_even(100 * 0.125, 0) AND {h32('0 || chr(124) || event_id')} % 100 < round_even(100 * 0.375, 0)")
def p4(spark, d):
    sampled = materialize(S.assign_pid(_events(spark, d).select("event_id"), ["event_id"]), ["pid"])
    return sampled.filter((F.col("pid") >= F.bround(F.lit(100 * 0.125))) & (F.col("pid") < F.bround(F.lit(100 * 0.375)))).select("event_id")


@query("p5_p7_p8_not_null", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> '' AND quality IS NOT NULL AND toxic IS NOT NULL")
def p5(spark, d):
    joined = S.read(spark, d, "documents").select("doc_id", "lang").join(S.read(spark, d, "labels"), "doc_id", "left")
    return joined.filter(F.col("quality").isNotNull() & (F.col("lang") != "")).dropna().select("doc_id", "quality")


@query("p9_prefix_rename", "SELECT event_id AS req_id, user_id AS req_user, value AS f_value FROM events")
def p9(spark, d):
    wide = S.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("value").alias("f_value"), F.lit(1).alias("label"))
    renamed = wide.withColumnsRenamed({c: f"req_{c}" for c in ("id", "user")})
    return renamed.select(*[c for c in renamed.columns if c.startswith(("req_", "f_"))])


@query("p10_hash_sample", f"SELECT event_id FROM events WHERE {h32('event_id')} % 10 = 0")
def p10(spark, d):
    return S.read(spark, d, "events").filter(hash32(F.col("event_id")) % 10 == 0).select("event_id")


@query("p11_request_offset", f"WITH {REQ} SELECT req_id, round(avg(value) + coalesce(CASE WHEN req_id % 200 = 0 THEN 1.5 END, 0), 6) AS fval FROM req JOIN f USING (event_type) GROUP BY req_id")
def p11(spark, d):
    e = S.read(spark, d, "events")
    means = e.groupBy("event_type").agg(F.avg("value").alias("fval"))
    req = requests(e).withColumn("req_offset_value", F.when(F.col("req_id") % 200 == 0, 1.5))
    return rounded(req.join(means, "event_type").select("req_id", (F.col("fval") + F.coalesce("req_offset_value", F.lit(0))).alias("fval")))


DELAY = "(event_id % 7 - 3) * 1800"  # a label's delay: for some rows it would come before the row itself


@query("d13_d14_times_and_levels", f"SELECT event_id, cast(epoch_us(ts) // 1000000 AS BIGINT) AS t, cast((epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER ()) // 3600 AS BIGINT) AS hours, cast(greatest(epoch_us(ts) // 1000000 + {DELAY}, epoch_us(ts) // 1000000) AS BIGINT) AS label_ts, CASE WHEN event_id % 22 + 1 <= 3 THEN '0-4' WHEN event_id % 22 + 1 <= 13 THEN '5-12' ELSE '13-22' END AS level_group FROM events")
def d13(spark, d):
    from inkling.functions.scalar import epoch_s, label_time

    e = S.read(spark, d, "events").select("event_id", epoch_s(F.col("ts")).alias("t"))
    first = e.agg(F.min("t").alias("t0"))  # one row
    hours = F.floor((F.col("t") - F.col("t0")) / 3600).cast("long")
    label = label_time(F.col("t") + F.expr(DELAY), F.col("t")).cast("long")
    return e.join(F.broadcast(first)).select("event_id", "t", hours.alias("hours"), label.alias("label_ts"), level_group(F.col("event_id") % 22 + 1).alias("level_group"))
