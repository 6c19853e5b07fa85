"""The registry of queries and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, digits: int = 6):
    """Floating columns rounded, as engines add up in other orders."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


#: Requests with a time: one of every hundred events, in microseconds.
def requests(events):
    from inkling.functions.scalar import epoch_us

    return events.filter("event_id % 100 = 0").select(F.col("event_id").alias("req_id"), "user_id", "event_type", epoch_us(F.col("ts")).alias("req_ts"))


def facts(events):
    from inkling.functions.scalar import epoch_us

    return events.select("user_id", "event_type", epoch_us(F.col("ts")).alias("ts"), "value", "event_id")


REQ = "req AS (SELECT event_id AS req_id, user_id, event_type, epoch_us(ts) AS req_ts FROM events WHERE event_id % 100 = 0), f AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS ts, value FROM events)"

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86400 * SECOND


def h32(key: str) -> str:
    """SQL of functions.hashing.hash32 over a text expression."""
    return f"cast('0x' || substr(md5(cast({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def u32(key: str) -> str:
    return f"(({h32(key)} + 0.5) / 4294967296.0)"
