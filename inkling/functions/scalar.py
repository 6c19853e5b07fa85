"""Scalar helpers of feature definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_s(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def monday_weekday(ts: Column) -> Column:
    """0 for Monday."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def money(text: Column) -> Column:
    """"$1,234.50" as a number; null where it is none."""
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def yes_no(text: Column) -> Column:
    return (F.lower(text) == "yes").cast("int")


def level_group(question: Column) -> Column:
    """Questions up to 3, 13 and 22."""
    return F.when(question <= 3, "0-4").when(question <= 13, "5-12").when(question <= 22, "13-22")


def label_time(label_ts: Column, ts: Column) -> Column:
    """When a label is known: never before the row itself; without a time of its own, with the row."""
    return F.greatest(label_ts, ts)
