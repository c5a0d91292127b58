"""Timestamps from the many forms that logs write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An epoch number above these is in milliseconds, microseconds, nanoseconds.
MILLIS, MICROS, NANOS = 1e11, 1e14, 1e17
FORMATS = ("yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z")


def from_epoch(number: Column) -> Column:
    """Epoch seconds, or smaller units told by magnitude."""
    n = number.cast("double")
    micros = F.when(n > NANOS, n / 1000).when(n > MICROS, n).when(n > MILLIS, n * 1000).otherwise(n * 1_000_000)
    return F.timestamp_micros(F.round(micros).cast("long"))


def parse_time(text: Column, reference: Column) -> Column:
    """An epoch number, ISO 8601, a few other forms, or a syslog time without a year: the reference's year, or the one before if that lies more than a day ahead."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^[A-Z][a-z]{2}, ", "")
    number = F.when(plain.rlike(r"^\d{9,19}(\.\d+)?$"), from_epoch(plain))
    year = lambda n: F.try_to_timestamp(F.concat((F.year(reference) - n).cast("string"), F.lit(" "), plain), F.lit("yyyy MMM d HH:mm:ss"))
    syslog = F.when(plain.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$"), F.when(year(0) > reference + F.expr("INTERVAL 1 DAY"), year(1)).otherwise(year(0)))
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(plain, r"Z$", "+00:00").try_cast("timestamp"))
    return F.coalesce(number, iso, syslog, *(F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS))
