"""Event time and ingest delay."""

from pyspark.sql import functions as F


def event_time(time_us="time_us"):
    """Microseconds since the epoch as a timestamp, exact to the microsecond."""
    return F.timestamp_micros(F.col(time_us))


def delay_seconds(arrived, happened):
    """Whole seconds between two timestamps, each floored to a second first."""
    return F.unix_seconds(arrived) - F.unix_seconds(happened)
