"""Windowed activity and health analytics, for batch frames and for streams.

``exact`` counts distinct values exactly; the default is a sketch of fixed
size.  Streams support the sketch only.
"""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.time import delay_seconds, event_time
from postloom.operators.posts import new_posts, post_languages


def distinct_count(column, exact=False, rsd=0.05):
    return F.count_distinct(column) if exact else F.approx_count_distinct(column, rsd)


def with_delay(rows):
    """Event time and ingest delay in whole seconds."""
    timed = rows.withColumn("post_timestamp", event_time())
    return timed.withColumn(
        "delay_sec", delay_seconds(F.col("kafka_timestamp"), F.col("post_timestamp"))
    )


def language_activity(parsed, exact=False, watermark=V.ACTIVITY_WATERMARK,
                      window=V.ACTIVITY_WINDOW, slide=V.ACTIVITY_SLIDE):
    """Posts, users, delay and topic spread per sliding window and language."""
    rows = post_languages(
        new_posts(parsed), "partition", "offset", "kafka_timestamp", "time_us", "partition_key"
    )
    return (
        with_delay(rows)
        .withWatermark("post_timestamp", watermark)
        .groupBy(F.window("post_timestamp", window, slide), "language")
        .agg(
            F.count("*").alias("post_count"),
            distinct_count("partition_key", exact).alias("unique_users"),
            F.avg("delay_sec").alias("mean_delay"),
            distinct_count("partition", exact).alias("partitions_processed"),
            F.min("offset").alias("min_offset"),
            F.max("offset").alias("max_offset"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "language",
            "post_count",
            "unique_users",
            F.round("mean_delay", 2).alias("avg_delay_sec"),
            "partitions_processed",
            "min_offset",
            "max_offset",
        )
    )


def platform_health(parsed, exact=False, watermark=V.HEALTH_WATERMARK,
                    window=V.HEALTH_WINDOW, slide=V.HEALTH_SLIDE):
    """Messages by kind, users, delay and topic spread per sliding window."""
    rows = with_delay(parsed.select("partition", "kafka_timestamp", "time_us", "kind", "did"))
    return (
        rows.withWatermark("post_timestamp", watermark)
        .groupBy(F.window("post_timestamp", window, slide))
        .agg(
            F.count("*").alias("total_messages"),
            distinct_count("did", exact).alias("unique_users"),
            distinct_count("partition", exact).alias("kafka_partitions_active"),
            F.avg("delay_sec").alias("mean_delay"),
            *[
                F.count_if(F.col("kind") == kind).alias(f"{kind}_messages")
                for kind in ("commit", "identity", "account")
            ],
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "total_messages",
            "unique_users",
            "kafka_partitions_active",
            F.round("mean_delay", 2).alias("avg_delay_sec"),
            "commit_messages",
            "identity_messages",
            "account_messages",
            share_percent("commit_messages", "total_messages").alias("commit_pct"),
        )
    )


def share_percent(part, whole):
    return F.round(F.col(part) * F.lit(100.0) / F.col(whole), 2)


def language_tumbling(parsed, time=None, drop_empty=False, watermark=V.TUMBLING_WATERMARK,
                      window=V.TUMBLING_WINDOW):
    """Posts per language in tumbling windows of ``time``, by default the time of ingest."""
    stamped = new_posts(parsed).withColumn(
        "timestamp", F.current_timestamp() if time is None else time
    )
    return (
        post_languages(stamped, "timestamp", drop_empty=drop_empty)
        .withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", window), "language")
        .agg(F.count("*").alias("post_count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "language",
            "post_count",
        )
    )


def unique_users(parsed, exact=False):
    """Distinct keys and topic partitions per hour of event time."""
    return (
        parsed.groupBy(F.date_trunc("hour", event_time()).alias("hour"))
        .agg(
            distinct_count("partition_key", exact).alias("unique_users"),
            distinct_count("partition", exact).alias("partitions"),
        )
    )


def kind_counts(parsed):
    """Messages of each kind per topic partition; an unknown kind counts in the total only."""
    return parsed.groupBy("partition").agg(
        F.count("*").alias("total_messages"),
        *[
            F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"{kind}_messages")
            for kind in ("commit", "identity", "account")
        ],
    )


def offset_stats(parsed):
    """Offset range and mean delay per topic partition."""
    return (
        with_delay(parsed)
        .groupBy("partition")
        .agg(
            F.min("offset").alias("min_offset"),
            F.max("offset").alias("max_offset"),
            F.round(F.avg("delay_sec"), 2).alias("avg_delay_sec"),
        )
    )
