"""Reports over the windowed tables.

Each takes the table as a DataFrame.  ``report`` looks a live table up by name
and gives None while it does not exist.
"""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.time import event_time
from postloom.operators.activity import distinct_count, with_delay
from postloom.operators.posts import new_posts, post_languages

log = logging.getLogger(__name__)


def report(spark, make, table=V.LANGUAGE_TABLE, **options):
    """``make`` over the live table, or None if no query has made the table yet."""
    try:
        return make(spark.table(table), **options)
    except AnalysisException as error:
        if error.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        log.error("no report: table %s does not exist", table)
        return None


def latency_grade(delay):
    """Name of the first bound the delay stays below; a missing delay gets the last grade."""
    below = [F.when(delay < bound, name) for bound, name in V.LATENCY_GRADES]
    return F.coalesce(*below, F.lit(V.LATENCY_GRADE_ELSE))


def latency_grades(windows, limit=V.REPORT_ROWS):
    """The latest windows with a grade for their mean delay."""
    return (
        windows.orderBy(F.desc("window_start"), "language")
        .limit(limit)
        .select(
            "window_start",
            "avg_delay_sec",
            "partitions_processed",
            latency_grade(F.col("avg_delay_sec")).alias("latency_grade"),
        )
    )


def partition_distribution(windows, limit=V.REPORT_ROWS):
    """The latest windows with their offset range and posts per partition.

    Offsets of different partitions share no scale, so the range is not a
    message count; ``partition_offset_range`` gives the range per partition.
    """
    return (
        windows.where("partitions_processed > 0")
        .orderBy(F.desc("window_start"), "language")
        .limit(limit)
        .select(
            "window_start",
            "partitions_processed",
            (F.col("max_offset") - F.col("min_offset")).alias("offset_range"),
            "post_count",
            F.round(F.col("post_count") / F.col("partitions_processed"), 2).alias(
                "avg_posts_per_partition"
            ),
        )
    )


def top_languages(windows, limit=V.TOP_LANGUAGES):
    """Languages by posts summed over all windows.

    Windows overlap, so a post counts once for each window it falls in and a
    user once per window; ``top_languages_exact`` counts each once.
    """
    return (
        windows.groupBy("language")
        .agg(
            F.sum("post_count").alias("total_posts"),
            F.sum("unique_users").alias("total_unique_users"),
            F.avg("avg_delay_sec").alias("avg_processing_delay"),
            F.count("*").alias("time_windows"),
            F.avg("partitions_processed").alias("avg_partitions_used"),
        )
        .orderBy(F.desc("total_posts"), "language")
        .limit(limit)
    )


def top_languages_exact(parsed, limit=V.TOP_LANGUAGES, exact=True):
    """Languages by posts, each post and each user counted once."""
    rows = post_languages(new_posts(parsed), "kafka_timestamp", "time_us", "partition_key")
    return (
        with_delay(rows)
        .groupBy("language")
        .agg(
            F.count("*").alias("total_posts"),
            distinct_count("partition_key", exact).alias("total_unique_users"),
            F.avg("delay_sec").alias("avg_processing_delay"),
        )
        .orderBy(F.desc("total_posts"), "language")
        .limit(limit)
    )


def top_language_windows(windows, limit=V.TOP_LANGUAGE_WINDOWS):
    """The windows with most posts of one language."""
    return (
        windows.select("language", "post_count", "window_start", "window_end")
        .orderBy(F.desc("post_count"), "window_start", "language")
        .limit(limit)
    )


def partition_offset_range(parsed, window=V.ACTIVITY_WINDOW):
    """Offset range and messages of each topic partition per window."""
    return (
        parsed.groupBy(F.window(event_time(), window), "partition")
        .agg(
            (F.max("offset") - F.min("offset")).alias("offset_range"),
            F.count("*").alias("messages"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "partition",
            "offset_range",
            "messages",
        )
    )


def collection_summary(posts, seconds=V.COLLECTION_SECONDS, bytes_per_post=V.BYTES_PER_POST):
    """Posts collected, posts per second and estimated size."""
    total = F.count("*")
    return posts.agg(
        total.alias("post_count"),
        (total / F.lit(float(seconds))).alias("posts_per_second"),
        (total * bytes_per_post / F.lit(1024.0 * 1024.0)).alias("estimated_mb"),
    )
