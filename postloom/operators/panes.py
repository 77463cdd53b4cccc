"""Activity and health as mergeable partial sums per pane.

A pane is a tumbling span as long as the slide of a window.  Its rows hold counts, sums and sketches
of distinct values, so panes of many batches, and the panes of an overlapping window, are merged by
adding and by uniting sketches: a user seen in two panes, or in two languages, counts once.
"""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.operators.activity import share_percent, with_delay
from postloom.operators.posts import new_posts, post_languages

# A sketch has 2 ** SKETCH_BITS registers; its relative standard error is 1.04 / sqrt of that.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
KINDS = ("commit", "identity", "account")


# Languages a heavy-hitter sketch keeps track of; counts are exact while there are fewer.
TRACKED = 1000


def sketch(column):
    return F.hll_sketch_agg(column, SKETCH_BITS)


def united(column):
    return F.hll_sketch_estimate(F.hll_union_agg(column))


def language_panes(parsed, pane=V.ACTIVITY_SLIDE):
    """``pane_start, language`` with the partial sums of posts, delays, users and offsets."""
    rows = with_delay(post_languages(
        new_posts(parsed), "partition", "offset", "kafka_timestamp", "time_us", "partition_key"))
    return rows.groupBy(F.window("post_timestamp", pane).alias("pane"), "language").agg(
        F.count("*").alias("posts"),
        F.sum("delay_sec").alias("delay"),
        F.count("delay_sec").alias("delays"),
        sketch("partition_key").alias("users"),
        sketch("partition").alias("partitions"),
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
    ).select(F.col("pane.start").alias("pane_start"), "*").drop("pane")


def health_panes(parsed, pane=V.HEALTH_SLIDE):
    """``pane_start`` with the partial sums of messages by kind, delays, users and partitions."""
    rows = with_delay(parsed.select("partition", "kafka_timestamp", "time_us", "kind", "did"))
    return rows.groupBy(F.window("post_timestamp", pane).alias("pane")).agg(
        F.count("*").alias("messages"),
        F.sum("delay_sec").alias("delay"),
        F.count("delay_sec").alias("delays"),
        sketch("did").alias("users"),
        sketch("partition").alias("partitions"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS],
    ).select(F.col("pane.start").alias("pane_start"), "*").drop("pane")


def in_windows(panes, window, slide):
    """Each pane once for every window it is part of; a window must be whole panes long."""
    seconds = F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {slide})")
    length = F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {window})")
    starts = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", length, seconds) - 1)
    start = F.unix_micros("pane_start") - F.col("_back") * seconds * 1_000_000
    return (
        panes.withColumn("_back", F.explode(starts))
        .withColumn("window_start", F.timestamp_micros(start))
        .withColumn("window_end", F.timestamp_micros(start + length * 1_000_000))
        .drop("_back", "pane_start")
    )


def mean_delay():
    return F.round(F.sum("delay") / F.sum("delays"), 2)


def language_windows(panes, window=V.ACTIVITY_WINDOW, slide=V.ACTIVITY_SLIDE):
    """The columns of ``activity.language_activity`` from panes of any number of batches."""
    return in_windows(panes, window, slide).groupBy("window_start", "window_end", "language").agg(
        F.sum("posts").alias("post_count"),
        united("users").alias("unique_users"),
        mean_delay().alias("avg_delay_sec"),
        united("partitions").alias("partitions_processed"),
        F.min("min_offset").alias("min_offset"),
        F.max("max_offset").alias("max_offset"),
    )


def health_windows(panes, window=V.HEALTH_WINDOW, slide=V.HEALTH_SLIDE):
    """The columns of ``activity.platform_health`` from panes of any number of batches."""
    return in_windows(panes, window, slide).groupBy("window_start", "window_end").agg(
        F.sum("messages").alias("total_messages"),
        united("users").alias("unique_users"),
        united("partitions").alias("kafka_partitions_active"),
        mean_delay().alias("avg_delay_sec"),
        *[F.sum(kind).alias(f"{kind}_messages") for kind in KINDS],
    ).withColumn("commit_pct", share_percent("commit_messages", "total_messages"))


def language_totals(panes):
    """Posts and users per language over all panes, each counted once."""
    return panes.groupBy("language").agg(
        F.sum("posts").alias("total_posts"), united("users").alias("total_unique_users"))


def top_sketch(parsed, tracked=TRACKED):
    """One row: the heavy hitters among the languages of new posts, in a sketch of bounded size."""
    rows = post_languages(new_posts(parsed), "partition")
    return rows.agg(F.call_function("approx_top_k_accumulate", F.col("language"), F.lit(tracked)).alias("tops"))


def united_tops(sketches, tracked=TRACKED):
    """One row from the rows of several ``top_sketch``."""
    return sketches.agg(F.call_function("approx_top_k_combine", F.col("tops"), F.lit(tracked)).alias("tops"))


def top_languages(sketches, limit=V.TOP_LANGUAGES, tracked=TRACKED):
    """``language, total_posts`` of the commonest languages, from the rows of ``top_sketch``."""
    # All that is tracked, so that ties are cut by name.
    counts = F.call_function("approx_top_k_estimate", F.col("tops"), F.lit(tracked))
    found = united_tops(sketches, tracked).select(F.inline(counts).alias("language", "total_posts"))
    return found.orderBy(F.desc("total_posts"), "language").limit(limit)
