"""The live job: one read of the feed into posts, activity, health, dead letters and late rows."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom import fixed_values as V
from postloom.functions.time import event_time
from postloom.operators import decode, panes
from postloom.operators.activity import language_activity, platform_health
from postloom.operators.posts import first_per_key, post_rows, raw_posts, windowed_posts
from postloom.streaming import fanout
from postloom.streaming.fanout import Table
from postloom.streaming.runner import QuerySet
from postloom.streaming.sinks import gather_windows, to_console, to_memory, to_parquet

HOUR = "yyyy-MM-dd-HH"
# So many row numbers are sent to every executor at most; more repeats are taken out by a shuffle.
FEW_REPEATS = 1_000_000


def by_hour(rows, time, name):
    return rows.withColumn(name, F.date_format(time, HOUR))


class LiveTables:
    """The tables of a live job below ``output``, how a batch adds to them, and how they are read.

    ``posts`` holds each post once: within a batch the first of its key, and no post that an earlier
    batch has landed with an event time within ``delay`` of the batch's.  ``language_panes`` and
    ``health_panes`` hold partial sums that are merged when read, so late rows still count while
    their hour is kept.  ``late_rows`` are the messages whose event time lies ``delay`` or more
    behind the latest one of the batches before.  ``batches`` has one row per batch.

    Folders are by hour and batch.  ``keep_hours`` removes the panes of hours that lie further
    behind the latest event; nothing is held by the driver.
    """

    def __init__(self, output, delay=V.POSTS_WATERMARK, keep_hours=None):
        self.output, self.delay, self.keep_hours = output, delay, keep_hours
        self.tables = {
            "dead_letters": Table(lambda held, *_: decode.dead_letters(held)),
            "late_rows": Table(self.late_rows),
            "posts": Table(self.new_posts, ("post_hour",), lambda held: by_hour(
                raw_posts(decode.good_messages(held)), "post_timestamp", "post_hour")),
            "language_panes": Table(lambda held, *_: by_hour(
                panes.language_panes(decode.good_messages(held)), "pane_start", "pane_hour"), ("pane_hour",)),
            "health_panes": Table(lambda held, *_: by_hour(
                panes.health_panes(decode.good_messages(held)), "pane_start", "pane_hour"), ("pane_hour",)),
            "language_tops": Table(self.running_tops),
            # Last, as it stands for the batch.
            "batches": Table(self.batch_row),
        }

    def path(self, name):
        return f"{self.output}/{name}"

    def read(self, spark, name):
        """A table as it is now; its columns are those of an empty batch, the folders' last."""
        empty = decode.marked_messages(spark.createDataFrame([], V.TOPIC_SCHEMA))
        spec = self.tables[name]
        rows = spec.like(empty) if spec.like else spec.rows(empty, 0, self.path(name))
        rows = rows.withColumn("batch_id", F.lit(0).cast("bigint"))
        folders = [*spec.by, "batch_id"]
        schema = StructType(rows.drop(*folders).schema.fields + rows.select(*folders).schema.fields)
        return fanout.stored(spark, self.path(name), schema)

    def high_before(self, spark, number):
        """The latest event time of all batches before ``number``, null before the first."""
        if number < 1:
            return F.lit(None).cast("timestamp")
        row = spark.read.parquet(f"{self.path('batches')}/batch_id={number - 1}").first()
        return F.lit(row["high"]).cast("timestamp")

    def is_late(self, spark, number):
        behind = self.high_before(spark, number) - F.expr(f"interval {self.delay}")
        return F.coalesce(event_time() <= behind, F.lit(False))

    def late_rows(self, held, number, path):
        good = decode.good_messages(held)
        return good.where(self.is_late(held.sparkSession, number))

    def batch_row(self, held, number, path):
        good, late = F.col("fault").isNull(), self.is_late(held.sparkSession, number)
        high = F.max(F.when(good, event_time()))
        return held.agg(
            F.count("*").alias("messages"), F.count_if(~good).alias("dead"),
            F.count_if(good & late).alias("late"), F.min(F.when(good, event_time())).alias("first_event"),
            high.alias("last_event"),
            F.greatest(high, self.high_before(held.sparkSession, number)).alias("high"),
            F.current_timestamp().alias("written"),
        ).coalesce(1)

    def new_posts(self, held, number, path):
        # Repeats are found by their keys alone; texts stay where they are while repeats are few.
        numbered = held.withColumn("_row", F.monotonically_increasing_id())
        rows = post_rows(decode.good_messages(numbered), "_row")
        short = rows.select("_row", "did", "rkey", "post_timestamp", "kafka_timestamp", "offset")
        kept = first_per_key(short, ["did", "rkey"], ["kafka_timestamp", "offset", "_row"])
        if number > 0:
            kept = self.not_landed(kept, held, number)
        repeats = short.select("_row").join(kept.select("_row"), "_row", "left_anti")
        if repeats.limit(FEW_REPEATS + 1).count() <= FEW_REPEATS:
            repeats = F.broadcast(repeats)
        once = rows.join(repeats, "_row", "left_anti").drop("_row")
        return by_hour(windowed_posts(once), "post_timestamp", "post_hour")

    def not_landed(self, found, held, number):
        """Without the posts that an earlier batch has landed."""
        spark, delay = held.sparkSession, F.expr(f"interval {self.delay}")
        first, last = held.where("fault is null").agg(
            F.date_format(F.min(event_time()) - delay, HOUR),
            F.date_format(F.max(event_time()) + delay, HOUR)).first()
        if first is None:
            return found
        # Only the hours that the batch touches are read.
        landed = self.read(spark, "posts").where(
            F.col("post_hour").between(first, last) & (F.col("batch_id") < number))
        keys = landed.select("did", "rkey", F.col("post_timestamp").alias("_seen"))
        near = ((found["did"] == keys["did"]) & (found["rkey"] == keys["rkey"])
                & (F.col("post_timestamp") <= F.col("_seen") + delay)
                & (F.col("post_timestamp") >= F.col("_seen") - delay))
        return found.join(keys, near, "left_anti")

    def running_tops(self, held, number, path):
        """The commonest languages of all batches so far: one sketch, carried from batch to batch."""
        now = panes.top_sketch(decode.good_messages(held))
        if number < 1:
            return now
        before = held.sparkSession.read.parquet(f"{path}/batch_id={number - 1}")
        return panes.united_tops(now.unionByName(before))

    def top_languages(self, spark, limit=V.TOP_LANGUAGES):
        """The commonest languages as of the last batch, by posts; each post counts once."""
        names = fanout.folder_names(spark, self.path("language_tops"))
        last = max((int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")), default=None)
        if last is None:
            return spark.createDataFrame([], "language string, total_posts bigint")
        state = spark.read.parquet(f"{self.path('language_tops')}/batch_id={last}")
        return panes.top_languages(state, limit)

    def expire(self, spark, number):
        # Only the sketch of the last batches is read again.
        fanout.remove(spark, f"{self.path('language_tops')}/batch_id={number - 3}")
        if self.keep_hours is None:
            return
        row = spark.read.parquet(f"{self.path('batches')}/batch_id={number}").select(
            F.date_format(F.col("high") - F.expr(f"interval {self.keep_hours} hours"), HOUR)).first()
        if row[0] is not None:
            for name in ("language_panes", "health_panes"):
                fanout.forget(spark, self.path(name), "pane_hour", row[0])

    def windows(self, spark):
        """The live tables by the names that reports look up, merged from the panes."""
        return {
            V.LANGUAGE_TABLE: panes.language_windows(self.read(spark, "language_panes")),
            V.HEALTH_TABLE: panes.health_windows(self.read(spark, "health_panes")),
            V.POSTS_TABLE: self.read(spark, "posts").drop("post_hour", "batch_id"),
        }

    def show(self, spark):
        """Make the live tables visible to ``reports.report``, as they are now."""
        for name, frame in self.windows(spark).items():
            frame.createOrReplaceTempView(name)
        return self


def start_live(messages, output, checkpoint, every=None, keep_hours=None, name="live"):
    """Start the live job on a stream of undecoded topic messages.

    The topic is read once per batch for all tables.  Without ``every`` the job takes what is there
    and ends.  Returns the running query and its ``LiveTables``.
    """
    tables = LiveTables(output, keep_hours=keep_hours)
    query = fanout.fan_out(
        messages, decode.marked_messages, tables.tables, output, checkpoint, name, every, tables.expire)
    return QuerySet(query), tables


# Output folder, table name, console rows and triggers (console, Parquet, memory).
SINKS = {
    "language": (
        "language_counts_kafka", V.LANGUAGE_TABLE, 20, "1 minute", "2 minutes", "1 minute",
    ),
    "raw_posts": ("raw_posts_kafka", V.POSTS_TABLE, 10, "1 minute", "1 minute", "1 minute"),
    "health": (
        "health_metrics_kafka", V.HEALTH_TABLE, 20, "30 seconds", "1 minute", "30 seconds",
    ),
}


def analytics(parsed):
    """The three result frames by name, with the output mode of their live views."""
    return {
        "language": (language_activity(parsed), "update", "complete"),
        "raw_posts": (raw_posts(parsed), "append", "append"),
        "health": (platform_health(parsed), "update", "complete"),
    }


def start_queries(parsed, output, checkpoints, console=True, memory=False, bounded=False):
    """Start the analytics as separate queries, each of which reads the stream for itself.

    For a look at a feed, or for state kept by Spark's own windows; ``start_live`` reads it once.
    Parquet tables go below ``output``, partitioned by ``window_start``; only
    they are checkpointed.  Console and memory sinks hold results on the
    driver.  ``bounded`` takes what is there and ends.
    """
    running = QuerySet()
    for name, (frame, console_mode, memory_mode) in analytics(parsed).items():
        folder, table, rows, console_every, parquet_every, memory_every = SINKS[name]
        if console:
            every = None if bounded else console_every
            running.add(to_console(frame, f"{name}_console", console_mode, every, rows))
        every = None if bounded else parquet_every
        stored = frame if name == "raw_posts" else gather_windows(frame)
        running.add(to_parquet(
            stored, f"{output}/{folder}", f"{checkpoints}/{folder}", f"{name}_parquet",
            "window_start", every,
        ))
        if memory:
            every = None if bounded else memory_every
            running.add(to_memory(frame, table, memory_mode, every))
    return running


def land_messages(parsed, path, checkpoint, every=None):
    """Write the decoded stream once, so that many queries can read files instead of the topic."""
    return to_parquet(parsed, path, checkpoint, "landing", every=every)


def landed_messages(spark, path, files_per_batch=None):
    """The landed messages as a stream, for ``start_live`` and others."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
