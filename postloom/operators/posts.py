"""Posts: selection, shape, identity and removal of repeats."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.text import SPACE, is_meaningful, is_nsfw, normalize_post, strip
from postloom.functions.time import event_time


def new_posts(parsed):
    """Commits that create a post."""
    return parsed.where(
        (F.col("kind") == V.POST_KIND)
        & (F.col("commit.operation") == V.POST_OPERATION)
        & (F.col("commit.collection") == V.POST_COLLECTION)
    )


def post_languages(posts, *keep, drop_empty=True):
    """One row per post and language; a missing or empty list gives no row."""
    spread = posts.select(*keep, F.explode("commit.record.langs").alias("language"))
    named = spread.where(F.col("language").isNotNull())
    return named.where(F.col("language") != "") if drop_empty else named


def collected_posts(parsed):
    """New posts as collected, repeats and empty texts included."""
    return new_posts(parsed).select(
        "did",
        F.col("commit.rkey").alias("rkey"),
        F.col("commit.record.text").alias("text"),
        F.col("commit.record.langs").alias("langs"),
        F.col("commit.record.createdAt").alias("created_at"),
    )


def first_per_key(rows, keys, order):
    """The first row of each key.

    The rank filter lets Spark keep one row per key in every input partition
    before the shuffle, so a key with many repeats does not fill one task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def thin_repeats(posts, keys):
    """Without the repeats of a key inside one Arrow batch; the first row of each stays.

    Needs no state and no shuffle.  It takes the weight off a key that fills
    the stream before the rows are sent to the task that owns the key.
    """
    keys = list(keys)

    def thin_task(batches):
        for batch in batches:
            names = pa.table({key: batch.column(key) for key in keys})
            names = names.append_column("_row", pa.array(np.arange(batch.num_rows)))
            first = names.group_by(keys).aggregate([("_row", "min")])["_row_min"]
            yield batch.take(first.combine_chunks().sort())

    return posts.mapInArrow(thin_task, posts.schema)


def drop_repeats(posts, keys=("did", "rkey"), order=("kafka_timestamp", "offset"),
                 time="post_timestamp", delay=V.POSTS_WATERMARK, keep_state=False, thin=False):
    """One row per key.

    A stream forgets a key once the watermark has passed it; ``keep_state``
    remembers every key for ever, and so needs state that grows with the stream.
    ``thin`` drops repeats in a stream before its shuffle, for feeds in which
    one message may be delivered very often.
    """
    keys = list(keys)
    if not posts.isStreaming:
        return first_per_key(posts, keys, order)
    if thin:
        posts = thin_repeats(posts, keys)
    marked = posts.withWatermark(time, delay)
    if keep_state:
        return marked.dropDuplicates(keys)
    return marked.dropDuplicatesWithinWatermark(keys)


def post_rows(parsed, *keep):
    """Non-empty new posts with event time, repeats included."""
    return (
        new_posts(parsed)
        .select(
            "did",
            F.col("commit.rkey").alias("rkey"),
            F.col("partition_key").alias("user_id"),
            F.col("commit.record.text").alias("text"),
            F.col("commit.record.langs").alias("langs"),
            event_time().alias("post_timestamp"),
            F.col("commit.record.createdAt").alias("created_at"),
            "kafka_timestamp",
            "offset",
            *keep,
        )
        .where(F.length("text") > 0)
    )


def windowed_posts(once, window=V.POSTS_WINDOW):
    """Rows of ``post_rows`` with the tumbling window they fall in."""
    return (
        once.withColumn("_window", F.window("post_timestamp", window))
        .withColumn("window_start", F.col("_window.start"))
        .withColumn("window_end", F.col("_window.end"))
        .drop("_window", "kafka_timestamp", "offset")
    )


def raw_posts(parsed, watermark=V.POSTS_WATERMARK, window=V.POSTS_WINDOW, keep_state=False,
              thin=False):
    """Distinct non-empty posts with event time and the tumbling window they fall in."""
    once = drop_repeats(post_rows(parsed), delay=watermark, keep_state=keep_state, thin=thin)
    return windowed_posts(once, window)


def with_post_id(posts, *keep):
    """Posts named ``did/rkey``; rows that lack a part have no identity and are left out."""
    return posts.where("did IS NOT NULL AND rkey IS NOT NULL").select(
        F.concat_ws("/", "did", "rkey").alias("post_id"), *keep
    )


def unnamed_posts(posts):
    """How many posts ``with_post_id`` leaves out, by the part they lack."""
    return posts.agg(
        F.count_if(F.col("did").isNull()).alias("without_did"),
        F.count_if(F.col("rkey").isNull()).alias("without_rkey"),
        F.count_if(F.col("did").isNull() | F.col("rkey").isNull()).alias("left_out"),
    )


def first_posts(posts, n=0, order="post_id"):
    """The first ``n`` posts by ``order``; 0, the default, keeps every row.

    Equal keys are ordered by the other columns.  Spark keeps no more than ``n`` rows of each input
    task before the final merge.
    """
    if not n:
        return posts
    return posts.orderBy(order, *[c for c in posts.columns if c != order]).limit(n)


def keep_texts(posts, text, wanted, name="text_clean"):
    """``posts`` with ``text`` as column ``name``, where the text is wanted.

    A filter on a computed column would compute it again; a list of no or one
    element, exploded, computes it once.
    """
    return posts.withColumn(name, F.explode(F.filter(F.array(text), wanted)))


def cleaned_posts(posts):
    """Stripped, non-empty text and its normalised form."""
    text = F.col("text")
    return posts.where(text.rlike(f"[^{SPACE}]")).withColumns(
        {"text": strip(text), "text_clean": normalize_post(text)}
    )


def analysis_posts(posts, whole_word=False):
    """Cleaned posts worth clustering: meaningful, not NSFW, not empty."""

    def wanted(clean):
        return is_meaningful(clean) & ~is_nsfw(clean, whole_word) & (F.length(clean) > 0)

    text = F.col("text")
    kept = keep_texts(posts.where(text.rlike(f"[^{SPACE}]")), normalize_post(text), wanted)
    return kept.withColumn("text", strip(text))
