"""From topic messages to typed columns, and back."""

from pyspark.sql import functions as F

from postloom import fixed_values as V

METADATA = ["partition", "offset", "kafka_timestamp", "partition_key"]


def decode_messages(topic, schema=V.FIREHOSE_SCHEMA):
    """Topic rows as ``partition, offset, kafka_timestamp, partition_key`` plus the envelope.

    Parsing is permissive: a broken message gives nulls, a field of the wrong
    type gives a null field.  ``split_dead_letters`` makes those rows visible.
    """
    return topic.select(
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("partition_key"),
        F.from_json(F.col("value").cast("string"), schema).alias("data"),
    ).select(*METADATA, "data.*")


def encode_messages(parsed):
    """Parsed rows as keyed topic messages; the inverse of ``decode_messages``."""
    envelope = F.struct("did", "time_us", "kind", "commit")
    return parsed.select(
        F.col("partition_key").cast("binary").alias("key"),
        F.to_json(envelope).cast("binary").alias("value"),
        "partition",
        "offset",
        F.col("kafka_timestamp").alias("timestamp"),
    )


def message_key(value):
    """Key of a raw JSON message: its ``did``.

    A message without the field gets the fixed key; an explicit null and an
    empty string give no key.
    """
    has_did = F.array_contains(F.json_object_keys(value), "did")
    did = F.get_json_object(value, "$.did")
    return F.when(has_did, F.nullif(did, F.lit(""))).otherwise(F.lit(V.UNKNOWN_KEY))


def keyed_messages(feed, value="value"):
    """A feed of JSON texts as ``key, value`` rows for a topic; other texts are left out."""
    text = F.col(value)
    return feed.where(F.json_object_keys(text).isNotNull()).select(
        message_key(text).alias("key"), text.alias("value")
    )


def fault(value, schema=V.FIREHOSE_SCHEMA, time_us=None):
    """Why a raw message cannot be counted, or null for a good one.

    ``time_us`` is the decoded time where the message is decoded anyway.
    """
    text = value.cast("string")
    if time_us is None:
        time_us = F.from_json(text, schema)["time_us"]
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.json_array_length(text).isNotNull(), "array")
        .when(F.json_object_keys(text).isNull(), "broken")
        .when(time_us.isNull(), "no_event_time")
    )


def marked_messages(topic, schema=V.FIREHOSE_SCHEMA):
    """Decoded messages with their ``fault``, and the raw message where it has one.

    One pass gives both good rows and dead letters.
    """
    decoded = topic.select("*", F.from_json(F.col("value").cast("string"), schema).alias("data"))
    reason = fault(F.col("value"), schema, F.col("data.time_us"))
    marked = decoded.withColumn("fault", reason)
    raw = F.when(F.col("fault").isNotNull(), F.col("value"))
    return marked.select(
        "partition", "offset", F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("partition_key"), "data.*", "fault",
        F.col("topic"), F.when(F.col("fault").isNotNull(), F.col("key")).alias("raw_key"),
        raw.alias("raw_value"))


def good_messages(marked):
    return marked.where(F.col("fault").isNull()).drop("fault", "topic", "raw_key", "raw_value")


def dead_letters(marked):
    """The raw messages with a fault, in the columns of a topic."""
    return marked.where(F.col("fault").isNotNull()).select(
        F.col("raw_key").alias("key"), F.col("raw_value").alias("value"), "topic", "partition",
        "offset", F.col("kafka_timestamp").alias("timestamp"), "fault")


def split_dead_letters(topic):
    """The topic as two frames: good messages, and bad ones with their ``fault``."""
    marked = topic.withColumn("fault", fault(F.col("value")))
    good = marked.where(F.col("fault").isNull()).drop("fault")
    return good, marked.where(F.col("fault").isNotNull())


def fault_counts(topic):
    """Messages per fault, with ``ok`` for the good ones."""
    reason = F.coalesce(fault(F.col("value")), F.lit("ok"))
    return topic.groupBy(reason.alias("fault")).agg(F.count("*").alias("messages"))
