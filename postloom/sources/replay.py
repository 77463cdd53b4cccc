"""Recorded feeds: a topic written to files, and files replayed as a stream."""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.session import write_table
from postloom.streaming.fanout import folder_names


def record_topic(topic, path, slices=1, files_per_slice=8, time="timestamp", newest_first=False,
                 rows_per_file=None):
    """Write ``topic`` so that a replay delivers it slice by slice.

    Slices are equal spans of ``time``, written one after the other; a replay
    of ``files_per_slice`` files per batch takes one slice per batch.  Messages are written by the tasks
    that have them, ``files_per_slice`` at most, and never shuffled; a slice with fewer files is
    filled up with empty ones.  No file has more than ``rows_per_file`` rows, so a replay of one
    file per batch admits no more.
    """
    if slices > 1:
        seconds = F.unix_micros(time)
        low, high = topic.agg(F.min(seconds), F.max(seconds)).first()
        part = F.floor((seconds - low) * slices / F.lit(high - low + 1))
    else:
        part = F.lit(0)
    order = range(slices - 1, -1, -1) if newest_first else range(slices)
    for done, number in enumerate(order, 1):
        chosen = topic.where(part == number) if slices > 1 else topic
        write_files(chosen.coalesce(files_per_slice), path, rows_per_file)
        if done < slices and not rows_per_file:
            empty = topic.sparkSession.createDataFrame([], topic.schema).coalesce(1)
            for _ in range(done * files_per_slice - file_count(topic.sparkSession, path)):
                write_files(empty, path)
    return path


def write_files(rows, path, rows_per_file=None):
    write_table(rows, path, "append", compression="zstd", maxRecordsPerFile=rows_per_file or 0)


def file_count(spark, path):
    return sum(name.endswith(".parquet") for name in folder_names(spark, path))


def replay_topic(spark, path, files_per_batch=None, bytes_per_batch=None):
    """A recorded topic as a stream, all files first to last."""
    reader = spark.readStream.schema(V.TOPIC_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def replay_lines(spark, path, files_per_batch=None):
    """A feed recorded as text, one JSON message per line, as a stream of ``value``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)
