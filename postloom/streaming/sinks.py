"""Where streams and tables go.

Every function starts one query.  ``every`` is the processing-time trigger;
without it the query takes what is there and ends.
"""

from postloom.session import work_dir


def _writer(stream, name, mode, every):
    writer = stream.writeStream.outputMode(mode)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def _view(stream, name, mode, every):
    """A sink that starts anew each time, with its state where all executors reach it."""
    fresh = work_dir(stream.sparkSession, f"view-{name}")
    return _writer(stream, name, mode, every).option("checkpointLocation", fresh)


def to_console(stream, name, mode="update", every=None, rows=20):
    """Print each batch on the driver, for a look at a running job."""
    writer = _view(stream, name, mode, every).format("console")
    return writer.option("truncate", False).option("numRows", rows).start()


def to_parquet(stream, path, checkpoint, name=None, partition_by=None, every=None):
    """Append to a Parquet table; a restart with the same checkpoint goes on where it stopped.

    Partitioning by ``window_start`` makes a directory per window; for long
    streams partition by a coarser column, see ``with_window_date``.
    """
    writer = _writer(stream, name, "append", every).format("parquet").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def to_memory(stream, name, mode="complete", every=None):
    """Keep the result as a table on the driver, for dashboards and tests on small results."""
    return _view(stream, name, mode, every).format("memory").start()


def to_kafka(messages, options, checkpoint, name=None, every=None):
    """Publish ``key, value`` rows; ``options`` come from ``kafka.write_options``."""
    writer = _writer(messages, name, "append", every).format("kafka").options(**options)
    return writer.option("checkpointLocation", checkpoint).start()


def gather_windows(windows):
    """One task, and so one file, per window and batch.

    For aggregates, which have a row per language at most; posts of one window
    are too many for a task.
    """
    return windows.repartition("window_start")


def with_window_date(windows):
    """With the day of ``window_start`` as a coarser partition column."""
    return windows.selectExpr("*", "to_date(window_start) AS window_date")


def write_table(rows, path, codec="zstd", partition_by=None, mode="overwrite"):
    """Write a batch as a Parquet table."""
    writer = rows.write.mode(mode).option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
