"""Running streams: sets of queries, time-boxed runs, progress."""

import logging
import time

from pyspark.sql import types as T

log = logging.getLogger(__name__)

PROGRESS_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("time", T.StringType()),
    T.StructField("input_rows", T.LongType()),
    T.StructField("rows_per_second", T.DoubleType()),
    T.StructField("watermark", T.StringType()),
    T.StructField("state_rows", T.LongType()),
    T.StructField("dropped_rows", T.LongType()),
])


class QuerySet:
    """Queries that are watched and stopped together.

    As a context manager it stops all its queries on the way out, also after
    an error, and a query that will not stop does not keep the others running.
    """

    def __init__(self, *queries):
        self.queries = list(queries)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stop()

    def add(self, query):
        self.queries.append(query)
        return query

    def active(self):
        return [query for query in self.queries if query.isActive]

    def failures(self):
        """Name and error of each query that has failed."""
        found = [(query.name, query.exception()) for query in self.queries]
        return [(name, error) for name, error in found if error is not None]

    def health(self):
        """Number of running queries, with a log line for each failure."""
        for name, error in self.failures():
            log.error("query %s failed: %s", name, error)
        running = len(self.active())
        log.info("%d of %d queries running", running, len(self.queries))
        return running

    def watch(self, seconds, step=15):
        """Log the health every ``step`` seconds, for ``seconds`` or until no query runs.

        A query that fails is logged; the others go on.
        """
        end = time.monotonic() + seconds
        while self.health() and (now := time.monotonic()) < end:
            until = min(end, now + step)
            while self.active() and (left := until - time.monotonic()) > 0:
                time.sleep(min(left, 0.5))

    def finish(self):
        """Wait for bounded queries to end; the first failure is raised."""
        for query in self.queries:
            query.awaitTermination()
        return self

    def stop(self):
        for query in self.queries:
            try:
                query.stop()
            except Exception as error:  # the others still have to stop
                log.error("query %s did not stop: %s", query.name, error)

    def progress(self, spark):
        return progress_table(spark, self.queries)


def run_for(query, seconds):
    """Let a query run for ``seconds``, or until it ends, then stop it."""
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
    return query


def progress_row(progress):
    """One batch's progress as a row of ``PROGRESS_SCHEMA``."""
    states = progress.stateOperators
    return (
        progress.name,
        progress.batchId,
        progress.timestamp,
        progress.numInputRows,
        float(progress.processedRowsPerSecond),
        progress.eventTime.get("watermark"),
        sum(state.numRowsTotal for state in states),
        sum(state.numRowsDroppedByWatermark for state in states),
    )


def progress_table(spark, queries):
    """The recent batches of the queries, one row each.

    The session keeps the last 100 per query; ``progress.ProgressLog`` keeps them all.
    """
    rows = [progress_row(progress) for query in queries for progress in query.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)
