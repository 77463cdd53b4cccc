"""A lasting record of what streams did: every batch of every query, and how queries ended."""

import logging
import queue
import threading

from pyspark.sql.streaming import StreamingQueryListener

from postloom.streaming.runner import PROGRESS_SCHEMA, progress_row

log = logging.getLogger(__name__)

ENDS_SCHEMA = "id string, run_id string, time string, error string"
FLUSH_ROWS = 50
FLUSH_SECONDS = 30
STOP = object()


class ProgressLog(StreamingQueryListener):
    """Appends the progress of all queries of a session to Parquet tables below ``path``.

    Use as a context manager around the queries' life.  Rows are written by a thread of their own,
    every ``FLUSH_ROWS`` rows or ``FLUSH_SECONDS``, so that no query waits; closing writes the rest.
    A driver that is lost loses no more than the rows of one flush.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.events = queue.Queue()
        self.writer = threading.Thread(target=self.write, daemon=True)

    def __enter__(self):
        self.spark.streams.addListener(self)
        self.writer.start()
        return self

    def __exit__(self, *_):
        self.close()

    def close(self):
        # Events of queries that have ended are still on their way through the session's bus.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        self.events.put(STOP)
        self.writer.join()

    def onQueryStarted(self, event):
        log.info("query %s started", event.name)

    def onQueryProgress(self, event):
        self.events.put(("batches", progress_row(event.progress)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.events.put(("ends", (str(event.id), str(event.runId), None, event.exception)))

    def write(self):
        rows = {"batches": [], "ends": []}
        running = True
        while running:
            try:
                event = self.events.get(timeout=FLUSH_SECONDS)
                running = event is not STOP
                if running:
                    rows[event[0]].append(event[1])
                    if len(rows[event[0]]) < FLUSH_ROWS:
                        continue
            except queue.Empty:
                pass
            for table, schema in (("batches", PROGRESS_SCHEMA), ("ends", ENDS_SCHEMA)):
                if rows[table]:
                    frame = self.spark.createDataFrame(rows[table], schema).coalesce(1)
                    frame.write.mode("append").parquet(f"{self.path}/{table}")
                    rows[table] = []


def batches(spark, path):
    """All recorded batches; a batch run again after a failure has a row for each run."""
    return spark.read.schema(PROGRESS_SCHEMA).parquet(f"{path}/batches")
