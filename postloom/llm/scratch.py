"""Tables between the steps of a job, in the folder that all executors share."""

from postloom.session import lean_reads, settings, work_dir, write_table

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


class Scratch:
    """One job's folder of intermediate tables.

    Written tables cut the lineage: a lost executor costs a re-read.  ``drop`` removes a table
    that no later step reads; what the returned frame still reads stays until the folder under
    ``spark.checkpoint.dir`` is cleared.
    """

    def __init__(self, spark, label):
        self.spark = spark
        self.base = work_dir(spark, label)
        lean_reads(spark)

    def path(self, name):
        return f"{self.base}/{name}"

    def save(self, df, name):
        """Write ``df`` and read it back; the shuffle files behind it go."""
        write_table(df, self.path(name))
        return self.read(df.schema, name)

    def read(self, schema, name):
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names):
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark, rows):
    """At most ``rows`` rows per Arrow batch for the jobs run inside, where rows are large, and in a
    batch read from Parquet, which is held as columns in memory."""
    return settings(spark, {ARROW_ROWS: rows, READER_ROWS: rows})


def is_small(df, row_bytes, limit=32 << 20):
    """Whether a written table of short rows may be sent to every executor."""
    return df.count() * row_bytes <= limit


def unused(columns, *names):
    """``names`` with underscores added until none is among ``columns``."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
