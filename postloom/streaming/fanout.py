"""One read of a stream into several tables, written again without harm when a batch is repeated.

A batch is read and decoded once and held, as files, while its tables are written: a table reads the
columns it needs, and no executor holds more of a batch than its tasks work on.  Each table's rows of a
batch go to folders named by the batch number, which a repeated batch replaces.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import lean_reads, write_table

# Below the output, and not read as a table: names with an underscore are left out.
HELD = "_held"


@dataclass(frozen=True)
class Table:
    """What a batch adds to a table: ``rows(batch, number, path)``, the columns its folders are
    named by, before the batch number, and a plain ``like(batch)`` of the same columns where
    ``rows`` runs jobs of its own."""

    rows: Callable
    by: tuple = ()
    like: Callable | None = None


def put(rows, path, number, by=()):
    """Replace the rows of batch ``number``."""
    writer = rows.withColumn("batch_id", F.lit(number).cast("bigint")).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(*by, "batch_id").parquet(path)


def file_system(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark, path):
    where, system = file_system(spark, path)
    system.mkdirs(where)


def folder_names(spark, path):
    where, system = file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def remove(spark, path):
    where, system = file_system(spark, path)
    system.delete(where, True)


def forget(spark, path, column, before):
    """Remove the folders of ``column`` whose value sorts before ``before``; their names."""
    old = [n for n in folder_names(spark, path) if n.startswith(f"{column}=") and n < f"{column}={before}"]
    for name in old:
        remove(spark, f"{path}/{name}")
    return old


def stored(spark: SparkSession, path, schema) -> DataFrame:
    """A table of ``fan_out`` as it is now, empty before its first batch."""
    make_folder(spark, path)
    return spark.read.schema(schema).parquet(path)


def fan_out(stream, prepare, tables, output, checkpoint, name, every=None, after=None):
    """Write every batch of ``stream`` to all ``tables`` and return the running query.

    ``prepare(batch)`` gives the frame that is held, as files below ``output``, while ``tables``, a dict
    of ``Table`` by name, are written in order; ``after(spark, number)`` runs when they are.  A batch that
    failed halfway is read again from the source and replaces what it had written.
    """
    lean_reads(stream.sparkSession)

    def process(batch, number):
        spark, folder = batch.sparkSession, f"{output}/{HELD}/batch_id={number}"
        prepared = prepare(batch)
        try:
            write_table(prepared, folder, compression="zstd")
            held = spark.read.schema(prepared.schema).parquet(folder)
            for table, spec in tables.items():
                path = f"{output}/{table}"
                put(spec.rows(held, number, path), path, number, spec.by)
            if after is not None:
                after(spark, number)
        finally:
            remove(spark, folder)

    writer = stream.writeStream.queryName(name).foreachBatch(process)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()
