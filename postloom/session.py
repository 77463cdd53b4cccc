"""Session defaults and the shared work folder."""

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# A vectored read holds a whole column chunk, and a direct buffer of that size outside the heap for
# every reading thread; without it a chunk is read in pieces of 8 MB.
VECTORED_READS = "parquet.hadoop.vectored.io.enabled"
# Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW_GROUP = "parquet.block.size"
ROW_GROUP_BYTES = 32 << 20


def build_session(app_name="postloom", master=None, shuffle_partitions=None, **conf):
    """A session with UTC times and adaptive execution.

    Memory, executors and ``spark.checkpoint.dir`` belong to the deployment;
    pass them on spark-submit or as keyword arguments with ``__`` for a dot.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(VECTORED_READS, "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def lean_reads(spark):
    """Let ``spark`` read Parquet in small pieces, whoever has built it."""
    spark.conf.set(VECTORED_READS, "false")


@contextmanager
def settings(spark, values):
    """``values`` by name for the jobs run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_table(df, path, mode="overwrite", **options):
    """Write ``df`` in small row groups and let go of the shuffle files behind it."""
    with settings(df.sparkSession, {CLEAN_SHUFFLES: "true"}):
        df.write.mode(mode).option(ROW_GROUP, ROW_GROUP_BYTES).options(**options).parquet(path)


def work_dir(spark, label):
    """A fresh folder for ``label`` below the cluster's ``spark.checkpoint.dir``, which all
    executors share; without that setting there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/postloom/{label}-{uuid.uuid4().hex}"


def write_and_read(df, label):
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run, and
    the next stage plans with the written table's true size.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    write_table(df, path, "errorifexists")
    return spark.read.schema(df.schema).parquet(path)
