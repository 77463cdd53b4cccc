"""Exact duplicates by a stream with keyed state that never expires.

Documents enter the stream as short rows: digest, stable identifier, content locator.  The state,
kept on the executors' disks, holds for each digest the identifier and locator of the row that
stays, and the number of rows seen.  Rows of one digest are combined inside each input task before
they reach the state, so a digest with a third of all rows sends one row per task.

A hit, a digest with more than one row, is only a candidate: its full texts are compared, and
different texts of one digest become groups of their own.
"""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postloom.llm.scratch import Scratch, is_small, unused

DIGEST_CHARS = 64
FILES_PER_BATCH = 256
#: State on disk; without reserving file space for every partition's store in advance, and with one
#: bounded memory for all stores of an executor, not one for each.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def with_digest(rows, name="text_sha256", text="text"):
    """Add the hex SHA-256 of the text with A-Z in lower case; null counts as empty."""

    def task(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "").to_pylist()
            found = [hashlib.sha256(t.encode().lower()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name]
            )

    schema = StructType([*rows.schema.fields, StructField(name, StringType())])
    return rows.mapInArrow(task, schema)


def normalised(text="text"):
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def state_of(feed, scratch, files_per_batch=FILES_PER_BATCH):
    """Run the rows of ``feed`` (a written table) through the keyed state.

    Returns ``digest, keep, group_size`` with the last state of each digest.  Every batch is
    written to a folder of its own number, so a batch that is run again replaces itself.
    """
    spark = feed.sparkSession
    stream = (
        spark.readStream.schema(feed.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(scratch.path("feed"))
    )
    state = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row", "locator")).alias("keep"),
        F.count("*").alias("group_size"),
    )

    def land(batch, number):
        batch.write.mode("overwrite").parquet(scratch.path(f"state/batch={number}"))

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", scratch.path("stream")).foreachBatch(land).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    landed = scratch.read(state.schema, "state/*")
    last = landed.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("last"))
    return last.select("digest", "last.keep", "last.group_size")


def split_clashes(rows, hits, digest_chars, scratch):
    """The feed with digests that different texts share made distinct, or None without any.

    Compares the full texts of all hits of ``rows (doc_id, text, locator)``.  Equal texts meet as one
    row per input task, so large groups of copies move little.  The rows of a clash, if there is
    one, are told apart by their content itself.
    """
    hits = F.broadcast(hits) if is_small(hits, 2 * digest_chars) else hits
    read = with_digest(rows).withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    contents = read.join(hits, "digest", "left_semi").select(
        "digest", normalised().alias("content")).distinct()
    clashing = scratch.save(
        contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"),
        "clashing",
    )
    if clashing.isEmpty():
        return None
    order = Window.partitionBy("digest").orderBy("content")
    variants = contents.join(clashing, "digest", "left_semi").withColumn(
        "variant", F.row_number().over(order))
    short = ["doc_id", "locator", "text_sha256", "digest"]
    plain = read.join(clashing, "digest", "left_anti").select(*short)
    told = read.join(clashing, "digest", "left_semi").withColumn("content", normalised()).join(
        variants, ["digest", "content"])
    told = told.withColumn("digest", F.concat_ws("-", "digest", F.col("variant").cast("string")))
    return plain.unionByName(told.select(*short)).withColumn("row", F.monotonically_increasing_id())


def exact_dedup(docs, digest_chars=DIGEST_CHARS, files_per_batch=FILES_PER_BATCH):
    """One row per row of ``docs (doc_id, text, ...)``: which row of its equal texts stays.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256, keep_locator``.  Of equal texts
    (A-Z folded, null as empty) the row with the largest doc_id stays, a null doc_id only among
    nulls; of rows that repeat a doc_id exactly one stays.  Other columns are not read.
    ``digest_chars`` below 64 makes clashing digests, for tests.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select("doc_id", "text", F.input_file_name().alias("locator"))
    feed = scratch.save(
        with_digest(rows).select(
            "doc_id", F.monotonically_increasing_id().alias("row"), "locator", "text_sha256",
            F.substring("text_sha256", 1, digest_chars).alias("digest"),
        ),
        "feed",
    )
    state = scratch.save(state_of(feed, scratch, files_per_batch), "groups")
    hits = scratch.save(state.where("group_size > 1").select("digest"), "hits")
    parted = split_clashes(rows, hits, digest_chars, scratch)
    if parted is not None:
        feed = scratch.save(parted, "parted")
        groups = feed.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row", "locator")).alias("keep"),
            F.count("*").alias("group_size"),
        )
        state = scratch.save(groups, "parted-groups")
    scratch.drop("state", "stream", "hits", "clashing")
    return feed.join(state, "digest").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
        F.col("keep.locator").alias("keep_locator"),
    )


def drop_exact_duplicates(docs):
    """The rows of ``docs`` that stay, with all their columns."""
    own, id_, digest = unused(docs.columns, "own_sha256", "kept_id", "kept_sha256")
    kept = exact_dedup(docs).where("kept").select(
        F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest))
    rows = with_digest(docs, own).join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)
