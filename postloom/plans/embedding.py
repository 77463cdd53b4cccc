"""The embedding job: a table of posts into a table of vectors."""

from contextlib import contextmanager

from postloom import fixed_values as V
from postloom.operators.posts import analysis_posts, first_posts, with_post_id
from postloom.operators.vectors import encode_posts
from postloom.sources.tables import spread
from postloom.streaming.sinks import write_table

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark, rows):
    """At most ``rows`` rows per Arrow batch for the jobs started inside."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def embed_table(spark, source, target, make_encoder, clean=False, limit=0, unit_length=True,
                truncate_dim=None, batch=V.ENCODER_BATCH, batch_rows=V.ARROW_BATCH_ROWS):
    """Encode the posts of ``source`` and write ``post_id, text, embedding`` to ``target``.

    ``clean`` keeps only posts worth clustering, adds ``text_clean`` and
    encodes that.  ``truncate_dim`` keeps the first components of each vector.  A worker holds the
    vectors of ``batch_rows`` posts at a time.  Texts are read, encoded, checked and written in one
    pass.
    """
    scan = spread(spark.read.parquet(source).select("did", "rkey", "text"))
    posts = with_post_id(scan, "text")
    if limit:
        # The cap leaves one partition; encode on all cores.
        posts = first_posts(posts, limit).repartition(spark.sparkContext.defaultParallelism)
    text = "text"
    if clean:
        posts, text = analysis_posts(posts), "text_clean"
    encoded = encode_posts(posts, make_encoder, text=text, unit_length=unit_length, batch=batch,
                           repair=True, truncate_dim=truncate_dim)
    with arrow_rows(spark, batch_rows):
        write_table(encoded, target)
