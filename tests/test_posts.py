from pyspark.sql import functions as F

from postloom.operators import activity, posts
from postloom.sources.tables import firehose, spread


def test_repeats_are_trimmed_before_the_shuffle(spark):
    """A third of all rows under one key still leaves at most a row per task and key."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("did"),
        F.lit("k").alias("rkey"), F.col("id").alias("offset"), F.col("id").alias("kafka_timestamp"),
    )
    once = posts.drop_repeats(rows)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert once.count() == 6001
    assert once.where("did = 0").first().offset == 0


def test_posts_without_identity(spark):
    rows = spark.createDataFrame(
        [("a", "1", "x"), (None, "2", "y"), ("b", None, "z")], "did string, rkey string, text string"
    )
    assert [r.post_id for r in posts.with_post_id(rows, "text").collect()] == ["a/1"]
    assert posts.unnamed_posts(rows).first().asDict() == {
        "without_did": 1, "without_rkey": 1, "left_out": 2,
    }


def test_first_posts(spark):
    rows = spark.range(20).withColumnRenamed("id", "post_id")
    assert [r.post_id for r in posts.first_posts(rows, 3).collect()] == [0, 1, 2]
    assert posts.first_posts(rows, 0).count() == 20


def test_first_posts_of_many_are_exact(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS post_id", "id AS other")
    got = posts.first_posts(rows, 20)
    assert [r.post_id for r in got.collect()] == list(range(20))
    assert posts.first_posts(rows).count() == 5000


def test_thinning_keeps_the_first_of_each_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("did"),
        F.lit("k").alias("rkey"), "id",
    ).coalesce(1)
    got = posts.thin_repeats(rows, ["did", "rkey"]).collect()
    assert {r.did: r.id for r in got} == {None: 0, 1: 1, 2: 2, 4: 4, 5: 5, 0: 7, 3: 10, 6: 13}
    assert len(got) == 8


def test_empty_language_is_a_choice(spark, folder):
    created = posts.new_posts(firehose(spark, folder))
    named = posts.post_languages(created, "offset")
    with_empty = posts.post_languages(created, "offset", drop_empty=False)
    assert with_empty.where("language = ''").count() == with_empty.count() - named.count() > 0


def test_sliding_total_is_twice_the_rows(spark, folder):
    parsed = firehose(spark, folder)
    total = activity.platform_health(parsed).agg(F.sum("total_messages")).first()[0]
    assert total == 2 * parsed.count()


def test_sketch_is_close_to_exact(spark, folder):
    parsed = firehose(spark, folder)
    exact = activity.unique_users(parsed, exact=True).orderBy("hour").collect()
    sketch = activity.unique_users(parsed).orderBy("hour").collect()
    for a, b in zip(exact, sketch, strict=True):
        assert abs(a.unique_users - b.unique_users) <= max(1, 0.15 * a.unique_users)


def test_ingest_time_windows(spark, folder):
    found = activity.language_tumbling(firehose(spark, folder))
    assert found.columns == ["window_start", "window_end", "language", "post_count"]
    # Stamped once per run, so that all rows fall into one window.
    assert found.select("window_start").distinct().count() == 1


def test_spread_leaves_large_tables_alone(spark):
    wide = spark.range(100).repartition(50)
    assert spread(wide) is wide
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 8
