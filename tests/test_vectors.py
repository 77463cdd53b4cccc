import math
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postloom.functions import vectors as V
from postloom.operators import vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, embedding array<float>")


def test_normalize_is_idempotent_and_keeps_zero(spark):
    rows = frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])
    once = rows.withColumn("embedding", V.normalize(F.col("embedding")))
    twice = once.withColumn("embedding", V.normalize(F.col("embedding")))
    got = {r.id: r.embedding for r in twice.collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>"
    )
    got = [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0.0])


def test_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = frame(spark, [(1, [1.0]), (2, [nan]), (3, [-inf]), (4, [None]), (5, None)])
    assert sorted(r.id for r in vectors.bad_vectors(rows).collect()) == [2, 3, 4, 5]


def flaky_encoder():
    def make():
        return lambda texts: [[float("nan")] if "bad" in t else [float(len(t))] for t in texts]

    return make


def test_repair(spark):
    rows = spark.createDataFrame(
        [(1, "abc", [3.0]), (2, "de", [float("nan")])], "id int, text string, embedding array<float>"
    )
    fixed = vectors.repair_vectors(rows, flaky_encoder(), unit_length=False)
    assert {r.id: r.embedding for r in fixed.collect()} == {1: [3.0], 2: [2.0]}


def test_repair_fails_if_still_bad(spark):
    rows = spark.createDataFrame(
        [(1, "bad", [float("nan")])], "id int, text string, embedding array<float>"
    )
    with pytest.raises(Exception, match="not finite after repair"):
        vectors.repair_vectors(rows, flaky_encoder(), unit_length=False).collect()


def test_encoder_runs_in_batches_and_fills_missing_text(spark):
    def make():
        def encode(texts):
            return [[float(len(texts)), float(len(t))] for t in texts]
        return encode

    rows = spark.createDataFrame([(i, None if i == 0 else "x" * i) for i in range(70)],
                                 "id int, text string").coalesce(1)
    got = vectors.encode_posts(rows, make, unit_length=False, batch=32).orderBy("id").collect()
    assert [r.embedding[1] for r in got] == [float(i) for i in range(70)]
    assert [r.embedding[0] for r in got] == [32.0] * 64 + [6.0] * 6
    assert got[0].text is None


def test_both_hashed_encoders_agree(spark):
    texts = ["a b c", "", None, "a a a b", " ".join(f"w{i}" for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = rows.select("id", vectors.hashed_embedding(F.col("text"), 32).alias("v"))
    hooked = vectors.encode_posts(rows, vectors.hashing_encoder(32), unit_length=False)
    left = {r.id: r.v for r in plain.collect()}
    assert left == {r.id: r.embedding for r in hooked.collect()}
    assert sum(map(abs, left[3])) in (2.0, 4.0)


def test_word_codes_are_sorted_without_a_comparing_lambda(spark):
    frame = spark.createDataFrame([("b a a",)], "text string").select(vectors.hashed_embedding(F.col("text")))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_reduction(spark):
    random = np.random.default_rng(1)
    data = random.normal(size=(200, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    rows = frame(spark, [(i, row.tolist()) for i, row in enumerate(data)])
    model = vectors.reduction_model(rows, 3)
    loadings = model.pc.toArray()
    assert np.allclose(loadings.T @ loadings, np.eye(3), atol=1e-8)
    shares = model.explainedVariance.toArray()
    assert (np.diff(shares) < 0).all()
    reduced = vectors.reduce_dims(rows, 3, model=model).orderBy("id")
    got = np.array([r.reduced for r in reduced.collect()])
    signs = np.array(vectors.component_signs(model))
    assert np.allclose(got, data @ loadings * signs, atol=1e-4)
    turned = loadings * signs
    assert (turned[np.abs(turned).argmax(axis=0), range(3)] > 0).all()


def test_one_model_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        open(f"{folder}/{uuid.uuid4()}", "w").close()
        return lambda texts: np.ones((len(texts), 2))

    rows = spark.range(640).select("id", F.lit("a").alias("text")).repartition(64, "id")
    rows = rows.select("id", "text")
    assert vectors.encode_posts(rows, make).where("size(embedding) = 2").count() == 640
    loads = len(list(tmp_path.iterdir()))
    assert 1 <= loads <= spark.sparkContext.defaultParallelism
    # Another model takes the place of the last one.
    other = vectors.encode_posts(rows, lambda: lambda texts: np.ones((len(texts), 3)))
    assert other.where("size(embedding) = 3").count() == 640


def test_repair_inside_the_encoding_task(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        def encode(texts):
            with open(calls, "a") as file:
                file.write("x" * len(texts))
            seen = len(open(calls).read())
            return [[float("nan") if t == "once" and seen <= 3 else 3.0, 4.0, 9.0] for t in texts]
        return encode

    rows = spark.createDataFrame([(1, "a"), (2, "once"), (3, None)], "id int, text string").coalesce(1)
    got = vectors.encode_posts(rows, make, repair=True, truncate_dim=2).collect()
    assert [r.embedding for r in got] == [pytest.approx([0.6, 0.8])] * 3
    assert len(open(calls).read()) == 4
    never = vectors.encode_posts(rows, flaky_encoder(), repair=True)
    assert never.count() == 3
    bad = rows.withColumn("text", F.lit("bad"))
    with pytest.raises(Exception, match="not finite after repair"):
        vectors.encode_posts(bad, flaky_encoder(), repair=True).collect()


def test_embedding_job_reads_and_writes_once(spark, tmp_path):
    from postloom.plans.embedding import ARROW_ROWS, embed_table

    def make():
        return lambda texts: np.full((len(texts), 4), float(len(texts)))

    posts = spark.range(500).select(
        F.lit("d").alias("did"), F.col("id").cast("string").alias("rkey"), F.lit("some text").alias("text"))
    source, target = str(tmp_path / "posts"), str(tmp_path / "vectors")
    posts.coalesce(1).write.parquet(source)
    before = spark.conf.get(ARROW_ROWS)
    embed_table(spark, source, target, make, unit_length=False, truncate_dim=2, batch=64, batch_rows=100)
    assert spark.conf.get(ARROW_ROWS) == before
    rows = spark.read.parquet(target).collect()
    assert len(rows) == 500 and {len(r.embedding) for r in rows} == {2}
    # Batches of 100 rows reach the encoder as 64 and 36 texts.
    assert {r.embedding[0] for r in rows} <= {64.0, 36.0} | {float(n) for n in range(1, 64)}
    assert max(r.embedding[0] for r in rows) <= 64


def test_a_worker_holds_the_texts_of_few_posts():
    """Of a batch of 1,000 posts the first vectors are given away when a hundred have been encoded."""
    seen = []

    class Posts:
        schema = StructType([StructField("text", StringType())])

        def mapInArrow(self, task, schema):
            return lambda batches: task(iter(batches))

        def mapInPandas(self, task, schema):
            return lambda batches: task(b.to_pandas() for b in batches)

    def encode(texts):
        seen.append(len(texts))
        return np.ones((len(texts), 2))

    batch = pa.RecordBatch.from_pydict({"text": [None, *map(str, range(999))]})
    task = vectors.encode_posts(Posts(), lambda: encode)
    next(task([batch]))
    assert 0 < sum(seen) <= 100
    assert sum(len(part) for part in task([batch])) == 1_000
    assert set(seen[:-1]) == {32}
