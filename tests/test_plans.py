"""Whole jobs, from input table to output table."""

import numpy as np

from postloom.operators.posts import collected_posts
from postloom.operators.vectors import hashing_encoder
from postloom.plans.cluster_map import cluster_map
from postloom.plans.embedding import embed_table
from postloom.session import work_dir
from postloom.sources.tables import firehose
from postloom.streaming.sinks import write_table

def test_embedding_job(spark, folder):
    posts, plain, clean = (work_dir(spark, name) for name in ("posts", "plain", "clean"))
    write_table(collected_posts(firehose(spark, folder)), posts)
    embed_table(spark, posts, plain, hashing_encoder(32))
    rows = spark.read.parquet(plain)
    assert rows.columns == ["post_id", "text", "embedding"]
    assert rows.count() == spark.read.parquet(posts).count()
    embed_table(spark, posts, clean, hashing_encoder(32), clean=True, limit=50, truncate_dim=8)
    rows = spark.read.parquet(clean)
    assert rows.columns == ["post_id", "text", "text_clean", "embedding"]
    assert 0 < rows.count() <= 50
    assert {len(r.embedding) for r in rows.collect()} == {8}


def test_cluster_map_job(spark):
    random = np.random.default_rng(2)
    centres = random.normal(size=(3, 16))
    rows = [
        (f"p{g}/{i}", (centres[g] + random.normal(size=16) * 0.02).tolist(), f"topic{g} word{i}")
        for g in range(3) for i in range(80)
    ]
    vectors = spark.createDataFrame(rows, "post_id string, embedding array<float>, text_clean string")
    bubbles = cluster_map(vectors, dims=8, min_pts=10).collect()
    assert sorted(b.summary.split(" ")[0] for b in bubbles) == ["topic0", "topic1", "topic2"]
    assert [b["size"] for b in bubbles] == [80, 80, 80]
    assert {b.color for b in bubbles} == {0.0, 0.5, 1.0}

    def labeller():
        return lambda prompts: ["x model Provide a concise topic model Named" for _ in prompts]

    named = cluster_map(vectors, labeller, dims=8, min_pts=10).collect()
    assert {b.summary for b in named} == {"Named"}
