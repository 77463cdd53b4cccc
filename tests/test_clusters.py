import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.operators import clusters, density, hierarchy, neighbors
from postloom.operators.skew import join_per_key, positions


# ---------------------------------------------------------------- skew helpers


@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_per_key_is_a_plain_join(spark, hot_keys, how):
    rows = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("key")
    )
    keyed = rows.where("key <> 7").groupBy("key").agg(F.count("*").alias("n"))
    got = join_per_key(rows, keyed, "key", "n", how, hot_keys)
    wanted = rows.join(keyed, "key", how).select(got.columns)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


@pytest.mark.parametrize("values", [[], [5], list(range(300)), [2**i for i in range(40)]])
def test_positions_rank_everything(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    got = {r.v: r.position for r in positions(rows, "v").collect()}
    assert got == {float(v): i for i, v in enumerate(sorted(values))}


# ---------------------------------------------------------------- density


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("shape", ["chain", "hub", "random", "none"])
def test_components(spark, shape, few):
    random = np.random.default_rng(3)
    pairs = {
        "chain": [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)],
        "hub": [("500", f"{i:03d}") for i in range(100)] + [("900", "901")],
        "random": [tuple(f"{v:03d}" for v in random.choice(200, 2, False)) for _ in range(120)],
        "none": [],
    }[shape]
    links = spark.createDataFrame(pairs, "`left` string, `right` string").coalesce(2)
    got = {r.cell: r.root for r in density.components(links, few).collect()}
    wanted = union_find(pairs)
    assert got == {cell: root for cell, root in wanted.items() if cell != root}


def blobs(copies=0, noise=100):
    """Five tight groups on the unit sphere, scattered points, and copies of one point."""
    random = np.random.default_rng(11)
    centres = random.normal(size=(5, 32))
    groups = np.repeat(np.arange(5), 120)
    points = centres[groups] / np.linalg.norm(centres[groups], axis=1, keepdims=True)
    points = points + random.normal(size=points.shape) * 0.02
    scattered = random.normal(size=(noise, 32))
    data = np.vstack([points, np.repeat(points[:1], copies, axis=0), scattered])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    return data, [*groups, *[0] * copies, *[-1] * noise]


def post_frame(spark, data):
    return spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(data)], "post_id int, embedding array<float>"
    ).repartition(4)


@pytest.mark.parametrize("copies, noise", [(0, 100), (500, 100), (0, 1_000), (0, 10_000)])
def test_density_finds_the_groups_whatever_the_noise(spark, copies, noise):
    data, truth = blobs(copies, noise)
    found = hierarchy.density_clusters(post_frame(spark, data), 32, min_pts=10, min_cluster_size=40)
    got = {r.post_id: r.cluster for r in found.collect()}
    assert len(got) == len(data)
    names = [Counter(got[i] for i, t in enumerate(truth) if t == g) for g in range(5)]
    assert all(len(counts) == 1 for counts in names)
    assert {c for counts in names for c in counts} == set(range(5))
    # By chance a scattered point lies near a group.
    outside = [got[i] for i, t in enumerate(truth) if t == -1]
    assert outside.count(-1) >= 0.98 * noise


def test_density_prefers_stable_parts_to_a_loose_whole(spark):
    random = np.random.default_rng(3)
    centres = np.linalg.qr(random.normal(size=(16, 16)))[0]
    # Two tight groups with a few posts between them, and a lone loose group.
    one = centres[0] + random.normal(size=(150, 16)) * 0.03
    two = centres[0] * 0.55 + centres[1] + random.normal(size=(150, 16)) * 0.03
    bridge = (centres[0] + two[:1]) / 2 + random.normal(size=(6, 16)) * 0.03
    three = centres[5] + random.normal(size=(150, 16)) * 0.14
    data = np.vstack([one, two, three, bridge])
    found = hierarchy.density_clusters(post_frame(spark, data), 16, min_pts=5, min_cluster_size=30)
    got = {r.post_id: r.cluster for r in found.collect()}
    parts = [Counter(got[i] for i in range(a, a + 150)).most_common(1)[0] for a in (0, 150, 300)]
    assert len({cluster for cluster, _ in parts}) == 3 and all(size >= 140 for _, size in parts)
    assert -1 not in {cluster for cluster, _ in parts}


def test_rows_that_cannot_be_compared_are_noise(spark):
    nan = float("nan")
    rows = [(i, [1.0, i * 1e-3]) for i in range(50)]
    rows += [(100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [1.0]), (104, [None, 1.0])]
    frame = spark.createDataFrame(rows, "post_id int, v array<float>")
    found = hierarchy.density_clusters(frame, 2, vector="v", min_pts=5, min_cluster_size=20)
    got = {r.post_id: r.cluster for r in found.collect()}
    assert {got[i] for i in range(50)} == {0} and {got[i] for i in range(100, 105)} == {-1}
    assert hierarchy.density_clusters(frame.limit(0), 2, vector="v").count() == 0
    with pytest.raises(ValueError, match="cannot show"):
        hierarchy.density_clusters(frame, 2, vector="v", min_pts=30, k=16)


@pytest.mark.parametrize("posts, bucket, deal", [(3_000, 64, 1024), (3_000, 64, 50)])
def test_neighbours_have_exact_cosines_and_recall(spark, monkeypatch, posts, bucket, deal):
    monkeypatch.setattr(neighbors, "DEAL_ROWS", deal)
    random = np.random.default_rng(8)
    centres = random.normal(size=(posts // 10, 24))
    data = np.repeat(centres, 10, axis=0) + random.normal(size=(posts, 24)) * 0.25
    data = np.vstack([data, centres[:1] + random.normal(size=(400, 24)) * 0.02]).astype(np.float32)
    near = neighbors.nearest(post_frame(spark, data), 24, least=0.8, k=9, bucket=bucket).collect()
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    cosines = unit @ unit.T
    assert all(abs(r.cosine - cosines[r.post, r.near]) < 1e-8 and r.cosine >= 0.8 for r in near)
    assert max(Counter(r.post for r in near).values()) <= 9
    assert all(r.post != r.near for r in near)
    met = {(r.post, r.near) for r in near}
    pairs = np.argwhere(np.triu(cosines[10:posts, 10:posts] >= 0.8, 1)) + 10
    assert np.mean([(a, b) in met or (b, a) in met for a, b in pairs]) >= 0.9
    # The posts of the full bucket all have near ones.
    assert {r.post for r in near} >= set(range(posts, posts + 400))
    edges = neighbors.neighbor_edges(spark.createDataFrame(near)).collect()
    assert {(r.left, r.right) for r in edges} == {(min(p), max(p)) for p in met}


@pytest.mark.parametrize("deal", [4096, 60])
def test_a_full_bucket_is_searched_whole(spark, monkeypatch, deal):
    monkeypatch.setattr(neighbors, "DEAL_ROWS", deal)
    random = np.random.default_rng(3)
    data = np.ones(24) + random.normal(size=(500, 24)) * 0.05
    rows = post_frame(spark, data.astype(np.float32))
    # One bucket holds them all: the nearest are the nearest of all.
    got = {}
    for r in neighbors.nearest(rows, 24, least=0.5, k=5, bucket=500).collect():
        got.setdefault(r.post, set()).add(r.near)
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    assert got == {i: set(np.argsort(-row)[:5].tolist()) for i, row in enumerate(cosines)}
    capped = neighbors.nearest(rows, 24, least=0.5, k=5, bucket=500, representatives=64)
    assert capped.select("near").distinct().count() <= 64


@pytest.mark.parametrize("kind", [pa.int64(), pa.string()])
def test_one_group_of_the_search_holds_many_buckets(kind):
    def side(*rows):
        buckets, ids, vectors = zip(*rows) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "post": pa.array(ids, pa.int64()).cast(kind),
                         "vector": pa.array(vectors, pa.list_(pa.float32()))})

    posts = side((5, 1, [1, 0]), (2, 2, [1, 0]), (5, 3, [3, 4]), (7, 4, [0, 1]))
    others = side((2, 2, [1, 0]), (2, 9, [2, 0]), (5, 1, [1, 0]), (5, 3, [3, 4]), (6, 4, [0, 1]))
    found = neighbors.near_rows(posts, others, 2, 0.5, 1)
    assert sorted((str(r["post"]), str(r["near"]), r["cosine"]) for r in found.to_pylist()) == [
        ("1", "3", 0.6), ("2", "9", 1.0), ("3", "1", 0.6)]
    for none in (neighbors.near_rows(posts, side(), 2, 0.5, 1), neighbors.near_rows(side(), others, 2, 0.5, 1)):
        assert none.num_rows == 0 and none.schema == found.schema


def test_the_search_has_a_group_per_block_of_buckets(spark):
    rows = post_frame(spark, np.eye(8, dtype=np.float32))
    plan = neighbors.nearest(rows, 8, bucket=1)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line]
    assert keys and "block" in keys[0] and "bucket" not in keys[0].split("compare(")[0]


def test_copies_become_one_signature(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(400)], "post_id int, v array<float>")
    located = density.with_cells(rows, 2, vector="v")
    assert [r.weight for r in density.signatures(located).collect()] == [400]


@pytest.mark.parametrize("bad", [[[1.0]], [[1.0], [1.0, 0.0, 2.0]], [[1.0, math.nan]], [None]])
def test_wrong_width_fails(spark, bad):
    data = list(enumerate([[1.0, 0.0], *bad]))
    rows = spark.createDataFrame(data, "post_id int, v array<float>")
    with pytest.raises(Exception, match="reshape"):
        density.with_cells(rows.coalesce(1), 2, vector="v").collect()


def test_everything_can_be_noise(spark):
    rows = spark.createDataFrame(
        [(i, [math.cos(i), math.sin(i)]) for i in range(6)], "post_id int, v array<float>")
    found = hierarchy.density_clusters(rows, 2, vector="v", min_pts=3, min_cluster_size=40)
    assert {r.cluster for r in found.collect()} == {-1} and found.count() == 6


# ---------------------------------------------------------------- about clusters


@pytest.fixture(scope="module")
def members(spark):
    random = np.random.default_rng(5)
    sizes = {0: 3, 1: 40, 2: 400, -1: 30}
    rows = [
        (f"{c}/{i}", c, random.normal(size=8).tolist(), f"word{c} common t{i}")
        for c, size in sizes.items() for i in range(size)
    ]
    return spark.createDataFrame(
        rows, "post_id string, cluster int, reduced array<float>, text_clean string"
    ).repartition(4)


def test_centroids_are_means(members):
    got = {r.cluster: r for r in clusters.centroids(members).collect()}
    rows = members.where("cluster <> -1").collect()
    assert sorted(got) == [0, 1, 2]
    for cluster, row in got.items():
        vectors = np.array([r.reduced for r in rows if r.cluster == cluster])
        assert row["size"] == len(vectors)
        assert np.allclose(row.centroid, vectors.mean(axis=0), atol=1e-6)


def test_sample(members):
    similar = clusters.member_similarity(members, clusters.centroids(members))
    first = clusters.sample_members(similar).collect()
    again = clusters.sample_members(similar.repartition(7)).collect()
    assert Counter(r.cluster for r in first) == {0: 3, 1: 10, 2: 10}
    assert {r.post_id for r in first} == {r.post_id for r in again}
    other = clusters.sample_members(similar, seed=43).collect()
    assert {r.post_id for r in first} != {r.post_id for r in other}


def test_sample_prefers_similar_and_survives_zero_weights(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("post_id"), F.lit(1).alias("cluster"),
        F.when(F.col("id") < 200, 1.0).otherwise(-0.5).alias("similarity"),
    )
    assert all(r.post_id < 200 for r in clusters.sample_members(rows).collect())
    flat = rows.withColumn("similarity", F.lit(0.0))
    assert clusters.sample_members(flat).count() == 10


def test_prompt(members):
    sample = clusters.sample_members(
        clusters.member_similarity(members, clusters.centroids(members))
    )
    prompts = {r.cluster: r.prompt for r in clusters.cluster_prompts(sample).collect()}
    lines = prompts[1].split("\n\n")[1].split("\n")
    assert len(lines) == 5 and all(line.startswith("word1 common t") for line in lines)
    first = [r for r in sample.collect() if r.cluster == 1 and r["rank"] == 1][0]
    assert lines[0] == first.text_clean


def test_labeller_hook(members):
    def make():
        return lambda prompts: [
            f"user {p[:9]} model Provide a concise topic. model  Topic  {len(p) > 0} " for p in prompts
        ]

    sample = clusters.sample_members(
        clusters.member_similarity(members, clusters.centroids(members))
    )
    labels = clusters.label_clusters(clusters.cluster_prompts(sample), make).collect()
    assert {(r.cluster, r.summary) for r in labels} == {(c, "Topic True") for c in (0, 1, 2)}


def test_terms(members):
    got = {r.cluster: r.summary.split(" ") for r in clusters.cluster_terms(members).collect()}
    assert sorted(got) == [0, 1, 2]
    for cluster, terms in got.items():
        assert terms[0] == f"word{cluster}" and len(terms) == 4


def test_scaling(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (2.0, 4.0)], "x double, y double")
    got = clusters.scale_to_unit(rows, "x", "y").orderBy("x").collect()
    assert [(r.x, r.y) for r in got] == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("count", [1, 2, 9])
def test_bubbles(spark, count):
    rows = [(3 * i, i + 1, float(i), float(-i), f"s{i}") for i in range(count)]
    summary = spark.createDataFrame(rows, "cluster int, size long, x double, y double, summary string")
    got = clusters.bubble_table(summary).orderBy("cluster").collect()
    assert [r.color for r in got] == pytest.approx([i / max(count - 1, 1) for i in range(count)])
    assert [r.label for r in got] == [f"Cluster {3 * i}" for i in range(count)]
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in got)
    assert got[-1].size_scaled == pytest.approx(count**0.5)


def test_lone_centroid_has_a_place(spark):
    one = spark.createDataFrame([(4, [1.0, 2.0])], "cluster int, centroid array<double>")
    assert [tuple(r) for r in clusters.centroid_xy(one).collect()] == [(4, 0.0, 0.0)]
