"""Hierarchical density clustering with noise over verified near posts.

* The core similarity of a post is the cosine of its ``min_pts``-th nearest post, itself included.
* Two near posts reach each other at the least of their cosine and their two core similarities.
* At each level of a ladder of similarities, from strict to loose, posts whose core similarity is
  at least the level are connected where they reach each other at it.
* A component of ``min_cluster_size`` posts is a cluster.  It goes on to the next level while it is
  the only cluster in its component there; where several meet, a new one begins.
* A cluster's stability is its posts times the widths of its levels, a level's width being the fall
  of 1 / (1 - similarity) to the next one.  From strict to loose, a cluster takes the place of those
  inside it where its stability is no less than theirs together; what is left are the clusters.
* All other posts are noise.

Posts of equal vectors are one weighted point.  A level connects the components of the one before,
by the edges it adds, so every edge is used once; all rounds are written tables.
"""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.operators.density import components, numbered
from postloom.operators.neighbors import NEIGHBORS, comparable, nearest
from postloom.session import write_and_read

LEVELS = (0.9, 0.8, 0.7, 0.6, 0.5)


def widths(levels):
    """Width of each level; the last one ends as much lower as it is below the one before."""
    ladder = [*levels, levels[-1] - (levels[-2] - levels[-1] if len(levels) > 1 else levels[-1])]
    heights = [1 / (1 - c) for c in ladder]
    return [a - b for a, b in zip(heights, heights[1:])]


def weighted_points(rows, dims, id="post_id", vector="embedding"):
    """``point, vector, weight``: one row per distinct vector, named by its least id, and ``id, point``
    of all rows that can be compared."""
    sound = comparable(rows, dims, id, vector).select(id, vector)
    points = write_and_read(
        sound.groupBy(vector).agg(F.min(id).alias("point"), F.count("*").alias("weight")), "points")
    return points, sound.join(points.select(vector, "point"), vector).select(id, "point")


def core_similarity(points, near, min_pts):
    """``point, weight, core`` of the points that have ``min_pts`` posts near, copies included."""
    own = points.select("point", "weight", F.lit(1.0).alias("cosine"), F.col("point").alias("near"),
                        F.col("weight").alias("posts"))
    others = near.withColumnRenamed("post", "point").join(
        points.select(F.col("point").alias("near"), F.col("weight").alias("posts")), "near")
    listed = others.groupBy("point").agg(F.collect_list(F.struct(-F.col("cosine"), "near", "posts")).alias("l"))
    listed = own.select("point", "weight", "posts").join(listed, "point", "left")
    nothing = F.array().cast("array<struct<c:double,posts:bigint>>")
    steps = F.coalesce(F.transform(F.array_sort("l"), lambda x: F.struct(
        (-x["col1"]).alias("c"), x["posts"].alias("posts"))), nothing)
    # Add up posts from the nearest on until there are enough; -1 is not enough yet.
    start = F.struct(F.col("posts").cast("bigint").alias("n"),
                     F.when(F.col("posts") >= min_pts, 1.0).otherwise(-1.0).alias("core"))
    done = F.aggregate(steps, start, lambda acc, x: F.struct(
        (acc["n"] + x["posts"]).alias("n"),
        F.when((acc["n"] < min_pts) & (acc["n"] + x["posts"] >= min_pts), x["c"])
        .otherwise(acc["core"]).alias("core")))
    cored = listed.select("point", "weight", done["core"].alias("core"))
    return cored.where("core > -1")


def level_of(similarity, levels):
    """The strictest level, from 0, that ``similarity`` reaches; null if none."""
    found = F.lit(None).cast("int")
    for at in reversed(range(len(levels))):
        found = F.when(F.round(similarity, 9) >= levels[at], at).otherwise(found)
    return found


def reach_edges(near, cores, levels):
    """``left, right, level``: near core posts with the first level they reach each other at."""
    core = cores.select("point", "core")
    ends = near.join(core.withColumnsRenamed({"point": "post", "core": "_a"}), "post").join(
        core.withColumnsRenamed({"point": "near", "core": "_b"}), "near")
    reach = level_of(F.least("cosine", "_a", "_b"), levels)
    pairs = ends.select(F.least("post", "near").alias("left"), F.greatest("post", "near").alias("right"),
                        reach.alias("level"))
    return pairs.where("level is not null").groupBy("left", "right").agg(F.min("level").alias("level"))


def renamed(edges, roots):
    """Edges between the components that hold their ends, each pair once."""
    for end in ("left", "right"):
        names = roots.select(F.col("cell").alias(end), "root")
        edges = edges.join(names, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return edges.where(F.col("left") != F.col("right")).groupBy(
        F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")
    ).agg(F.min("level").alias("level"))


def merge_levels(cores, edges, levels, min_cluster_size):
    """For each level two tables: ``node, root, fresh``, what became part of which component, points
    that enter at this level as fresh ones, and the components ``root, size, own, best, chosen``."""
    width = widths(levels)
    cores = write_and_read(cores.select("point", "weight", level_of(F.col("core"), levels).alias("level"))
                           .where("level is not null"), "cores")
    edges = write_and_read(edges, "reach")
    none, found = F.lit(0.0), []
    held = None
    for at in range(len(levels)):
        fresh = cores.where(F.col("level") == at).select(
            F.col("point").alias("node"), F.col("weight").alias("size"),
            none.alias("own"), none.alias("best"), F.lit(False).alias("big"), F.lit(True).alias("fresh"))
        nodes = fresh if held is None else fresh.unionByName(held)
        roots = components(edges.where(F.col("level") == at).select("left", "right"))
        merged = write_and_read(
            nodes.join(roots.withColumnRenamed("cell", "node"), "node", "left")
            .withColumn("root", F.coalesce("root", "node")), f"merged-{at}")
        grown = merged.groupBy("root").agg(
            F.sum("size").alias("size"), F.sum(F.col("big").cast("int")).alias("parts"),
            F.sum("own").alias("own"), F.sum("best").alias("best"))
        big = F.col("size") >= min_cluster_size
        own = F.when(big, F.col("size") * F.lit(width[at])
                     + F.when(F.col("parts") == 1, F.col("own")).otherwise(0.0)).otherwise(0.0)
        grown = grown.select("root", "size", big.alias("big"), own.alias("own"), F.col("best").alias("inner"))
        chosen = F.col("big") & (F.round("own", 6) >= F.round("inner", 6))
        grown = write_and_read(
            grown.select("root", "size", "big", "own", F.greatest("own", "inner").alias("best"),
                         chosen.alias("chosen")), f"components-{at}")
        found.append((merged.select("node", "root", "fresh"), grown))
        held = grown.select(
            F.col("root").alias("node"), "size", "own", "best", "big", F.lit(False).alias("fresh"))
        if at + 1 < len(levels):
            edges = write_and_read(renamed(edges.where(F.col("level") > at), roots), f"edges-{at}")
    return found


def chosen_clusters(merges):
    """``point, root`` of the points in a chosen cluster; ``root`` names the cluster."""
    covered, points = None, None
    for merged, grown in reversed(merges):
        named = grown.select("root", F.when(F.col("chosen"), F.col("root")).alias("cluster"))
        if covered is not None:
            # A component inside a chosen cluster belongs to it, whatever it chose itself.
            outer = covered.select(F.col("node").alias("root"), F.col("cluster").alias("_outer"))
            named = named.join(outer, "root", "left").select(
                "root", F.coalesce("_outer", "cluster").alias("cluster"))
        covered = merged.join(named.where("cluster is not null"), "root")
        entered = covered.where("fresh").select(
            F.col("node").alias("point"), F.col("cluster").alias("root"))
        points = entered if points is None else points.unionByName(entered)
    return points


def density_clusters(rows, dims, id="post_id", vector="embedding", min_pts=10,
                     min_cluster_size=V.MIN_CLUSTER_SIZE, levels=LEVELS, k=NEIGHBORS, **search):
    """``id, cluster`` for every row; noise has cluster -1.

    Ids are unique.  Rows without an id or with a vector that is missing, zero, not finite or of
    another width than ``dims`` are noise.
    """
    if k < min_pts - 1:
        raise ValueError(f"{k} neighbours cannot show {min_pts} posts")
    rows = write_and_read(rows.select(id, vector), "vectors")
    points, named = weighted_points(rows, dims, id, vector)
    near = write_and_read(
        nearest(points, dims, "point", vector, least=levels[-1], k=k, **search), "near")
    cores = write_and_read(core_similarity(points, near, min_pts), "core")
    merges = merge_levels(cores, reach_edges(near, cores, levels), levels, min_cluster_size)
    inside = write_and_read(chosen_clusters(merges), "inside")
    numbers = write_and_read(numbered(inside.select("root").distinct()).select("root", "cluster"), "numbers")
    placed = inside.join(numbers, "root").select("point", "cluster")
    placed = named.join(placed, "point").select(id, "cluster")
    return rows.select(id).join(placed, id, "left").select(
        id, F.coalesce("cluster", F.lit(V.NOISE)).alias("cluster"))
