"""Dense cells: where posts meet, and how cells are linked.

A cell is a box of ``cell_width`` along ``projections`` random directions; each
of ``tables`` tables has its own directions and offsets, so that close posts
parted by an edge in one table share a cell in another.

* A cell that holds ``min_pts`` posts is dense.
* A post is a core post when it lies in ``min_cells`` dense cells; one dense
  cell alone can be chance.
* Two dense cells are linked when ``min_pts`` core posts lie in both.

Cells count posts without comparing them; clusters come from compared neighbours,
see ``operators/hierarchy.py``.  Copies of a post collapse into one weighted
signature before anything is joined.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from postloom import fixed_values as V
from postloom.functions.hashing import md5_uint
from postloom.operators.skew import join_per_key, positions
from postloom.session import write_and_read

MIN_CELLS = 2
FEW_EDGES = 100_000


def directions(dims, projections, tables, seed):
    """A sign matrix and box offsets, fixed by md5 so that any engine can repeat them."""

    def digest(*parts):
        return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()

    lines = [(t, p) for t in range(tables) for p in range(projections)]
    signs = [[1.0 if digest(t, p, i)[0] < "8" else -1.0 for i in range(dims)] for t, p in lines]
    shifts = [int(digest(t, p)[:8], 16) / 16**8 for t, p in lines]
    return np.array(signs).T, np.array(shifts)


def with_cells(rows, dims, id="post_id", vector="embedding", cell_width=1.0, projections=6,
               tables=8, seed=V.REDUCE_SEED):
    """``id, cells``: the names of the ``tables`` cells each vector lies in.

    The projection is one matrix product per Arrow batch; a vector that is
    missing, of another width or not finite fails the job.
    """
    signs, shifts = directions(dims, projections, tables, seed)
    width = len(shifts)

    def box_task(batches):
        for batch in batches:
            count = batch.num_rows
            widths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if (widths != dims).any() or not np.isfinite(flat).all():
                raise ValueError(f"cannot reshape to rows of {dims} finite numbers")
            matrix = flat.reshape(count, dims)
            boxes = np.floor(matrix @ signs / cell_width + shifts).astype(np.int32)
            ends = pa.array(np.arange(count + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(ends, pa.array(boxes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id, "boxes"])

    points = rows.select(id, vector)
    schema = StructType([points.schema[id], StructField("boxes", ArrayType(IntegerType()))])
    cells = F.array(*[
        F.concat(
            F.lit(f"{t}:"),
            F.array_join(F.slice("boxes", 1 + t * projections, projections), ","),
        )
        for t in range(tables)
    ])
    return points.mapInArrow(box_task, schema).select(id, cells.alias("cells"))


def signatures(located):
    """Posts that share all cells, as one weighted row."""
    return located.groupBy("cells").agg(F.count("*").alias("weight"))


def dense_cells(found, min_pts=V.MIN_CLUSTER_SIZE):
    """Cells with at least ``min_pts`` posts."""
    spread = found.select(F.explode("cells").alias("cell"), "weight")
    filled = spread.groupBy("cell").agg(
        F.sum("weight").alias("posts"), F.count("*").alias("signatures")
    )
    return filled.where(F.col("posts") >= min_pts)


def dense_members(found, dense, min_cells=MIN_CELLS):
    """Signatures of core posts with their dense cells, sorted by name, and the fullest of them."""
    spread = found.select("cells", "weight", F.explode("cells").alias("cell"))
    kept = join_per_key(spread, dense, "cell", "signatures")
    # One row per table at most meets here, so the lists are short.
    return (
        kept.groupBy("cells", "weight")
        .agg(
            F.sort_array(F.collect_list("cell")).alias("dense"),
            F.max(F.struct("posts", "cell")).alias("_fullest"),
        )
        .where(F.size("dense") >= min_cells)
        .withColumn("cell", F.col("_fullest.cell"))
        .drop("_fullest")
    )


def cell_links(members, min_pts=V.MIN_CLUSTER_SIZE):
    """Pairs of dense cells with at least ``min_pts`` core posts in both."""
    pairs = F.flatten(
        F.transform(
            "dense",
            lambda a, i: F.transform(
                F.slice("dense", i + 2, F.size("dense")),
                lambda b: F.struct(a.alias("left"), b.alias("right")),
            ),
        )
    )
    spread = members.select(F.explode(pairs).alias("pair"), "weight")
    shared = spread.groupBy("pair.left", "pair.right").agg(F.sum("weight").alias("posts"))
    return shared.where(F.col("posts") >= min_pts)


def smallest_neighbours(edges):
    """For each node ``of`` with an edge: its least neighbour and its degree."""
    return edges.groupBy("of").agg(F.min("to").alias("least"), F.count("*").alias("degree"))


def both_ways(edges):
    ends = F.array(
        F.struct("of", "to"), F.struct(F.col("to").alias("of"), F.col("of").alias("to"))
    )
    return edges.select(F.inline(ends))


def large_star(edges):
    """Tie each node's larger neighbours to the least node it knows."""
    spread = both_ways(edges)
    least = smallest_neighbours(spread)
    tied = join_per_key(spread.where("to > of"), least, "of", "degree")
    return tied.select(F.col("to").alias("of"), F.least("of", "least").alias("to")).distinct()


def small_star(edges):
    """Tie each node and its smaller neighbours to the least of them."""
    least = smallest_neighbours(edges)
    tied = join_per_key(edges, least, "of", "degree")
    ends = F.array(
        F.struct(F.col("to").alias("of"), F.col("least").alias("to")),
        F.struct(F.col("of"), F.col("least").alias("to")),
    )
    return tied.select(F.inline(ends)).where("of <> to").distinct()


def is_star_forest(edges):
    """Every node hangs on one root, and no root hangs on anything."""
    ends = F.array(
        F.struct(F.col("of").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("to").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(
        F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")
    )
    return nodes.where("hangs + holds > 1").isEmpty()


def united(edges):
    """``cell, root`` of a bounded number of edges, by union-find in one task."""
    kind = edges.schema["of"].dataType.simpleString()

    def task(batches):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        like = None
        for batch in batches:
            like = batch
            for one, two in zip(batch.column("of").to_pylist(), batch.column("to").to_pylist()):
                one, two = find(one), find(two)
                parent[max(one, two)] = min(one, two)
        if like is not None:
            cells = [x for x in parent if find(x) != x]
            type_ = like.schema.field("of").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, type_), pa.array([find(x) for x in cells], type_)], ["cell", "root"])

    return edges.repartition(1).mapInArrow(task, f"cell {kind}, root {kind}")


def components(links, few=FEW_EDGES):
    """``cell, root`` for every linked cell that is not itself a root; the root is the least cell.

    Up to ``few`` edges, a bound that does not grow with the data, are united by one task.  More
    take alternating large-star and small-star steps: the number of edges never grows, and the
    rounds needed grow with the logarithm of the graph.  Each round is written down, so a lost
    executor does not replay earlier rounds.
    """
    edges = write_and_read(
        links.select(F.greatest("left", "right").alias("of"), F.least("left", "right").alias("to")),
        "edges",
    )
    if edges.count() <= few:
        return write_and_read(united(edges), "united")
    while not is_star_forest(edges):
        edges = write_and_read(large_star(edges), "edges")
        edges = write_and_read(small_star(edges), "edges")
    return edges.select(F.col("of").alias("cell"), F.col("to").alias("root"))


def numbered(clusters):
    """Clusters numbered from 0, in the order of a hash of their root cell."""
    hashed = clusters.withColumn("_order", md5_uint(F.col("root").cast("string"), 1, 13))
    return positions(hashed, "_order", "cluster").withColumn(
        "cluster", F.col("cluster").cast("int")
    ).drop("_order")


def locate(rows, dims, id="post_id", vector="embedding", min_pts=V.MIN_CLUSTER_SIZE,
           **cell_options):
    """Three written tables: the rows with their cells, the signatures, the dense cells."""
    located = write_and_read(with_cells(rows, dims, id, vector, **cell_options), "cells")
    found = write_and_read(signatures(located), "signatures")
    return located, found, write_and_read(dense_cells(found, min_pts), "dense-cells")
