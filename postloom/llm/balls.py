"""Links of clumped vectors, exactly: balls around pivots, compared block by block.

A pivot has many links.  Vectors within the link angle of a pivot belong to the ball of the nearest
one and are compared with all vectors that can link with a member of the ball, by the triangle
inequality of angles: those within twice the link angle of the pivot.  Vectors are dealt to blocks
of like angle to the pivot.  Two blocks whose largest angles add up to at most the link angle link
in full without a comparison, two whose angles differ by more do not link at all; only what lies
between is compared, a whole block with a whole block.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: A pivot has a link to more than the part of a leaf, and to so many sampled vectors at least.
DENSE_PART, LEAST_DENSE = 4, 8
BLOCK = 1024
#: Rings of equal breadth from a pivot to its link angle.
RINGS = 32
#: Arc cosines are exact to about 1e-8; what lies nearer to a bound is compared.
SLACK = 1e-6


def pivots_of(sample, count, leaf, threshold):
    """Unit vectors in the middle of the sample's clumps, densest first; ``sample`` stands for
    ``count`` vectors."""
    none = np.zeros((0, sample.shape[1]))
    if count <= leaf:
        return none
    least = max(leaf / DENSE_PART * len(sample) / count, LEAST_DENSE)
    single, degree = sample.astype(np.float32), np.zeros(len(sample), np.int64)
    for at in range(0, len(sample), 256):
        degree[at:at + 256] = (single[at:at + 256] @ single.T >= threshold).sum(axis=1)
    pivots, free = [], np.ones(len(sample), bool)
    for at in np.argsort(-degree, kind="stable"):
        if degree[at] < least:
            break
        if not free[at]:
            continue
        near = free & (sample @ sample[at] >= threshold)
        if near.sum() < least:
            continue
        middle = sample[near].mean(axis=0)
        middle /= np.linalg.norm(middle)
        around = free & (sample @ middle >= threshold)
        pivots.append(middle if around.sum() >= near.sum() else sample[at])
        free &= ~(around if around.sum() >= near.sum() else near)
    return np.array(pivots) if pivots else none


def reached(reps, pivots, limit):
    """``vec_id, copies, vector, ball, inner, angle`` for every vector and every ball with a member
    that it can link with; a pair of members of two balls is left to the first of the two."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            units = flat / np.linalg.norm(flat, axis=1, keepdims=True)
            for at in range(0, batch.num_rows, BLOCK):
                angles = np.arccos(np.clip(units[at:at + BLOCK] @ shared.value.T, -1, 1))
                own = angles.argmin(axis=1)
                own[angles.min(axis=1) > limit] = len(shared.value)
                balls = np.arange(len(shared.value))
                rows, ball = np.nonzero((angles <= 2 * limit + SLACK) & (balls <= own[:, None]))
                taken = batch.take(pa.array(rows + at))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(ball, pa.int32()), pa.array(own[rows] == ball),
                     pa.array(angles[rows, ball])],
                    ["vec_id", "copies", "vector", "ball", "inner", "angle"])

    return reps.select("vec_id", "copies", "vector").mapInArrow(
        task, "vec_id bigint, copies bigint, vector array<double>, ball int, inner boolean, angle double")


def blocks_of(reach, limit):
    """One row for each block: its vectors in ``rows``, its least and largest angle."""
    ringed = reach.withColumn("ring", F.floor(F.col("angle") * (RINGS / limit)))
    sizes = ringed.groupBy("ball", "inner", "ring").agg(
        F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = ringed.join(F.broadcast(sizes), ["ball", "inner", "ring"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), "parts"))
    return dealt.groupBy("ball", "inner", "ring", "part").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"),
        F.min("vec_id").alias("least"), F.sum("copies").alias("copies"),
        F.collect_list(F.struct("vec_id", "copies", "vector")).alias("rows")).withColumn(
        "block", F.concat_ws("-", "ball", "inner", "ring", "part"))


def compared_blocks(pairs, threshold):
    """Compare the vectors of ``one`` and ``two`` of each pair: ``vec_id, linked, n``."""

    def opened(column, i):
        rows = column[i].values
        count = len(rows)
        vectors = rows.field("vector").flatten().to_numpy().reshape(count, -1)
        return (rows.field("vec_id").to_numpy(), rows.field("copies").to_numpy(), vectors,
                np.linalg.norm(vectors, axis=1))

    def linked(same, one, two):
        """A link counts for both ends; the labels are the least vectors that links reach."""
        near = one[2] @ two[2].T
        near /= one[3][:, None] * two[3][None, :]
        near = near >= threshold
        if same:
            np.fill_diagonal(near, False)
        counts, labels = [near @ two[1], one[1] @ near], [one[0], two[0]]
        most = np.iinfo(np.int64).max
        while True:
            first = np.minimum(labels[0], np.where(near, labels[1][None, :], most).min(axis=1))
            second = np.minimum(labels[1], np.where(near, first[:, None], most).min(axis=0))
            if (first == labels[0]).all() and (second == labels[1]).all():
                break
            labels = [first, second]
        for ids, label, n in list(zip((one[0], two[0]), labels, counts))[:1 if same else 2]:
            kept = n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[kept]), pa.array(label[kept]), pa.array(n[kept])],
                ["vec_id", "linked", "n"])

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from linked(
                    batch.column(0)[i].as_py(), opened(batch.column(1), i), opened(batch.column(2), i))

    return pairs.select("same", "one", "two").mapInArrow(
        task, "vec_id bigint, linked bigint, n bigint")


def ball_links(reps, pivots, scratch, threshold):
    """``vec_id, linked, n`` of all links with a member of a ball, and the vectors in no ball."""
    limit = math.acos(threshold)
    reach = scratch.save(reached(reps, pivots, limit), "reach")
    blocks = scratch.save(blocks_of(reach, limit), "blocks")
    short = blocks.drop("rows", "ring", "part")
    first = short.where("inner").select("ball", *[
        F.col(c).alias(f"{c}_1") for c in ("block", "low", "high", "least", "copies")])
    second = short.select("ball", "inner", *[
        F.col(c).alias(f"{c}_2") for c in ("block", "low", "high", "least", "copies")])
    pairs = first.join(second, "ball").where(
        (~F.col("inner") | (F.col("block_1") <= F.col("block_2")))
        & (F.col("low_2") - F.col("high_1") <= limit + SLACK)
        & (F.col("low_1") - F.col("high_2") <= limit + SLACK)).withColumn(
        "same", F.col("block_1") == F.col("block_2")).withColumn(
        "settled", F.col("high_1") + F.col("high_2") <= limit - SLACK)
    pairs = scratch.save(pairs, "block-pairs")
    settled, open_ = pairs.where("settled"), pairs.where("not settled").select("same", "block_1", "block_2")
    rows = blocks.select("block", "rows")
    open_ = open_.join(rows.toDF("block_1", "one"), "block_1").join(rows.toDF("block_2", "two"), "block_2")
    found = scratch.save(compared_blocks(open_.repartition(F.xxhash64("block_1", "block_2")), threshold), "compared")
    # In a settled pair each vector links with all of the other block, so with its least one too.
    sides = F.array(
        F.struct(F.col("block_1").alias("block"), F.col("least_2").alias("linked"), F.col("copies_2").alias("n")),
        F.struct(F.col("block_2").alias("block"), F.col("least_1").alias("linked"), F.col("copies_1").alias("n")))
    sides = F.when(F.col("same"), F.slice(sides, 1, 1)).otherwise(sides)
    whole = settled.select("same", F.inline(sides)).groupBy("block").agg(
        F.min("linked").alias("linked"), F.sum("n").alias("n"), F.max("same").alias("own"))
    whole = blocks.select("block", F.explode("rows").alias("row")).join(whole, "block").select(
        "row.vec_id", "linked", (F.col("n") - F.when(F.col("own"), F.col("row.copies")).otherwise(0)).alias("n"))
    ties = settled.select(
        F.col("least_1").alias("vec_id"), F.col("least_2").alias("linked"), F.lit(0).cast("bigint").alias("n"))
    rest = reps.join(reach.where("inner").select("vec_id"), "vec_id", "left_anti")
    return found.unionByName(whole).unionByName(ties), scratch.save(rest, "rest")
