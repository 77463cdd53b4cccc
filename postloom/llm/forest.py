"""Near-duplicate vectors by a forest of random-projection trees.

Each tree cuts the vectors again and again at the median of a random direction; vectors near the
cut go to both sides (spill).  Vectors that share a leaf of any tree are compared, links are
verified with the exact cosine in double precision, and linked vectors are united.

The upper cuts are fitted on a bounded sample, every vector is routed.  A leaf that is still too
large is cut further by medians over all of its vectors, so no leaf goes to one task whole.  Trees
are added until partners made for the sampled vectors, at the threshold itself, are measured to
meet in some leaf.

A clump of near copies has no median that keeps its pairs together, so the trees do not get it:
vectors near a pivot that has many links (``balls.py``) are compared exactly with all that can link
with them, and only the rest goes to the forest.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postloom.llm.balls import ball_links, pivots_of
from postloom.llm.graph import components
from postloom.llm.scratch import Scratch, is_small

THRESHOLD = 0.9
LEAF = 1024
SPILL = 0.06
SAMPLE = 20_000
LEAST_SAMPLED = 16
#: The share of linked pairs at the threshold that all trees together may miss.
MISS = 0.01
BLOCK = 1024
TREE_BITS = 40


def direction(width, *key):
    """A random direction fixed by its key."""
    digest = hashlib.blake2b(":".join(map(str, key)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little")).normal(size=width)


def keyed(rows):
    """``vec_id, content, vector`` of the vectors that can link: finite components, not all zero,
    and a vec_id.

    ``content`` names the direction to nine digits, so multiples of a vector share it; ``vector``
    is scaled by a power of two, so no length overflows.
    """

    def task(batches):
        for batch in batches:
            ids, keys, vectors = [], [], []
            for vec_id, vector in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                if vec_id is None or vector is None or None in vector:
                    continue
                values = np.array(vector, np.float64)
                if np.isfinite(values).all() and values.any():
                    values = np.ldexp(values, -np.frexp(np.abs(values).max())[1])
                    unit = np.round(values / np.linalg.norm(values), 9) + 0.0
                    ids.append(vec_id)
                    keys.append(hashlib.blake2b(unit.tobytes(), digest_size=16).digest())
                    vectors.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "content", "vector"])

    return rows.select("vec_id", "embedding").mapInArrow(
        task, "vec_id bigint, content binary, vector array<double>")


def unit_rows(column):
    flat = column.flatten().to_numpy().reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def partners(vectors, threshold):
    """For each unit vector one at cosine ``threshold`` to it, in a random direction."""
    away = np.random.default_rng(0).normal(size=vectors.shape)
    away -= (away * vectors).sum(axis=1, keepdims=True) * vectors
    length = np.linalg.norm(away, axis=1, keepdims=True)
    away /= np.where(length > 0, length, 1)
    return threshold * vectors + math.sqrt(1 - threshold**2) * away


def fit_forest(sample, count, width, leaf=LEAF, threshold=THRESHOLD):
    """Nodes of all trees, ``{(tree, node): (direction, low, high)}``, and the number of trees; a
    leaf has no entry.

    ``sample`` stands for ``count`` vectors.  A node is cut while it stands for more than ``leaf``
    vectors and the sample has ``LEAST_SAMPLED`` there.  Every sampled vector goes down with a
    partner; there are trees until the chance that partners never met is ``MISS`` on average.
    Below the sample's reach each cut still to come keeps partners as the last cut did.
    """
    nodes, share, trees = {}, count / max(1, len(sample)), 0
    mates, missed = partners(sample, threshold), np.ones(len(sample))
    while not trees or missed.sum() > MISS * len(missed):
        met = np.zeros(len(sample))
        open_nodes = [(1, np.arange(len(sample)), np.arange(len(sample)), 1.0)]
        while open_nodes:
            node, members, pairs, stay = open_nodes.pop()
            here = len(members) * share
            if here <= leaf or len(members) < LEAST_SAMPLED:
                deeper = math.ceil(math.log2(max(1, here / leaf)))
                met[pairs] = np.maximum(met[pairs], stay**deeper)
                continue
            line = direction(width, "node", trees, node)
            place = sample[members] @ line
            low, high = np.quantile(place, [0.5 - SPILL, 0.5 + SPILL])
            nodes[trees, node] = line, low, high
            one, two = sample[pairs] @ line, mates[pairs] @ line
            lower, upper = (one <= high) & (two <= high), (one >= low) & (two >= low)
            stay = (lower | upper).mean() if len(pairs) else stay
            open_nodes.append((2 * node, members[place <= high], pairs[lower], stay))
            open_nodes.append((2 * node + 1, members[place >= low], pairs[upper], stay))
        missed *= 1 - met
        trees += 1
    return nodes, trees


def routed(reps, nodes, trees):
    """``vec_id, leaf`` for every vector and every leaf it falls into."""
    shared = reps.sparkSession.sparkContext.broadcast(nodes)

    def task(batches):
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            vectors = unit_rows(batch.column(1))
            found_ids, leaves = [], []
            for tree in range(trees):
                waiting = [(1, np.arange(len(ids)))]
                while waiting:
                    node, members = waiting.pop()
                    cut = known.get((tree, node))
                    if cut is None:
                        found_ids.append(ids[members])
                        leaves.append(np.full(len(members), (tree << TREE_BITS) + node, np.int64))
                        continue
                    place = vectors[members] @ cut[0]
                    waiting.append((2 * node, members[place <= cut[2]]))
                    waiting.append((2 * node + 1, members[place >= cut[1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found_ids)), pa.array(np.concatenate(leaves))],
                ["vec_id", "leaf"])

    return reps.select("vec_id", "vector").mapInArrow(task, "vec_id bigint, leaf bigint")


def projected(rows, width, step):
    """Add ``place``: the vector along a random direction of its leaf and step."""

    def task(batches):
        lines = {}
        for batch in batches:
            vectors = unit_rows(batch.column(2)) if batch.num_rows else None
            places = np.zeros(batch.num_rows)
            leaves = batch.column(1).to_numpy()
            for leaf in np.unique(leaves):
                if leaf not in lines:
                    lines[leaf] = direction(width, "leaf", step, leaf)
                here = leaves == leaf
                places[here] = vectors[here] @ lines[leaf]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places)], ["vec_id", "leaf", "place"])

    return rows.select("vec_id", "leaf", "vector").mapInArrow(
        task, "vec_id bigint, leaf bigint, place double")


def cut_large(placed, reps, width, scratch, most):
    """Cut leaves of more than ``most`` vectors at medians over all their vectors, until none is
    left; new leaves are named by a hash within their tree."""
    step = 0
    while True:
        large = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = scratch.save(large.select("leaf"), f"large-{step}")
        if large.isEmpty():
            return placed
        inside = placed.join(large, "leaf", "left_semi").join(reps.select("vec_id", "vector"), "vec_id")
        inside = scratch.save(projected(inside, width, step), f"projected-{step}")
        cuts = inside.groupBy("leaf").agg(F.percentile_approx(
            "place", [0.5 - SPILL, 0.5 + SPILL], 10_000).alias("cut"))
        sides = F.array_compact(F.array(
            F.when(F.col("place") <= F.col("cut")[1], F.lit(0)),
            F.when(F.col("place") >= F.col("cut")[0], F.lit(1))))
        named = F.shiftleft(F.shiftright("leaf", TREE_BITS), TREE_BITS) + F.pmod(
            F.xxhash64("leaf", "side", F.lit(step)), F.lit(1 << TREE_BITS))
        halves = inside.join(cuts, "leaf").select("vec_id", "leaf", F.explode(sides).alias("side"))
        halves = halves.select("vec_id", named.alias("leaf"))
        rest = placed.join(large, "leaf", "left_anti").select("vec_id", "leaf")
        placed = scratch.save(rest.unionByName(halves), f"placed-{step}")
        scratch.drop(f"large-{step}", f"projected-{step}")
        step += 1


def leaf_links(rows, threshold=THRESHOLD):
    """Compare the vectors of each leaf: ``vec_id, linked, n``.

    ``rows`` has ``leaf, vec_id, copies, leaves, vector`` with all leaves of the vector, ascending.
    ``n`` counts the vectors linked to ``vec_id`` whose first common leaf this is, copies too;
    ``linked`` is the least vector that links in the leaf reach, so links are not listed.
    """

    def compared(leaf, ids, copies, leaves, vectors):
        count = len(ids)
        norms = np.linalg.norm(vectors, axis=1)
        width = max(map(len, leaves))
        places = np.full((count, width), -1, np.int64)
        for i, own in enumerate(leaves):
            places[i, :len(own)] = own
        links, least = np.zeros(count, np.int64), np.arange(count)
        ones, twos = [], []
        for at in range(0, count, BLOCK):
            part = vectors[at:at + BLOCK] @ vectors[at:].T
            part /= norms[at:at + BLOCK, None] * norms[None, at:]
            one, two = np.nonzero(part >= threshold)
            later = two > one
            ones.append(one[later] + at)
            twos.append(two[later] + at)
        one, two = np.concatenate(ones), np.concatenate(twos)
        for at in range(0, len(one), 20_000):
            i, j = one[at:at + 20_000], two[at:at + 20_000]
            first = np.full(len(i), -1, np.int64)
            for k in range(width - 1, -1, -1):
                own = places[i, k]
                met = (places[j] == own[:, None]).any(axis=1) & (own >= 0)
                first[met] = own[met]
            here = first == leaf
            np.add.at(links, i[here], copies[j[here]])
            np.add.at(links, j[here], copies[i[here]])
        while len(one):
            lower = np.minimum(least[one], least[two])
            if (least[one] == lower).all() and (least[two] == lower).all():
                break
            np.minimum.at(least, one, lower)
            np.minimum.at(least, two, lower)
        kept = (links > 0) | (least != np.arange(count))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[kept]), pa.array(ids[least[kept]]), pa.array(links[kept])],
            ["vec_id", "linked", "n"])

    def task(batches):
        leaf, parts = None, [[], [], [], []]
        for batch in batches:
            names = batch.column(0).to_pylist()
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            flat, ends = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            ends = ends - ends[0]
            for i, name in enumerate(names):
                if name != leaf:
                    if parts[0]:
                        yield compared(leaf, np.array(parts[0]), np.array(parts[1]), parts[2],
                                       np.array(parts[3]))
                    leaf, parts = name, [[], [], [], []]
                for part, value in zip(parts, (*[c[i] for c in columns], flat[ends[i]:ends[i + 1]])):
                    part.append(value)
        if parts[0]:
            yield compared(
                leaf, np.array(parts[0]), np.array(parts[1]), parts[2], np.array(parts[3]))

    dealt = rows.repartition("leaf").sortWithinPartitions("leaf", "vec_id")
    return dealt.select("leaf", "vec_id", "copies", "leaves", "vector").mapInArrow(
        task, "vec_id bigint, linked bigint, n bigint")


def drawn_units(reps, sample):
    drawn = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    return unit_rows(drawn.column(0).combine_chunks()) if drawn.num_rows else np.zeros((0, 1))


def links_among(reps, width, threshold, leaf, sample):
    """``vec_id, linked, n`` of the distinct vectors ``reps``, all of one width: clumps by balls, the
    rest by trees."""
    scratch, count = Scratch(reps.sparkSession, "forest-width"), reps.count()
    pivots = pivots_of(drawn_units(reps, sample), count, leaf, threshold)
    balls = None
    if len(pivots):
        balls, reps = ball_links(reps, pivots, scratch, threshold)
        count = reps.count()
    nodes, trees = fit_forest(drawn_units(reps, sample), count, width, leaf, threshold)
    placed = scratch.save(routed(reps, nodes, trees), "placed")
    placed = cut_large(placed, reps, width, scratch, 2 * leaf)
    leaves = placed.groupBy("vec_id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    ready = reps.select("vec_id", "copies", "vector").join(leaves, "vec_id")
    ready = ready.withColumn("leaf", F.explode("leaves"))
    found = leaf_links(ready, threshold)
    return scratch.save(found if balls is None else found.unionByName(balls), "found")


def near_vectors(rows, threshold=THRESHOLD, leaf=LEAF, sample=SAMPLE):
    """``vec_id, n_links, component_id, kept`` for every row of ``rows (vec_id, embedding, ...)``.

    Null vectors, vectors of zeros or with null or non-finite components link with nothing, and
    vectors of different lengths do not link with each other.  Vectors of one direction are compared
    once and link with each other.  Rows with a null vec_id link with nothing and are not kept.
    """
    scratch = Scratch(rows.sparkSession, "forest")
    whole = scratch.save(keyed(rows), "keyed")
    reps = whole.groupBy("content").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"),
        F.min_by("vector", "vec_id").alias("vector"))
    reps = scratch.save(reps.withColumn("width", F.size("vector")), "reps")
    sizes = reps.groupBy("width").count()
    large = [r.width for r in sizes.where(F.col("count") > leaf).orderBy("width").collect()]
    # A width of no more vectors than a leaf holds is one leaf.
    few = reps.where(~F.col("width").isin(large)).withColumn("leaf", F.col("width").cast("bigint"))
    found = leaf_links(few.withColumn("leaves", F.array("leaf")), threshold)
    for width in large:
        same = reps.where(F.col("width") == width)
        found = found.unionByName(links_among(same, width, threshold, leaf, sample))
    found = scratch.save(found, "found")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("linked").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    known = reps.select("content", F.col("vec_id").alias("rep"), "copies")
    known = known.join(counts, known["rep"] == counts["vec_id"], "left").drop("vec_id")
    known = known.join(roots, known["rep"] == roots["node"], "left").select(
        "content", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("root"))
    known = scratch.save(known, "known")
    known = F.broadcast(known) if is_small(known, 48) else known
    placed_rows = whole.select("vec_id", "content").join(known, "content").select(
        F.col("vec_id").alias("own"), "n_links", "root").groupBy("own").agg(
        F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    joined = rows.select("vec_id").join(placed_rows, F.col("vec_id") == F.col("own"), "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
