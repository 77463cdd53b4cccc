"""Near posts: pairs with their cosine, a bounded number for each post.

Random sign planes part the posts into buckets, several tables of them with other planes.  The number
of planes grows with the logarithm of the posts, so that an even bucket holds ``bucket`` of them.
Every post is compared with all others of its buckets by exact cosine and keeps its ``k`` nearest of
at least ``least``.  So edges grow with the number of posts; work grows with the square of a bucket, and
a full bucket is dealt to as many tasks as it needs, each of which holds two deals of its posts.

With ``representatives`` every post is compared with so many posts of a bucket only, the first by a hash
of their id, all of them in a bucket that is not fuller.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.vectors import is_finite, norm
from postloom.operators.density import directions
from postloom.session import write_and_read

BUCKET = 64
TABLES = 12
NEIGHBORS = 16
DEAL_ROWS = 4096
BLOCK_BITS = 4
COSINES_AT_ONCE = 1 << 20


def comparable(rows, dims, id="post_id", vector="embedding"):
    """Rows with an id and a vector of ``dims`` finite components that is not zero."""
    sound = (F.size(vector) == dims) & is_finite(F.col(vector)) & (norm(F.col(vector)) > 0)
    return rows.where(F.col(id).isNotNull() & F.coalesce(sound, F.lit(False)))


def planes(posts, bucket=BUCKET):
    """How many planes part ``posts`` into even buckets of ``bucket``."""
    return max(0, math.ceil(math.log2(posts / bucket))) if posts else 0


def with_buckets(rows, dims, bits, tables=TABLES, id="post_id", vector="embedding",
                 seed=V.REDUCE_SEED):
    """``id, vector, buckets``: in each table, the side of each plane as a digit."""
    signs, _ = directions(dims, max(bits, 1), tables, seed)

    def task(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sides = (flat.reshape(batch.num_rows, dims) @ signs >= 0).reshape(batch.num_rows, tables, -1)
            numbers = sides[:, :, :bits] @ (1 << np.arange(bits, dtype=np.int64))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(ends, pa.array(numbers.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [id, vector, "buckets"])

    points = rows.select(id, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(task, kinds + ", buckets array<bigint>")


def near_rows(posts, others, dims, least, k):
    """``post, near, cosine`` of the ``k`` nearest ``others`` in each post's bucket, and of those as near as
    the last of them.

    Both are Arrow tables of ``bucket, post, vector``, of many buckets: a call costs more than a bucket.
    Ids stay in Arrow, as a Python object for each pair costs more than its cosine.
    """
    sides = []
    for side in (posts, others):
        buckets = side.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        flat = side.column("vector").combine_chunks().flatten()
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(side.num_rows, dims)[order]
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        sides.append((buckets[order], side.column("post").combine_chunks().take(pa.array(order)), matrix))
    (mine, ids, left), (theirs, names, right) = sides
    distinct = names.unique()
    own, known = (pc.fill_null(pc.index_in(x, value_set=distinct), -1).to_numpy() for x in (ids, names))
    rows, columns, found = [], [], []
    for bucket in np.unique(mine):
        a, b = (slice(*np.searchsorted(x, [bucket, bucket + 1])) for x in (mine, theirs))
        if b.start == b.stop:
            continue
        step = max(1, COSINES_AT_ONCE // (b.stop - b.start))
        for at in range(a.start, a.stop, step):
            some = slice(at, min(at + step, a.stop))
            # Rounded, so that equal cosines are equal in whatever order they were added up.
            cosines = np.round(left[some] @ right[b].T, 9)
            cosines[own[some][:, None] == known[b][None, :]] = -2
            keep = min(k, cosines.shape[1])
            if keep < cosines.shape[1]:
                bound = -np.partition(-cosines, keep - 1, axis=1)[:, keep - 1:keep]
                cosines = np.where(cosines >= bound, cosines, -2)
            row, column = np.nonzero(cosines >= least)
            rows.append(row + at)
            columns.append(column + b.start)
            found.append(cosines[row, column])
    row, column = (np.concatenate([np.array([], np.int64), *x]) for x in (rows, columns))
    return pa.table({"post": ids.take(pa.array(row)), "near": names.take(pa.array(column)),
                     "cosine": np.concatenate([np.array([], np.float64), *found])})


def dealt(rows, many, own, other):
    """``rows`` with their deal as ``own``, once for each deal of the other side as ``other``."""
    deals = F.coalesce("deals", F.lit(1).cast("bigint"))
    return rows.join(many, ["table", "bucket"], "left").withColumns({
        own: F.pmod(F.xxhash64("post"), deals),
        other: F.explode(F.sequence(F.lit(0).cast("bigint"), deals - 1))}).drop("deals")


def nearest(rows, dims, id="post_id", vector="embedding", least=0.5, k=NEIGHBORS, tables=TABLES,
            bucket=BUCKET, seed=V.REDUCE_SEED, representatives=None):
    """``post, near, cosine``: up to ``k`` near posts of each post, nearest first, ties by id.

    Ids are unique; posts that are not ``comparable`` have none.  Without ``representatives`` a post
    is compared with all posts of its buckets.
    """
    sound = write_and_read(comparable(rows, dims, id, vector).select(id, vector), "comparable")
    bits = planes(sound.count(), bucket)
    placed = with_buckets(sound, dims, bits, tables, id, vector, seed)
    spread = write_and_read(
        placed.select(F.posexplode("buckets").alias("table", "bucket"), F.col(id).alias("post"),
                      F.col(vector).alias("vector")), "buckets")
    first = spread
    if representatives:
        order = Window.partitionBy("table", "bucket").orderBy(F.md5(F.col("post").cast("string")), "post")
        first = spread.withColumn("_rank", F.row_number().over(order)).where(
            F.col("_rank") <= representatives).drop("_rank")
    sizes = spread.groupBy("table", "bucket").agg(F.ceil(F.count("*") / DEAL_ROWS).alias("deals"))
    # One deal for all but the full buckets, whose rows are dealt by a hash of the post.
    many = sizes.where("deals > 1")
    mine, asked = dealt(spread, many, "deal", "other"), dealt(first, many, "other", "deal")
    # A group of the search is many buckets; of a full one it has one deal of each side.
    mine, asked = (x.withColumn("block", F.shiftright("bucket", BLOCK_BITS)) for x in (mine, asked))
    key = ["table", "block", "deal", "other"]
    kind = sound.schema[id].dataType.simpleString()

    def compare(posts, others):
        return near_rows(posts, others, dims, least, k)

    # New names for the same columns, or the two sides would be ambiguous.
    asked = asked.select(*(F.col(c).alias(c) for c in mine.columns))
    met = mine.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        compare, f"post {kind}, near {kind}, cosine double")
    once = met.groupBy("post", "near").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("post").orderBy(F.desc("cosine"), "near")
    ranked = once.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    return ranked.drop("_rank")


def neighbor_edges(near):
    """``left, right, cosine``: each pair of ``nearest`` once."""
    ends = near.select(
        F.least("post", "near").alias("left"), F.greatest("post", "near").alias("right"), "cosine")
    return ends.groupBy("left", "right").agg(F.max("cosine").alias("cosine"))
