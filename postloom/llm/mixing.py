"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's documents are wanted ``target / source_size`` times.  The whole copies are certain;
of the rest a sample of fixed size is drawn: documents are ranked by their random odds divided by
their inclusion odds, and taken in this order until the words still wanted are reached.

The cut in the order is found from sums by source and slice of the order, then inside one slice,
so no source, however large, is sorted or summed in one task.  The decision for a document is an
expression over its own columns and its source's row.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.functions.hashing import md5_uint
from postloom.llm.scratch import Scratch, is_small, unused

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
SLICES = 4096
SEED = 42


def size_of(text="text"):
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def rank_sources(sizes, scratch):
    """Number the sources from 0 by code point, null last, without a global window.

    The table is range-partitioned and written sorted; ranks are places within a part plus the
    sizes of the parts before it, of which there are no more than shuffle partitions.
    """
    spread = sizes.repartitionByRange(F.col("source").asc_nulls_last())
    spread = spread.sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.save(spread.withColumn("id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("id", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(parts), part == F.col("part"))
    place = F.col("id") - F.shiftleft(F.col("part"), 33)
    return ranked.select("source", "source_size", (F.col("before") + place).alias("rank"))


def with_targets(ranked, weights=WEIGHTS, most=MOST_COPIES):
    """Add each source's target: its share by weight, at most ``most`` times its size, what is
    above reshared by weight among the others until none is above."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn(
        "weight", F.element_at(listed, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    cap = (most * F.col("source_size")).cast("double")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= cap
        row = weighed.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (total - row["full"]) / row["open"]
    return weighed.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight", "rank")


def order_key(wanted, doc_id="doc_id", favour=None, seed=SEED):
    """Random odds over inclusion odds, mapped into 0 to 1; 1 where nothing is wanted.

    ``favour`` multiplies a document's inclusion odds.
    """
    u = (md5_uint(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
                  1, 13).cast("double") + 0.5) / float(2**52)
    share = wanted - F.floor(wanted)
    odds = share / (1 - share) * (F.lit(1.0) if favour is None else F.col(favour))
    quotient = F.when(odds > 0, u / (1 - u) / F.when(odds > 0, odds))
    return F.coalesce(quotient / (1 + quotient), F.lit(1.0))


def slice_of(key):
    return F.least(F.floor(key * SLICES), F.lit(SLICES - 1)).cast("int")


def plan_mix(docs, favour=None, weights=WEIGHTS, most=MOST_COPIES, seed=SEED):
    """One row per source: ``source, source_size, target, copies, cut_slice, cut``.

    ``cut`` is the last place of the order that is taken within slice ``cut_slice``; slices
    before it are taken whole.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    extra = [favour] if favour else []
    sized = docs.select("doc_id", "source", size_of().alias("size"), *extra)
    sized = scratch.save(sized, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = scratch.save(
        with_targets(scratch.save(rank_sources(sizes, scratch), "ranks"), weights, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.when(
        F.col("source_size") > 0, F.col("source_size"))).otherwise(0.0)
    sources = scratch.save(
        sources.withColumn("wanted", wanted).withColumn("copies", F.floor("wanted"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "wanted")
    keyed = join_sources(sized, sources, scratch).withColumn(
        "key", order_key(F.col("wanted"), favour=favour, seed=seed))
    keyed = keyed.withColumn("slice", slice_of(F.col("key"))).where("rest > 0 and key < 1")
    before = Window.partitionBy("source").orderBy("slice")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy("source", "slice", "rest").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cuts = scratch.save(
        slices.where("start < rest and start + words >= rest").groupBy("source").agg(
            F.min(F.struct("slice", "start")).alias("at")
        ).select("source", "at.slice", "at.start"), "cut-slices")
    inside = keyed.drop("source_size", "target", "copies").join(
        F.broadcast(cuts) if is_small(cuts, 64) else cuts,
        keyed["source"].eqNullSafe(cuts["source"]) & (keyed["slice"] == cuts["slice"]),
    ).select(cuts["source"], "rest", "start", "key", "doc_id", "size")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    order = order.rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    inside = inside.withColumn("middle", taken).where("middle <= rest")
    last = inside.groupBy("source").agg(
        F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    cuts = cuts.join(last.withColumnRenamed("source", "own"),
                     F.col("source").eqNullSafe(F.col("own")), "left").select(
        F.col("source").alias("own"), F.col("slice").alias("cut_slice"), "cut")
    return scratch.save(
        sources.join(cuts, F.col("source").eqNullSafe(F.col("own")), "left").drop("own", "rest"),
        "plan")


def join_sources(rows, sources, scratch):
    """Add its source's row to each of ``rows``; the sources are sent whole when few."""
    table = sources.withColumnRenamed("source", "own_source")
    table = F.broadcast(table) if is_small(sources, 160) else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")


def mix(docs, favour=None, weights=WEIGHTS, most=MOST_COPIES, seed=SEED):
    """``doc_id, size, source_size, target, copies, taken`` for every row of
    ``docs (doc_id, text, source, ...)``.

    ``taken`` is ``copies * size``: the words the mix takes of the document.  Null texts have
    size 0, a null source is a source of its own, rows that repeat a doc_id share their place in
    the order.  ``favour`` names a column that multiplies the inclusion odds.
    """
    plan = plan_mix(docs, favour, weights, most, seed)
    extra = [favour] if favour else []
    rows = docs.select("doc_id", "source", size_of().alias("size"), *extra)
    return decided(join_sources(rows, plan, None), favour, seed).select(
        "doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def decided(rows, favour=None, seed=SEED):
    """Add the sampled copy to the certain ``copies`` of rows that carry their source's plan."""
    key = order_key(F.col("wanted"), favour=favour, seed=seed)
    place = F.struct(key.alias("key"), F.col("doc_id"), F.col("size"))
    sampled = (key < 1) & F.coalesce(
        (slice_of(key) < F.col("cut_slice"))
        | ((slice_of(key) == F.col("cut_slice")) & (place <= F.col("cut"))), F.lit(False))
    return rows.withColumn("copies", F.col("copies") + sampled.cast("bigint"))


def draw_mix(docs, weights=WEIGHTS, most=MOST_COPIES, seed=SEED):
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    plan = plan_mix(docs, None, weights, most, seed)
    (row,) = unused(["size", *plan.columns], "row")
    rows = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source",
                       size_of().alias("size"))
    drawn = decided(join_sources(rows, plan, None), None, seed).where("copies > 0")
    return drawn.select(row, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{row}.*")
