"""Joins and rankings that stay balanced when one key holds much of the data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

HOT_KEYS = 1000


def join_per_key(rows, keyed, key, weight, how="inner", hot_keys=HOT_KEYS):
    """Join ``rows`` with ``keyed``, which has one row per key.

    ``weight`` is the column of ``keyed`` that says how many rows share the
    key.  The ``hot_keys`` heaviest keys are joined by broadcast: never more
    than that many rows, whatever the data.  All other keys are joined by
    shuffle, where none can hold more than one part in ``hot_keys``.

    ``rows`` is read twice and ``keyed`` three times, so hand in tables or
    cheap expressions over tables, see ``write_and_read``.
    """
    hot = F.broadcast(keyed.orderBy(F.desc(weight), key).limit(hot_keys))
    hot_rows = rows.join(hot, key)
    cold_rows = rows.join(hot.select(key), key, "left_anti").join(keyed, key, how)
    return hot_rows.unionByName(cold_rows)


def positions(rows, order, name="position", buckets=64):
    """0-based rank of each row by the numeric column ``order``, distinct per row.

    Rows are ranked within value ranges and shifted by the sizes of the lower
    ranges, so no task has to sort everything.
    """
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.approxQuantile(order, shares, 0.001)
    if not bounds:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    lower = F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda bound: bound < F.col(order))
    ranged = rows.withColumn("_range", F.size(lower))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # At most `buckets` rows from here to the broadcast.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0))
    starts = sizes.select("_range", start.alias("_start"))
    return (
        ranged.withColumn("_within", within)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_within") - 1)
        .drop("_range", "_within", "_start")
    )
