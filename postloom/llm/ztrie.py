"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a sequence of turns; a prefix of it is known by a 128-bit chained hash.  The trie
holds compacted nodes only: an edge with the hashes of its prefixes and its end, the node's extent.
A node is found by its handle, the prefix whose depth is the two-fattest number of the edge's
depths ``(top, depth]``, the one divisible by the highest power of two.  A conversation finds the
edge it leaves the trie from by a fat binary search: it asks for handles at two-fattest depths of
the interval that is left, as many times as its length has bits, each time by one join.

Conversations are inserted in batches.  Every batch locates the exits of all that are left, cuts
the left edges at all exits, and hangs one conversation, drawn by hash, on each new branch.  Those
that leave the trie where they end are done, the others go on below that branch.  A conversation
drawn at random from a subtree halves the part that any other one is left in with at least even
odds, so the number of batches grows with the logarithm of the conversations, not with their length.

The edges hung by one conversation form its path.  Sums over subtrees run from the last batch's
paths to the first one's, a window along each path; an edge is expanded to one row per depth last.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch, is_small

ROOT = b""
NODE_BYTES = 200
BLOCK_IDS = 1_024
SHARED = 100
MOST_SHARED = 6


def ordered_turns(rows):
    """``conv_id, turns (turn, digest, chars)`` of each conversation, ordered by turn, null first.

    Rows of equal turns are ordered by the digest of role and text.  A conversation is one row of 28
    bytes a turn; rows without a conv_id belong to none.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"),
        F.length(text).alias("chars"))
    turns = rows.where("conv_id is not null").select("conv_id", turn.alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(turns):
    """Every conversation c with its first turns taken from conversation ``c - c % 100``.

    ``c % 100`` has the sign of c, as in SQL.
    """
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    heads = turns.where(F.col("conv_id") % SHARED == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    joined = turns.withColumn("base", base).withColumn("taken", taken).join(heads, "base", "left")
    own = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")), own).alias("turns"))


def with_prefixes(convs):
    """``conv_id, depth, prefixes, chars``: hash and code points of each prefix, from depth 1 on."""

    def task(batches):
        for batch in batches:
            lists = batch.column("digests")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            digests = lists.flatten().to_pylist()
            hashes = []
            for a, b in zip(ends[:-1], ends[1:]):
                last = b""
                for digest in digests[a:b]:
                    last = hashlib.sha256(last + digest).digest()[:16]
                    hashes.append(last)
            sums = np.concatenate(([0], np.cumsum(batch.column("sizes").flatten().to_numpy().astype(np.int64))))
            sizes = np.diff(ends)
            chars = sums[1:] - np.repeat(sums[ends[:-1]], sizes)
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(hashes, pa.binary())),
                 pa.ListArray.from_arrays(offsets, pa.array(chars))],
                ["conv_id", "depth", "prefixes", "chars"])

    flat = convs.select(
        "conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("sizes"))
    return flat.mapInArrow(
        task, "conv_id bigint, depth int, prefixes array<binary>, chars array<bigint>")


def fattest(low, high):
    """The number in ``(low, high]`` divisible by the highest power of two."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def with_handle(nodes):
    """Add the handle of each edge, and the first prefix on it."""
    at = fattest(F.col("top"), F.col("depth")) - F.col("top") - 1
    return nodes.withColumn("handle", F.get("hashes", at)).withColumn("first", F.get("hashes", F.lit(0)))


def probe(rows, nodes, key, by):
    """Left join of ``rows`` with the nodes whose ``by`` is ``key``; nodes are unique in it.

    A table of nodes of at most 32 MB is sent to all executors, a larger one is joined by shuffle,
    where Spark splits the rows of a handle that very many conversations ask for.
    """
    side = nodes.select(
        F.col(by).alias("_key"), F.col("extent").alias("_extent"), F.col("depth").alias("_depth"),
        F.col("top").alias("_top"), F.col("hashes").alias("_hashes"))
    return rows.join(side, key == F.col("_key"), "left")


def exits(waiting, nodes, steps):
    """Where each waiting conversation leaves the trie: ``at``, the depth, and ``edge``, the extent
    of the edge it leaves within, null if it leaves at a node.

    ``waiting.low`` is the depth of a node known to be on its way.
    """
    rows = waiting.withColumn("high", F.col("depth")).withColumn("edge", F.lit(None).cast("binary"))
    rows = rows.withColumn("at", F.lit(None).cast("int"))
    names = rows.columns

    def shared():
        return F.col("_top") + F.size(F.array_intersect("_hashes", "prefixes"))

    for _ in range(steps):
        going = F.col("edge").isNull() & (F.col("low") < F.col("high"))
        rows = rows.withColumn("fat", F.when(going, fattest(F.col("low"), F.col("high"))))
        rows = probe(rows, nodes, F.get("prefixes", F.col("fat") - 1), "handle")
        hit = F.col("_key").isNotNull()
        passed = hit & F.coalesce(
            F.get("prefixes", F.col("_depth") - 1) == F.col("_extent"), F.lit(False))
        changed = {
            "low": F.when(passed, F.col("_depth")).otherwise(F.col("low")),
            "high": F.when(going & ~hit, F.col("fat") - 1).otherwise(F.col("high")),
            "edge": F.when(hit & ~passed, F.col("_extent")).otherwise(F.col("edge")),
            "at": F.when(hit & ~passed, shared()).otherwise(F.col("at")),
        }
        rows = rows.select(*(changed.get(n, F.col(n)).alias(n) for n in names))
    # An edge left before its handle is the child of the last node by the next prefix.
    inside = F.col("edge").isNull() & (F.col("low") < F.col("depth"))
    rows = probe(rows, nodes, F.when(inside, F.get("prefixes", F.col("low"))), "first")
    hit = F.col("_key").isNotNull()
    return rows.select(
        "seq", "depth", "prefixes", "chars",
        F.when(hit, F.col("_extent")).otherwise(F.col("edge")).alias("edge"),
        F.when(hit, shared()).otherwise(F.coalesce("at", "low")).alias("at"))


def cut(nodes, exits):
    """Edges cut at every depth a conversation leaves them, the pieces on the path of the whole."""
    cuts = exits.where("edge is not null").groupBy("edge").agg(
        F.array_sort(F.collect_set("at")).alias("cuts"))
    joined = nodes.join(cuts, nodes["extent"] == F.col("edge"), "left")
    bounds = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth"))
    pieces = joined.select("*", F.posexplode(bounds).alias("piece", "to"), bounds.alias("bounds"))
    start = F.when(F.col("piece") == 0, F.col("top")).otherwise(F.get("bounds", F.col("piece") - 1))
    pieces = pieces.withColumn("from", start)
    skip, size = F.col("from") - F.col("top"), F.col("to") - F.col("from")
    whole = F.col("piece") == 0
    return pieces.select(
        F.get("hashes", F.col("to") - F.col("top") - 1).alias("extent"), F.col("from").alias("top"),
        F.col("to").alias("depth"),
        F.when(whole, F.col("parent")).otherwise(F.get("hashes", skip - 1)).alias("parent"),
        F.slice("hashes", skip + 1, size).alias("hashes"),
        F.slice("chars", skip + 1, size).alias("chars"),
        F.when(whole, F.col("before")).otherwise(F.get("chars", skip - 1)).alias("before"),
        "path", "batch")


def leaves(rows, batch):
    """The drawn conversations as edges from where they leave the trie to their ends."""
    size = F.col("depth") - F.col("at")
    below = F.col("at") > 0
    return rows.select(
        F.col("seq").alias("extent"), F.col("at").alias("top"), "depth",
        F.when(below, F.get("prefixes", F.col("at") - 1)).otherwise(F.lit(ROOT)).alias("parent"),
        F.slice("prefixes", F.col("at") + 1, size).alias("hashes"),
        F.slice("chars", F.col("at") + 1, size).alias("chars"),
        F.when(below, F.get("chars", F.col("at") - 1)).otherwise(F.lit(0)).alias("before"),
        F.col("seq").alias("path"), F.lit(batch).alias("batch"))


def build(sequences, scratch):
    """Insert all distinct ``sequences (seq, depth, prefixes, chars)``; nodes and batches."""
    steps = int(sequences.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]).bit_length()
    waiting = sequences.select("seq", "depth", "prefixes", "chars", F.lit(0).alias("low"))
    nodes, batch = None, 0
    while True:
        if nodes is None:
            found = waiting.withColumn("edge", F.lit(None).cast("binary")).withColumnRenamed("low", "at")
        else:
            side = F.broadcast(nodes) if is_small(nodes, NODE_BYTES + 28 * (1 << steps)) else nodes
            found = scratch.save(exits(waiting, side, steps), f"exits-{batch}")
        branch = F.get("prefixes", F.col("at"))
        drawn = found.where(F.col("at") < F.col("depth")).groupBy(branch.alias("branch")).agg(
            F.min(F.struct(F.xxhash64("seq"), "seq"))["seq"].alias("seq"))
        placed = scratch.save(
            found.join(drawn.select("seq", F.lit(True).alias("drawn")), "seq", "left"),
            f"placed-{batch}")
        hung = leaves(placed.where("drawn"), batch)
        after = hung if nodes is None else cut(nodes, placed).unionByName(hung)
        after = scratch.save(with_handle(after), f"nodes-{batch}")
        scratch.drop(f"exits-{batch}", f"nodes-{batch - 1}", f"placed-{batch - 1}")
        waiting = placed.where("drawn is null and at < depth").select(
            "seq", "depth", "prefixes", "chars", F.col("at").alias("low"))
        nodes, batch = after, batch + 1
        if waiting.isEmpty():
            return nodes, batch


SUMS = ["n", "low", "leaves", "saved", "branches"]


def totals(nodes, sequences, batches, scratch):
    """Nodes with the sums of their subtrees, and the tops of the paths as shares of their parents.

    ``n`` members, ``low`` the least of them, ``children``, ``leaves`` and ``below``, the saved
    tokens under the node's own edge.
    """
    ends = sequences.select(F.col("seq").alias("extent"), F.col("n").alias("own"), F.col("low").alias("own_low"))
    whole = scratch.save(nodes.join(ends, "extent", "left"), "with-ends")
    done, tops = [], []
    up = Window.partitionBy("path").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for batch in reversed(range(batches)):
        here = whole.where(F.col("batch") == batch).drop("batch")
        if tops:
            shares = tops[0]
            for other in tops[1:]:
                shares = shares.unionByName(other)
            shares = shares.groupBy("parent").agg(
                F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("leaves").alias("leaves"),
                F.sum("saved").alias("saved"), F.count("*").alias("branches"))
            shares = shares.withColumnRenamed("parent", "extent")
            here = here.join(shares, "extent", "left")
        else:
            here = here.select("*", *(F.lit(None).cast("bigint").alias(n) for n in SUMS))
        zero = F.lit(0).cast("bigint")
        edge_chars = F.element_at("chars", -1) - F.col("before")
        children = F.coalesce("branches", zero) + F.when(F.row_number().over(up) > 1, 1).otherwise(0)
        here = here.withColumn("children", children).withColumn(
            "members", F.sum(F.coalesce("own", zero) + F.coalesce("n", zero)).over(so_far))
        here = here.withColumn("edge_saved", (F.col("members") - 1) * edge_chars)
        leaf = F.when(F.col("children") == 0, 1).otherwise(0)
        here = here.select(
            "extent", "path", "parent", "top", "depth", "chars", "before", "own", "children",
            F.col("members").alias("n"),
            F.min(F.least("own_low", "low")).over(so_far).alias("low"),
            F.sum(F.coalesce("leaves", zero) + leaf).over(so_far).alias("leaves"),
            (F.sum(F.col("edge_saved") + F.coalesce("saved", zero)).over(so_far)
             - F.col("edge_saved")).alias("below"),
            F.col("edge_saved"))
        here = here.withColumn("parent_low", F.lead("low").over(up))
        here = scratch.save(here, f"totals-{batch}")
        done.append(here)
        tops.append(here.where("parent_low is null").select(
            "parent", "n", "low", "leaves", (F.col("below") + F.col("edge_saved")).alias("saved")))
    return done, tops


def end_hashes(members):
    """``seq, ends_sha256`` of ``members (seq, conv_id)``: the hash of the ids that end there.

    Ids are joined in blocks first, so a sequence that very many conversations share reaches the
    one task that hashes it as few rows; that task streams over them.
    """
    block = F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = members.groupBy("seq", block).agg(F.array_join(ids, ",").alias("ids"))

    def task(batches):
        last, digest = None, None
        for batch in batches:
            found = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if seq != last:
                    if last is not None:
                        found.append((last, digest.hexdigest()))
                    last, digest = seq, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows(found)
        if last is not None:
            yield rows([(last, digest.hexdigest())])

    def rows(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
            ["seq", "ends_sha256"])

    ordered = blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids")
    return ordered.mapInArrow(task, "seq binary, ends_sha256 string")


def prefix_trie(rows):
    """Nodes of the trie of the rebuilt conversations of ``rows (conv_id, turn, role, text)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, one
    row per distinct prefix, the empty one included.  Null roles and texts are empty, rows without
    a conv_id are left out, repeated rows are turns of their own, an empty table has no nodes; other
    columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "ztrie")
    turns = scratch.save(ordered_turns(rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")), "turns")
    convs = with_prefixes(rebuilt(turns)).withColumn(
        "seq", F.coalesce(F.get("prefixes", F.col("depth") - 1), F.lit(ROOT)))
    convs = scratch.save(convs, "conversations")
    sequences = scratch.save(
        convs.where("depth > 0").groupBy("seq").agg(
            F.first("depth").alias("depth"), F.first("prefixes").alias("prefixes"),
            F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("low")),
        "sequences")
    nodes, batches = build(sequences, scratch)
    done, tops = totals(nodes, sequences, batches, scratch)
    whole, shares = done[0], tops[0]
    for other in done[1:]:
        whole = whole.unionByName(other)
    for other in tops[1:]:
        shares = shares.unionByName(other)
    hashes = end_hashes(convs.select("seq", "conv_id"))
    hashes = scratch.save(hashes, "ends")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    least = convs.agg(F.min("conv_id")).first()[0]
    parents = whole.select(F.col("extent").alias("parent"), F.col("low").alias("_low"))
    placed = whole.join(parents, "parent", "left").join(
        hashes.withColumnRenamed("seq", "extent"), "extent", "left")
    inner = F.inline(F.transform(F.sequence(F.lit(1), F.size("chars")), lambda i: F.struct(
        i.alias("i"),
        F.when(i == 1, F.col("before")).otherwise(F.get("chars", i - 2)).alias("above"))))
    placed = placed.select("*", F.element_at("chars", -1).alias("total"), inner)
    last = F.col("top") + F.col("i") == F.col("depth")
    first = F.col("i") == 1
    upper = F.when(F.col("top") == 0, F.lit(least)).otherwise(F.col("_low"))
    found = placed.select(
        F.col("low").alias("conv_id"), (F.col("top") + F.col("i")).cast("bigint").alias("depth"),
        F.when(first, upper).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("total") - F.col("above"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"))
    zero = F.lit(0).cast("bigint")
    parts = shares.where(F.col("parent") == F.lit(ROOT)).select(
        F.lit(1).alias("children"), "leaves", "saved", F.lit("").alias("ends"))
    parts = parts.unionByName(hashes.where(F.col("seq") == F.lit(ROOT)).select(
        zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.col("ends_sha256").alias("ends")))
    count = convs.count()
    root = parts.agg(
        F.lit(least).cast("bigint").alias("conv_id"), zero.alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(count).cast("bigint").alias("n_convs"),
        F.sum("children").cast("bigint").alias("n_children"),
        F.greatest(F.sum("leaves"), F.lit(1)).cast("bigint").alias("n_leaves"),
        F.sum("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce(F.nullif(F.max("ends"), F.lit("")), nothing).alias("ends_sha256"))
    return root.where(F.lit(count > 0)).unionByName(found)
