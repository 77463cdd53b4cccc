"""Ranked lexical search over a length-stratified index.

Documents whose lengths give the same normaliser ``m`` form a stratum, in which a posting's impact
depends on its term frequency alone.  Each input task indexes its own documents as a shard.  A row of
the index is a shard's part of a stratum: its doc_ids, and its postings by term and term frequency,
the documents of equal frequency together, so that an impact is computed once for all of them.
Nothing is shuffled to build the index.

A search picks the asked terms out of every part.  The highest frequency of each term bounds the
score of all documents of a part.  Each item first visits its best-bounded strata, enough of them to
hold ``SEED_DOCS`` matches, which gives a score that its answers must reach; then every other part
whose bound reaches it, and a task raises that score as it finds better documents.  No document that
could be among the answers is left out.
"""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch, arrow_rows

TOP = 20
SEED_DOCS = 200
SHARD_POSTINGS = 800_000
BATCH_POSTINGS = 100_000
TASK_POSTINGS = 1_000_000
SCORES_AT_ONCE = 4_000_000
ITEM_BYTES = 4 << 20
# Parts and texts are large rows: few of them at a time between Spark and its workers.
ROWS_AT_ONCE = 64
FLOOR, SLOPE = 75, 25
WEIGHT, IMPACT, FREQUENCY, LENGTH = 1000, 1_000_000_000, 1000, 12

#: Bytes of terms, A-Z folded, all others made a space.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def terms(text):
    """The terms of a text in UTF-8; null has none."""
    return text.translate(TERM_BYTES).split() if text else []


def binary_texts(batch):
    return batch.column("text").cast(pa.binary()).to_pylist()


def lengths(docs):
    """``n``, the number of terms, of each document that has one."""

    def task(batches):
        for batch in batches:
            sizes = np.array([len(terms(t)) for t in binary_texts(batch)], np.int64)
            kept = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(sizes[kept])], ["n"])

    return docs.select("text").mapInArrow(task, "n bigint")


def normaliser(n, count, total):
    """``m`` of a document of ``n`` terms among ``count`` documents of ``total`` terms."""
    return FLOOR + SLOPE * n * count // total


PARTS = "ids array<bigint>, terms array<{term}>, tf array<int>, sizes array<int>, docs array<int>"


def part_columns(ids, terms, tf, sizes, docs, id_ends, row_ends, doc_ends):
    """The list columns of several parts, from flat arrays and the ends of each part in them."""
    lists = [(ids, id_ends), (terms, row_ends), (tf, row_ends), (sizes, row_ends), (docs, doc_ends)]
    return [pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), v) for v, e in lists]


class Shard:
    """The postings of one shard, held as numbers until they are ordered into parts."""

    def __init__(self, name):
        self.name, self.size = name, 0
        self.vocabulary = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.docs, self.strata, self.postings = [], [], []

    def add(self, docs, texts, count, total):
        """Index some documents; one without a term is not indexed."""
        number, ids, sizes = self.vocabulary, [], []
        for doc, text in zip(docs, texts):
            words = terms(text)
            if words:
                self.docs.append(doc)
                sizes.append(len(words))
                ids += [number[w] for w in words]
        if not ids:
            return
        first = len(self.docs) - len(sizes)
        self.strata += [normaliser(n, count, total) for n in sizes]
        keys = np.repeat(np.arange(first, len(self.docs)), sizes) << 32 | np.array(ids, np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        self.postings.append((keys, tf.astype(np.int32)))
        self.size += len(keys)

    def parts(self):
        """Record batches of the index, ordered by stratum; documents are numbered within a part by
        doc_id, null first."""
        if not self.docs:
            return
        strata = np.array(self.strata, np.int64)
        known = np.array([d if d is not None else 0 for d in self.docs], np.int64)
        missing = np.array([d is None for d in self.docs])
        order = np.lexsort((known, ~missing, strata))
        begins = np.r_[True, strata[order][1:] != strata[order][:-1]]
        starts = np.flatnonzero(begins)
        part = np.empty(len(order), np.int64)
        part[order] = np.cumsum(begins) - 1
        local = np.empty(len(order), np.int32)
        local[order] = np.arange(len(order)) - starts[part[order]]
        ids, m = pa.array(known[order], mask=missing[order]), strata[order][starts]
        id_ends = np.r_[starts, len(order)]
        keys = np.concatenate([k for k, _ in self.postings])
        tf = np.concatenate([f for _, f in self.postings])
        self.postings = []
        doc, term = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        order = np.lexsort((local[doc], tf, term, part[doc]))
        doc, term, tf = doc[order], term[order], tf[order]
        place = part[doc]
        cuts = np.flatnonzero(np.r_[
            True, (place[1:] != place[:-1]) | (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        row_ends = np.searchsorted(place[cuts], np.arange(len(m) + 1))
        doc_ends = np.searchsorted(place, np.arange(len(m) + 1))
        names = pa.array(list(self.vocabulary), pa.binary())
        sizes = np.diff(np.r_[cuts, len(doc)]).astype(np.int32)
        local = local[doc]
        at = 0
        while at < len(m):
            to = max(at + 1, int(np.searchsorted(doc_ends, doc_ends[at] + BATCH_POSTINGS)) - 1)
            rows = slice(row_ends[at], row_ends[to])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(to - at, self.name)), pa.array(m[at:to]), *part_columns(
                    ids[id_ends[at]:id_ends[to]], names.take(pa.array(term[cuts[rows]])),
                    pa.array(tf[cuts[rows]]), pa.array(sizes[rows]),
                    pa.array(local[doc_ends[at]:doc_ends[to]]), id_ends[at:to + 1],
                    row_ends[at:to + 1], doc_ends[at:to + 1])],
                ["shard", "m", "ids", "terms", "tf", "sizes", "docs"])
            at = to


def build_index(docs, count, total):
    """``shard, m, ids, terms, tf, sizes, docs``: one row per part, all terms of all documents.

    A shard is one input task's documents, or a part of them with ``SHARD_POSTINGS`` postings.  A
    null doc_id is indexed as any other; a repeated one is one document per row.
    """

    def task(batches):
        shard = Shard(TaskContext.get().partitionId() << 20)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shard.add(part.column("doc_id").to_pylist(), binary_texts(part), count, total)
                if shard.size >= SHARD_POSTINGS:
                    yield from shard.parts()
                    shard = Shard(shard.name + 1)
        yield from shard.parts()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        task, "shard bigint, m bigint, " + PARTS.format(term="binary"))


def item_terms(items):
    """``item_id, place, term, repeats``, one row per item's distinct term; ``place`` tells rows of
    one item_id apart."""

    def task(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), binary_texts(batch)):
                rows += [(item, at, t, n) for t, n in Counter(terms(text)).items()]
                at += 1
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in
                 zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                ["item_id", "place", "term", "repeats"])

    chosen = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return chosen.mapInArrow(task, "item_id bigint, place bigint, term binary, repeats bigint")


def item_groups(asked, limit=ITEM_BYTES):
    """The rows of ``asked`` in groups of whole items, of at most ``limit`` bytes or one item each."""
    group, size, last = [], 0, None
    for row in asked.orderBy("place").toLocalIterator():
        if row["place"] != last and size > limit:
            yield group
            group, size = [], 0
        last = row["place"]
        group.append((row["place"], bytes(row["term"]), row["repeats"]))
        size += len(row["term"]) + 64
    if group:
        yield group


class Items:
    """A group of items: its terms, and for each of them the items that ask for it, numbered."""

    def __init__(self, group):
        self.places = np.array(sorted({place for place, _, _ in group}), np.int64)
        self.terms = sorted({term for _, term, _ in group})
        term = {t: i for i, t in enumerate(self.terms)}
        pairs = np.array([(term[t], p, n) for p, t, n in group], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.item = np.searchsorted(self.places, pairs[:, 1])
        self.repeats = pairs[:, 2]
        self.weight = np.zeros(len(pairs))
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def weigh(self, weights):
        """Set the weights of the terms, by their numbers."""
        self.weight = (self.repeats * np.repeat(weights, np.diff(self.start))).astype(np.float64)

    def askers(self, terms):
        """``which of terms, pair`` for every item that asks for one of ``terms``."""
        counts = self.start[terms + 1] - self.start[terms]
        row = np.repeat(np.arange(len(terms)), counts)
        return row, inside(counts) + self.start[terms][row]


def inside(sizes):
    """0, 1, ... within each of several runs."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def matched_parts(index, names):
    """Parts with the asked terms only, by their numbers in ``names``, which is one group's terms."""
    shipped = index.sparkSession.sparkContext.broadcast(names)

    def task(batches):
        asked = pa.array(shipped.value, pa.binary())
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            number = pc.index_in(lists.flatten(), value_set=asked)
            hit = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                continue
            ends -= ends[0]
            of_part = np.searchsorted(ends, hit, side="right") - 1
            sizes = batch.column("sizes").flatten().to_numpy()
            flat = batch.column("docs").flatten().to_numpy()
            before = np.cumsum(sizes, dtype=np.int64) - sizes
            picked = inside(sizes[hit]) + np.repeat(before[hit], sizes[hit])
            parts, row_ends = np.unique(of_part, return_index=True)
            row_ends = np.r_[row_ends, len(hit)]
            doc_ends = np.r_[0, np.cumsum(sizes[hit], dtype=np.int64)][row_ends]
            chosen = batch.take(pa.array(parts))
            ids = chosen.column("ids")
            yield pa.RecordBatch.from_arrays(
                [chosen.column("m"), *part_columns(
                    ids.flatten(), number.take(pa.array(hit)),
                    batch.column("tf").flatten().take(pa.array(hit)), pa.array(sizes[hit]),
                    pa.array(flat[picked]), ids.offsets.to_numpy().astype(np.int64), row_ends, doc_ends)],
                ["m", "ids", "terms", "tf", "sizes", "docs"])

    return index.mapInArrow(task, "m bigint, " + PARTS.format(term="int"))


def document_counts(parts, terms):
    """How many documents have each of a group's ``terms`` numbers; one row per task and term."""

    def task(batches):
        found = np.zeros(terms, np.int64)
        for batch in batches:
            np.add.at(found, batch.column("terms").flatten().to_numpy(),
                      batch.column("sizes").flatten().to_numpy())
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["term", "df"])

    found = parts.select("terms", "sizes").mapInArrow(task, "term bigint, df bigint")
    rows = found.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(terms, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


def term_weights(df, count):
    return np.array([
        math.floor(WEIGHT * math.log((2 * count + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()])


class Part:
    """A part of a stratum, as a search sees it."""

    def __init__(self, batch, i):
        def values(name):
            return batch.column(name)[i].values

        self.m = batch.column("m")[i].as_py()
        self.ids = values("ids")
        self.terms, tf = values("terms").to_numpy().astype(np.int64), values("tf").to_numpy().astype(np.int64)
        self.sizes = values("sizes").to_numpy().astype(np.int64)
        self.docs = values("docs").to_numpy().astype(np.int64)
        self.impacts = (IMPACT * tf // (FREQUENCY * tf + LENGTH * self.m)).astype(np.float64)
        # Frequencies of a term rise, so its last row has the highest impact.
        self.last = np.flatnonzero(np.r_[self.terms[1:] != self.terms[:-1], True])

    def bounds(self, items):
        """Per item the highest score a document here could have."""
        row, pair = items.askers(self.terms[self.last])
        return np.bincount(
            items.item[pair], items.weight[pair] * self.impacts[self.last][row], len(items.places))

    def matches(self, items):
        """Per item how many documents have one of its terms, the commonest one here."""
        row, pair = items.askers(self.terms)
        found = np.zeros(len(items.places), np.int64)
        np.maximum.at(found, items.item[pair], self.sizes[row])
        return found

    def scores(self, items, visiting):
        """Scores of all documents for the ``visiting`` items, some of them at a time.

        Sums of whole numbers below 2 ** 53 are exact in doubles.
        """
        row, pair = items.askers(self.terms)
        place = np.full(len(items.places), -1)
        place[visiting] = np.arange(len(visiting))
        asked = place[items.item[pair]]
        count, before = len(self.ids), np.cumsum(self.sizes) - self.sizes
        step = max(1, SCORES_AT_ONCE // count)
        for at in range(0, len(visiting), step):
            some = visiting[at:at + step]
            mine = np.flatnonzero((asked >= at) & (asked < at + step))
            r, sizes = row[mine], self.sizes[row[mine]]
            docs = self.docs[inside(sizes) + np.repeat(before[r], sizes)]
            value = items.weight[pair[mine]] * self.impacts[r]
            yield some, np.bincount(
                np.repeat((asked[mine] - at) * count, sizes) + docs, np.repeat(value, sizes),
                len(some) * count).reshape(len(some), count)


def scan(parts, tasks, shared, schema, visit):
    """Run ``visit(items, extra, parts)`` on all parts of a task; what is ``shared`` is one group of
    items and at most ``SEED_DOCS`` strata and one score for each of them."""

    def task(batches):
        group, weights, extra = shared.value
        items = Items(group)
        items.weigh(weights)
        yield from visit(items, extra, (
            Part(batch, i) for batch in batches for i in range(batch.num_rows)))

    # An explicit number: few rows with much work behind them are not to be joined into few tasks.
    return parts.repartition(tasks).mapInArrow(task, schema)


def stratum_bounds(items, extra, parts):
    """Per item and stratum the highest score a document could have, and its matches, over a task."""
    best = defaultdict(lambda: np.zeros((2, len(items.places)), np.int64))
    for part in parts:
        held = best[part.m]
        held[0] = np.maximum(held[0], part.bounds(items).astype(np.int64))
        held[1] += part.matches(items)
    for m, (bound, matches) in best.items():
        who = np.flatnonzero(bound)
        yield pa.RecordBatch.from_arrays(
            [pa.array(items.places[who]), pa.array(np.full(len(who), m)), pa.array(bound[who]),
             pa.array(matches[who])], ["place", "m", "bound", "matches"])


def answers(items, extra, parts):
    """Documents that reach their item's least score, at most ``top`` of each item and part.

    In the first visit a part is visited by the items that have its stratum among their seeds, in
    the second one by the others whose bound here reaches their score.  The score rises to that of
    an item's ``top``-th best document of this task.
    """
    least, seeds, first, top = extra
    least = least.astype(np.float64)
    best = np.zeros((len(items.places), top))
    for part in parts:
        seeded = np.zeros(len(items.places), bool)
        seeded[seeds.get(part.m, [])] = True
        if first and not seeded.any():
            continue
        visiting = np.flatnonzero((seeded == first) & (part.bounds(items) >= least))
        for some, scores in part.scores(items, visiting):
            found = []
            for k in np.flatnonzero((scores >= least[some][:, None]).any(axis=1)).tolist():
                item, own = some[k], scores[k]
                reach = np.flatnonzero(own >= least[item])
                if len(reach) > top:
                    # Documents are numbered by doc_id.
                    reach = reach[np.lexsort((reach, -own[reach]))[:top]]
                found.append((item, reach, own[reach]))
                merged = np.concatenate([best[item], own[reach]])
                best[item] = -np.partition(-merged, top - 1)[:top]
                least[item] = max(least[item], best[item].min())
            if found:
                docs = np.concatenate([f[1] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(items.places[[f[0] for f in found]], [len(f[1]) for f in found])),
                     part.ids.take(pa.array(docs)),
                     pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))],
                    ["place", "doc_id", "score"])


def best(found, top):
    """The ``top`` documents of each place, equal scores by ascending doc_id."""
    order = Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index, group, count, top, scratch, label):
    """``place, doc_id, score`` of at least all answers to one group of items."""
    spark = index.sparkSession
    context, items = spark.sparkContext, Items(group)
    parts = scratch.save(matched_parts(index, items.terms), f"{label}-matched")
    postings = parts.agg(F.sum(F.size("docs"))).first()[0] or 0
    tasks = max(2 * context.defaultParallelism, postings // TASK_POSTINGS + 1)
    weights = term_weights(document_counts(parts, len(items.terms)), count)
    shared = context.broadcast((group, weights, None))
    limits = scan(parts, tasks, shared, "place bigint, m bigint, bound bigint, matches bigint", stratum_bounds)
    limits = limits.groupBy("place", "m").agg(F.max("bound").alias("bound"), F.sum("matches").alias("matches"))
    before = Window.partitionBy("place").orderBy(F.desc("bound"), "m").rowsBetween(
        Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("matches").over(before), F.lit(0))
    chosen = limits.withColumn("seen", seen).where(F.col("seen") < SEED_DOCS).select("place", "m")
    number, seeds = {p: i for i, p in enumerate(items.places.tolist())}, defaultdict(list)
    for row in chosen.collect():
        seeds[row["m"]].append(number[row["place"]])
    least = np.ones(len(number), np.int64)
    schema = "place bigint, doc_id bigint, score bigint"
    shared = context.broadcast((group, weights, (least, dict(seeds), True, top)))
    first = scratch.save(scan(parts, tasks, shared, schema, answers), f"{label}-seeds")
    reached = best(first, top).groupBy("place").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    for row in reached.where(F.col("n") >= top).collect():
        least[number[row["place"]]] = row["score"]
    shared = context.broadcast((group, weights, (least, dict(seeds), False, top)))
    rest = scratch.save(scan(parts, tasks, shared, schema, answers), f"{label}-rest")
    return first.unionByName(rest)


def ranked(docs, items, top=TOP):
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    All rows of ``docs`` are indexed and searched.  Null texts have no terms; a repeated doc_id is
    one document per row, a repeated item_id one item per row; an item without terms or matches
    has no rows.  Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "strata")
    found = None
    with arrow_rows(spark, ROWS_AT_ONCE):
        count, total = lengths(docs).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        asked = scratch.save(item_terms(items), "asked")
        if count:
            index = scratch.save(build_index(docs, count, total), "index")
            for at, group in enumerate(item_groups(asked)):
                more = search(index, group, count, top, scratch, f"answers-{at}")
                found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    places = asked.select("place", "item_id").distinct()
    return best(found, top).join(places, "place").select("item_id", "rank", "doc_id", "score")
