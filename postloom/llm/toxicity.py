"""Toxicity as severity grades, by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(threshold_k - w.x)``: one weight per feature, shared by the ordered
thresholds.  Features are the distinct words of the whole text and their beginnings, so one toxic
word counts the same in a short and in a long text.  A text's severity is its expected grade.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postloom.llm.wordbytes import run_hashes, runs, text_blocks, texts_of

#: Bytes of the beginnings; 0 is the whole word.
BEGINNINGS = (0, 4, 6)
TRAIN_PER_CLASS = 4000
LEAST_TEXTS = 4
LEAST_SCORE = 4.0
MOST_FEATURES = 5000
GRADES = 3
STEPS, RATE, DECAY = 400, 0.05, 1e-4
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(data, offsets):
    """``(text, feature)`` arrays of all words and beginnings, repeats included."""
    starts, ends = runs(WORD_BYTES[data], offsets)
    owners = texts_of(starts, offsets)
    found, texts = [], []
    for size in BEGINNINGS:
        longer = ends - starts > size if size else np.ones(len(starts), bool)
        cut = starts[longer] + size if size else ends
        hashes = run_hashes(data, starts[longer], cut) ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
        found.append(hashes)
        texts.append(owners[longer])
    return np.concatenate(texts), np.concatenate(found)


def feature_lists(docs):
    """``doc_id, features``: the distinct features of each text."""

    def task(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_blocks(batch):
                count = len(offsets) - 1
                texts, features = text_features(data, offsets)
                order = np.argsort(texts, kind="stable")
                ends = np.cumsum(np.bincount(texts, minlength=count))[:-1]
                lists = [np.unique(x).view(np.int64) for x in np.split(features[order], ends)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, features array<bigint>")


def sample_labels(labels, per_class=TRAIN_PER_CLASS):
    """At most ``per_class`` labelled documents of each class, by a hash of the doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id")
             .limit(per_class) for k in (0, 1)]
    return drawn[0].unionByName(drawn[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights of selected features and ordered thresholds."""

    def __init__(self, features, weights, thresholds):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def chances(self, score):
        """Chance of each grade for each score ``w.x``."""
        below = sigmoid(self.thresholds - score[:, None])
        ends = np.concatenate(
            [np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(ends, axis=1)

    def scores(self, data, offsets):
        """``w.x`` of each text."""
        count = len(offsets) - 1
        if not len(self.features):
            return np.zeros(count)
        texts, features = text_features(data, offsets)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        known = self.features[at] == features
        pairs = np.unique(texts[known] * len(self.features) + at[known])
        owners, at = np.divmod(pairs, len(self.features))
        return np.bincount(owners, self.weights[at], minlength=count)


def select_features(lists, toxic):
    """Features whose share of texts differs clearly between the classes, ascending."""
    every = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    names, at = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    with_, total = max(1, toxic.sum()), len(lists)
    a = np.bincount(at, toxic[owner].astype(float), minlength=len(names))
    n = np.bincount(at, minlength=len(names))
    share = (n + 1) / (total + 2)
    score = (a / with_ - (n - a) / max(1, total - with_)) / np.sqrt(
        share * (1 - share) * (1 / with_ + 1 / max(1, total - with_)))
    score[n < LEAST_TEXTS] = 0
    best = np.argsort(-np.abs(score), kind="stable")[:MOST_FEATURES]
    best = np.sort(best[np.abs(score[best]) >= LEAST_SCORE])
    return names[best], score[best]


def grade(rows, columns, positive, toxic):
    """Grades of labelled texts: 0 not toxic; toxic texts are 1, or 2 from the median number of
    toxic features on."""
    hits = np.bincount(rows, positive[columns].astype(float), minlength=len(toxic))
    middle = np.median(hits[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, np.where(hits >= max(middle, 2), 2, 1), 0)


def fit(lists, toxic, weight):
    """Fit weights and thresholds by Adam on the weighted log-likelihood with weight decay."""
    features, score = select_features(lists, toxic)
    found = [np.searchsorted(features, x) for x in lists]
    kept = [at[(at < len(features))] for at in found]
    kept = [at[np.isin(features[at], x)] if len(features) else at[:0] for at, x in zip(kept, lists)]
    rows = np.repeat(np.arange(len(lists)), [len(np.unique(at)) for at in kept])
    columns = np.concatenate([np.unique(at) for at in kept]) if kept else np.zeros(0, int)
    grades = grade(rows, columns, score > 0, toxic)
    model = OrdinalModel(features, np.zeros(len(features)), np.array([0.0, 1.0]))
    weight = weight / weight.sum()
    base, gap = 0.0, 0.0
    slots = np.zeros((2, len(features) + 2))
    every = np.arange(len(lists))
    for step in range(1, STEPS + 1):
        model.thresholds = np.array([base, base + np.exp(gap)])
        z = np.bincount(rows, model.weights[columns], minlength=len(lists))
        below = sigmoid(model.thresholds - z[:, None])
        chance = np.maximum(model.chances(z)[every, grades], 1e-9)
        slope = below * (1 - below)
        upper = np.where(grades < GRADES - 1, slope[every, np.minimum(grades, GRADES - 2)], 0)
        lower = np.where(grades > 0, slope[every, np.maximum(grades - 1, 0)], 0)
        on_z = weight * (upper - lower) / chance
        on_t = [-(weight * (upper * (grades == k) - lower * (grades == k + 1)) / chance).sum()
                for k in range(GRADES - 1)]
        move = np.concatenate([
            np.bincount(columns, on_z[rows], minlength=len(features)) + DECAY * model.weights,
            [sum(on_t), on_t[1] * np.exp(gap)]])
        slots[0] = 0.9 * slots[0] + 0.1 * move
        slots[1] = 0.999 * slots[1] + 0.001 * move**2
        change = RATE * slots[0] / (1 - 0.9**step) / (
            np.sqrt(slots[1] / (1 - 0.999**step)) + 1e-10)
        model.weights -= change[:-2]
        base, gap = base - change[-2], gap - change[-1]
    return model


def train(docs, labels, per_class=TRAIN_PER_CLASS):
    """Fit on a bounded sample of labelled documents; None without labelled texts."""
    drawn = sample_labels(labels, per_class)
    # At most 2 * per_class rows, so they may be sent to every executor.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    chosen = chosen.dropDuplicates(["doc_id"])
    found = feature_lists(chosen).join(F.broadcast(drawn), "doc_id").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return None
    lists = [np.array(x, np.int64).view(np.uint64) for x in found.column("features").to_pylist()]
    toxic = found.column("toxic").to_numpy()
    # Both classes weigh the same: a toxic text is not to be missed for being rare.
    return fit(lists, toxic, 1 / np.sqrt(np.bincount(toxic, minlength=2))[toxic])


def severities(docs, labels, **sample):
    """``doc_id, severity, grade, toxic`` for every row of ``docs (doc_id, text, ...)``.

    ``severity`` is the expected grade, 0 to 2; ``grade`` the likeliest one; ``toxic`` whether grades
    above 0 are likelier than 0.  Null and empty texts, and all texts when nothing is labelled, have
    severity 0.  Repeated rows are graded each; of repeated labels the toxic one counts; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))

    def task(batches):
        model = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_blocks(batch):
                count = len(offsets) - 1
                chances = np.zeros((count, GRADES))
                chances[:, 0] = 1
                if model is not None:
                    filled = np.diff(offsets) > 0
                    chances[filled] = model.chances(model.scores(data, offsets))[filled]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count), pa.array(chances @ np.arange(GRADES)),
                     pa.array(chances.argmax(axis=1).astype(np.int64)),
                     pa.array(chances[:, 0] < 0.5)],
                    ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(
        task, "doc_id bigint, severity double, grade bigint, toxic boolean")
