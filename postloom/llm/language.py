"""Language of a text by a byte convolutional network.

A text is read in windows of fixed length.  Filters of several widths run over the bytes of a
window, each keeps its largest response, and a softmax over these gives the languages.  A text's
prediction is the mean over all its windows, weighted by their letters.

The network is trained in numpy on a bounded sample of labelled texts.  For prediction the
embedding and the filters are multiplied out into tables by pairs of bytes, which give the same
responses with look-ups alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from postloom.llm.scratch import unused
from postloom.llm.wordbytes import FOLD, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Up to 1000 Spark keeps no more rows of a language in each input task either.
TRAIN_PER_LANGUAGE = 1000
TRAIN_ROWS = 12_000
TRAIN_CHARS = 600
PARTS_PER_LANGUAGE = 64
EPOCHS, LEAST_STEPS = 6, 900
UNKNOWN = "und"
WINDOWS_AT_ONCE = 512


def _byte_classes():
    """Space, digit, sign, one class per letter, and the bytes of other scripts."""
    classes = np.full(256, 2, np.uint8)
    classes[[0, 9, 10, 11, 12, 13, 32]] = 0
    classes[48:58] = 1
    classes[97:123] = np.arange(3, 29)
    classes[128:192] = np.arange(29, 93)
    classes[192:256] = 93 + np.arange(64) % 8
    return classes


CLASSES = _byte_classes()
N_CLASSES = 101
LETTERS = np.isin(np.arange(256), np.concatenate([np.arange(97, 123), np.arange(192, 256)]))


def folded(data):
    """Bytes in lower case, for A-Z and for the two-byte capitals of Latin scripts."""
    data = FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[1:][capital] += 32
    return data


def windows(data, offsets):
    """Class codes of all windows, the text and the number of letters of each."""
    data = folded(data)
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    size = np.minimum(WINDOW, offsets[1:][owner] - start)
    place = np.arange(WINDOW)
    inside = place < size[:, None]
    taken = data[np.where(inside, start[:, None] + place, 0)] if len(data) else np.zeros(
        (0, WINDOW), np.uint8)
    letters = (LETTERS[taken] & inside).sum(axis=1)
    return np.where(inside, CLASSES[taken], 0).astype(np.uint8), owner, letters


def softmax(scores):
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


class ByteNetwork:
    """Embedding, filters of several widths, largest response, softmax."""

    def __init__(self, languages, seed=7):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {"embedding": random.normal(0, 0.3, (N_CLASSES, EMBEDDING))}
        for width in WIDTHS:
            self.weights[f"filter{width}"] = random.normal(
                0, 1 / np.sqrt(width * EMBEDDING), (width * EMBEDDING, FILTERS))
            self.weights[f"bias{width}"] = np.zeros(FILTERS)
        self.weights["out"] = random.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages)))
        self.weights["out_bias"] = np.zeros(len(languages))

    def fit(self, codes, labels, epochs=EPOCHS, batch=64, rate=0.004, seed=11):
        """Adam on the cross-entropy; only the largest responses carry gradients."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(codes)))):
            order = random.permutation(len(codes))
            for at in range(0, len(order), batch):
                picked = order[at:at + batch]
                step += 1
                for name, slope in self._slopes(codes[picked], labels[picked]).items():
                    first[name] += 0.1 * (slope - first[name])
                    second[name] += 0.001 * (slope**2 - second[name])
                    move = first[name] / (1 - 0.9**step)
                    self.weights[name] -= rate * move / (
                        np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _slopes(self, codes, labels):
        w, count = self.weights, len(codes)
        embedded = w["embedding"][codes]
        pooled, seen = [], {}
        for width in WIDTHS:
            last = WINDOW - width + 1
            patches = np.concatenate([embedded[:, i:last + i] for i in range(width)], axis=2)
            found = patches @ w[f"filter{width}"] + w[f"bias{width}"]
            best = found.argmax(axis=1)
            peak = np.take_along_axis(found, best[:, None], 1)[:, 0]
            pooled.append(np.maximum(peak, 0))
            seen[width] = patches, best, peak
        hidden = np.concatenate(pooled, axis=1)
        error = softmax(hidden @ w["out"] + w["out_bias"])
        error[np.arange(count), labels] -= 1
        error /= count
        slopes = {"out": hidden.T @ error, "out_bias": error.sum(axis=0),
                  "embedding": np.zeros_like(w["embedding"])}
        back = error @ w["out"].T
        for k, width in enumerate(WIDTHS):
            patches, best, peak = seen[width]
            slope = back[:, k * FILTERS:(k + 1) * FILTERS] * (peak > 0)
            rows = np.arange(count)[:, None]
            chosen = patches[rows, best]
            slopes[f"filter{width}"] = np.einsum("nfd,nf->df", chosen, slope)
            slopes[f"bias{width}"] = slope.sum(axis=0)
            inner = slope[:, :, None] * w[f"filter{width}"].T
            for i in range(width):
                part = inner[:, :, i * EMBEDDING:(i + 1) * EMBEDDING]
                np.add.at(slopes["embedding"], codes[rows, best + i], part)
        return slopes

    def compiled(self):
        """Response tables by byte pair (widths 2 and 4) and by single byte (width 3)."""
        e = self.weights["embedding"]

        def places(width):
            parts = self.weights[f"filter{width}"].reshape(width, EMBEDDING, FILTERS)
            return [e @ part for part in parts]

        def pair(a, b):
            return (a[:, None] + b[None]).reshape(-1, FILTERS)

        two, three, four = (places(width) for width in WIDTHS)
        tables = pair(*two), pair(three[0], three[1]), three[2], pair(*four[:2]), pair(*four[2:])
        return CompiledNetwork(
            self.languages, [t.astype(np.float32) for t in tables],
            [self.weights[f"bias{width}"] for width in WIDTHS],
            self.weights["out"], self.weights["out_bias"],
        )


class CompiledNetwork:
    """A trained network as look-up tables."""

    def __init__(self, languages, tables, biases, out, out_bias):
        self.languages, self.tables, self.biases = languages, tables, biases
        self.out, self.out_bias = out, out_bias

    def probabilities(self, codes):
        """Language probabilities of each window."""
        found = [self._part(codes[i:i + WINDOWS_AT_ONCE])
                 for i in range(0, len(codes), WINDOWS_AT_ONCE)]
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))

    def _part(self, codes):
        two, three, third, four, fourth = self.tables
        pairs = codes[:, :-1].astype(np.int32) * N_CLASSES + codes[:, 1:]
        wide = three[pairs[:, :-1]]
        wide += third[codes[:, 2:]]
        wider = four[pairs[:, :-2]]
        wider += fourth[pairs[:, 2:]]
        peaks = [two[pairs].max(axis=1), wide.max(axis=1), wider.max(axis=1)]
        hidden = np.concatenate(
            [np.maximum(peak + bias, 0) for peak, bias in zip(peaks, self.biases)], axis=1)
        return softmax(hidden @ self.out + self.out_bias)


def held_out():
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs, per_language=TRAIN_PER_LANGUAGE, rows=TRAIN_ROWS):
    """Fit on at most ``per_language`` labelled texts of a language and ``rows`` in all, a piece
    of at most ``TRAIN_CHARS`` characters from anywhere in each.

    The sample is drawn by a hash of the doc_id, so it is the same on every run.  Returns None
    when nothing is labelled.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out()
    )
    drawn = F.xxhash64("doc_id", F.lit(1))
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(
        F.length("text") - TRAIN_CHARS, F.lit(1))).cast("int")
    piece = F.col("text").substr(start + 1, F.lit(TRAIN_CHARS))
    # The first of each part of a language, then the first of those: no task has a whole language.
    parted = labelled.select(
        "lang", "doc_id", piece.alias("text"), drawn.alias("drawn"),
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PARTS_PER_LANGUAGE)).alias("part"))
    order = Window.partitionBy("lang", "part").orderBy("drawn", "doc_id")
    first = parted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    best = Window.partitionBy("lang").orderBy("drawn", "doc_id")
    sample = first.withColumn("rank", F.row_number().over(best))
    sample = sample.where(F.col("rank") <= per_language).orderBy("rank", "lang").limit(rows)
    found = sample.select("lang", "text").toArrow()
    if not found.num_rows:
        return None
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    codes, labels = [], []
    (whole,) = found.combine_chunks().to_batches()
    for first, data, offsets in text_blocks(whole):
        cut, owner, letters = windows(data, offsets)
        codes.append(cut[letters > 20])
        labels += [languages.index(names[first + o]) for o in owner[letters > 20]]
    network = ByteNetwork(languages)
    codes = np.concatenate(codes)
    if len(codes):
        network.fit(codes, np.array(labels))
    return network.compiled()


def predict(rows, model, language="lang_pred", score="score", text="text"):
    """Add the predicted language and its probability to ``rows``.

    Null texts and texts without a letter are ``und`` with score 0; so is every text when there
    is no model.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        network = shared.value
        for batch in batches:
            names, scores = [], []
            texts = batch.column(text)
            for first, data, offsets in text_blocks(batch, text):
                count = len(offsets) - 1
                if network is None:
                    names += [UNKNOWN] * count
                    scores += [0.0] * count
                    continue
                codes, owner, letters = windows(data, offsets)
                total = np.zeros((count, len(network.languages)))
                weight = np.bincount(owner, letters, minlength=count)
                weighed = network.probabilities(codes) * letters[:, None]
                for k in range(total.shape[1]):
                    total[:, k] = np.bincount(owner, weighed[:, k], minlength=count)
                best = total.argmax(axis=1)
                for i in range(count):
                    if weight[i] and (
                        data[offsets[i]:offsets[i + 1]].max() < 128
                        or any(map(str.isalpha, texts[first + i].as_py()))
                    ):
                        names.append(network.languages[best[i]])
                        scores.append(float(total[i, best[i]] / weight[i]))
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, language, score])

    added = [StructField(language, StringType()), StructField(score, DoubleType())]
    return rows.mapInArrow(task, StructType([*rows.schema.fields, *added]))


def languages_of(docs, **sample):
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text, lang)``.

    Repeated rows are rows of their own; a null doc_id has a null ``held_out`` and is not learned from;
    other columns are not read.
    """
    found = predict(docs.select("doc_id", "text"), train(docs, **sample))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs, least=0.3, **sample):
    """The rows of ``docs`` whose language is found with a score of ``least`` or more; when nothing
    is labelled to learn from, all rows with a letter in their text."""
    language, score = unused(docs.columns, "lang_pred", "lang_score")
    model = train(docs, **sample)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model, language, score)
    return found.where((F.col(language) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
