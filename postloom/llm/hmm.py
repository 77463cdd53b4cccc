"""Scores of whole texts by a hidden Markov language model.

Words are counted over all training texts.  The ``OWN_WORDS`` most frequent words and the end of a
text are symbols of their own; every other word belongs to one of ``CLASSES`` symbols, found from
its last bytes, and has a share of it by its count.  Latent states emit symbols:

    P(text) = sum over state paths of  start * transitions * emissions,  times the words' shares

Baum-Welch trains the states.  Each round reads all training texts; every task adds up the expected
transitions and emissions of its texts, Spark sums them over the tasks, and the driver holds only
the model, whose size is fixed by the parameters.  The likelihood of a text is exact: a long text is
cut into segments whose transfer matrices are computed side by side and chained in order.

The model starts from the neighbours in all training texts: symbols are dealt into ``GROUPS`` groups,
the most frequent ones alone, Spark counts the pairs of groups that follow each other, and the states
are fitted to that table, whose size does not grow with the corpus.  The counts, the pairs and the
``ROUNDS`` rounds after them cover every training text whole.
"""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch

STATES = 8
OWN_WORDS = 24_000
CLASSES = 8_192
LEXICON_WORDS = 200_000
COUNTED_WORDS = 300_000
LONG_WORD = 40
SEGMENT = 256
TOKENS_AT_ONCE = 400_000
GROUP_SEGMENTS = 2_048
ROUNDS = 3
GROUPS = 512
PAIR_ROUNDS = 200
# Pseudo-tokens with the corpus' own frequencies, added to each state's emissions.
PRIOR = 300.0
# Expected counts are summed as whole multiples of this, so that their order does not matter.
GRAIN = 2.0 ** -16
END = b""


def word_keys(text):
    """The folded words of a text; a word of over ``LONG_WORD`` bytes is known by its digest."""
    words = text.lower().split()
    if words and max(map(len, words)) > LONG_WORD:
        return [w if len(w) <= LONG_WORD else hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


def word_class(word):
    return zlib.crc32(word[-3:]) % CLASSES


def held_out():
    """One document in five, by its id; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def binary_texts(batch):
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def count_words(docs):
    """``word, c`` over all rows of ``docs``, words combined in each input task; the end of a text
    is the empty word."""

    def task(batches):
        counts = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["word", "c"])

        for batch in batches:
            for text in binary_texts(batch):
                counts.update(word_keys(text))
                counts[END] += 1
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select("text").mapInArrow(task, "word binary, c bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """How words become symbols; 0 is the end of a text, then own words, then classes."""

    def __init__(self, words, counts, own, masses):
        """``words`` by falling count, ``masses`` of the classes' words beyond ``words``."""
        self.own = min(own, len(words))
        self.number = {w: i for i, w in enumerate(words)}
        self.log_count = np.log10(np.asarray(counts, np.float64) + 0.5)
        self.symbol = np.arange(len(words)) + 1
        for i in range(self.own, len(words)):
            self.symbol[i] = 1 + self.own + word_class(words[i])
        end = self.number.get(END)
        if end is not None:
            self.symbol[end] = 0
        self.count = 1 + self.own + CLASSES
        mass = np.zeros(self.count)
        np.add.at(mass, self.symbol, np.asarray(counts, np.float64) + 0.5)
        mass[1 + self.own:] += masses + 0.5
        mass[0] = max(mass[0], 0.5)
        if end is not None and end < self.own:
            mass[1 + end] = 0.5
        self.unigram = mass / mass.sum()
        # A word's share of its class is (c + 0.5) / mass; own symbols have one word.
        self.log_mass = np.zeros(self.count)
        self.log_mass[1 + self.own:] = np.log10(mass[1 + self.own:])

    def encode(self, texts):
        """For each text ``symbols, tokens, known, sum of log10(c + 0.5) over known words, the same
        over known words in classes, Counter of words not in the lexicon``."""
        words, ends = [], []
        for text in texts:
            words += word_keys(text)
            words.append(END)
            ends.append(len(words))
        number = self.number
        ids = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
        unseen = np.flatnonzero(ids < 0)
        if len(self.number):
            logs, symbols = self.log_count[ids], self.symbol[ids]
        else:
            logs, symbols = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        logs[unseen] = 0
        symbols[unseen] = [
            1 + self.own + word_class(words[i]) if words[i] else 0 for i in unseen]
        in_class = np.where(symbols > self.own, logs, 0.0)
        symbols = symbols.astype(np.uint16 if self.count <= 1 << 16 else np.uint32)
        cuts = np.searchsorted(unseen, [0, *ends])
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            missing = unseen[cuts[k]:cuts[k + 1]]
            yield (symbols[a:b], b - a, b - a - len(missing), logs[a:b].sum(),
                   in_class[a:b].sum(), Counter(words[i] for i in missing))


class Model:
    """Start probabilities, transitions and emissions, with the sums one round collects."""

    def __init__(self, start, moves, emits):
        self.start, self.moves, self.emits = start, moves, np.ascontiguousarray(emits)
        self.states = len(start)

    @classmethod
    def first(cls, unigram, states=STATES, seed=7):
        draw = np.random.default_rng(seed)
        emits = unigram[:, None] * draw.gamma(1.0, 1.0, (len(unigram), states))
        moves = draw.random((states, states)) + 2 * states * np.eye(states)
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True),
                   emits / emits.sum(0))

    def improved(self, sums, unigram):
        """The model after a round of Baum-Welch."""
        starts, moves, emits = (np.maximum(x, 0) for x in sums[:3])
        moves = moves + 0.1
        emits = emits + PRIOR * unigram[:, None]
        starts = starts + 0.1
        return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    def likelihoods(self, texts):
        """Log likelihood of each sequence of symbols by the scaled forward recursion."""
        chunk = Chunk(self, texts)
        ahead = chunk.starts()
        logs = np.zeros(len(chunk.begin))
        for at in range(0, len(logs), GROUP_SEGMENTS):
            part = slice(at, at + GROUP_SEGMENTS)
            logs[part] = chunk.forward(part, ahead[part])[0]
        return np.add.reduceat(logs, chunk.head)

    def expected(self, texts):
        """Expected starts, transitions and emissions over the sequences, and their likelihood."""
        chunk, states = Chunk(self, texts), self.states
        ahead, behind = chunk.starts(), chunk.ends()
        count = len(chunk.begin)
        starts, moves = np.zeros(states), np.zeros((states, states))
        emits, total = np.zeros((len(self.emits), states)), 0.0
        last, first = np.empty((count, states)), np.empty((count, states))
        for at in range(0, count, GROUP_SEGMENTS):
            part = slice(at, min(at + GROUP_SEGMENTS, count))
            logs, order, active, alphas, scales = chunk.forward(part, ahead[part], keep=True)
            total += logs.sum()
            begin, beta = chunk.begin[part][order], behind[part][order]
            ending = np.empty((len(order), states))
            shares = np.empty((int(chunk.size[part].sum()), states))
            symbols = np.empty(len(shares), np.int64)
            after, filled = None, 0
            for t in range(len(active) - 1, -1, -1):
                m = active[t]
                alpha = alphas[t][:m]
                newly = active[t + 1] if t + 1 < len(active) else 0
                if m > newly:
                    # Segments that end here: scale what comes after so that shares add up to 1.
                    fresh = slice(newly, m)
                    beta[fresh] /= (alpha[fresh] * beta[fresh]).sum(1, keepdims=True)
                    ending[fresh] = alpha[fresh]
                if newly:
                    moves += alpha[:newly].T @ after
                share = alpha * beta[:m]
                symbol = chunk.flat[begin[:m] + t]
                shares[filled:filled + m], symbols[filled:filled + m] = share, symbol
                filled += m
                after = self.emits[symbol] * beta[:m] / scales[t][:m, None]
                beta[:m] = after @ self.moves.T
            last[part.start + order], first[part.start + order] = ending, after
            heads = chunk.is_head[part][order]
            starts += share[heads].sum(0)
            for state in range(states):
                emits[:, state] += np.bincount(symbols, shares[:, state], len(emits))
        # Moves from the end of a segment to the start of the next one of its text.
        joint = np.flatnonzero(~chunk.is_head[1:])
        if len(joint):
            follow = first[joint + 1]
            weight = (last[joint] * (follow @ self.moves.T)).sum(1, keepdims=True)
            moves += (last[joint] / weight).T @ follow
        return starts, moves * self.moves, emits, total


class Chunk:
    """Sequences cut into segments, swept side by side, a symbol per step."""

    def __init__(self, model, texts):
        sizes = np.array([len(t) for t in texts])
        self.model, self.flat = model, np.concatenate(texts).astype(np.int64)
        parts = -(-sizes // SEGMENT)
        self.head = np.cumsum(parts) - parts
        inside = np.arange(parts.sum()) - np.repeat(self.head, parts)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, parts) + inside * SEGMENT
        self.size = np.minimum(SEGMENT, np.repeat(sizes, parts) - inside * SEGMENT)
        self.parts, self.is_head = parts, inside == 0
        self.is_tail = inside == np.repeat(parts, parts) - 1
        self.middle = np.flatnonzero(~self.is_tail)
        self.transfer = None

    def forward(self, part, ahead, keep=False):
        """Sweep segments from their predicted states: log likelihood of each, and with ``keep``
        the order of the sweep, how many segments are active at each step, states and scales."""
        model, size = self.model, self.size[part]
        order = np.argsort(-size, kind="stable")
        size, begin, ahead = size[order], self.begin[part][order], ahead[order].copy()
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")
        logs, alphas, scales = np.zeros(len(size)), [], []
        for t in range(steps):
            m = active[t]
            x = ahead[:m] * model.emits[self.flat[begin[:m] + t]]
            scale = x.sum(1)
            x /= scale[:, None]
            logs[:m] += np.log(scale)
            ahead[:m] = x @ model.moves
            if keep:
                alphas.append(x)
                scales.append(scale)
        if keep:
            return logs, order, active, alphas, scales
        found = np.empty(len(order))
        found[order] = logs
        return found, None

    def matrices(self):
        """Transfer matrix, up to scale, of every segment that another one follows."""
        if self.transfer is None:
            states, begin = self.model.states, self.begin[self.middle]
            whole = np.broadcast_to(np.eye(states), (len(begin), states, states)).copy()
            for t in range(SEGMENT if len(begin) else 0):
                whole *= self.model.emits[self.flat[begin + t]][:, None, :]
                whole = (whole.reshape(-1, states) @ self.model.moves).reshape(whole.shape)
                if t % 8 == 7:
                    whole /= whole.max(axis=(1, 2), keepdims=True)
            self.transfer = whole
        return self.transfer

    def chained(self):
        """Texts by falling number of segments, and how many have more than ``j`` of them."""
        order = np.argsort(-self.parts, kind="stable")
        most = int(self.parts[order[0]])
        return order, np.searchsorted(-self.parts[order], -np.arange(1, most), side="left"), most

    def starts(self):
        """Predicted states at the start of each segment."""
        ahead = np.tile(self.model.start, (len(self.begin), 1))
        place = np.cumsum(~self.is_tail) - 1
        order, more, most = self.chained()
        matrices = self.matrices()
        for j in range(1, most):
            at = self.head[order[:more[j - 1]]] + j
            x = np.einsum("ni,nij->nj", ahead[at - 1], matrices[place[at - 1]])
            ahead[at] = x / x.sum(1, keepdims=True)
        return ahead

    def ends(self):
        """What comes after each segment, as weights of its last states, up to scale."""
        model, states = self.model, self.model.states
        behind = np.ones((len(self.begin), states))
        order, more, most = self.chained()
        if most == 1:
            return behind
        # Weights of the predicted states at the start of each segment but the first ones.
        weights = np.ones((len(self.begin), states))
        tails = np.flatnonzero(self.is_tail & ~self.is_head)
        tails = tails[np.argsort(-self.size[tails], kind="stable")]
        weight = np.ones((len(tails), states))
        for t in range(int(self.size[tails[0]]) - 1, -1, -1):
            m = int(np.searchsorted(-self.size[tails], -t, side="left"))
            x = model.emits[self.flat[self.begin[tails[:m]] + t]] * weight[:m]
            if t:
                x = x @ model.moves.T
            weight[:m] = x / x.max(1, keepdims=True)
        weights[tails] = weight
        place = np.cumsum(~self.is_tail) - 1
        matrices = self.matrices()
        for j in range(most - 2, 0, -1):
            at = self.head[order[:more[j]]] + j
            y = np.einsum("nij,nj->ni", matrices[place[at]], weights[at + 1])
            weights[at] = y / y.max(1, keepdims=True)
        behind[self.middle] = weights[self.middle + 1] @ model.moves.T
        return behind


def chunks(batches, column="symbols", width=np.uint16):
    """Rows of record batches as sequences, ``TOKENS_AT_ONCE`` symbols or one text at a time."""
    rows, size = [], 0
    for batch in batches:
        for raw in batch.column(column).to_pylist():
            rows.append(np.frombuffer(raw, width))
            size += len(rows[-1])
            if size >= TOKENS_AT_ONCE:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def encode_texts(docs, symbols, own, masses):
    """One row per document: a row number, its symbols and sums, and its words not in the lexicon.

    ``symbols`` is a broadcast of the lexicon's words and counts, bounded by ``LEXICON_WORDS``.
    """

    def task(batches):
        coder = Symbols(*symbols.value, own, masses)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows = list(coder.encode(binary_texts(part)))
                size = len(rows)
                ends = np.cumsum([0] + [len(r[5]) for r in rows]).astype(np.int32)
                rare = pa.StructArray.from_arrays(
                    [pa.array([w for r in rows for w in r[5]], pa.binary()),
                     pa.array([n for r in rows for n in r[5].values()], pa.int64())],
                    ["word", "n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(at, at + size), pa.int64()),
                    part.column("doc_id"), part.column("held_out"),
                    pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    *(pa.array([r[i] for r in rows], kind)
                      for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))),
                    pa.ListArray.from_arrays(pa.array(ends), rare),
                ], ["row", "doc_id", "held_out", "symbols", "n_tokens", "n_lexicon", "logs",
                    "class_logs", "rare"])
                at += size

    return docs.mapInArrow(task, (
        f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
        "symbols binary, n_tokens bigint, n_lexicon bigint, logs double, class_logs double, "
        "rare array<struct<word: binary, n: bigint>>"))


def expected_sums(coded, model, width):
    """One round over all training texts: the sums of all tasks, added up by Spark."""
    states, spark = model.states, coded.sparkSession
    shipped = spark.sparkContext.broadcast((model.start, model.moves, model.emits))
    names = [f"s{i}" for i in range(states)]

    def task(batches):
        local = Model(*shipped.value)
        starts, moves, emits, total = np.zeros(states), 0, 0, 0.0
        for texts in chunks(batches, width=width):
            found = local.expected(texts)
            starts, moves, emits, total = (
                x + y for x, y in zip((starts, moves, emits, total), found))
        if np.isscalar(emits):
            return
        used = np.flatnonzero(emits.any(1))
        other = np.vstack([moves, starts, np.full(states, total)])
        rows = np.round(np.vstack([emits[used], other]) / GRAIN).astype(np.int64)
        place = np.concatenate([used, -1 - np.arange(len(other))])
        for at in range(0, len(rows), 8_192):
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[at:at + 8_192]), *(pa.array(c) for c in rows[at:at + 8_192].T)],
                ["place", *names])

    rows = coded.where(~F.col("held_out")).select("symbols").mapInArrow(
        task, "place bigint, " + ", ".join(f"{n} bigint" for n in names))
    sums = rows.groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    shipped.unpersist()
    place = sums.column("place").to_numpy()
    values = np.column_stack([sums.column(n).to_numpy() for n in names]).astype(np.float64) * GRAIN
    emits, other = np.zeros_like(model.emits), np.zeros((states + 2, states))
    emits[place[place >= 0]] = values[place >= 0]
    other[-1 - place[place < 0]] = values[place < 0]
    return other[states], other[:states], emits, float(other[states + 1, 0])


def symbol_groups(unigram, groups=GROUPS):
    """A group for every symbol: the heaviest ones have one each, the others share the last half."""
    order = np.argsort(-unigram, kind="stable")
    alone = groups // 2
    found = np.empty(len(unigram), np.int64)
    found[order] = np.where(
        np.arange(len(order)) < alone, np.arange(len(order)), alone + np.arange(len(order)) % (groups - alone))
    return found


def pair_counts(coded, group, width, groups=GROUPS):
    """How often a symbol of one group follows one of another, over all training texts, and how often a
    text starts with each group."""
    shipped = coded.sparkSession.sparkContext.broadcast(group)

    def task(batches):
        found, firsts = np.zeros(groups * groups, np.int64), np.zeros(groups, np.int64)
        for texts in chunks(batches, width=width):
            flat = shipped.value[np.concatenate(texts)]
            heads = np.cumsum([0] + [len(t) for t in texts[:-1]])
            inside = np.ones(len(flat), bool)
            inside[heads] = False
            at = np.flatnonzero(inside)
            found += np.bincount(flat[at - 1] * groups + flat[at], minlength=len(found))
            firsts += np.bincount(flat[heads], minlength=groups)
        every = np.concatenate([found, firsts])
        place = np.flatnonzero(every)
        for at in range(0, len(place), 65_536):
            part = place[at:at + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(every[part])], ["place", "n"])

    rows = coded.where(~F.col("held_out")).select("symbols").mapInArrow(task, "place int, n bigint")
    sums = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shipped.unpersist()
    every = np.zeros(groups * groups + groups)
    every[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return every[:-groups].reshape(groups, groups), every[-groups:]


def paired_model(pairs, firsts, group, unigram, states=STATES, rounds=PAIR_ROUNDS):
    """The states that explain which groups follow each other: P(a, b) = sum of joint[i, j] *
    emits[a, i] * emits[b, j], fitted by expectation maximisation."""
    mass = np.bincount(group, unigram, len(firsts))
    first = Model.first(mass, states)
    emits, joint = first.emits, first.moves / states
    for _ in range(rounds if pairs.any() else 0):
        seen = emits @ joint @ emits.T
        ratio = np.divide(pairs, seen, out=np.zeros_like(pairs), where=seen > 0)
        sums = emits * (ratio @ emits @ joint.T + ratio.T @ emits @ joint)
        joint = joint * (emits.T @ ratio @ emits) + 0.1
        joint = joint / joint.sum()
        sums += PRIOR * mass[:, None]
        emits = sums / sums.sum(0)
    # A text starts in the states that its first group speaks for.
    weight = emits * joint.sum(1)
    start = (firsts / np.maximum(weight.sum(1), 1e-300)) @ weight + 0.1
    share = np.divide(unigram, mass[group], out=np.zeros_like(unigram), where=mass[group] > 0)
    return Model(start / start.sum(), joint / joint.sum(1, keepdims=True), emits[group] * share[:, None])


def train(coded, unigram, width, states=STATES, rounds=ROUNDS):
    """A model from the pairs of all training texts, then ``rounds`` of Baum-Welch over all of them."""
    group = symbol_groups(unigram)
    pairs, firsts = pair_counts(coded, group, width)
    model = paired_model(pairs, firsts, group, unigram, states)
    likelihoods = []
    for _ in range(rounds if firsts.any() else 0):
        sums = expected_sums(coded, model, width)
        likelihoods.append(sums[3])
        model = model.improved(sums, unigram)
    return model, likelihoods


def likelihoods(coded, model, log_mass, width):
    """Add ``likelihood``, the log10 probability of each row's symbols, less the logarithms of the
    masses of its words' classes."""
    shipped = coded.sparkSession.sparkContext.broadcast(
        (model.start, model.moves, model.emits, log_mass))
    kept = [n for n in coded.columns if n not in ("symbols", "rare")]

    def task(batches):
        *parts, masses = shipped.value
        local = Model(*parts)
        for batch in batches:
            found = [
                local.likelihoods(texts) / math.log(10)
                - np.add.reduceat(masses[np.concatenate(texts)],
                                  np.cumsum([0] + [len(t) for t in texts[:-1]]))
                for texts in chunks([batch], width=width)
            ]
            columns = [batch.column(n) for n in kept]
            found = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*kept, "likelihood"])

    schema = ", ".join(f"{n} {coded.schema[n].dataType.simpleString()}" for n in kept)
    return coded.drop("rare").mapInArrow(task, schema + ", likelihood double")


def text_scores(docs, states=STATES, own=OWN_WORDS, lexicon=LEXICON_WORDS, rounds=ROUNDS):
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A null text is empty and has one token, its end.  Repeated rows are scored once each; other
    columns are not read.  Without training texts every probability is 1 and the scores are 0.
    ``base_score`` is the smoothed unigram model, ``score`` the log10 probability under the trained
    hidden Markov model; it knows the words of ``base_score`` and one unseen word per class.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "hmm")
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    counts = scratch.save(count_words(docs.where(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not total:
        return docs.mapInArrow(unknown, (
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
            "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
    top = counts.orderBy(F.desc("c"), "word").limit(lexicon).toArrow()
    words, known = top.column("word").to_pylist(), top.column("c").to_pylist()
    beyond = (F.col("c") < known[-1]) | ((F.col("c") == known[-1]) & (F.col("word") > F.lit(words[-1])))
    masses = np.zeros(CLASSES)
    place = F.crc32(F.substring("word", -3, 3)) % CLASSES
    for row in counts.where(beyond).groupBy(place.alias("at")).agg(
            (F.sum("c") + 0.5 * F.count("*")).alias("mass")).collect():
        masses[row["at"]] = row["mass"]
    symbols = Symbols(words, known, own, masses)
    width = np.uint16 if symbols.count <= 1 << 16 else np.uint32
    shipped = spark.sparkContext.broadcast((words, known))
    coded = scratch.save(encode_texts(docs, shipped, own, masses), "coded")
    model, _ = train(coded, symbols.unigram, width, states, rounds)
    scored = likelihoods(coded, model, symbols.log_mass, width)
    rare = coded.select("row", F.inline("rare")).join(counts, "word", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * logs).alias("rare_logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_rare"))
    scale = math.log10(total + 0.5 * (distinct + 1))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_lexicon") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("likelihood") + F.col("class_logs") + rare_logs).alias("score"))


def unknown(batches):
    """Rows without any training text: no word is known and nothing is unlikely."""
    for batch in batches:
        size = batch.num_rows
        tokens = [len(word_keys(t)) + 1 for t in binary_texts(batch)]
        none, zero = pa.array([0] * size, pa.int64()), pa.array([0.0] * size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()),
             none, none, zero, zero],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
