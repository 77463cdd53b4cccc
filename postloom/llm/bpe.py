"""BPE encoding and decoding with a transducer lexicon.

The frequent words of the corpus are compiled with their ids into a minimal acyclic automaton:
words with common endings share states, and the arcs carry numbers that add up to the word's
number, which leads to its ids.  The automaton is a file that every worker memory-maps.  Words
of a text walk it together, one byte per step; a word it does not hold is merged exactly.
"""

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import SparkFiles
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from postloom.session import work_dir

LEXICON_WORDS = 150_000
CACHE_WORDS = 200_000
COUNTED_WORDS = 150_000
TEXTS_AT_ONCE = 64
SHORT_WORD = 40


def byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return letters


class Vocabulary:
    """A tokenizer file: how texts become words, and words ids."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids = model["vocab"]
        self.ranks = {tuple(pair): at for at, pair in enumerate(merges)}
        self.suffix = model["end_of_word_suffix"] or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.ascii_words = re.compile(
            split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, self.special)))
        # What all special tokens begin with; a text without it has none of them.
        self.hint = os.path.commonprefix(list(self.special))
        self.letters = byte_letters()
        tokens = {**{i: t for t, i in self.ids.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def pieces(self, text):
        """The words of a text in order; special tokens come as their ids."""
        if not self.special or self.hint not in text:
            return self.plain_words(text)
        found, at = [], 0
        for mark in self.marks.finditer(text):
            found += self.plain_words(text[at:mark.start()])
            found.append(self.special[mark.group()])
            at = mark.end()
        return found + self.plain_words(text[at:])

    def plain_words(self, text):
        """White space only parts words, so runs of it need not be made one space first."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, word):
        """Ids of one word: the pair of the lowest rank is joined until none is left."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.suffix
        parts = self.join_short(parts) if len(parts) <= SHORT_WORD else self.join_long(parts)
        ids = self.ids
        return [ids[p] for p in parts if p in ids]

    def join_short(self, parts):
        """Join the first pair of the lowest rank, over and over."""
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while found:
            least = min(found)
            if least == none:
                break
            i = found.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def join_long(self, parts):
        """The same with linked neighbours and a heap of pairs, for words of any length."""
        count = len(parts)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        ranks = self.ranks
        heap = []
        for i in range(count - 1):
            rank = ranks.get((parts[i], parts[i + 1]))
            if rank is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else count
            if j >= count or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < count:
                before[after[i]] = i
                rank = ranks.get((parts[i], parts[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))
            if before[i] >= 0:
                rank = ranks.get((parts[before[i]], parts[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p is not None]


@cache
def vocabulary(path):
    """One per worker."""
    return Vocabulary(path)


def compile_lexicon(entries, file):
    """Write the minimal acyclic transducer of ``entries (word, ids)`` to a binary file.

    Words are added in byte order; a state whose continuation is finished is replaced by an equal
    one seen before.  An arc's number is how many words come before it at its state, so the
    numbers along a word's arcs add up to its rank.
    """
    entries = sorted((word.encode(), ids) for word, ids in entries)
    registered, states = {}, []
    path_arcs = [[False, []]]
    previous = b""

    def settle(keep):
        while len(path_arcs) > keep + 1:
            final, arcs = path_arcs.pop()
            key = final, tuple(arcs)
            if key not in registered:
                registered[key] = len(states)
                states.append(key)
            parent = path_arcs[-1][1]
            parent[-1] = parent[-1][0], registered[key]

    for word, _ in entries:
        common = len(os.path.commonprefix([previous, word]))
        settle(common)
        for byte in word[common:]:
            path_arcs[-1][1].append((byte, None))
            path_arcs.append([False, []])
        path_arcs[-1][0] = True
        previous = word
    settle(0)
    states.append((path_arcs[0][0], tuple(path_arcs[0][1])))
    # State 0 is the dead end; the states written are numbered from 1.
    used = sorted({byte for _, arcs in states for byte, _ in arcs})
    classes = np.zeros(256, np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    step = np.zeros((len(states) + 1, len(used) + 1, 2), np.int32)
    below = np.zeros(len(states) + 1, np.int64)
    final = np.zeros(len(states) + 1, np.int32)
    for at, (ends, arcs) in enumerate(states, 1):
        seen = int(ends)
        final[at] = ends
        for byte, target in arcs:
            step[at, classes[byte]] = target + 1, seen
            seen += below[target + 1]
        below[at] = seen
    ends = np.cumsum([0] + [len(ids) for _, ids in entries])
    flat = np.array([i for _, ids in entries for i in ids], np.int32)
    parts = [classes.astype(np.int32), ends.astype(np.int32), flat, final, step.reshape(-1)]
    head = np.array([len(p) for p in parts] + [len(used) + 1], np.int32)
    file.write(np.concatenate([head, *parts]).tobytes())
    return len(states)


class Lexicon:
    """A compiled transducer, memory-mapped."""

    def __init__(self, path):
        # A plain view of the mapped file: memmap objects are slow to slice.
        whole = np.memmap(path, np.int32, "r").view(np.ndarray)
        sizes = whole[:6].tolist()
        cuts = 6 + np.cumsum([0] + sizes[:5])
        self.classes, self.ends, self.flat, self.final, step = (
            whole[cuts[i]:cuts[i + 1]] for i in range(5))
        self.classes = np.array(self.classes, np.int64)
        self.step = step.reshape(-1, 2)
        self.width = sizes[5]
        self.root = len(self.final) - 1

    def lookup(self, data, starts, lengths):
        """The number of each word, or -1: all words walk together, a byte per step."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.full(len(order), self.root, np.int64)
        number = np.zeros(len(order), np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        active = len(order)
        for place in range(longest):
            active = int(np.searchsorted(-lengths[:active], -place, side="left"))
            if not active or not state[:active].any():
                break
            codes = self.classes[data[starts[:active] + place]]
            arc = self.step[state[:active] * self.width + codes]
            state[:active] = arc[:, 0]
            number[:active] += arc[:, 1]
        # A word longer than the walk went has died on the way.
        found = np.empty(len(order), np.int64)
        found[order] = np.where(self.final[state] == 1, number, -1)
        return found


@cache
def lexicon(path):
    return Lexicon(path)


def slices(batches):
    """Record batches of few texts, so that a worker holds little at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def count_words(docs, tokenizer):
    """``word, n`` over all texts, words combined in each input task."""

    def task(batches):
        vocab, counts = vocabulary(tokenizer), Counter()

        def rows():
            words = [w for w in counts if type(w) is str]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())],
                ["word", "n"])

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    counts.update(vocab.pieces(text))
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select("text").mapInArrow(task, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs, tokenizer, words=LEXICON_WORDS):
    """Compile the ``words`` most frequent words of ``docs`` and ship the file to the workers.

    The file lies in the folder that all executors share.  Returns the name under which workers
    find their copy of it.
    """
    spark = docs.sparkSession
    top = count_words(docs, tokenizer).orderBy(F.desc("n"), "word").limit(words).toArrow()
    vocab = vocabulary(tokenizer)
    folder = work_dir(spark, "lexicon")
    name = f"lexicon-{os.path.basename(folder)}.bin"
    files, place = pyarrow.fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    files.create_dir(place)
    with files.open_output_stream(f"{place}/{name}") as file:
        compile_lexicon([(w, vocab.merge(w)) for w in top.column("word").to_pylist()], file)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


class Encoder:
    """Ids of texts: the lexicon for the words it holds, exact merges for the others."""

    def __init__(self, vocab, words):
        self.vocab, self.words, self.cache = vocab, words, {}

    def merge(self, word):
        if type(word) is int:
            return [word]
        ids = self.cache.get(word)
        if ids is None:
            ids = self.vocab.merge(word)
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, texts):
        """Flat ids and the end of each text in them."""
        pieces, counts = [], []
        for text in texts:
            own = self.vocab.pieces(text) if text else []
            pieces += own
            counts.append(len(own))
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(counts) + 1, np.int64)
        # Words hold no white space, so spaces part them; a special token is a word of no bytes.
        try:
            joined = " ".join(pieces).encode()
        except TypeError:
            joined = " ".join([p if type(p) is str else "" for p in pieces]).encode()
        data = np.frombuffer(joined, np.uint8)
        cuts = np.concatenate(([-1], np.flatnonzero(data == 32), [len(data)]))
        starts, lengths = cuts[:-1] + 1, np.diff(cuts) - 1
        number = self.words.lookup(data, starts, lengths)
        number[lengths == 0] = -1
        known = number >= 0
        sizes = np.zeros(len(pieces), np.int64)
        first = self.words.ends[np.maximum(number, 0)].astype(np.int64)
        sizes[known] = self.words.ends[number[known] + 1] - first[known]
        unseen = np.flatnonzero(~known)
        merged = [self.merge(pieces[i]) for i in unseen]
        sizes[unseen] = [len(ids) for ids in merged]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.empty(ends[-1], np.int32)
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        taken = np.repeat(known, sizes)
        source = np.repeat(first, sizes) + inside
        flat[taken] = self.words.flat[source[taken]]
        if len(unseen):
            flat[~taken] = np.concatenate([np.array(ids, np.int32) for ids in merged])
        return flat, ends[np.concatenate(([0], np.cumsum(counts)))]


def encode(docs, tokenizer, words=LEXICON_WORDS, text="text", ids="ids"):
    """Add the token ids of each text to ``docs``; null is empty, and so are its ids."""
    name = build_lexicon(docs, tokenizer, words)

    def task(batches):
        encoder = Encoder(vocabulary(tokenizer), lexicon(SparkFiles.get(name)))
        for part in slices(batches):
            flat, ends = encoder.encode(part.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids])

    added = StructField(ids, ArrayType(IntegerType()))
    return docs.mapInArrow(task, StructType([*docs.schema.fields, added]))


def decode(rows, tokenizer, ids="ids", text="decoded"):
    """Add the text of each row's ids: its tokens joined by a space, special ones included."""

    def task(batches):
        tokens = vocabulary(tokenizer).tokens
        for part in slices(batches):
            lists = part.column(ids)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            found = [" ".join([tokens[i] for i in flat[a:b].tolist()])
                     for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found, pa.string())], [*part.schema.names, text])

    return rows.mapInArrow(task, StructType([*rows.schema.fields, StructField(text, StringType())]))


class Written:
    """What stands for each word: its ids in decimals, and their tokens, both joined by a space.

    Words of the lexicon are kept; the others, merged, make room for new ones from time to time.
    """

    def __init__(self, vocab, words):
        self.vocab, self.words = vocab, words
        self.decimals, self.decoded, self.merged, self.silent = {}, {}, [], set()

    def learn(self, pieces):
        """Have all words of some lists of words."""
        if len(self.merged) > CACHE_WORDS:
            for word in self.merged:
                del self.decimals[word], self.decoded[word]
            self.merged = []
        unseen = set().union(*pieces).difference(self.decimals)
        plain = [w for w in unseen if type(w) is str]
        for word in unseen.difference(plain):
            self.put(word, [word])
        if not plain:
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in plain])
        starts = np.concatenate(([0], ends[:-1]))
        data = np.frombuffer(" ".join(plain).encode(), np.uint8)
        number = self.words.lookup(data, starts, ends - 1 - starts)
        known = number >= 0
        first, last = self.words.ends[number[known]].tolist(), self.words.ends[number[known] + 1].tolist()
        ranges = iter(zip(first, last))
        for word, inside in zip(plain, known.tolist()):
            if inside:
                a, b = next(ranges)
                self.put(word, self.words.flat[a:b].tolist())
            else:
                self.put(word, self.vocab.merge(word))
                self.merged.append(word)

    def put(self, word, ids):
        tokens = self.vocab.tokens
        self.decimals[word] = " ".join(map(str, ids))
        self.decoded[word] = " ".join([tokens[i] for i in ids])
        if not ids:
            self.silent.add(word)

    def texts(self, words):
        """Ids and decoded text of a list of words."""
        if self.silent:
            words = [w for w in words if w not in self.silent]
        return (" ".join(map(self.decimals.__getitem__, words)),
                " ".join(map(self.decoded.__getitem__, words)))


def digests(docs, tokenizer, words=LEXICON_WORDS):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs (doc_id, text)``.

    A null text is empty, an empty one has no tokens; repeated rows are rows of their own.  Texts are
    encoded, decoded and hashed in one pass: the distinct words of some texts are looked up once, and
    the ids and tokens of a text are those of its words.
    """
    name = build_lexicon(docs, tokenizer, words)

    def task(batches):
        vocab = vocabulary(tokenizer)
        written = Written(vocab, lexicon(SparkFiles.get(name)))
        for part in slices(batches):
            pieces = [vocab.pieces(t) if t else [] for t in part.column("text").to_pylist()]
            written.learn(pieces)
            counts, hashes, back = [], [], []
            for own in pieces:
                ids, text = written.texts(own)
                counts.append(ids.count(" ") + 1 if ids else 0)
                hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        task, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
