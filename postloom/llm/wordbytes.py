"""Words of whole texts as numpy arrays: cut, fold and hash a block of texts at once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

with np.errstate(over="ignore"):
    def mixed(x):
        """A bijective scrambling of 64-bit values."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    BYTE_CODE = BYTE_CODE[FOLD] | np.uint64(1)
    PLACE_CODE = mixed(np.arange(901, 933, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    PLACE_CODE |= np.uint64(1)
RADIX = np.uint64(0xD6E8FEB86659FD93)


def text_blocks(batch, column="text", limit=BLOCK_BYTES):
    """Cut a record batch into blocks of whole texts: ``(first row, bytes, offsets)``.

    A null text is empty.  A block holds at most ``limit`` bytes, or one text.
    """
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    buffers = texts.buffers()
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(buffers[1], np.int64, count + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(count, max(first + 1, last))
        yield (
            first,
            data[offsets[first]:offsets[last]],
            offsets[first:last + 1] - offsets[first],
        )
        first = last


def runs(inside, offsets):
    """Starts and ends of the runs of true bytes; no run crosses from one text to the next."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def texts_of(starts, offsets):
    """The text each start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data, starts, ends):
    """A 64-bit hash of each run of bytes, with A-Z folded to a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    codes = BYTE_CODE[data[place + np.repeat(starts, lengths)]]
    powers = np.full(int(lengths.max()), RADIX, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(powers, dtype=np.uint64)
        codes *= powers[place]
        return mixed(np.add.reduceat(codes, firsts) + lengths.astype(np.uint64))


def folded_words(data, offsets):
    """Hashes of the white-space separated words and the number of words of each text."""
    starts, ends = runs(~SPACE[data], offsets)
    counts = np.bincount(texts_of(starts, offsets), minlength=len(offsets) - 1)
    return run_hashes(data, starts, ends), counts


def gram_hash(columns):
    """Hash of a sequence of word hashes, given as one array per place."""
    with np.errstate(over="ignore"):
        total = np.full(len(columns[0]), len(columns), np.uint64)
        for code, column in zip(PLACE_CODE, columns):
            total += code * column
        return mixed(total)


def shingle_sets(data, offsets, width=5):
    """For each text the sorted distinct hashes of its ``width``-word sequences.

    A text with fewer words has its whole sequence as one, a text without words none.
    """
    words, counts = folded_words(data, offsets)
    ends = np.cumsum(counts)
    if len(words) >= width:
        last = len(words) - width + 1
        grams = gram_hash([words[i:last + i] for i in range(width)])
    for end, count in zip(ends, counts):
        if count >= width:
            yield np.unique(grams[end - count:end - width + 1])
        elif count:
            yield gram_hash([words[i:i + 1] for i in range(end - count, end)])
        else:
            yield words[:0]
