"""The conversation trie, the text scores and the ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import hmm, strata, ztrie
from postloom.llm.scratch import arrow_rows

TURNS = "conv_id bigint, turn bigint, role string, text string, low int, depth string"


def trie_of(rows):
    """``{prefix: row}`` of the contract, from plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            pair = role or "", text or ""
            digest = hashlib.sha256(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, pair))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    found = {}
    for prefix in sorted(members, key=len, reverse=True):
        below = [p for p in found if len(p) == len(prefix) + 1 and p[:len(prefix)] == prefix]
        convs = [c for c, _ in members[prefix]]
        ends = ",".join(str(c) for c in sorted(c for c, end in members[prefix] if end))
        saved = (len(convs) - 1) * (len(prefix[-1][1]) if prefix else 0)
        found[prefix] = (
            min(convs), len(prefix), min(c for c, _ in members[prefix[:-1]]) if prefix else None,
            len(convs), len(below), sum(found[b][5] for b in below) or 1,
            saved + sum(found[b][6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return found


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark):
    pick = random.Random(11)
    rows = []
    for conv in [*range(-130, 320), 10**12, 10**12 + 7]:
        common = pick.randint(0, 4)
        for turn in range(pick.randint(1, 9) if conv % 17 else 40):
            text = f"t{turn}" if turn < common else f"é{pick.randint(0, 3)}" * turn
            rows.append((conv, turn, "user" if turn % 2 else "bot", text, 1, "x"))
    rows += [(None, 0, "user", "lost", 1, "x"), (500, None, None, None, 1, "x"),
             (500, None, "", "", 1, "x"), (500, 3, "user", "z" * 50_000, 1, "x"), (501, 1, "a", "b", 1, "x")]
    rows += [r for r in rows if r[0] == 40]
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    found = ztrie.prefix_trie(frame).select(COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(trie_of(rows).values())


def test_trie_of_a_chain_of_prefixes_and_of_equal_conversations(spark):
    # Ids that end in 00 start with their own turns only.
    chain = [(100 * i, t, "u", str(t)) for i in range(1, 31) for t in range(i)]
    same = [(100 * i, t, "u", f"s{t}") for i in range(40, 140) for t in range(3)]
    frame = spark.createDataFrame(chain + same, "conv_id bigint, turn bigint, role string, text string")
    found = ztrie.prefix_trie(frame).select(COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(trie_of(chain + same).values())


@pytest.mark.parametrize("nodes_sent", [True, False])
def test_exits_by_broadcast_and_by_shuffle_are_the_same(spark, monkeypatch, nodes_sent):
    monkeypatch.setattr(ztrie, "is_small", lambda *_: nodes_sent)
    rows = [(c, t, "u", str((c * 7 + t) % 3)) for c in range(0, 3000, 100) for t in range(c // 300 + 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = ztrie.prefix_trie(frame).select(COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(trie_of(rows).values())


def test_trie_of_no_conversations_and_of_turnless_ones(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert ztrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "u", "gone")]
    found = ztrie.prefix_trie(spark.createDataFrame(rows, schema)).select(COLUMNS).collect()
    ends = hashlib.sha256(str(turnless).encode()).hexdigest()
    assert [tuple(r) for r in found] == [(turnless, 0, None, 1, 0, 1, 0, ends)]


def test_handles_are_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    frame = spark.createDataFrame(pairs, "a int, b int")
    for a, b, fat in frame.select("a", "b", ztrie.fattest(F.col("a"), F.col("b"))).collect():
        assert fat == max(range(a + 1, b + 1), key=lambda n: n & -n)


def swept(model, text):
    """Start, transition and emission counts and likelihood by plain recursions."""
    ahead = [model.start * model.emits[text[0]]]
    for s in text[1:]:
        ahead.append((ahead[-1] @ model.moves) * model.emits[s])
    behind = [np.ones(model.states)]
    for s in text[:0:-1]:
        behind.append(model.moves @ (model.emits[s] * behind[-1]))
    behind, whole = behind[::-1], ahead[-1].sum()
    emits, moves = np.zeros_like(model.emits), np.zeros_like(model.moves)
    for i, s in enumerate(text):
        emits[s] += ahead[i] * behind[i] / whole
        if i:
            moves += model.moves * np.outer(ahead[i - 1], model.emits[s] * behind[i]) / whole
    return ahead[0] * behind[0] / whole, moves, emits, math.log(whole)


def test_segments_give_the_plain_recursions(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    monkeypatch.setattr(hmm, "GROUP_SEGMENTS", 4)
    draw = np.random.default_rng(1)
    unigram = draw.random(20)
    model = hmm.Model.first(unigram / unigram.sum(), 3)
    texts = [draw.integers(0, 20, n) for n in (1, 4, 5, 6, 11, 37, 64, 10)]
    wanted = [sum(x) for x in zip(*(swept(model, t) for t in texts))]
    for have, want in zip(model.expected(texts), wanted):
        assert np.allclose(have, want, rtol=1e-10)
    assert np.allclose(model.likelihoods(texts), [swept(model, t)[3] for t in texts])
    better = model.improved(model.expected(texts), unigram / unigram.sum())
    assert better.likelihoods(texts).sum() > model.likelihoods(texts).sum()


def two_tongues():
    pick = random.Random(4)
    tongues = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = []
    for i in range(300):
        words = [pick.choice(tongues[i % 2]) for _ in range(pick.randint(1, 40))]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "É\x1cé " + "y" * 60_000), (302, "A0 B1\x0bnever"), (None, "a1")]
    return rows


def test_scores_equal_brute_force_and_beat_unigrams(spark):
    rows = two_tongues()
    frame = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, symbols string")
    found = hmm.text_scores(frame.repartition(3), states=3, own=20, lexicon=40, rounds=2).collect()
    assert len(found) == len(rows)

    def tokens(text):
        return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w] + [b""]

    def held(doc):
        return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 1

    counts = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    total, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    wanted = Counter(
        (d, held(d), len(tokens(t)), sum(w in counts for w in tokens(t)), total,
         round(sum(math.log10((counts[w] + 0.5) / scale) for w in tokens(t)), 6)) for d, t in rows)
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == wanted
    held_out = [r for r in found if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_probabilities_of_one_word_texts_add_up_to_no_more_than_one(spark):
    docs = spark.createDataFrame(two_tongues(), "doc_id bigint, text string")
    words = [f"{c}{i}" for i in range(30) for c in "ab"] + ["never", "é"]
    asked = spark.createDataFrame(
        [(d, w) for d, w in zip((x for x in range(10**6) if zlib.crc32(str(x).encode()) % 5 == 1), words)],
        "doc_id bigint, text string")
    found = hmm.text_scores(docs.unionByName(asked), states=2, own=20, lexicon=40, rounds=1)
    ids = [r.doc_id for r in asked.collect()]
    scores = [r.score for r in found.where(F.col("doc_id").isin(ids)).collect() if r.n_tokens == 2]
    assert 0 < sum(10 ** s for s in scores) <= 1 + 1e-9


def test_long_texts_shape_the_first_model(spark):
    """Texts of over 2,000 words that go around in a circle of words: the next word is known."""
    texts = [" ".join(f"w{(i * 7 + k) % 12}" for k in range(2_500)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = hmm.text_scores(docs.repartition(3), states=6, own=20, lexicon=40, rounds=2).collect()
    assert all(r.score > 0.9 * r.base_score for r in found)  # logarithms, below 0


def test_pairs_of_groups_are_counted_over_all_training_texts(spark):
    pick = random.Random(5)
    texts = [[pick.randrange(9) for _ in range(pick.choice((1, 2, 50, 3_000)))] for _ in range(60)]
    rows = [(bytes(np.array(t, np.uint16)), i % 5 == 1) for i, t in enumerate(texts)]
    coded = spark.createDataFrame(rows, "symbols binary, held_out boolean").repartition(4)
    group = np.array([0, 1, 2, 3, 3, 2, 1, 0, 3])
    pairs, firsts = hmm.pair_counts(coded, group, np.uint16, 4)
    wanted, begun = np.zeros((4, 4)), np.zeros(4)
    for i, text in enumerate(texts):
        if i % 5 != 1:
            begun[group[text[0]]] += 1
            for a, b in zip(text, text[1:]):
                wanted[group[a], group[b]] += 1
    assert (pairs == wanted).all() and (firsts == begun).all()


def test_scores_without_training_texts(spark):
    held = next(x for x in range(100) if zlib.crc32(str(x).encode()) % 5 == 1)
    found = hmm.text_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in found] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert hmm.text_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def ranked_by_hand(docs, items, top):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(
            {c: c + 32 for c in range(65, 91)}))

    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, own in held:
            m = 75 + 25 * sum(own.values()) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (10**9 * own[t] // (1000 * own[t] + 12 * m)) for t in terms(text) if own[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        rows += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return Counter(rows)


@pytest.mark.parametrize("shard, seeds", [(4_000_000, 200), (40, 1)])
def test_search_equals_brute_force(spark, monkeypatch, shard, seeds):
    monkeypatch.setattr(strata, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(strata, "SEED_DOCS", seeds)
    monkeypatch.setattr(strata, "ITEM_BYTES", 400)
    pick = random.Random(9)
    words = ["the"] * 40 + [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x_y", "3.5"]
    docs = [(i, " ".join(pick.choice(words) for _ in range(pick.choice([1, 3, 20, 21, 150]))))
            for i in range(250)]
    docs += docs[:30] + [(None, "the w1"), (900, None), (901, ""), (902, "!?"), (903, "w2 " * 20_000)]
    items = [(i, " ".join(pick.choice(words) for _ in range(8))) for i in range(20)]
    items += [(20, "w1 w1 W1"), (21, None), (22, "nowhere"), (23, ""), (0, "w3"), (None, "w4")]
    frame = spark.createDataFrame(
        [(*d, 1, "x") for d in docs], "doc_id bigint, text string, m int, term string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, place int")
    found = strata.ranked(frame.repartition(3), asked.repartition(2)).collect()
    assert Counter(tuple(r) for r in found) == ranked_by_hand(docs, items, 20)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert strata.ranked(docs.limit(0), items).count() == 0
    assert strata.ranked(docs, items.limit(0)).count() == 0
    # The one document's term has the weight of a term that all documents have.
    assert strata.ranked(docs, items).count() == 1


def test_large_rows_are_read_a_few_at_a_time(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    with arrow_rows(spark, 7):
        assert [spark.conf.get(name) for name in names] == ["7", "7"]
    assert [spark.conf.get(name) for name in names] == before
