"""Each operator against brute force or a round trip, and on rows that are null, empty or repeated."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import (
    bpe, chat, dedup, forest, jaccard, language, licenses, mixing, toxicity, warc)
from postloom.llm.queries import tokenizer
from postloom.llm.scratch import Scratch
from postloom.session import CLEAN_SHUFFLES
from postloom.streaming.fanout import folder_names

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, digest int"
ODD = [
    (1, "Alpha beta", "en", "a", 1, "x", 0), (2, "alpha BETA", "en", "a", 1, "x", 0),
    (2, "alpha BETA", "en", "a", 1, "x", 0), (3, None, None, None, None, None, None),
    (4, "", "de", "b", 0, "", 0), (None, "lost words here", "en", "b", 1, "x", 1),
    (5, "É" * 3000 + " " + "z" * 70000, "fr", "c", 1, "x", 1), (6, "123 !!", "en", None, 1, "x", 1),
    (7, "ABC é É", "fr", "c", 1, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark.createDataFrame(ODD, DOCS).repartition(3)


def fold(text):
    return (text or "").encode().lower()


def test_exact_dedup_keeps_the_largest(odd):
    rows = dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len({fold(r[1]) for r in ODD})
    group = [r for r in rows if r.text_sha256 == hashlib.sha256(b"alpha beta").hexdigest()]
    assert {r.keep_id for r in group} == {2} and {r.group_size for r in group} == {3}
    kept = dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({fold(r[1]) for r in ODD})


def test_exact_dedup_compares_bytes_of_clashing_digests_over_several_batches(odd):
    rows = dedup.exact_dedup(odd, digest_chars=1, files_per_batch=1).collect()
    sizes = Counter(fold(r[1]) for r in ODD)
    for r in rows:
        text = next(t for t in sizes if hashlib.sha256(t).hexdigest() == r.text_sha256)
        assert r.group_size == sizes[text]


def test_exact_dedup_parts_texts_of_one_whole_digest_by_content(spark, odd, monkeypatch):
    rows = [(1, "x"), (2, "y"), (3, "X"), (3, "y"), (4, "other"), (5, "OTHER"), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = dedup.with_digest

    def clashing(rows, name="text_sha256", text="text"):
        short = F.lower(F.coalesce(text, F.lit(""))).isin("x", "y")
        return real(rows, name, text).withColumn(name, F.when(short, "same").otherwise(F.col(name)))

    monkeypatch.setattr(dedup, "with_digest", clashing)
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.exact_dedup(frame).collect())
    assert found == Counter([(1, 3, 2, False), (3, 3, 2, True), (2, 3, 2, False), (3, 3, 2, True),
                             (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)])


def test_operators_on_empty_tables(spark, odd):
    docs = odd.limit(0)
    assert dedup.exact_dedup(docs).count() == 0
    assert jaccard.near_duplicates(docs).count() == 0
    assert licenses.scan(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(turns).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.roundtrip(pages).count() == 0


def linked(rows):
    sets = {}
    for i, text in rows:
        words = fold(text).decode().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short", [1, 64])
def test_near_duplicates_equal_brute_force(spark, odd, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    pick = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    base, passage = ([pick.choice(words) for _ in range(40)] for _ in range(2))
    texts = []
    for i in range(70):
        copy = list(base)
        for _ in range(pick.randint(0, 3)):
            copy[pick.randrange(40)] = pick.choice(words)
        texts.append(copy if i % 2 else [pick.choice(words) for _ in range(i)] + passage)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, "one"), (901, "ONE"), (902, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert found == linked(rows)


def test_near_duplicates_of_odd_rows(odd):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert jaccard.drop_near_duplicates(odd).columns == odd.columns


def near_copies(spark, groups=40, each=4):
    words = [[f"w{g}x{i}" for i in range(60)] for g in range(groups)]
    rows = [(g * each + k, " ".join(words[g][:59 - k])) for g in range(groups) for k in range(each)]
    rows += [(1000 + i, text) for i, text in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_blocks_are_searched_in_rounds_of_bounded_bytes(spark, monkeypatch):
    docs = near_copies(spark)
    whole = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert len({row[2] for row in whole}) == 40
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    members = spark.createDataFrame([(b, b + 1, 60) for b in range(30)], "block bigint, doc_id bigint, n bigint")
    queries = members.select("block", F.col("block").alias("query"))
    sets = jaccard.sets(docs.where("doc_id < 5"))
    scratch = Scratch(spark, "rounds")
    found = jaccard.searched_blocks(members, queries, sets, True, scratch, "near")
    assert sum(name.startswith("near-of-") for name in folder_names(spark, scratch.base)) > 1
    assert sorted((r.query, r.doc_id) for r in found.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == whole


def test_near_duplicates_go_without_a_shuffle_of_texts(spark):
    docs = near_copies(spark).unionByName(spark.createDataFrame([(None, "w0x0 w0x1")], "doc_id bigint, text string"))
    kept = jaccard.drop_near_duplicates(docs)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [
        *((False, g * 4) for g in range(40)), (True, None)]


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffles():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in folders.apply(i).getName() for i in range(folders.size()))

    before = shuffles()
    table = Scratch(spark, "shuffled").save(spark.range(1000).repartition(4, "id"), "table")
    assert shuffles() <= before
    assert table.count() == 1000 and spark.conf.get(CLEAN_SHUFFLES) == "false"
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"


def test_heap_merge_counts():
    pick = random.Random(1)
    for _ in range(200):
        lists = [sorted(pick.sample(range(40), pick.randint(0, 20))) for _ in range(8)]
        least = pick.randint(1, 6)
        counts = Counter(x for ids in lists for x in ids)
        found = dict(jaccard.merged_counts(lists, least))
        assert set(found) == {x for x, n in counts.items() if n >= least}
        assert all(found[x] == counts[x] for x in found)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 3 else None) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, second = (sorted(map(tuple, mixing.mix(frame).collect())) for _ in range(2))
    assert first == second
    taken, target = Counter(), {}
    for _, size, source_size, goal, _, words in first:
        assert words <= 3 * size
        taken[source_size, goal] += words
    for key, words in taken.items():
        assert abs(words - key[1]) <= 7
    del target


def test_mix_of_odd_rows(odd):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.draw_mix(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_encoding_equals_the_library(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    rows = bpe.decode(bpe.encode(odd, tokenizer(), words=3), tokenizer()).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests_of_all_documents_equal_the_library(spark, odd, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select("doc_id", "text")).unionByName(spark.createDataFrame(
            [(-1, "<|endoftext|>a <|x <|startoftext|> b"), (-2, " \n "), (-3, "\u0000a\x1f b́ ﬁ Σς")],
            "doc_id bigint, text string"))
    rows = bpe.digests(docs, tokenizer(), words=500)
    wanted = []
    for doc, text in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256(back.encode()).hexdigest()))
    assert Counter(tuple(r) for r in rows.collect()) == Counter(wanted)
    assert bpe.digests(docs.limit(0), tokenizer()).count() == 0


def test_transducer_numbers_words_in_order(tmp_path):
    words = ["a", "ab", "abc", "b", "bc", "zebra", "é", "éa"]
    path = str(tmp_path / "lexicon")
    with open(path, "wb") as file:
        states = bpe.compile_lexicon([(w, [i]) for i, w in enumerate(words)], file)
    assert states < sum(map(len, words))
    asked = ["abc", "abcd", "é", "zebr", "b", "q"]
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    lengths = np.array([len(w.encode()) for w in asked])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    numbers = bpe.Lexicon(path).lookup(data, starts, lengths)
    assert numbers.tolist() == [words.index(w) if w in words else -1 for w in asked]


def test_chat_round_trip_and_layouts(spark):
    odd = ["a\\b", "<|im_end|>\n", "\\<|im_start|>", "</s>[INST] ok", "<<|x", "", None, "\n\\"]
    rows = [(1, i, t, r) for i, (t, r) in enumerate(zip(odd, reversed(odd)))]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = chat.canonical_turns(chat.gather(frame))
    row = turns.withColumn("back", chat.read_back(chat.formatted(F.col("turns")))).first()
    assert row.back == row.turns and len(row.turns) == len(odd)
    records = ['{"prompt":"a","completion":"b"}', '{"instruction":"do","input":"","output":"y"}',
               '{"conversations":[{"from":"human","value":"h"}]}', '{"zzz":1}', "broken{", None]
    found = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string"))
    texts = {r.record: r.turns and [tuple(t) for t in r.turns] for r in found.collect()}
    assert texts[records[0]] == [("user", "a"), ("assistant", "b")]
    assert texts[records[1]] == [("user", "do"), ("assistant", "y")]
    assert texts[records[2]] == [("user", "h")]
    assert texts[records[3]] is None and texts[records[4]] is None and texts[None] is None
    with pytest.raises(ValueError):
        chat.typed_turns(spark.range(1))


def test_chat_layouts_by_the_paths_of_all_messages(spark):
    records = {
        '{"messages":[{"role":"gpt"},{"role":"human","content":"x","name":"n"}],"id":7}':
            [("gpt", ""), ("human", "x")],
        '{"messages":[]}': [],
        '{"conversations":[{"from":"Human","value":"h"},{"from":"gpt","value":null,"w":1}]}':
            [("user", "h"), ("assistant", "")],
        '{"dialog":[{"speaker":"gpt","text":"[1]"}],"note":[{"a":1}]}': [("gpt", "[1]")],
        '{"prompt":"[{\\"role\\":1}]","completion":"b"}': None,
        '{"messages":["a"]}': None, "[]": None, "{}": None,
    }
    found = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string"))
    got = {r.record: r.turns and [tuple(t) for t in r.turns] for r in found.collect()}
    for record, turns in records.items():
        if turns is not None:
            assert got[record] == turns or (turns == [] and got[record] == []), record


def test_chat_digests_keep_roles_in_every_layout(spark):
    from compare import connect, differences
    from postloom.llm.queries import ORACLES

    pick = random.Random(2)
    texts = ["", "a", "</s>[INST] ok", "\\\\n", "é\n\u2028", "<|im_end|>\n", '{"x":[1]}', None]
    roles = ["human", "gpt", "assistant", "user", "system", "Assistant", "", None]
    rows = [(c, t if t else None, pick.choice(roles), pick.choice(texts), "x")
            for c in [*range(-9, 30), None] for t in range(pick.randint(1, 6))]
    rows += rows[:5]
    schema = "conv_id bigint, turn bigint, role string, text string, record string"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    database = connect("/root/testdata/sf0.001")
    database.execute("CREATE OR REPLACE TABLE chat (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    database.executemany("INSERT INTO chat VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    sql = ORACLES["op5_chat_format"].replace("FROM conversations", "FROM chat")
    fixed = [(-7, t, r, "</s>[INST] ok [/INST]", "x") for t, r in ((0, "user"), (1, "assistant"))]
    extra, missing = differences(
        chat.digests(frame.unionByName(spark.createDataFrame(fixed, schema))), database,
        sql.replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,"))
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3])


def test_chat_mask_covers_the_texts_as_written(spark):
    turns = [("user", "q"), ("assistant", "a<|b"), ("x", "y"), ("assistant", "")]
    frame = spark.createDataFrame([(turns,)], "turns " + chat.TURNS)
    text, spans = frame.select(chat.formatted(F.col("turns")), chat.loss_spans(F.col("turns"))).first()
    assert [text[s:s + n] for s, n in spans] == ["a<\\|b", ""]
    assert all(text[:s].endswith("assistant\n") for s, _ in spans)


def test_warc_ranges_of_any_size(spark, odd):
    html = ["x" * 200, "x" * 200, None, "", "é\x1f\x8b\x08" * 500, "x" * 50, "x" * 50]
    rows = [(i, f"http://h/{i} \n", h, i) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, bytes int")
    for size in (64, 300, 1 << 20):
        found = {r.page_id: r for r in warc.roundtrip(pages, range_bytes=size).collect()}
        assert len(found) == len(html)
        for i, text in enumerate(html):
            assert found[i].payload_bytes == len((text or "").encode())
            assert found[i].payload_digest == hashlib.sha256((text or "").encode()).hexdigest()
        assert (found[1].record_type, found[1].refers_to) == ("revisit", 0)
        assert {found[i].record_type for i in (0, 2, 3, 4, 5, 6)} == {"response"}


def test_warc_ranges_are_read_by_many_tasks(spark, odd):
    pages = spark.range(400).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(k))) for k in range(20)]).alias("html")).coalesce(2)
    scratch = warc.Scratch(spark, "many")
    folder = f"file://{scratch.path('archives')}"
    archives = scratch.save(warc.write_archives(warc.plan_revisits(pages, 100), folder), "manifest")
    read = warc.read_archives(archives, folder, 4_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in read) == 400 and len(read) >= 8


def test_warc_of_null_and_repeated_page_ids(spark, odd):
    rows = [(1, "u", "a" * 200), (1, "u", "a" * 200), (None, "u", "b" * 200), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = Counter((r.page_id, r.payload_bytes) for r in warc.roundtrip(pages).collect())
    assert found == Counter([(1, 200), (1, 200), (None, 200), (2, 0)])


def test_warc_reader_passes_over_magic_inside_members():
    members = [warc.record_member(i, "u", "a", 1, hashlib.sha256(b"a").hexdigest(), None)
               for i in range(3)]
    noise = b"\x1f\x8b\x08junk"
    whole = members[0] + noise + members[1] + gzip.compress(b"no record") + members[2]
    found = [at for at, _, _ in warc.records_from(io.BytesIO(whole), 0, len(whole), len(whole))]
    assert len(found) == 3
    again = [at for cut in range(0, len(whole), 50) for at, _, _ in warc.records_from(
        io.BytesIO(whole), cut, min(cut + 50, len(whole)), len(whole))]
    assert again == found


def test_toxicity_catches_toxic_words(spark, odd):
    pick = random.Random(5)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        text = [pick.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text[3:3] = ["vile"] * (1 + i % 2)
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks[:300], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.severities(docs, labels).collect()}
    assert all(found[i].toxic == (i % 5 == 0) for i in range(300, 400))
    assert {r.severity for r in toxicity.severities(odd, labels.limit(0)).collect()} == {0.0}


def test_license_base_equals_brute_force(spark, odd):
    texts = ["Apache License, CC-BY mit license", "gnu GNU general public LICENSE apache license",
             None, "", "mit", "Permission is hereby granted, free of any charge, to any person who "
             "is obtaining a copy of this software"]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))

    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text).decode())
        hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in hits]
        return (len(words), len(hits), min(places, default=None), max(places, default=None),
                ",".join(sorted({label for _, label in hits})))

    wanted = Counter((r.doc_id, *brute(r.text)) for r in frame.collect())
    rows = licenses.scan(frame).collect()
    assert Counter(tuple(r)[:6] for r in rows) == wanted
    assert {r.labels for r in rows if r.doc_id == 105} == {"mit"}


def test_language_of_held_out_texts(spark, odd, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.languages_of(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)
    found = {r.doc_id: r.lang_pred for r in language.languages_of(odd).collect()}
    assert found[3] == found[4] == found[6] == "und"
    assert language.keep_known(odd).columns == odd.columns
    assert {r.lang_pred for r in language.languages_of(odd.limit(0)).collect()} == set()


def test_vectors_link_as_brute_force(spark):
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(30, 16))
    vectors = [(centres[i % 30] + random_.normal(size=16) * 0.12).tolist() for i in range(600)]
    vectors += [vectors[0], [0.0] * 16, [None] * 16, [float("nan")] * 16, [1.0], None]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, leaf int")
    found = {r.vec_id: r for r in forest.near_vectors(frame, leaf=64).collect()}
    good = np.array(vectors[:601])
    good /= np.linalg.norm(good, axis=1, keepdims=True)
    degree = ((good @ good.T) >= 0.9).sum(axis=1) - 1
    assert sum(found[i].n_links for i in range(601)) >= 0.9 * degree.sum()
    assert all(found[i].n_links <= degree[i] for i in range(601))
    assert all(found[i].n_links == 0 and found[i].kept for i in range(601, 606))
    assert found[600].component_id == found[0].component_id
    assert forest.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("closeness", [0.96, 0.92])
def test_vectors_of_a_clump_of_several_leaves_link(spark, closeness):
    random_ = np.random.default_rng(5)
    noise = random_.normal(size=(1200, 64))
    noise[:, 0] = 0
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    clump = math.sqrt(1 - closeness) * noise[:400]
    clump[:, 0] = math.sqrt(closeness)
    vectors = np.concatenate([clump, noise[400:], noise[400:450] + 0.01, clump[:20]])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r for r in forest.near_vectors(frame, leaf=64).collect()}
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    degree = ((vectors @ vectors.T) >= 0.9).sum(axis=1) - 1
    inside = [*range(400), *range(1250, 1270)]
    assert all(found[i].n_links == degree[i] for i in inside)
    assert {found[i].component_id for i in inside} == {0}
    assert sum(found[i].n_links for i in range(400, 1250)) >= 0.95 * degree[400:1250].sum()
    assert all(found[i].n_links <= degree[i] for i in range(400, 1250))


def test_vectors_of_every_width_and_multiples_of_one_direction_link(spark):
    line = [[float(k), 0.0, 0.0] for k in range(1, 41)]
    vectors = line + [[-0.0, 3e200, 4e200]] * 2 + [[1.0, 2.0]] * 3 + [[2.0, 4.0]] + [[-1.0, 2.0]] + [[5.0]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r for r in forest.near_vectors(frame, leaf=8).collect()}
    assert [found[i].n_links for i in range(len(vectors))] == [39] * 40 + [1] * 2 + [3] * 4 + [0] * 2
    assert sorted(i for i in found if found[i].kept) == [0, 40, 42, 46, 47]


def test_warc_header_of_any_length_and_records_are_counted(spark, odd):
    long = random.Random(3).randbytes(900_000).hex()
    rows = [(1, "u", "a" * 200), (2, long, "b"), (3, "x" * 3_000_000, "a" * 200), (4, "u", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = {r.page_id: r.refers_to for r in warc.roundtrip(pages, range_bytes=300_000).collect()}
    assert found == {1: None, 2: None, 3: 1, 4: None}
    read = spark.createDataFrame([("a",), ("a",), ("b",)], "archive string")
    kept = spark.createDataFrame([("a", 9, 2), ("b", 9, 1)], "archive string, bytes bigint, records bigint")
    warc.check_counts(read, kept)
    with pytest.raises(ValueError, match="b gave 1 records of 2"):
        warc.check_counts(read, kept.withColumn("records", F.lit(2)))


def test_without_labels_only_letterless_texts_are_dropped(odd):
    kept = language.keep_known(odd.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 2, None, 5, 7])


def test_pipeline_stages_on_odd_rows_equal_brute_force(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    near = " ".join(f"w{i}" for i in range(60))
    rows = ODD + [(10, near, "en", "a", 1, "x", 0), (11, near + " more", "en", "b", 1, "x", 0),
                  (12, near.upper(), "en", "b", 1, "x", 0), (13, "short one", None, None, 1, "x", 0)]
    docs, kept = spark.createDataFrame(rows, DOCS).repartition(3), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, None).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe_lexicon" or docs.columns == before
        kept[name] = docs
    ids = {n: Counter(r.doc_id for r in f.collect()) for n, f in kept.items()}
    assert ids["language_id"] == Counter([1, 2, 2, None, 5, 7, 10, 11, 12, 13])
    assert ids["exact_dedup"] == Counter([2, None, 5, 7, 11, 12, 13])
    assert ids["ngram_jaccard"] == Counter([2, None, 5, 7, 11, 13])
    copies = {r.doc_id: r.copies for r in mixing.mix(kept["ngram_jaccard"]).collect()}
    assert ids["pareto_mixing"] == Counter({d: n for d, n in copies.items() if n})
    library = Tokenizer.from_file(tokenizer())
    wanted = Counter()
    for r in kept["pareto_mixing"].collect():
        coded = library.encode(r.text or "", add_special_tokens=False).ids
        wanted[r.doc_id, hashlib.sha256(" ".join(map(str, coded)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.ids_sha256) for r in docs.collect()) == wanted
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, None).count() == 0


def test_short_and_long_words_are_merged_alike():
    vocab = bpe.vocabulary(tokenizer())
    pick = random.Random(6)
    for size in [1, 2, 3, 7, 20, 40, 200]:
        for _ in range(30):
            word = "".join(pick.choice("abcdeinorst-éñ") for _ in range(size))
            parts = [vocab.letters[b] for b in word.encode()]
            parts[-1] += vocab.suffix
            assert vocab.join_short(list(parts)) == vocab.join_long(list(parts))


def test_chances_of_grades_are_differences_of_cumulative_links():
    draw = np.random.default_rng(0)
    score, cuts = draw.normal(size=50), np.array([-0.3, 0.8])
    model = toxicity.OrdinalModel(np.array([1], np.uint64), np.zeros(1), cuts)
    chances = model.chances(score)
    assert np.allclose(chances.sum(axis=1), 1) and (chances > 0).all()
    plain = 1 / (1 + np.exp(-(cuts - score[:, None])))
    assert np.allclose(chances[:, 0], plain[:, 0]) and np.allclose(chances[:, 2], 1 - plain[:, 1])
