"""Text rules: literal results, and properties over random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions import text as rules

EDGE_ROWS = [
    "", " ", "The and de", "Hello @élan_9 world", "#tag1 #Tag2", "12345", "a1b2c3", "tab\tand\nline",
    " nbsp here ", "日本語 テキスト @日本 です", "naïve café Ünïcode", "😀 emoji 😀", "???", "_",
    "www.example.com", "http://a.b/c d", "http://a https://b c", "http://a www.b c d", "İstanbul",
    "x\x1cy\x85z", "  the   cat  ", "class", "ASS", "a-nude b", "it's", "¿qué? ¡sí!", "​zero",
]


def random_texts():
    random.seed(7)
    alphabet = "aàéZ09_@#.:/ \t\n ?!日😀ß-www"
    return ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    text = F.col("text")
    given = [(i, t) for i, t in enumerate(EDGE_ROWS + random_texts())]
    return spark.createDataFrame(given, "id int, text string").select(
        "text",
        rules.normalize_post(text).alias("clean"),
        rules.strip(text).alias("strip"),
        rules.is_meaningful(text).alias("meaningful"),
        rules.is_nsfw(text).alias("nsfw"),
        rules.is_nsfw(text, whole_word=True).alias("nsfw_word"),
        rules.label_text(text).alias("label"),
    ).collect()


def by_text(rows, column):
    return {r.text: r[column] for r in rows}


def test_normalize(rows):
    found = by_text(rows, "clean")
    assert found["The and de"] == "" and found["12345"] == ""
    assert found["Hello @élan_9 world"] == "hello world"
    assert found["#tag1 #Tag2"] == "tag tag"
    assert found["  the   cat  "] == "cat"
    for clean in found.values():
        assert not re.search(r"[#0-9]|@\w", clean) and clean == " ".join(clean.split())
        assert not set(clean.split()) & set(V.STOPWORDS)


def test_strip(rows):
    assert [r.strip for r in rows] == [r.text.strip() for r in rows]


def test_meaningful(rows):
    found = by_text(rows, "meaningful")
    assert not found["???"] and not found[""] and found["_"]
    assert not found["www.example.com"] and not found["http://a https://b c"]
    assert found["http://a.b/c d"] and found["http://a www.b c d"]


def test_label_text(rows):
    found = by_text(rows, "label")
    assert found["http://a.b/c d"] == "d" and found["¿qué? ¡sí!"] == "qué sí"
    assert found["it's"] == "its" and found["???"] == ""


def test_nsfw(rows):
    found, words = by_text(rows, "nsfw"), by_text(rows, "nsfw_word")
    assert found["class"] and found["ASS"] and not found["12345"]
    assert words["ASS"] and words["a-nude b"] and not words["class"]


def test_label_answer(spark):
    given = [
        ("user\nx\nmodel\nProvide a concise topic.\nmodel\n  Cats  in hats ", "Cats in hats"),
        ("a MODEL provide a concise topic MODEL b model Provide a concise topic. model c", "c"),
        ("no echo at all", "no echo at all"),
    ]
    rows = spark.createDataFrame(given, "generated string, wanted string")
    for row in rows.select("wanted", rules.label_answer(F.col("generated")).alias("got")).collect():
        assert row.got == row.wanted
