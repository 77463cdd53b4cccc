"""License scan by diagonal voting, in DataFrame operations only.

Rolling word pairs of every text are joined with the places of the same pairs in templates.  A
place in the text less the place in the template is a diagonal: pairs of one passage vote for the
same diagonal, and words put in or left out only move to a neighbouring one.  Neighbouring
diagonals are merged, and what the votes cover of the template decides.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch

GRAM = 2
#: Neighbouring diagonals of one passage: so many words may be put in or left out between them.
DRIFT = 4
#: Part of a template's pairs that must be found.
COVER = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are a finding wherever their words stand consecutively.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Sentences of license notices, found also with words put in or left out.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("licensed under the apache license version 2 0 you may not use this file except in "
     "compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files", "mit"),
    ("this work is licensed under a creative commons attribution 4 0 international license",
     "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
]


def template_grams(spark, phrases=PHRASES, notices=NOTICES):
    """Word pairs of all templates: ``gram_hash, gram, template, place``; a fixed small table."""
    texts = [t for t, _ in phrases] + [t for t, _ in notices]
    rows = []
    for template, text in enumerate(texts):
        words = text.split()
        rows += [(" ".join(words[i:i + GRAM]), template, i) for i in range(len(words) - GRAM + 1)]
    table = spark.createDataFrame(rows, "gram string, template int, place int")
    return table.select(F.xxhash64("gram").alias("gram_hash"), "gram", "template", "place")


def text_words(text="text"):
    """Words of a text in lower case; null is empty.

    Of other letters only the Kelvin sign has an ASCII letter as its lower case, a k, which no base
    phrase holds; so base findings are those of folding A-Z alone, at a fraction of the cost.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def hits(docs, grams):
    """Pairs of texts that are in a template, and one row per text that is in none.

    ``row, doc_id, n_words, template, diagonal, at, place``; the row without a template has the
    number of words.  A row number stands for the text, so doc_ids may repeat.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_words().alias("words"))
    pair = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat(
        F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)))
    pairs = F.when(F.size("words") >= GRAM, pair).otherwise(F.array().cast("array<string>"))
    # The text's own row is a pair that no template has: its number of words.
    placed = words.select(
        "row", "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("at", "gram"))
    found = placed.withColumn("gram_hash", F.xxhash64("gram")).join(
        F.broadcast(grams.unionByName(own_row(grams))), ["gram_hash", "gram"])
    at = (F.col("at") - 1).cast("bigint")
    return found.select(
        "row", "doc_id", "n_words", "template", at.alias("at"), "place",
        (at - F.col("place")).alias("diagonal"))


def own_row(grams):
    return grams.sparkSession.range(1).select(
        F.xxhash64(F.lit("")).alias("gram_hash"), F.lit("").alias("gram"),
        F.lit(None).cast("int").alias("template"), F.lit(None).cast("int").alias("place"))


def diagonals(found):
    """Votes by diagonal: ``row, doc_id, n_words, template, diagonal, votes, places, first, last``.

    A diagonal has at most one vote for each place of its template.
    """
    return found.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_list("place").alias("places"),
        F.min("at").alias("first"), F.max("at").alias("last"))


def passages(voted):
    """Neighbouring diagonals of one template, merged: ``votes, found, first, last`` of each."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))
    numbered = voted.withColumn("opens", apart.cast("int")).withColumn(
        "passage", F.sum("opens").over(order))
    return numbered.groupBy("row", "doc_id", "n_words", "template", "passage").agg(
        F.sum("votes").alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
        F.min("first").alias("first"), F.max("last").alias("last"))


def scan(docs, phrases=PHRASES, notices=NOTICES, cover=COVER):
    """License findings of every row of ``docs (doc_id, text, ...)``.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.  Base places are
    those where a phrase's words stand consecutively: diagonals with a vote for every pair.
    ``labels`` adds notices of which at least ``cover`` is found in one passage, with votes on half
    of its words.  ``score`` is the best part of a template found in a finding, 0 without one.  Null
    and empty texts have no words and empty labels; rows that repeat a doc_id are scanned each.
    """
    spark = docs.sparkSession
    labelled = [*phrases, *notices]
    known = F.broadcast(spark.createDataFrame(
        [(i, len(t.split()) - GRAM + 1, label) for i, (t, label) in enumerate(labelled)],
        "template int, pairs int, label string"))
    # Dealt by text once, and written: the texts are read once for phrases and notices.
    found = hits(docs, template_grams(spark, phrases, notices)).repartition("row")
    voted = Scratch(spark, "licenses").save(diagonals(found), "votes")
    is_phrase = F.coalesce(F.col("template") < len(phrases), F.lit(True))
    single = voted.where(is_phrase).join(known, "template", "left")
    base = F.coalesce(F.col("votes") == F.col("pairs"), F.lit(False))
    single = single.select(
        "row", "doc_id", "n_words", base.alias("is_base"),
        F.when(base, F.col("diagonal")).alias("place"), F.when(base, F.col("label")).alias("label"),
        base.cast("double").alias("part"))
    merged = passages(voted.where(~is_phrase)).join(known, "template")
    part = F.col("found") / F.col("pairs")
    verified = (part >= cover) & (2 * F.col("votes") >= F.col("last") - F.col("first") + 1)
    merged = merged.where(verified).select(
        "row", "doc_id", "n_words", F.lit(False).alias("is_base"),
        F.lit(None).cast("bigint").alias("place"), "label", part.alias("part"))
    both = single.unionByName(merged).groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("is_base").cast("bigint")).alias("n_base"),
        F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",")
        .alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("part").alias("score"))
    return both.drop("row")
