"""Licence scan by a positional index of rare words.

A template is a passage of a licence with a mandatory key phrase. Document frequencies of all template words are
counted over the corpus; the key phrase's word of highest IDF is the template's index word, posted with its position.
In a file, each occurrence of an index word looks up its postings and gives the place where the template would start.
At that place the key phrase must stand whole, and the share of the template's words that stand at their relative
positions is its support. All is done within a row, so nothing but the word counts is shuffled, and the work is linear
in a file's index words.

Base phrases are templates that are their own key phrase. A template of the method adds its label from ``support`` on.
The score is the best support of the labels found; a base phrase counts as 1.

Cases: a null or empty text has no words and no labels (empty strings), null places and score 0; a null id keeps its
row; repeated rows repeat; an empty table gives no rows; columns other than the id and the text are ignored. Index words
of equal frequency are taken in alphabetical order.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import texts

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases whose labels are asked for.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Fixed values: (label, passage, key phrase within it) of well-known licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def vocabulary(templates, base) -> list[str]:
    return sorted({w for _, passage, *_ in (*templates, *base) for w in passage.split()})


def frequencies(rows: DataFrame, vocab: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each template word; as many numbers as the templates have words."""
    own = F.array_intersect("words", F.array(*map(F.lit, vocab)))
    counted = rows.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counted}
    return found.pop("", 0), found


def index_of(templates, base, documents: int, found: dict[str, int]):
    """For each template: label, passage, where its key phrase starts, phrase, index word and its place in the phrase."""
    out = []
    for label, passage, phrase in [*templates, *((label, p, p) for label, p in base)]:
        words, key = passage.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        idf = {w: math.log((documents + 1) / (found.get(w, 0) + 1)) for w in key}
        rare = min(key, key=lambda w: (-idf[w], w))
        out.append((label, words, start, key, rare, key.index(rare)))
    return out


def places(entry) -> Column:
    """(start of the key phrase, support) wherever the phrase stands whole."""
    _, words, start, key, rare, at = entry
    whole = F.array(*map(F.lit, key))
    here = F.filter("hits", lambda h: (h["word"] == rare) & (h["pos"] >= at)
                    & (F.slice(F.col("words"), h["pos"] - at + 1, F.lit(len(key))) == whole))

    def support(h):
        agree = F.lit(0)
        for i, w in enumerate(words):
            k = h["pos"] - at - start + i
            same = F.when(k >= 0, F.coalesce(F.get(F.col("words"), k) == w, F.lit(False))).otherwise(F.lit(False))
            agree = agree + same.cast("int")
        return F.struct((h["pos"] - at).alias("start"), (agree / F.lit(float(len(words)))).alias("support"))

    return F.transform(here, support)


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, support: float = 0.5, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for each row.

    ``places`` lists (label, start, support) of everything found, base phrases and templates.
    """
    rows = texts(docs, id_column, text).select("doc_id", words_of(F.col("text")).alias("words"))
    entries = index_of(templates, base, *frequencies(rows, vocabulary(templates, base)))
    rare = sorted({e[4] for e in entries})
    # Positions are listed only for rows that hold an index word.
    listed = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("word"))),
                      lambda h: h["word"].isin(rare))
    empty = "array<struct<pos: int, word: string>>"
    hits = F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), listed).otherwise(F.array().cast(empty))
    rows = rows.withColumn("hits", hits)
    n_own = len(templates)
    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"),
                        *(places(e).alias(f"t{i}") for i, e in enumerate(entries)))

    def listed_as(i, entry):
        return F.transform(f"t{i}", lambda p: F.struct(F.lit(entry[0]).alias("label"), p["start"].cast("long").alias(
            "start"), p["support"].alias("support")))

    based = F.concat(*(listed_as(i, e) for i, e in enumerate(entries) if i >= n_own))
    more = F.filter(F.concat(*(listed_as(i, e) for i, e in enumerate(entries) if i < n_own)),
                    lambda p: p["support"] >= support) if n_own else F.filter(based, lambda p: F.lit(False))
    found = found.select("doc_id", "n_words", based.alias("based"), more.alias("more"))

    def names(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    return found.select(
        "doc_id", "n_words", F.size("based").cast("long").alias("n_base"),
        F.array_min("based.start").alias("first_word"), F.array_max("based.start").alias("last_word"),
        names(F.col("based.label")).alias("base_labels"),
        names(F.concat("based.label", "more.label")).alias("labels"),
        F.coalesce(F.array_max(F.concat("based.support", "more.support")), F.lit(0.0)).alias("score"),
        F.concat("based", "more").alias("places"))


def plain_words(text: str) -> list[str]:
    """The words of a text, stated in Python for the tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c
                                                                   for c in text))
