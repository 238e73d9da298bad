"""License scan by an exact set-similarity join, in DataFrame functions alone (operator 8).

Templates are sentences that license texts hold. A block (a line, or a paragraph of several lines) matches a
template when it holds at least ``CONTAINMENT`` of the template's distinct words. The join is exact:

* words are ordered by their frequency in the corpus, rarest first;
* prefix filter: a match with overlap of at least a = ceil(CONTAINMENT x |T|) must share one of the first
  |T| - a + 1 words of the template and one of the first |B| - a + 1 of the block, so only these are joined on;
* length filter: |B| >= a;
* positional filter: words i and j in their orders leave room for min(|T| - i, |B| - j) common words at most,
  the shared one included, which must reach a;
* what is left is verified on the whole sets.

Only words of some template matter to the overlap, so blocks are cut down to these first. The template side
is small by its bound (``MAX_TEMPLATE_WORDS``) and broadcast.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
MAX_TEMPLATE_WORDS = 100_000
#: Words are runs of letters and digits of ASCII and of anything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of common licenses; (label, text).
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case; texts with the two letters whose lower case is ASCII are lowered letter by letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[\\u0130\\u212A]"), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP, -1), "")


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word and base_array (labels of the phrases found).

    Words are joined with a space on both sides of each, so that phrases next to each other share none.
    """
    t = docs.withColumn("_flat", F.concat(F.lit(" "), F.regexp_replace(lowered(F.coalesce(F.col(text_col), F.lit(""))), GAP, " "), F.lit(" ")))
    t = t.withColumn("_flat", F.regexp_replace("_flat", "^ +| +$", ""))
    t = t.withColumn("n_words", F.when(F.col("_flat") == "", 0).otherwise(
        F.length("_flat") - F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))) + 1).cast("bigint"))
    some = F.lit(False)
    for phrase in PHRASES:
        some = some | F.col("_flat").contains(phrase)
    t = t.withColumn("_wide", F.when(some, F.concat(F.lit(" "), F.replace(F.col("_flat"), F.lit(" "), F.lit("  ")), F.lit(" "))))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = f" {phrase.replace(' ', '  ')} "
        n = (F.length("_wide") - F.length(F.replace(F.col("_wide"), F.lit(p), F.lit("")))) / len(p)
        n = F.coalesce(F.round(n), F.lit(0)).cast("bigint")
        before = F.substring_index("_wide", p, 1)
        until = F.expr(f"substring(_wide, 1, length(_wide) - length(substring_index(_wide, '{p}', -1)) - {len(p)})")

        def words(s):
            return F.size(F.array_remove(F.split(s, " +", -1), "")).cast("bigint")

        counts.append(n)
        firsts.append(F.when(n > 0, words(before)))
        lasts.append(F.when(n > 0, words(until)))
        labels.append(F.when(n > 0, F.lit(label)))
    return (t.withColumns({"n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts),
                           "last_word": F.greatest(*lasts), "base_array": F.array_compact(F.array(*labels))})
            .drop("_flat", "_wide"))


def _key(id_col: str, text_col: str) -> list[Column]:
    """A document: its id and a hash of its text, so that rows under one id are told apart."""
    return [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")]


def template_join(docs: DataFrame, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
                  containment: float = CONTAINMENT) -> DataFrame:
    """Blocks that match a template: _id, _hash (of the text), block, label, template number, containment.

    Null and empty texts and blocks have no words and match nothing; repeated rows repeat their matches.
    """
    spark = docs.sparkSession
    sets = [(k, label, sorted(set(text.split()))) for k, (label, text) in enumerate(templates)]
    if sum(len(s) for _, _, s in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast; split the templates into runs")
    vocabulary = sorted({w for _, _, s in sets for w in s})
    words = F.array_intersect(_words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    held = docs.select(*_key(id_col, text_col), F.col(text_col).alias("_text"), words.alias("_own"))
    seen = {r["w"]: r["n"] for r in held.select(F.explode("_own").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rows, needed = [], set()
    for k, label, s in sets:
        order = sorted(s, key=rank.__getitem__)
        need = math.ceil(containment * len(order) - 1e-9)
        needed |= set(order[:len(order) - need + 1])
        rows += [(k, label, need, len(order), order, i, w) for i, w in enumerate(order[:len(order) - need + 1])]
    side = F.broadcast(spark.createDataFrame(
        rows, "template int, label string, need int, t_size int, t_words array<string>, i int, word string"))
    least = min((r[2] for r in rows), default=1)
    near = held.where(F.arrays_overlap("_own", F.array(*map(F.lit, sorted(needed))))) if needed else held.where("false")
    lines = F.split("_text", "\n", -1)
    paragraphs = F.filter(F.split("_text", "\n[\\x20\\x09\\x0D]*\n", -1), lambda p: p.contains("\n"))
    order_map = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    blocks = near.select("_id", "_hash", F.posexplode(F.concat(lines, paragraphs)).alias("block", "_line"))
    blocks = blocks.withColumn("_set", F.array_intersect(_words(F.col("_line")), F.array(*map(F.lit, vocabulary)))).drop("_line")
    blocks = blocks.where(F.size("_set") >= least)
    blocks = blocks.withColumn("_set", F.transform(
        F.array_sort(F.transform("_set", lambda w: F.struct(F.element_at(order_map, w).alias("r"), w.alias("w")))),
        lambda x: x["w"]))
    heads = blocks.select("*", F.posexplode(F.slice("_set", F.lit(1), F.size("_set") - least + 1)).alias("j", "word"))
    size = F.size("_set")
    pairs = (heads.join(side, "word").where(size >= F.col("need"))
             .where(F.least(F.col("t_size") - F.col("i"), size - F.col("j")) >= F.col("need")))
    common = F.array_intersect("_set", "t_words")
    return (pairs.where((F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word")))
            .select("_id", "_hash", "block", "label", "template", (F.size(common) / F.col("t_size")).alias("containment")))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels adds those of matching templates to the base ones; score is the best containment found, 1 where a
    phrase stands, else 0. A null or empty text has no words and no labels; repeated rows are repeated.
    """
    found = (template_join(docs, templates, id_col, text_col, containment).groupBy("_id", "_hash")
             .agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best")))
    own = base(docs.select(*_key(id_col, text_col), F.col(text_col).alias("_body")), "_body").drop("_body")
    t = own.alias("d").join(found.withColumnsRenamed({"_id": "_fid", "_hash": "_fhash"}),
                            F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_hash") == F.col("_fhash")), "left")
    both = F.array_union("base_array", F.coalesce("_more", F.array().cast("array<string>")))

    def joined(x):
        return F.array_join(F.array_sort(F.array_distinct(x)), ",")

    return t.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                    joined(F.col("base_array")).alias("base_labels"), joined(both).alias("labels"),
                    F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
