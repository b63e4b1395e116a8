"""License scans by a positional rare-token index.

A template is a licence text with a label and a key phrase that every hit must
hold. The index is the key phrases' postings: word -> (template, offset). A scan

1. counts in how many documents each key-phrase word stands (one pass, one
   count a word), which orders the words by IDF,
2. looks up, in each file, the key-phrase words it holds, rarest first; a template
   of which one is missing is out,
3. turns the places of the rarest word into starts (position - offset) and
   intersects them with the starts that each further word's places give, in
   order of falling IDF, until none are left or all words agree,
4. verifies that the key phrase stands at each start in full and that at least
   :data:`MIN_SUPPORT` of the template's words agree around it.

IDF decides only in which order postings meet, never the result. Look-up and
match run inside the task that reads the file: no shuffle of text. ``templates``
may be any texts; :func:`templates_of` takes them from a table.

Defined results: null or empty text has no words and no labels; repeated rows
are scanned one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, WORD_GAP, ascii_lower, let, rows, split_words

MIN_SUPPORT = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: the key phrase, as first word and number of words; None: all words
    key: tuple[int, int] | None = None
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_span(self) -> tuple[int, int]:
        return self.key or (0, len(self.words))

    @property
    def key_words(self) -> list[str]:
        return self.words[self.key_span[0] : sum(self.key_span)]


# Phrases and texts of public licences, in words.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
             "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
             "to whom the software is furnished to do so subject to the following conditions", (0, 6)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
             "permission notice appear in all copies", (0, 6)),
    Template("apache-2.0", "licensed under the apache license version 2 0", (3, 2)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", (3, 8)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
             "must retain the above copyright notice this list of conditions and the following disclaimer", (0, 7)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
             "written permission", (16, 8)),
    Template("gpl-3", "gnu general public license version 3", (1, 5)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", (0, 7)),
    Template("lgpl", "lesser general public license", (0, 4)),
    Template("mpl-2.0", "mozilla public license version 2 0", (0, 3)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", (0, 7)),
    Template("cc-by-nc", "cc by nc", (0, 3)),
    Template("cc-by-sa", "cc by sa", (0, 3)),
    Template("cc", "creative commons attribution", (0, 2)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", (0, 6)),
    Template("public-domain", "dedicated to the public domain", (3, 2)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", (0, 7)),
)
_PLACES = "array<int>"


def templates_of(table: DataFrame) -> tuple[Template, ...]:
    """Templates from a table (label, text, key_first, key_words), one a row; it is the stated query set and read whole."""
    def words(t: str) -> str:
        return " ".join(w for w in re.split(WORD_GAP, t.translate(str.maketrans(UPPER, LOWER))) if w)

    found = (Template(r["label"], words(r["text"]), None if r["key_first"] is None else (r["key_first"], r["key_words"])) for r in table.collect())
    return tuple(t for t in found if t.words)


def document_frequency(df: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Documents that hold each key-phrase word. A row with a count per word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    held = F.array_distinct(F.filter(F.transform(split_words(F.col("text")), ascii_lower), lambda w: w.isin(vocabulary)))
    return {r["w"]: r["n"] for r in rows(df, id_col, text_col).select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan(df: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, and hits as array<struct<label,start,n,support,base>>."""
    counts = document_frequency(df, templates, id_col, text_col)
    rare = lambda w: (counts.get(w, 0), w)
    vocabulary = sorted({w for t in templates for w in t.key_words}, key=rare)
    t = rows(df, id_col, text_col).select("doc_id", split_words(F.col("text")).alias("_words"), F.lower("text").alias("_low"))
    # most files lack some word of every key phrase: substring tests, rarest words first, spare them the walk over their words
    may = F.lit(False)
    for key in sorted({tuple(sorted(set(t.key_words), key=rare)) for t in templates}):
        may = may | reduce(Column.__and__, [F.contains("_low", F.lit(w)) for w in key])
    t = t.select("doc_id", "_words", may.alias("_may"))
    hit_type = "array<struct<label:string,start:bigint,n:bigint,support:double,base:boolean>>"

    index = F.array(*(F.struct(
        F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.lit(t.key_span[0]).alias("first"), F.lit(t.base).alias("base"),
        F.array(*map(F.lit, t.key_words)).alias("key"),
        F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("at")) for i, w in sorted(enumerate(t.key_words), key=lambda x: (rare(x[1]), x[0])))).alias("posting"),
    ) for t in templates))

    def hits_of(t: Column, ws: Column, places: Column) -> Column:
        starts_by = lambda p: F.transform(F.coalesce(F.element_at(places, p["w"]), F.array().cast(_PLACES)), lambda at: at - p["at"])
        rest = F.slice(t["posting"], F.lit(2), F.size(t["posting"]))
        agreed = F.aggregate(rest, starts_by(F.get(t["posting"], F.lit(0))), lambda s, p: F.when(F.size(s) > 0, F.array_intersect(s, starts_by(p))).otherwise(s))
        full = F.filter(agreed, lambda k: F.when(k >= 0, F.slice(ws, k + 1, F.size(t["key"])) == t["key"]).otherwise(False))

        def hit(k: Column) -> Column:
            # template words around the key phrase may stick out of the text
            agree = F.filter(t["words"], lambda w, i: F.get(ws, k - t["first"] + i) == w)
            n = F.size(t["words"])
            return F.struct(t["label"].alias("label"), k.cast("long").alias("start"), n.cast("long").alias("n"),
                            (F.size(agree).cast("double") / n.cast("double")).alias("support"), t["base"].alias("base"))

        return F.filter(F.transform(full, hit), lambda h: h["support"] >= MIN_SUPPORT)

    def hits(ws: Column) -> Column:
        posts = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda p: p["w"].isin(vocabulary))

        def matched(ps: Column) -> Column:
            held = F.array_distinct(F.transform(ps, lambda p: p["w"]))
            places = F.map_from_entries(F.transform(held, lambda w: F.struct(w, F.transform(F.filter(ps, lambda p: p["w"] == w), lambda p: p["at"]))))

            def found(at: Column) -> Column:
                possible = F.filter(index, lambda t: F.size(F.array_except(t["key"], F.map_keys(at))) == 0)
                return F.flatten(F.transform(possible, lambda t: hits_of(t, ws, at))).cast(hit_type)

            return F.when(F.size(ps) > 0, let(places, found)).otherwise(F.array().cast(hit_type))

        return let(posts, matched)

    found = F.when(F.col("_may") & (F.size("_words") > 0), let(F.transform("_words", ascii_lower), hits)).otherwise(F.array().cast(hit_type))
    return t.select("doc_id", F.size("_words").cast("long").alias("n_words"), found.alias("hits"))


def report(df: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places, labels and the best support as score."""
    found = scan(df, templates, id_col, text_col)
    base = F.filter("hits", lambda h: h["base"])
    join = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"), join(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["support"])), F.lit(0.0)).alias("score"),
    )
