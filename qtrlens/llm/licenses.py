"""Licence scan with a positional rare-token index, in DataFrame functions only.

Licence texts are templates: words, and the mandatory key phrases among them. The index
maps a word to postings (template, place); a template is filed under its two mandatory words
of highest corpus IDF. A file that holds a template holds all its mandatory words, so these
two are the file's highest-IDF words of that licence: each file looks up its own rare words,
and an occurrence less the posting's place is a start of that template. Starts that both words
support (intersection by relative position) are verified: every key phrase must stand there
word by word. The score of a start is the IDF share of the template's words in place. Index
and templates are literals that expressions look into, so the plan is as long for a thousand
templates as for one.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base result.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Label, template, mandatory key phrases (separated by ";").
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing;as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge;obtaining a copy"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license;version 3"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright;related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "accompanying materials;eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it;gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included;substantial portions"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "express or implied warranty;held liable for any damages"),
)
#: A template names a licence if so much of its IDF weight is in place.
LABEL_FROM = 0.6
#: A start is one number, template * SPAN + word; no text has that many words.
SPAN_BITS = 40
SPAN = 1 << SPAN_BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _templates():
    """(label, words, mandatory places, is base) of every template."""
    out = [(label, text.split(), list(range(len(text.split()))), True) for label, text in BASE]
    for label, text, keys in TEMPLATES:
        words, must = text.split(), set()
        for key in keys.split(";"):
            key = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            must |= set(range(at, at + len(key)))
        out.append((label, words, sorted(must), False))
    return out


def words_of(text: Column) -> Column:
    """The whole text's words: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) + 1 of the templates' words, over all
    documents: at most one row per template word reaches the driver."""
    vocabulary = sorted({w for _, words, _, _ in _templates() for w in words})
    had = docs.select(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary))).alias("had"))
    got = had.select(F.explode(F.array_append("had", F.lit(""))).alias("w")).groupBy("w").count().collect()
    seen = {r["w"]: r["count"] for r in got}
    return {w: math.log((1 + seen.get("", 0)) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}


def _index(weights: dict[str, float]) -> list[dict[str, list[int]]]:
    """Two rare-token indexes, for the rarest and the second rarest mandatory word of each template
    (highest IDF first, ties to the first place): word to postings ``template * SPAN - place``,
    templates from 1. Such a posting plus where the word stands is a start."""
    out: list[dict[str, list[int]]] = [{}, {}]
    for k, (_, words, must, _) in enumerate(_templates(), 1):
        rare = sorted(must, key=lambda j: (-weights[words[j]], j))[:2]
        for index, j in zip(out, (rare[0], rare[-1])):
            index.setdefault(words[j], []).append(k * SPAN - j)
    return out


def _literal(value, kind: str) -> Column:
    """A nested value as one foldable expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start; null without any), base_labels, labels (with
    the method's own; distinct, sorted, comma-joined, empty without any) and score (0 to 1).

    Null and empty texts have no words; very long ones are scanned whole; repeated rows get equal
    results; an empty table gives an empty result. Other columns are not read. No row moves; one
    pass counts the IDF."""
    weights = weights or idf(docs, text)
    found, indexes = _templates(), _index(weights)
    place = lambda words, j: {"j": j, "w": words[j], "idf": weights[words[j]]}
    places = "array<array<struct<j int, w string, idf double>>>"
    all_places = _literal([[place(words, j) for j in range(len(words))] for _, words, _, _ in found], places)
    must_places = _literal([[place(words, j) for j in must] for _, words, must, _ in found], places)
    totals = _literal([sum((weights[w] for w in words), 0.0) for _, words, _, _ in found], "array<double>")
    labels, bases = _literal([t[0] for t in found], "array<string>"), _literal([t[3] for t in found], "array<boolean>")

    def looked_up(index):  # starts of the templates that the file's words are filed under
        postings = _literal(index, "map<string, array<long>>")
        mine = F.filter("rare", lambda x: x["w"].isin(list(index)))
        return F.flatten(F.transform(mine, lambda x: F.transform(F.element_at(postings, x["w"]), lambda p: p + x["i"])))

    def number(start):  # of the template
        return F.shiftright(start, SPAN_BITS).cast("int")

    def standing(p, start):
        return F.coalesce(F.get("words", (start % SPAN).cast("int") + p["j"]) == p["w"], F.lit(False))

    def verified(start):
        return F.forall(F.element_at(must_places, number(start)), lambda p: standing(p, start))

    def share(start):
        got = F.aggregate(F.element_at(all_places, number(start)), F.lit(0.0), lambda sum_, p: sum_ + F.when(standing(p, start), p["idf"]).otherwise(F.lit(0.0)))
        return F.round(got / F.element_at(totals, number(start)), 9)

    def described(start):
        k = number(start)
        return F.struct((start % SPAN).alias("at"), F.element_at(labels, k).alias("label"), F.element_at(bases, k).alias("base"), share(start).alias("share"))

    rare = sorted({w for index in indexes for w in index})
    rows = docs.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))
    rows = rows.select("*", F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull()).alias("rare"))
    # a word nearer to the text's start than its place in the template gives a number beyond the text
    shared = F.filter(F.array_intersect(*map(looked_up, indexes)), lambda start: start % SPAN < F.size("words"))
    rows = rows.select("doc_id", "words", F.filter(shared, verified).alias("starts"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("starts", described).alias("found"))
    rows = rows.select("*", F.filter("found", lambda x: x["base"]).alias("based"), F.filter("found", lambda x: x["share"] >= LABEL_FROM).alias("named"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return rows.select("doc_id", "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(F.col("based")["at"]).alias("first_word"),
                       F.array_max(F.col("based")["at"]).alias("last_word"), joined("based").alias("base_labels"), joined("named").alias("labels"),
                       F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0))).alias("score"))


def duckdb_sql() -> str:
    """The same rows by a plain join of words and template words."""
    values = ", ".join(f"({k}, '{label}', {j}, '{w}', {str(j in must).lower()}, {str(base).lower()})"
                       for k, (label, words, must, base) in enumerate(_templates()) for j, w in enumerate(words))
    return rf"""
with t(k, label, j, word, must, base) as (values {values}),
d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select rid, unnest(words) as word, unnest(range(len(words))) as i from d),
n as (select count(*) as n from d),
idf as (select v.word, ln((1 + n) / (1 + count(distinct rid))::double) + 1 as idf
        from (select distinct word from t) v left join w using (word), n group by v.word, n),
whole as (select k, sum(idf) as total, count(*) filter (must) as n_must from t join idf using (word) group by k),
hit as (select rid, t.k, label, base, i - j as o, sum(idf) as got, count(*) filter (must) as n from w join t using (word) join idf using (word) group by all),
ok as (select rid, k, label, base, o, round(got / total, 9) as share from hit join whole using (k) where n = n_must),
r as (select rid, count(*) filter (base) as n_base, min(o) filter (base) as first_word, max(o) filter (base) as last_word,
             string_agg(distinct label, ',' order by label) filter (base) as base_labels,
             string_agg(distinct label, ',' order by label) filter (share >= {LABEL_FROM}) as labels, max(share) as score from ok group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, least(1.0, coalesce(score, 0.0))::double as score
from d left join r using (rid)"""
