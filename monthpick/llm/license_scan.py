"""Licence scan: sparse TF-IDF cosine to templates, then directory inheritance (operator 6).

DataFrame functions only.  There are two sets of templates, each with its own idf, and
a unit's cosine to each template of a set decides:

* short notices in one sentence, by words: the units are a file's lines with an anchor
  word (licences name themselves) and, if it has such a line, its whole text;
* licence texts and standard headers (folder ``licenses``), by runs of three words in a
  paragraph: the units are whole files and every run of up to six paragraphs, however
  their lines are wrapped or commented.  No anchor is asked for.  A unit at a cosine of c
  shares at least c^2 of a template's squared weight, and only files that do are cut
  into units, so that bound loses none.

The best unit of both gives the file's own licence; a file whose whole text is near a
template is a licence file and speaks for its directory.  Files without a licence of
their own inherit that of the nearest ancestor directory that has one: directories are
joined with their own ancestors, each distinct directory once, so a directory with a
third of all files is one row there.

Edge cases: null and empty texts have no licence of their own; rows with one path are
one file; of equal cosines the template first in alphabetical order wins, of several
licence files in a directory the best and then the first by path; very long texts are
scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch

#: Licence templates (notices and first sentences), by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. The Unlicense.",
}
ANCHOR = "(?i)licen[cs]e|copyright|public domain"
WORD = "[a-z0-9]+"
MIN_COSINE, DIGITS = 0.6, 4
#: Licence texts (SPDX identifier.txt) and standard headers (SPDX identifier.notice.txt).
TEXTS = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
GRAM, PARAGRAPHS = 3, 6
#: A comment's last line before code ends a paragraph; so does a line without letters and digits.
COMMENT = r"[ \t]*+(?:#|//|\*|/\*|--|;|%)"
COMMENT_END, BLANK = rf"(?m)^({COMMENT}.*+)\n(?!{COMMENT})", r"\n[^\p{L}\p{N}\n]*+(?=\n)"


def _weights(words: dict[str, list[str]]) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    n, found = len(words), {}
    for ws in words.values():
        for w in set(ws):
            found[w] = found.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + found[w])) + 1 for ws in words.values() for w in ws}
    rows = []
    for k, ws in words.items():
        weights = {w: ws.count(w) * idf[w] for w in set(ws)}
        norm = math.sqrt(sum(weights[w] * weights[w] for w in dict.fromkeys(ws)))
        rows += [(k, w, x / norm) for w, x in sorted(weights.items())]
    return rows, idf, math.log(1 + n) + 1


def template_weights() -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(template, word, normed weight) rows, idf by word, and the idf of a word that no template has."""
    return _weights({k: re.findall(WORD, v.lower()) for k, v in TEMPLATES.items()})


def text_weights() -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """The same of the licence texts and headers, with runs of three words of a paragraph for words."""
    grams = {}
    for k, v in TEXTS.items():
        paragraphs = [re.findall(WORD, p) for p in re.split(r"\n[^a-z0-9\n]*(?=\n)", v.lower())]
        grams[k] = [" ".join(ws[i : i + GRAM]) for ws in paragraphs for i in range(len(ws) - GRAM + 1)]
    return _weights(grams)


def _nearest(terms: DataFrame, weights: tuple, license_of=lambda k: k) -> DataFrame:
    """(path, unit, b) of the units (path, unit, word, tf) that are near a template; b is score, order and licence of the best."""
    rows, idf, unknown = weights
    spark = terms.sparkSession
    names = sorted({k for k, _, _ in rows})
    ranks = {x: i for i, x in enumerate(sorted({*TEMPLATES, *map(_license, TEXTS)}))}
    by_word = {}
    for k, w, x in rows:
        by_word.setdefault(w, {})[names.index(k)] = x
    known = spark.createDataFrame([(w, idf[w], t) for w, t in by_word.items()], "word string, idf double, t map<int,double>")  # fixed size
    tf = terms.join(F.broadcast(known), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    norms = F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")
    dots = [F.sum(F.when(F.col("t")[i].isNotNull(), F.col("x") * F.col("t")[i])).alias(f"d_{i}") for i in range(len(names))]
    scored = tf.groupBy("path", "unit").agg(norms, *dots)
    options = F.array(*[F.struct(F.round(F.coalesce(F.col(f"d_{i}"), F.lit(0.0)) / F.col("norm"), DIGITS).alias("score"), F.lit(-ranks[license_of(k)]).alias("order"), F.lit(license_of(k)).alias("license")) for i, k in enumerate(names)])
    return scored.select("path", "unit", F.array_max(options).alias("b")).where(F.col("b.score") >= MIN_COSINE)


def _license(template: str) -> str:
    return template.removesuffix(".notice")


def _grams(text: Column) -> Column:
    """All runs of three words."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.regexp_extract_all(plain, F.lit(r"(?<![a-z0-9])(?=([a-z0-9]++" + r"\x20[a-z0-9]++" * (GRAM - 1) + "))"), F.lit(1))


def _near_texts(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, unit, b) of whole files (unit 0) and runs of paragraphs that are near a licence text or header."""
    weights = text_weights()
    squares = {}
    for k, w, x in weights[0]:
        squares.setdefault(w, []).append((k, x * x))
    shared = F.broadcast(files.sparkSession.createDataFrame(list(squares.items()), "word string, s array<struct<template:string,square:double>>"))
    text = F.coalesce("text", F.lit(""))
    some = files.select("path", F.explode(F.array_distinct(_grams(text))).alias("word")).join(shared, "word").select("path", F.inline("s"))
    enough = (MIN_COSINE - 10**-DIGITS) ** 2
    possible = scratch.stage(some.groupBy("path", "template").agg(F.sum("square").alias("share")).where(F.col("share") >= enough).select("path").distinct())
    paragraphs = F.split(F.regexp_replace(text, COMMENT_END, "$1\n\n"), BLANK)
    pieces = files.join(possible, "path", "left_semi").select("path", F.posexplode(paragraphs).alias("at", "content")).where(F.col("content").rlike("[A-Za-z0-9]"))
    pieces = pieces.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1)
    terms = pieces.select("path", "at", F.explode(_grams(F.col("content"))).alias("word")).groupBy("path", "at", "word").agg(F.count(F.lit(1)).alias("tf"))
    runs = [F.when(F.col("at") >= j, (F.col("at") - j) * PARAGRAPHS + k) for k in range(1, PARAGRAPHS + 1) for j in range(k)]
    units = F.filter(F.array(F.lit(0), *runs), lambda u: u.isNotNull())
    terms = terms.select("path", "word", "tf", F.explode(units).alias("unit")).groupBy("path", "unit", "word").agg(F.sum("tf").alias("tf"))
    return _nearest(terms, weights, _license)


def scan(files: DataFrame) -> DataFrame:
    """(path, license, how, score) of every distinct path of ``files`` (path, text); how is own, inherited or none."""
    spark = files.sparkSession
    scratch = Scratch(spark, "license-scan")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(ANCHOR))
    units = F.when(F.size(lines) > 0, F.concat(F.array(text), lines))
    exploded = files.where(text.rlike(ANCHOR)).select("path", F.posexplode(units).alias("unit", "content"))
    terms = exploded.select("path", "unit", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))).alias("word"))
    tf = terms.groupBy("path", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    best = _nearest(tf, template_weights()).unionByName(_near_texts(files, scratch))
    own = scratch.stage(best.groupBy("path").agg(F.max("b").alias("b"), F.max(F.when(F.col("unit") == 0, F.col("b"))).alias("whole")))
    paths = scratch.stage(files.select("path").distinct().withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    speaking = own.where("whole IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("at"), F.struct((-F.col("whole.score")).alias("s"), F.col("path"), F.col("whole.license").alias("license")).alias("c")).groupBy("at").agg(F.min("c").alias("c"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = paths.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("at"))
    inherited = ancestors.join(speaking, "at").groupBy("dir").agg(F.max(F.struct(F.length("at").alias("depth"), (-F.col("c.s")).alias("score"), F.col("c.license").alias("license"))).alias("i"))
    out = paths.join(own.select("path", "b"), "path", "left").join(inherited, "dir", "left")
    how = F.when(F.col("b").isNotNull(), "own").when(F.col("i").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("b.license", "i.license").alias("license"), how.alias("how"), F.coalesce("b.score", "i.score").alias("score"))


def oracle() -> str:
    """The same by plain SQL over ``documents``, a file for each document in source/lang."""
    rows, idf, unknown = template_weights()
    quoted = ", ".join(f"('{k}', '{w}', {x!r}::DOUBLE)" for k, w, x in rows)
    idfs = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    return f"""
WITH weights(template, word, weight) AS (VALUES {quoted}), known(word, idf) AS (VALUES {idfs}),
files AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM files),
hits AS (SELECT doc_id, content FROM lines WHERE regexp_matches(content, '{ANCHOR}')),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS unit, content FROM hits
  UNION ALL SELECT doc_id, 0, text FROM files WHERE doc_id IN (SELECT doc_id FROM hits)),
words AS (SELECT doc_id, unit, unnest(regexp_extract_all(lower(content), '{WORD}')) AS word FROM units),
tf AS (SELECT doc_id, unit, w.word, count(*) * coalesce(any_value(idf), {unknown!r}::DOUBLE) AS x FROM words w LEFT JOIN known USING (word) GROUP BY ALL),
norms AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM tf GROUP BY ALL),
cosines AS (SELECT doc_id, unit, template, round(sum(x * weight) / any_value(norm), {DIGITS}) AS score
  FROM tf JOIN weights USING (word) JOIN norms USING (doc_id, unit) GROUP BY doc_id, unit, template),
good AS (SELECT * FROM cosines WHERE score >= {MIN_COSINE}),
own AS (SELECT doc_id, template, score FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) = 1),
first_of AS (SELECT f.source, f.lang, g.template, g.score FROM (SELECT * FROM good WHERE unit = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) = 1) g JOIN files f USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY f.source, f.lang ORDER BY g.score DESC, f.doc_id::VARCHAR || '.txt') = 1)
SELECT f.doc_id, coalesce(o.template, i.template) AS license,
  CASE WHEN o.template IS NOT NULL THEN 'own' WHEN i.template IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  coalesce(o.score, i.score) AS score
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN first_of i ON f.source = i.source AND f.lang = i.lang
"""
