"""License scans: exact set-similarity join of text blocks with licence notices. Native DataFrame code only.

A block is a line, or a run of lines as hard-wrapped notices have them: from each line on, the following lines belong to its
block as long as the lines before them have 1 to ``SHORT_LINE`` words and the block ``BLOCK_WORDS`` words at most, which is
more than the longest template has. Lines end at any of the usual breaks; an empty line ends a block.

A block matches a template if it holds at least ``threshold`` of the template's distinct words (containment). Words are
ordered by their global frequency over all blocks, rarest first. A pair is a candidate only if a word of the block's prefix
equals a word of the template's prefix (prefix filter), the block has enough words (length filter), and enough words are
left after the shared one on both sides (positional filter). Candidates are verified exactly. Words outside the template
vocabulary cannot count towards any overlap and are left out of a block's set before it is ordered; the vocabulary is a
fixed list, which is why its frequency table (a row for each word) may go to the driver and templates may be broadcast.
Texts are read once; what is saved of each is its base columns and its blocks that have words enough for some template.

Defined cases: null text counts as empty; empty text gives no words, no labels, score 0; null doc_id is kept; repeated rows
each give the same result; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

THRESHOLD, SHORT_LINE, BLOCK_WORDS, LINES_IN_BLOCK = 0.8, 20, 48, 16
#: Phrases whose every place is counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Common licence notices, one block each.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the license at http www apache org licenses LICENSE 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "Copyright notice. All rights reserved. No part of this publication may be reproduced, distributed or transmitted"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_LINE = r"[\x00-\x09\x0B\x0C\x0E-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_sets(templates=TEMPLATES, threshold=THRESHOLD) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, words needed) of each template."""
    sets = [(i, label, sorted(set(words_of(text)))) for i, (label, text) in enumerate(templates)]
    return [(i, label, ws, math.ceil(round(threshold * len(ws), 9))) for i, label, ws in sets if ws]


def _folded(text):
    """Lower case as far as ASCII words go: the one other letter whose lower case is an ASCII letter (Kelvin sign) is kept apart."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))


def _blocks(text, vocabulary: list[str], least: int):
    """The vocabulary words (distinct, in the vocabulary's order) of each block that has ``least`` of them or more."""
    order = F.lit(vocabulary)
    line = F.split(F.regexp_replace(_folded(text), IN_LINE, " "), "\r\n?|\n")
    words = F.transform(line, lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    lines = F.transform(words, lambda w: F.struct(F.size(w).alias("n"), F.array_intersect(order, w).alias("ws")))

    def block(x, i):
        start = F.struct(x["n"].alias("n"), F.array(x["ws"]).alias("ws"), ((x["n"] > 0) & (x["n"] <= SHORT_LINE)).alias("open"))

        def step(b, y):
            more = b["open"] & (y["n"] > 0) & (b["n"] + y["n"] <= BLOCK_WORDS)
            return F.when(more, F.struct((b["n"] + y["n"]).alias("n"), F.concat(b["ws"], F.array(y["ws"])).alias("ws"), (y["n"] <= SHORT_LINE).alias("open"))).otherwise(
                F.struct(b["n"].alias("n"), b["ws"].alias("ws"), F.lit(False).alias("open"))
            )

        # lines without a word of the vocabulary begin no block: what they could hold, the next line's block holds
        run = F.aggregate(F.slice(F.col("__lines"), i + 2, F.lit(LINES_IN_BLOCK - 1)), start, step)
        return F.when((F.size(x["ws"]) > 0) & (x["n"] <= SHORT_LINE), F.array_intersect(order, F.flatten(run["ws"]))).otherwise(x["ws"])

    return lines, F.filter(F.transform("__lines", block), lambda ws: F.size(ws) >= least)


def _matches(blocks: DataFrame, sets: list, vocabulary: list[str]) -> DataFrame:
    """A row for each (key, label) that a block (key, ws) contains a template of, with the best containment."""
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    prefixes, least = [], min(a for *_, a in sets)
    for number, label, ws, need in sets:
        ws = sorted(ws, key=rank.get)
        prefixes += [(number, label, ws, need, i, ws[i]) for i in range(len(ws) - need + 1)]
    schema = T.StructType([T.StructField("tid", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("tws", T.ArrayType(T.StringType())), T.StructField("need", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("w", T.StringType())])
    index = blocks.sparkSession.createDataFrame(prefixes, schema)
    size = F.size("ws")
    probes = blocks.select("key", F.array_intersect(F.lit(ordered), "ws").alias("ws")).select("key", "ws", F.posexplode(F.slice("ws", F.lit(1), size - least + 1)).alias("j", "w"))
    candidates = probes.join(F.broadcast(index), "w").where(
        (size >= F.col("need")) & (F.col("j") <= size - F.col("need")) & (1 + F.least(F.size("tws") - 1 - F.col("i"), size - 1 - F.col("j")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("ws", "tws"))
    return candidates.where(overlap >= F.col("need")).groupBy("key", "label").agg(F.max(overlap / F.size("tws")).alias("containment"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Each document's base phrase places and template labels.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score is the best containment of a
    matched template, 1.0 where a base phrase stands, 0.0 where nothing was found.
    """
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for _, _, ws, _ in sets for w in ws})
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(_folded(F.col("text")), SEPARATORS, " ")), F.lit(" "))
    lines, blocks = _blocks(F.col("text"), vocabulary, min(a for *_, a in sets))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), spaced.alias("s"), lines.alias("__lines"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    hit = lambda p: F.contains(F.col("s"), F.lit(f" {p} "))
    count = lambda p: F.when(hit(p), F.regexp_count("s", F.lit(f"(?= {re.escape(p)} )"))).otherwise(0)
    n_words = F.when(F.length("s") <= 2, 0).otherwise(spaces(F.col("s")) - 1)
    first = lambda p: F.when(hit(p), spaces(F.substring("s", F.lit(1), F.locate(f" {p} ", F.col("s")))) - 1)
    behind = lambda p: F.substring(F.reverse("s"), F.lit(1), F.locate(f" {p} "[::-1], F.reverse(F.col("s"))) + len(p) + 1)
    last = lambda p: F.when(hit(p), spaces(F.col("s")) - spaces(behind(p)))
    nothing = F.lit(None).cast("int")
    base = rows.select(
        "doc_id", "key", n_words.cast("long").alias("n_words"),
        sum((count(p) for p, _ in phrases), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[first(p) for p, _ in phrases], nothing).cast("long").alias("first_word"),
        F.greatest(*[last(p) for p, _ in phrases], nothing).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*[F.when(hit(p), F.lit(label)) for p, label in phrases]))).alias("base"),
        blocks.alias("blocks"),
    )
    base = saved(base, "blocks")
    found = _matches(base.select("key", F.explode("blocks").alias("ws")), sets, vocabulary).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    joined = base.drop("blocks").join(found, "key", "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """DuckDB SQL for :func:`license_scan` by comparing every block with every template."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in ws)}], {need})" for i, label, ws, need in template_sets(templates, threshold))
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM places WHERE {' AND '.join(f'ws[i + {k}] = {w!r}' for k, w in enumerate(p.split()))}" for p, label in phrases
    )
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs WHERE len(ws) > 0),
hits AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
lines AS (SELECT doc_id, li, regexp_extract_all(line, '{word}') AS ws FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS li FROM (SELECT doc_id, string_split_regex({low}, '\r\n?|\n') AS ls FROM documents))),
runs AS (SELECT a.doc_id, a.li, b.li AS lj, b.ws, sum(len(b.ws)) OVER w AS n, bool_and(len(b.ws) BETWEEN 1 AND {SHORT_LINE}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open
 FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.li BETWEEN a.li AND a.li + {LINES_IN_BLOCK - 1} WINDOW w AS (PARTITION BY a.doc_id, a.li ORDER BY b.li)),
blocks AS (SELECT doc_id, list_distinct(flatten(list(ws))) AS b FROM runs WHERE lj = li OR (open AND len(ws) > 0 AND n <= {BLOCK_WORDS}) GROUP BY doc_id, li),
t(tid, label, tws, need) AS (VALUES {values}),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(tws, b)) / len(tws)) AS c FROM blocks, t WHERE len(b) >= need AND len(list_intersect(tws, b)) >= need GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(g.c, 0.0)::DOUBLE) AS score
FROM docs d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN found g ON g.doc_id = d.doc_id"""
