"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of words across lines, so that a wrapped notice is found: windows are a quarter (at a
threshold of 0.8) longer than the template, which leaves room for words between, as of comments. A block's token set is joined to the templates' token sets: a block matches a template when it holds at
least `threshold` of the template's tokens (containment). Tokens are ordered by how many blocks of the whole corpus hold
them, rarest first. By the prefix filter, a block that matches must hold one of the first |T| - need + 1 tokens of the
template; by the length filter it holds need template tokens at least; by the positional filter the tokens left after
a common one must suffice. What passes is verified, so the result is exact. Only tokens of templates can count towards
containment, so blocks carry only those, and their frequencies are at most as many as the templates have tokens. Windows
are only looked at around the places of prefix tokens, each with as many neighbours as the longest window holds.

The base scan counts the places where the words of a fixed phrase stand consecutively.

Nulls and odd input: a null text is empty: no words, no places, empty labels, null first_word and last_word, score 0.
Rows are judged one by one, so repeated rows repeat their result and a null doc_id is kept. An empty table gives an
empty result. Other columns are ignored, whatever they are called. Ties do not arise: labels are sets.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.storage import stored

#: Words of a lower-cased text, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices as their publishers word them.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.8


def token_set(text: str) -> set[str]:
    return set(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def needed(size: int, threshold: float) -> int:
    """The least overlap that reaches the threshold."""
    return max(1, math.ceil(size * threshold - 1e-9))


def width(text: str, threshold: float) -> int:
    """Words of a window for a template."""
    return math.ceil(len(re.findall(WORD, text)) / threshold - 1e-9)


def _list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _array(items) -> str:
    return f"array({_list(items)})"


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """For each row: its words, base places, the template tokens of each of its lines and, of several lines, their places."""
    d = docs.select(
        F.monotonically_increasing_id().alias("q_row"),
        F.col(id_col).alias("doc_id"),
        # lower() also lower-cases other letters; only the Kelvin sign would become an ASCII one.
        F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("ĸ"))).alias("q_low"),
    )
    d = d.withColumn("q_lines", F.transform(F.split("q_low", "\n"), lambda x: F.regexp_extract_all(x, F.lit(WORD), 0)))
    d = d.withColumn("q_maybe", F.expr(" OR ".join(f"contains(q_low, '{p.split()[-1]}') AND contains(q_low, '{p.split()[0]}')" for p, _ in PHRASES)))
    d = d.withColumn("q_words", F.when(F.col("q_maybe"), F.flatten("q_lines")))
    for i, (phrase, _) in enumerate(PHRASES):
        hit = " AND ".join(f"get(q_words, i + {j}) = '{w}'" for j, w in enumerate(phrase.split()))
        d = d.withColumn(f"q_at{i}", F.expr(f"CASE WHEN q_maybe AND size(q_words) > 0 THEN filter(sequence(0, size(q_words) - 1), i -> {hit}) ELSE CAST(array() AS ARRAY<INT>) END"))
    places = F.concat(*[f"q_at{i}" for i in range(len(PHRASES))])
    label = lambda i, name: F.when(F.size(f"q_at{i}") > 0, F.lit(name))
    return d.select(
        "q_row", "doc_id",
        F.expr("aggregate(q_lines, 0L, (n, x) -> n + size(x))").alias("n_words"),
        F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[label(i, name) for i, (_, name) in enumerate(PHRASES)]))).alias("base"),
        F.expr(f"filter(transform(q_lines, x -> array_intersect(x, {_array(vocabulary)})), x -> size(x) > 0)").alias("blocks"),
        F.expr(f"CASE WHEN size(q_lines) > 1 THEN array_compact(transform(flatten(q_lines), (x, i) -> CASE WHEN x IN ({_list(vocabulary)}) THEN struct(i AS pos, x AS token) END)) END").alias("marks"),
    )


def _windows(rows: DataFrame, prefixes: DataFrame, wholes: DataFrame, tokens: list[str], mapping: str, longest: int) -> DataFrame:
    """q_row, label, contained: matches of windows of words, whatever lines these are on. tokens: those of prefixes."""
    near = f"transform(slice(marks, greatest(j - {longest - 2}, 1), {2 * longest - 1}), m -> struct(m.pos AS pos, {mapping}[m.token] AS rank))"
    places = f"filter(sequence(0, size(marks) - 1), j -> marks[j].token IN ({_list(tokens)}))"
    at = rows.where("size(marks) > 0").select("q_row", F.explode(F.expr(f"transform({places}, j -> struct(marks[j].pos AS p, {mapping}[marks[j].token] AS rank, {near} AS near))")).alias("at"))
    j = at.select("q_row", "at.*").join(F.broadcast(prefixes.select("rank", "template")), "rank").join(F.broadcast(wholes), "template")
    j = j.withColumn("near", F.expr("filter(near, m -> abs(m.pos - p) < width AND array_contains(t_ranks, m.rank))")).where("size(array_distinct(near.rank)) >= need")
    held = "size(array_distinct(transform(filter(near, b -> b.pos >= a.pos AND b.pos < a.pos + width), b -> b.rank)))"
    j = j.withColumn("held", F.expr(f"array_max(transform(filter(near, a -> a.pos <= p), a -> {held}))"))
    return j.where("held >= need").select("q_row", "label", (F.col("held") / F.size("t_ranks")).alias("contained"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels and score of every document; see the module's text."""
    spark = docs.sparkSession
    sets = [(label, token_set(text)) for label, text in templates]
    vocabulary = sorted(set().union(*[s for _, s in sets]))
    rows = stored(_blocks(docs, id_col, text_col, vocabulary), "license-blocks")

    # One row for each token of the templates: a bound that the corpus does not move.
    counts = dict(rows.select(F.explode(F.flatten("blocks")).alias("token")).groupBy("token").count().collect())
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    index, whole = [], []
    for no, (label, tokens) in enumerate(sets):
        order, need = sorted(rank[t] for t in tokens), needed(len(tokens), threshold)
        whole.append((no, label, need, order, width(templates[no][1], threshold)))
        index += [(order[i], no, i) for i in range(len(order) - need + 1)]
    least = min(x[2] for x in whole)
    prefixes = spark.createDataFrame(index, "rank int, template int, t_pos int")
    wholes = spark.createDataFrame(whole, "template int, label string, need int, t_ranks array<int>, width int")

    mapping = "map(" + ", ".join(f"'{t}', {r}" for t, r in rank.items()) + ")"
    long_enough = rows.select("q_row", F.posexplode("blocks").alias("block", "tokens")).where(F.size("tokens") >= least)
    blocks = long_enough.select("q_row", F.expr(f"sort_array(transform(tokens, x -> {mapping}[x]))").alias("ranks")).distinct()
    found = blocks.select("q_row", "ranks", F.posexplode("ranks").alias("b_pos", "rank")).join(F.broadcast(prefixes), "rank").join(F.broadcast(wholes), "template")
    reach = F.expr("least(t_pos, b_pos) + 1 + least(size(t_ranks) - t_pos, size(ranks) - b_pos) - 1 >= need")
    found = found.where(reach).where(F.size(F.array_intersect("ranks", "t_ranks")) >= F.col("need"))
    found = found.select("q_row", "label", (F.size(F.array_intersect("ranks", "t_ranks")) / F.size("t_ranks")).alias("contained"))
    rare = {r for r, _, _ in index}
    found = found.unionByName(_windows(rows, prefixes, wholes, [t for t in vocabulary if rank[t] in rare], mapping, max(x[4] for x in whole)))
    best = found.groupBy("q_row").agg(F.collect_set("label").alias("own"), F.max("contained").alias("contained"))

    j = rows.join(best, "q_row", "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return j.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(0.0), F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    lists = ", ".join(f"({i}, '{label}', [{', '.join(repr(t) for t in sorted(token_set(text)))}])" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{name}')" for p, name in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words FROM d),
p(ws, label) AS (VALUES {phrases}),
b AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(ws)] = ws)) AS pos FROM w, p),
bd AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
t(no, label, ts) AS (VALUES {lists}),
k AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{WORD}')) AS ks FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(ks, ts)) / len(ts) AS c FROM k, t WHERE len(list_intersect(ks, ts)) >= ceil(len(ts) * {THRESHOLD}E0 - 1E-9)),
md AS (SELECT doc_id, list(DISTINCT label) AS own, max(c) AS c FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
 greatest(CASE WHEN n_base > 0 THEN 1E0 ELSE 0E0 END, coalesce(c, 0E0)) AS score
FROM w LEFT JOIN bd ON bd.doc_id = w.doc_id LEFT JOIN md ON md.doc_id = w.doc_id"""


ORACLE = _oracle()
