"""License scans by an exact set-similarity join of text blocks and licence templates.

A text is taken as words; a block is a run of ``2 * width`` words that starts at a multiple of ``width``, the width of a template being
the power of two at or above its number of words, so every place of a template's length lies inside one block. A block
meets a template when it holds at least ``THRESHOLD`` of the template's distinct words. Words are ordered by the number of documents of the whole
corpus that hold them, rarest first, and three filters, none of which loses a match, precede the count:

* prefix: a template of n words that needs k of them shares one of its first n - k + 1 words with every block that meets it;
* length: the block holds k words of the templates at least;
* position: one shared word plus the words that follow it on the shorter side must reach k.

All of it is DataFrame expressions. The index of template prefixes is as large as the templates, whatever the corpus, and is broadcast;
blocks of different documents never meet. Besides, the words of fixed phrases are found where they stand in a row.

Edge cases. Null or empty text: no words, no place, score 0. Rows with a null or repeated key are kept: matches come back by key and digest of
the text, so equal rows get equal results. A hot key is spread by the digest. Ties of frequency go by the word. Case is
folded for A-Z only. Input columns that share a name with an output column are replaced, all others pass through in one struct, so
no name can clash. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.common import without

THRESHOLD = 0.8
#: fixed values: the word pattern, the base phrases and their labels
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.lower().split()

    @property
    def width(self) -> int:
        return 1 << max(2, (len(self.words) - 1).bit_length())

    @property
    def need(self) -> int:
        return ceil(THRESHOLD * len(set(self.words)) - 1e-9)


#: public licence notices, their sentences as words
TEMPLATES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                    "to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                    "conditions are met"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                    "published by the free software foundation"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("disclaimer", "the software is provided as is without warranty of any kind express or implied"),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    # the two letters outside ASCII whose lower case holds an ASCII letter become others outside ASCII
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def token_order(parsed: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """Template words, those in the fewest documents of the corpus first. ``parsed`` has ``_words``; one row per template word comes back."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = parsed.select(F.explode(F.array_intersect(_literal(vocabulary), "_words")).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(spark, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """(token, template, label, width, place, size, need, tokens): the prefix of each template in corpus order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, t in enumerate(templates):
        tokens = sorted(set(t.words), key=rank.__getitem__)
        rows += [(tokens[p], i, t.label, t.width, p, len(tokens), t.need, tokens) for p in range(len(tokens) - t.need + 1)]
    return spark.createDataFrame(rows, "token string, template int, label string, width int, place int, size int, need int, tokens array<string>")


def _blocks(parsed: DataFrame, templates: tuple[Template, ...], order: list[str], keys: list[str]) -> DataFrame:
    """(keys, width, start, n_words, held): blocks of the widths of the templates; ``held`` are their template words in corpus order."""
    least: dict[int, int] = {}
    for t in templates:
        least[t.width] = min(least.get(t.width, t.need), t.need)
    widths = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(k).alias("least")) for w, k in sorted(least.items())])).alias("c")
    n = F.size("_words")
    starts = F.sequence(F.lit(0), F.greatest(n - F.col("c.width") - 1, F.lit(0)), F.col("c.width"))
    cut = (parsed.select(*keys, "_words", widths).select(*keys, "c", "_words", F.explode(starts).alias("start"))
           .select(*keys, "c", "start", F.slice("_words", F.col("start") + 1, 2 * F.col("c.width")).alias("_words")))
    held = cut.select(*keys, "c", "start", F.size("_words").alias("n_words"), F.array_intersect(_literal(order), "_words").alias("held"))
    return held.where(F.size("held") >= F.col("c.least")).select(*keys, "c.width", "c.least", "start", "n_words", "held")


def similar_blocks(parsed: DataFrame, templates: tuple[Template, ...], keys: list[str]) -> DataFrame:
    """(keys, start, n_words, template, label, containment) of every block that meets a template. ``parsed`` has ``_words``."""
    order = token_order(parsed, templates)
    index = prefix_index(parsed.sparkSession, templates, order)
    heads = sorted({w for t in templates for w in sorted(set(t.words), key=order.index)[:len(set(t.words)) - t.need + 1]})
    blocks = _blocks(parsed.where(F.arrays_overlap("_words", _literal(heads))), templates, order, keys)
    # a block's own prefix: words so late that fewer than the least need remain cannot be the first shared one
    prefix = F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)
    tokens = blocks.select(*keys, "width", "start", "n_words", "held", F.posexplode(prefix).alias("at", "token"))
    reach = 1 + F.least(F.size("held") - F.col("at") - 1, F.col("size") - F.col("place") - 1)
    met = tokens.join(F.broadcast(index), ["token", "width"]).where(reach >= F.col("need"))
    shared = F.size(F.array_intersect("held", "tokens"))
    found = met.where(shared >= F.col("need")).withColumn("containment", shared / F.col("size"))
    return found.select(*keys, "start", "n_words", "template", "label", "containment").distinct()


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])
    likely = reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in parts])
    return F.when(likely, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``blocks``, an array of the blocks that
    meet a template (start, n_words, template, label, containment). The score is 1 at a base phrase, else the largest containment, else 0."""
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
    rows = without(docs, *added)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    parsed = rows.select("row", "key", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), words_of(F.col("text")).alias("_words"))
    blocks = similar_blocks(parsed.drop("row"), templates, ["key", "digest"])
    block = F.struct("start", "n_words", "template", "label", "containment")
    per_text = blocks.groupBy("key", "digest").agg(F.array_sort(F.collect_list(block)).alias("blocks")).withColumnsRenamed({"key": "_key", "digest": "_digest"})
    places = [_places(F.col("_words"), phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(BASE)]
    based = parsed.select("row", "key", "digest", F.size("_words").cast("long").alias("n_words"), *places)
    all_places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    based = based.select("row", "key", "digest", "n_words", F.size(all_places).cast("long").alias("n_base"),
                         F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
                         F.array_sort(named).alias("base_labels"))
    both = based.join(per_text, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    found = F.coalesce("blocks", F.array().cast(per_text.schema["blocks"].dataType))
    labels = F.array_sort(F.array_union("base_labels", F.transform(found, lambda b: b["label"])))
    best = F.coalesce(F.array_max(F.transform(found, lambda b: b["containment"])), F.lit(0.0))
    return both.select("row.*", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), found.alias("blocks"))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = scan(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), TEMPLATES, key, text)
    return out.select(key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("blocks").cast("long").alias("n_blocks"))


def oracle(name: str = "documents") -> str:
    """The summary as DuckDB SQL: every block against every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join(f"({i}, '{t.label}', {t.width}, {t.need}, {len(set(t.words))}, {sorted(set(t.words))})" for i, t in enumerate(TEMPLATES))
    parts = []
    for phrase, label in BASE:
        here = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1))
        parts.append(f"list_transform(list_filter(range(len(w)), lambda i: {here}), lambda i: {{'i': i, 'label': '{label}'}})")
    return f"""
    WITH t(template, label, width, need, size, tokens) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM {name}),
    b AS (SELECT k, width, unnest(range(0, greatest(len(w) - width, 1), width)) AS start, w FROM d, (SELECT DISTINCT width FROM t)),
    s AS (SELECT k, width, start, list_distinct(w[start + 1:start + 2 * width]) AS held FROM b),
    m AS (SELECT k, label, len(list_intersect(held, tokens)) AS shared, need, size FROM s JOIN t USING (width)),
    g AS (SELECT k, list(DISTINCT label) AS labels, max(shared / size) AS best, count(*) AS n_blocks FROM m WHERE shared >= need GROUP BY k),
    p AS (SELECT *, list_concat({parts[0]}, list_concat({parts[1]}, {parts[2]})) AS p FROM d),
    a AS (SELECT p.*, list_distinct(list_transform(p, lambda x: x.label)) AS base, list_transform(p, lambda x: x.i) AS places FROM p)
    SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
           array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
           CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
    FROM a LEFT JOIN g USING (k)"""
