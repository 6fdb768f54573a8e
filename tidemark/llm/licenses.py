"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are windows of consecutive words, whatever the line breaks: a template of at most c
words (c = 4, 8, 16 or 32) is looked for in windows of 2c words that begin at every c-th word,
so each passage of c + 1 words lies in one of them.  A window's tokens that occur in some
template of that c are put in one global order, rarest first by the number of documents
that hold them, counted over the whole table.  A template of n tokens is met where the
window holds at least ceil(THRESHOLD * n) of them, so

* prefix: window and template share one of their first (size - needed + 1) tokens;
* length: the window has at least as many tokens as are needed;
* position: what remains after the shared token on both sides can reach that number.

The join runs on the prefix tokens against the template table, whose size is fixed by
``TEMPLATES``, and an intersection confirms each pair.  Documents without any template's
prefix token are never cut into windows.  Everything is DataFrame operations.

``match_blocks`` reports every pair that meets the threshold.  A label is given for each
template met, but where in one window the tokens it shares lie strictly within those that
another one shares (CC BY within CC BY-NC), or are the same and the other one has fewer left.  Besides, the places of three fixed phrases are
listed (``PHRASES``).

Defined results: a null or empty text has no words, places or labels and score 0; rows are
judged by their text alone, with or without an id, repeated or not; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_PATTERN, WORD_PATTERN, ascii_lower, pieces, table

THRESHOLD = 0.9

#: Phrases and their labels.
PHRASES = {
    "cc-by": ("cc", "by"),
    "gpl": ("general", "public", "license"),
    "reserved": ("all", "rights", "reserved"),
}

#: The sentences by which public licenses are declared.
TEMPLATES = {
    "agpl-3.0": [
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "licensed under the Apache 2.0 license"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "Released under the BSD License",
        "Licensed under the BSD License",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "Licensed under the ISC License"],
    "lgpl-2.1": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ],
    "lgpl-3.0": [
        "licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "distributed under the MIT License",
    ],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "proprietary": ["All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


def span(text: str) -> int:
    """The smallest power of two from 4 on that is no less than the number of a template's words."""
    return max(4, 1 << (len(re.findall(WORD_PATTERN, text.lower())) - 1).bit_length())


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD_PATTERN, text.lower())))


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def words_of(text) -> F.Column:
    return pieces(ascii_lower(F.coalesce(text, F.lit(""))), GAP_PATTERN)


def literal(tokens) -> F.Column:
    return F.array(*[F.lit(t) for t in tokens])


def token_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The template tokens, rarest first over all documents; at most len(vocabulary) rows reach the driver."""
    seen = (
        docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), literal(vocabulary))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    n = {r.token: r.n for r in seen}
    return sorted(vocabulary, key=lambda t: (n.get(t, 0), t))


def text_key(text) -> list[F.Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def windows_of(c: int, least: int, vocabulary, first: list[str]) -> F.Column:
    """(c, least, start, tokens) of the windows of 2c words in ``w`` that hold a prefix token and tokens enough."""
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*first), i)), lambda i: i.isNotNull())
    both = lambda i: F.array(c * F.floor(i / c).cast("int"), c * F.floor(i / c).cast("int") - c)
    starts = F.filter(F.array_distinct(F.flatten(F.transform(hits, both))), lambda at: at >= 0)

    def window(at):
        some = F.transform(F.sequence(at + 1, F.least(at + 2 * c, F.size("w"))), lambda i: F.element_at("w", i))
        return F.struct(F.lit(c).alias("c"), F.lit(least).alias("least"), at.alias("start"), F.array_intersect(vocabulary, some).alias("tokens"))

    return F.filter(F.transform(starts, window), lambda x: F.size(x["tokens"]) >= x["least"])


def match_blocks(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every (document, window, template) that meets the threshold.

    doc_id, h1 and h2 (hashes of the text), first word and words of the window, label, the tokens shared and the template's size.
    """
    spark = docs.sparkSession
    known = [(label, span(t), template_tokens(t)) for label, texts in templates.items() for t in texts]
    order = token_order(docs, text_col, sorted({t for _, _, tokens in known for t in tokens}))
    rank = {t: i for i, t in enumerate(order)}
    index, windows, prefixes = [], [], set()
    for c in sorted({c for _, c, _ in known}):
        own = [(label, sorted(tokens, key=rank.__getitem__), needed(len(tokens), threshold)) for label, k, tokens in known if k == c]
        least = min(need for _, _, need in own)
        rows = [(t[i], c, i, label, t, need) for label, t, need in own for i in range(len(t) - need + 1)]
        vocabulary = literal(sorted({t for _, ts, _ in own for t in ts}, key=rank.__getitem__))
        first = sorted({r[0] for r in rows})
        index += rows
        prefixes |= {r[0] for r in rows}
        windows.append(windows_of(c, least, vocabulary, first))
    index_df = F.broadcast(  # as many rows as the fixed templates have prefix tokens
        spark.createDataFrame(index, "token string, c int, t_pos int, label string, t_tokens array<string>, need int")
    )
    text = F.col(text_col)
    blocks = (
        docs.select(F.col(id_col).alias("doc_id"), *text_key(text), words_of(text).alias("w"))
        .filter(F.arrays_overlap("w", literal(sorted(prefixes))))
        .select("doc_id", "h1", "h2", F.inline(F.concat(*windows)))
    )
    probes = blocks.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("b_pos", "token"))
    room = F.least(F.size("tokens") - F.col("b_pos"), F.size("t_tokens") - F.col("t_pos"))
    return (
        probes.join(index_df, ["token", "c"])
        .filter((F.size("tokens") >= F.col("need")) & (room >= F.col("need")))
        .withColumn("shared", F.array_intersect("tokens", "t_tokens"))
        .filter(F.size("shared") >= F.col("need"))
        .select("doc_id", "h1", "h2", "start", (2 * F.col("c")).alias("words"), "label", "shared", F.size("t_tokens").alias("size"))
        .distinct()
    )


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document row with word count, phrase places, labels and score."""
    found = match_blocks(docs, id_col=id_col, text_col=text_col, **options)
    inside = "size(array_except(x.shared, y.shared)) = 0 and (size(y.shared) > size(x.shared) or y.share > x.share)"
    within = f"filter(m, x -> not exists(m, y -> {inside}))"
    best = (
        found.drop("doc_id")
        .groupBy("h1", "h2", "start", "words")
        .agg(F.collect_set(F.struct("label", "shared", (F.size("shared") / F.col("size")).alias("share"))).alias("m"))  # the templates at most
        .select("h1", "h2", F.explode(F.expr(within)).alias("m"))
        .groupBy("h1", "h2")
        .agg(F.collect_set("m.label").alias("found"), F.max("m.share").alias("share"))
    )
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", *text_key(F.col("text")), words_of(F.col("text")).alias("w")
    )
    base = base.withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    none = F.array().cast("array<int>")
    for label, phrase in PHRASES.items():
        here = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(phrase))
        at = F.expr(f"filter(sequence(0, size(w) - {len(phrase)}), i -> {here})")
        base = base.withColumn(label, F.when(F.contains("joined", F.lit(f" {' '.join(phrase)} ")), at).otherwise(none))
    places = F.concat(*[F.col(f"`{k}`") for k in PHRASES])
    base = base.select(
        "doc_id",
        "h1",
        "h2",
        F.size("w").cast("long").alias("n_words"),
        places.alias("places"),
        F.array_compact(F.array(*[F.when(F.size(F.col(f"`{k}`")) > 0, F.lit(k)) for k in sorted(PHRASES)])).alias("base"),
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    n_base = F.size("places").cast("long")
    return base.join(best, ["h1", "h2"], "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    rows = ", ".join(
        f"('{k}', {span(v)}, ['{"', '".join(t)}'], {needed(len(t), THRESHOLD)})" for k, texts in TEMPLATES.items() for v in texts for t in [template_tokens(v)]
    )
    spans = ", ".join(f"({c})" for c in sorted({span(v) for texts in TEMPLATES.values() for v in texts}))
    places = " UNION ALL ".join(
        f"SELECT r, '{k}' AS label, i - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w) - {len(p) - 2})) AS i FROM d WHERE len(w) >= {len(p)}) WHERE "
        + " AND ".join(f"w[i + {n}] = '{t}'" for n, t in enumerate(p))
        for k, p in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS v(label, c, tokens, need)),
l AS (SELECT r, c, i, list_distinct(w[i * c + 1:i * c + 2 * c]) AS w FROM (SELECT r, w, c, unnest(range((len(w) - 1) // c + 1)) AS i FROM d, (VALUES {spans}) AS s(c) WHERE len(w) > 0)),
m AS (SELECT r, l.c, i, label, list_intersect(w, tokens) AS shared, len(list_intersect(w, tokens)) / len(tokens) AS share FROM l JOIN t ON l.c = t.c WHERE len(list_intersect(w, tokens)) >= need),
f AS (SELECT r, label, share FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.r = m.r AND o.c = m.c AND o.i = m.i AND list_has_all(o.shared, m.shared) AND (len(o.shared) > len(m.shared) OR o.share > m.share))),
p AS ({places}),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM f) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM f GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r LEFT JOIN s ON s.r = d.r
"""


OP6_SQL = _sql()
