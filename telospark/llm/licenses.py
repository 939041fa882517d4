"""License scans by an exact set-similarity join; DataFrame functions only.

A template is a licence notice; a text block is a window of consecutive words, twice as long as the
template's stride (the power of two at or above its number of words) and starting at each multiple
of it, so that a notice that stands in a text lies whole in some block. A block matches when it
holds at least `threshold` of the template's distinct words.

The join is exact and filters as set-similarity joins do. Words are ordered by their count in the
corpus, rarest first. A matching block must hold one of the first |T| - need + 1 words of a template
(prefix filter), so only blocks around those rare words are looked at. A block's words of the
vocabulary of all templates, in the same order, must be at least `need` (length filter), and behind
the shared word both sides must still have enough left (positional filter). What is left is
verified on the full sets. Fixed phrases are found in the same join: each is anchored at its rarest
word and then compared word by word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import small_enough, table

#: What separates words, after A-Z have become a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A notice. In one document, templates of a family compete: only those with its greatest
    containment, and of these the ones with most words, give their labels."""

    label: str
    family: str
    text: str


#: Notices as their licences recommend them, shortened to what names the licence.
TEMPLATES = (
    Template("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd-2", "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"),
    Template("bsd-3", "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("gpl-2", "gnu", "this work is licensed under the gnu general public license version 2"),
    Template("gpl-3", "gnu", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("gpl-3", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("lgpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version of the license or at your option any later version"),
    Template("agpl-3", "gnu", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("mpl-2", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("cc-by", "cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "cc", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "cc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc0", "cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("zlib", "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)

#: At most so many templates and phrases; with their words they bound what is broadcast.
MAX_TEMPLATES = 5_000


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lowered, null as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def stride_of(n_words: int) -> int:
    return 1 << max(0, n_words - 1).bit_length()


def _vocabulary(words: DataFrame, tokens: set[str]) -> dict[str, int]:
    """Words of templates and phrases with their counts in the corpus; the tokens bound its size."""
    spark = words.sparkSession
    known = F.broadcast(spark.createDataFrame([(t,) for t in sorted(tokens)], "token string"))
    found = words.select(F.explode_outer("__telo_words").alias("token")).join(known, "token").groupBy("token").count()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in found.collect()}


def _anchors(spark, count: dict[str, int], templates, phrases, threshold: float) -> tuple[DataFrame, list[str]]:
    """One row per prefix word of a template and one per phrase, for a broadcast; and the vocabulary
    of the templates in the global order."""
    rank = {t: i for i, t in enumerate(sorted(count, key=lambda t: (count[t], t)))}
    rows = []
    for k, t in enumerate(templates):
        own = sorted(set(t.text.split()), key=rank.get)
        need = -(-len(own) * round(threshold * 1_000_000) // 1_000_000)
        stride = stride_of(len(t.text.split()))
        rows += [(w, k, t.label, t.family, i, need, stride, own) for i, w in enumerate(own[: len(own) - need + 1])]
    for k, (phrase, label) in enumerate(phrases.items()):
        own = phrase.split()
        at = min(range(len(own)), key=lambda i: (rank[own[i]], i))
        rows.append((own[at], -1 - k, label, None, at, len(own), None, own))
    schema = "token string, template int, label string, family string, at int, need int, stride int, own array<string>"
    vocabulary = sorted({w for t in templates for w in t.text.split()}, key=rank.get)
    return spark.createDataFrame(rows, schema), vocabulary


def matches(docs: DataFrame, words: str, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """docs without `words` (an array of words), one row per place of a phrase (template below 0, place its
    first word) and per block and template that match, or several equal rows of the latter. New
    columns: template, label, family, place (first word of the block), n_own (distinct words of the
    template), containment."""
    if len(templates) + len(phrases) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates and phrases")
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rest = [c for c in docs.columns if c != words]
    docs = docs.withColumnRenamed(words, "__telo_words")
    count = _vocabulary(docs, {w for t in templates for w in t.text.split()} | {w for p in phrases for w in p.split()})
    anchors, vocabulary = _anchors(docs.sparkSession, count, templates, phrases, threshold)
    # outer: else the optimiser would add a filter on the size, and split each text twice
    places = docs.select(*rest, "__telo_words", F.posexplode_outer("__telo_words").alias("__telo_pos", "token"))
    hits = places.join(F.broadcast(anchors), "token")
    # a phrase starts before its anchor; a template's blocks are the two over the anchor
    top = F.floor(F.col("__telo_pos") / F.col("stride")).cast("int")
    starts = F.when(F.col("template") < 0, F.array(F.col("__telo_pos") - F.col("at"))).otherwise(F.array(top * F.col("stride"), (top - 1) * F.col("stride")))
    hits = hits.withColumn("place", F.explode(starts)).where("place >= 0")
    size = F.when(F.col("template") < 0, F.col("need")).otherwise(2 * F.col("stride"))
    hits = hits.withColumn("__telo_block", F.slice("__telo_words", F.col("place") + 1, size)).drop("__telo_words")
    # of a block, the words of the vocabulary in the global order
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.expr("cast(array() as array<string>)")
    hits = hits.withColumn("__telo_own", F.when(F.col("template") >= 0, F.array_intersect(known, "__telo_block")))
    behind = F.size("__telo_own") - F.array_position("__telo_own", F.col("token")).cast("int")
    long_enough = F.size("__telo_own") >= F.col("need")
    enough_left = 1 + F.least(F.size("own") - F.col("at") - 1, behind) >= F.col("need")
    hits = hits.where(F.when(F.col("template") < 0, F.col("__telo_block") == F.col("own")).otherwise(long_enough & enough_left))
    common = F.when(F.col("template") < 0, F.size("own")).otherwise(F.size(F.array_intersect("own", "__telo_own")))
    hits = hits.withColumn("__telo_n", common).where("__telo_n >= need")
    return hits.select(*rest, "template", "label", "family", "place", F.size("own").alias("n_own"), (F.col("__telo_n") / F.size("own")).alias("containment"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """df with n_words, n_base (places of phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels and labels (distinct, sorted, comma-joined; the latter
    with those of the templates) and score: 1 with a phrase, else the greatest containment of a
    matching block, else 0.

    Null texts count as empty and have no labels. A result depends on the text alone, so repeated
    rows and null keys do no harm. Extra columns pass through; new ones replace columns of their
    names. An empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))), 256)
    rows = df.withColumn("__telo_key", digest)
    found = table(matches(rows.select("__telo_key", words_of(F.col(text)).alias("__telo_w")), "__telo_w", templates, phrases, threshold), "license-matches")
    # templates of a family compete within a document; at most one row a template meets in a window
    best = found.where("template >= 0").groupBy("__telo_key", "template", "label", "family").agg(F.max(F.struct("containment", "n_own")).alias("fit"))
    most = F.max("fit").over(Window.partitionBy("__telo_key", "family"))
    best = best.withColumn("most", most).where("fit = most").groupBy("__telo_key").agg(F.collect_set("label").alias("more"), F.max("fit.containment").alias("containment"))
    base = found.where("template < 0").distinct().groupBy("__telo_key").agg(
        F.count("*").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"), F.collect_set("label").alias("base")
    )
    per_text = table(base.join(best, "__telo_key", "full"), "license-texts")
    none = F.expr("cast(array() as array<string>)")
    new = {
        "n_words": F.size("__telo_words").cast("long"),
        "n_base": F.coalesce("__telo_hit.n_base", F.lit(0)).cast("long"),
        "first_word": F.col("__telo_hit.first_word"),
        "last_word": F.col("__telo_hit.last_word"),
        "base_labels": F.array_join(F.array_sort(F.coalesce("__telo_hit.base", none)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(F.coalesce("__telo_hit.base", none), F.coalesce("__telo_hit.more", none))), ","),
        "score": F.when(F.col("__telo_hit.n_base") > 0, 1.0).otherwise(F.coalesce("__telo_hit.containment", F.lit(0.0))),
    }
    hit = small_enough(per_text.select("__telo_key", F.struct("n_base", "first_word", "last_word", "base", "more", "containment").alias("__telo_hit")))
    out = rows.withColumn("__telo_words", words_of(F.col(text))).join(hit, "__telo_key", "left")
    keep = [c for c in df.columns if c not in new]
    return out.select(*keep, *(c.alias(n) for n, c in new.items()))
