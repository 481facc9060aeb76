"""Licence scan by a positional index of rare words."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


# The phrases that must always be found.
BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
#: With them, sentences of well-known licences, of our own choice, and the key phrase that each must hold.
TEMPLATES = (
    *BASE,
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "the apache license"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "used to endorse or promote products"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "free software foundation either version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
)
#: Anchors of a template: the words of its key phrase with the highest IDF; the share of its IDF that must stand in place.
ANCHORS, SHARE = 2, 0.7


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    # Of all other letters two become A-Z ones in lower case: these are put out of the way first.
    lowered = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9")))
    plain = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """IDF of every word of the templates over all documents; the driver gets one number per template word."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    rows = docs.select(words(F.col(text_col)).alias("w")).select(F.array_intersect("w", F.array(*map(F.lit, vocabulary))).alias("w"))
    # One row holds the number of documents, as the word "".
    seen = rows.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in seen}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def key_place(template: Template) -> int:
    """Where the key phrase first stands in the template, in words."""
    own, key = template.text.split(), template.key.split()
    return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


def anchors(template: Template, weights: dict[str, float]) -> list[tuple[str, int]]:
    """The distinct words of the key phrase with the highest IDF, and their places in the template.

    The key phrase has to stand whole, so its words are in place wherever the template is found: no start is missed for
    a word that the file has changed elsewhere, and the share of IDF alone decides on those."""
    at, key = key_place(template), template.key.split()
    return sorted({w: at + key.index(w) for w in key}.items(), key=lambda x: (-weights[x[0]], x[1]))[:ANCHORS]


def postings(tokens: Column, rare: list[str]) -> Column:
    """``array<struct<w, i>>``: the text's words that are an anchor of some template, and their places. One pass over the
    words and one set look-up each, however many templates there are."""
    there = F.transform(tokens, lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i"))))
    return F.filter(there, lambda x: x.isNotNull())


def _starts(found: Column, template: Template, weights: dict[str, float]) -> Column:
    """Places where the template would start if its anchors stand where it has them: their postings, shifted by their
    place in the template, intersected."""

    def shifted(word: str, at: int) -> Column:
        return F.transform(F.filter(found, lambda x: x["w"] == word), lambda x: x["i"] - at)

    starts, *others = [shifted(word, at) for word, at in anchors(template, weights)]
    for other in others:
        starts = F.array_intersect(starts, other)
    return starts


def _in_place(tokens: Column, start: Column, own: list[str], at: int = 0) -> list[Column]:
    return [F.coalesce(F.get(tokens, start + at + j) == w, F.lit(False)) for j, w in enumerate(own)]


def _verified(tokens: Column, found: Column, template: Template, weights: dict[str, float], share: float) -> Column:
    """``array<struct<start, score>>`` of the starts whose key phrase stands whole and whose words in place hold ``share`` of the IDF."""
    own, key = template.text.split(), template.key.split()
    at = key_place(template)
    whole = sum(weights[w] for w in own)

    def judged(start: Column) -> Column:
        score = sum((hit.cast("double") * weights[w] for hit, w in zip(_in_place(tokens, start, own), own, strict=True)), F.lit(0.0))
        ok = F.lit(True)
        for hit in _in_place(tokens, start, key, at):
            ok = ok & hit
        return F.struct(start.alias("start"), F.when(ok, F.least(F.lit(1.0), score / whole)).otherwise(0.0).alias("score"))

    return F.filter(F.transform(_starts(found, template, weights), judged), lambda x: x["score"] >= share)


def scan(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    templates: tuple[Template, ...] = TEMPLATES,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Reads the whole text in one narrow pass, no shuffle; of texts of any length only the places of anchors are kept.
    ``labels`` also has those of the licence sentences that stand with ``share`` of their IDF in place and their key
    phrase whole; ``score`` is the best share of a verified template. Null and empty texts have no words, no places
    (``first_word`` and ``last_word`` null), empty labels and score 0. Repeated rows are scanned each; an empty table
    gives an empty result. Other columns are not read.
    """
    weights = idf(docs, templates, text_col) if weights is None else weights
    rare = sorted({w for t in templates for w, _ in anchors(t, weights)})
    names = [f"_t{i}" for i in range(len(templates))]
    none = F.array().cast("array<struct<start:int,score:double>>")

    def judged(w: Column, found: Column) -> Column:
        verified = [F.when(F.size(found) > 0, _verified(w, found, t, weights, share)) for t in templates]
        return F.struct(F.size(w).cast("long").alias("n_words"), *[F.coalesce(v, none).alias(n) for n, v in zip(names, verified, strict=True)])

    # The lambdas hold the words and the postings, so each is made once for all templates.
    each = lambda w: F.transform(F.array(postings(w, rare)), lambda found: judged(w, found))[0]
    out = docs.select(F.col(id_col).alias("_id"), F.transform(F.array(words(F.col(text_col))), each)[0].alias("_r")).select("_id", "_r.*")
    base = [n for n, t in zip(names, templates, strict=True) if t.base]
    places = F.concat(*[F.filter(n, lambda x: x["score"] > 1 - 1e-9)["start"] for n in base])

    def joined(chosen: list[str]) -> Column:
        labels = [F.when(F.size(n) > 0, F.lit(t.label)) for n, t in zip(names, templates, strict=True) if n in chosen]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    best = F.greatest(*[F.coalesce(F.array_max(F.col(n)["score"]), F.lit(0.0)) for n in names])
    return out.withColumn("_places", places).select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(names).alias("labels"),
        best.alias("score"),
    )
