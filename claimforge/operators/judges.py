"""Judging claim elements against a specification: two channels, their fusion, and what a verdict must satisfy."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import met, once, sentences, stem, tokens

# Thresholds of the judges and of the fusion.
MATCH_SHARE, MATCH_TOKENS, SPAN = 0.6, 2, 200
LENIENT_SHARE, PART = 0.40, 4
LEAST_CONFIDENCE = 0.3
COVERED, GAP, AGREEMENT = 0.60, 0.30, 0.60


def specifications(texts: DataFrame) -> DataFrame:
    """``texts`` (with ``spec``) with each text's tokens, their stems, and its sentences with their tokens."""
    parts = F.transform(sentences(F.col("spec")), lambda s: F.struct(s.alias("text"), tokens(s).alias("tokens")))
    own = texts.withColumns({"spec_tokens": tokens(F.col("spec")), "spec_sentences": parts})
    own = own.withColumn("spec_stems", F.array_distinct(F.transform("spec_tokens", stem)))
    return own.withColumn("spec_near", near_stems(F.col("spec_stems")))


def specification(spark: SparkSession, text: str) -> DataFrame:
    """One row: the text and what ``specifications`` says of it, all worked out once."""
    return specifications(spark.createDataFrame([(text,)], "spec string"))


def verdict(label: Column, span: Column, confidence: Column) -> Column:
    """The verdict constraint: a match needs a span and some confidence, a miss has none; all else is unclear and for review."""
    none = F.lit(None).cast("string")
    span = F.coalesce(F.nullif(span, F.lit("")), none)
    kept = (
        F.when((label == "MATCH") & span.isNull(), "UNCLEAR")
        .when((label == "MATCH") & (confidence < LEAST_CONFIDENCE), "UNCLEAR")
        .when((label == "MISSING") & span.isNotNull(), "UNCLEAR")
        .otherwise(label)
    )
    return F.struct(kept.alias("verdict"), span.alias("span"), confidence.cast("double").alias("confidence"), (kept == "UNCLEAR").alias("needs_review"))


def best_sentence(matched: Column, parts: Column) -> Column:
    """The sentence with most of the matched tokens, the first of equals, cut to a span; null without any."""
    rated = F.transform(parts, lambda p, i: F.struct(F.size(F.array_intersect(p["tokens"], matched)).alias("n"), (-i).alias("i"), F.substring(p["text"], 1, SPAN).alias("text")))
    top = F.array_max(rated)
    return F.when(top["n"] > 0, top["text"])


def strict(element: Column, matched: Column, span: Column) -> Column:
    """Exact token overlap, from the element's tokens, those matched, and the best sentence for them."""
    n, size = F.size(matched), F.size(element)
    share = n / F.nullif(size, F.lit(0))
    label = F.when(size == 0, "UNCLEAR").when(n == 0, "MISSING").when((share >= MATCH_SHARE) & (n >= MATCH_TOKENS), "MATCH").otherwise("UNCLEAR")
    confidence = F.when(size == 0, 0.0).when(n == 0, 1.0).otherwise(share)
    return verdict(label, F.when(n > 0, span), confidence)


def near_stems(stems: Column) -> Column:
    """``struct<said, pattern>`` of the stems with ``PART`` characters: all of them with blanks between, which no stem
    has, and a pattern that finds any of them; it finds nothing without any."""
    long = F.filter(stems, lambda s: F.length(s) >= PART)
    pattern = F.when(F.size(long) == 0, "(?!)").otherwise(F.array_join(F.transform(long, lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E"))), "|"))
    return F.struct(F.array_join(long, " ").alias("said"), pattern.alias("pattern"))


def lenient_matches(element: Column, stems: Column, near: Column | None = None) -> Column:
    """Tokens whose stem is a stem of the specification, or contains one or is contained, from four characters on.

    ``near`` is ``near_stems`` of the stems, if known: a stem is then held against all of them at once.
    """
    near = near_stems(stems) if near is None else near

    def met(e: Column) -> Column:
        own = e["stem"]
        inside = F.contains(near["said"], own) | (F.regexp_instr(own, near["pattern"]) > 0)
        return F.array_contains(stems, own) | ((F.length(own) >= PART) & inside)

    stemmed = F.transform(element, lambda t: F.struct(t.alias("token"), stem(t).alias("stem")))
    return F.filter(stemmed, met)["token"]


def _grams(word: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (PART - 1)), lambda i: F.substring(word, i, F.lit(PART))))


def stem_matches(own: DataFrame, other: DataFrame) -> DataFrame:
    """``own, other`` for the stems (a column of that name each) that match leniently: equal ones, and of those with
    ``PART`` characters one that the other contains.

    What a stem contains has its first ``PART`` characters among the stem's own stretches of that length, so the two
    meet by equality there and are held against each other after. Only distinct stems meet, never texts.
    """
    own, other = own.select("own").distinct(), other.select("other").distinct()
    found = own.join(other, F.col("own") == F.col("other"))
    for short, long, a, b in (("own", "other", own, other), ("other", "own", other, own)):
        starts = a.filter(F.length(short) >= PART).withColumn("_g", F.substring(short, 1, PART))
        held = b.filter(F.length(long) >= PART).withColumn("_g", F.explode(_grams(long)))
        found = found.unionByName(starts.join(held, "_g").filter(F.contains(long, F.col(short))).select("own", "other"))
    return found.distinct()


def lenient_over(elements: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """``element, key, n_terms, n_matched`` for every distinct element and every specification (``key, spec``) of which
    it leniently meets the share of terms that a match takes.

    Specifications are as many as they are and none is broadcast: stems match stems once for all of them, then each
    stem of an element meets the specifications that have a match for it, and terms are counted. Elements without
    terms meet nothing; null specifications have no stems.
    """
    terms = elements.select("element").distinct().withColumn("_t", tokens(F.col("element")))
    terms = terms.select("element", F.size("_t").cast("long").alias("n_terms"), F.explode("_t").alias("_term")).withColumn("own", stem(F.col("_term")))
    said = specs.select(key, F.explode(tokens(F.col("spec"))).alias("_term")).select(key, stem(F.col("_term")).alias("other")).distinct()
    meets = stem_matches(terms, said).join(said, "other").select("own", key).distinct()
    counts = terms.join(meets, "own").groupBy("element", key, "n_terms").agg(F.count(F.lit(1)).alias("n_matched"))
    return counts.filter(F.col("n_matched") / F.col("n_terms") >= LENIENT_SHARE)


def lenient(element: Column, matched: Column, span: Column) -> Column:
    """Stem overlap, for recall; its span comes from surface tokens only, so a match by stems alone becomes unclear."""
    n, size = F.size(matched), F.size(element)
    share = n / F.nullif(size, F.lit(0))
    label = F.when(size == 0, "UNCLEAR").when(n == 0, "MISSING").when(share >= LENIENT_SHARE, "MATCH").otherwise("UNCLEAR")
    confidence = F.when(size == 0, 0.0).when(n == 0, 1.0).otherwise(share)
    return verdict(label, F.when(n > 0, span), confidence)


CHANNELS = {"strict": strict, "recall": lenient}


def coerce(label: Column, confidence: Column, span: Column, spec: Column) -> Column:
    """An outside judge's answer: unknown labels are unclear, confidences 0 to 1, spans literal parts of the specification."""
    up = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    label = F.when(up.isin("MATCH", "MISSING", "UNCLEAR"), up).otherwise("UNCLEAR")
    number = F.coalesce(confidence.try_cast("double"), F.lit(0.0))
    number = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(number), 0.0).otherwise(number)))
    literal = F.when((F.length(span) > 0) & F.contains(spec, span), span)
    number = F.when((label == "MISSING") & (F.coalesce(span, F.lit("")) == ""), 1.0).otherwise(number)
    return verdict(label, F.when(label != "MISSING", literal), number)


def judged_by(elements: DataFrame, spec: str, answer: Callable[[pd.Series, str], pd.DataFrame]) -> DataFrame:
    """``elements`` with the coerced verdicts of an outside judge.

    ``answer`` gets a batch of elements, nulls included, and the specification; it returns as many rows of
    ``label, confidence, span``, all strings or null. What it says is never trusted: see ``coerce``.
    """

    @F.pandas_udf("label string, confidence string, span string")
    def ask(said: pd.Series) -> pd.DataFrame:
        return answer(said, spec)

    rows = elements.withColumn("_said", ask("element"))
    rows = rows.withColumn("_v", coerce(F.col("_said.label"), F.col("_said.confidence"), F.col("_said.span"), F.lit(spec)))
    return rows.select(*elements.columns, "_v.*")


def rationale(element: Column, found: dict[str, Column]) -> Column:
    """What the channels' verdicts rest on: how many of the element's terms each found, and which, in order."""
    size = F.size(element).cast("string")
    said = lambda name, terms: F.concat(F.lit(f"{name}: "), F.size(terms).cast("string"), F.lit(" of "), size, F.lit(" terms"), F.when(F.size(terms) > 0, F.concat(F.lit(" ("), F.array_join(F.array_sort(terms), ", "), F.lit(")"))).otherwise(""))
    return F.when(F.size(element) == 0, "no terms to look for").otherwise(F.concat_ws("; ", *[said(name, terms) for name, terms in found.items()]))


def only_one(spec: DataFrame) -> DataFrame:
    """A specification's row; more than one is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # two rows at most
    told = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one specification"))).otherwise(F.lit(True))
    return spec.limit(2).withColumn("_n", n).filter(told.cast("boolean")).drop("_n")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``element`` and what a specification has) with ``element_tokens``, both verdicts and their rationale."""
    rows = once(rows, element_tokens=tokens(F.col("element")))
    exact = F.array_intersect("element_tokens", "spec_tokens")
    rows = once(rows, _strict=exact, _recall=lenient_matches(F.col("element_tokens"), F.col("spec_stems"), F.col("spec_near")))
    rows = once(rows, _strict_span=best_sentence(F.col("_strict"), F.col("spec_sentences")), _recall_span=best_sentence(F.array_intersect("_recall", "spec_tokens"), F.col("spec_sentences")))
    verdicts = {name: make(F.col("element_tokens"), F.col(f"_{name}"), F.col(f"_{name}_span")) for name, make in CHANNELS.items()}
    return once(rows, **verdicts, rationale=rationale(F.col("element_tokens"), {name: F.col(f"_{name}") for name in CHANNELS}))


def judge(elements: DataFrame, spec: DataFrame, key: str | None = None, told: Callable[[DataFrame], DataFrame] = lambda texts: texts) -> DataFrame:
    """``elements`` (with ``element``) with both channels' verdicts and their rationale; the specification is one row, or
    with ``key`` that of the element's key.

    With one specification an element's text settles its verdicts, so each distinct text is judged once and its rows get
    what was found by an equality join. A null element is judged as an empty one. ``told`` makes of the judged texts
    (``element`` and what was found) what their rows get, and so does its work once a text too.
    """
    shown = ("element_tokens", "spec_tokens", *CHANNELS, "rationale")
    if key:
        return told(_judged(elements.join(spec, key)).select(*elements.columns, *shown))
    rows = elements.withColumn("_element", F.coalesce("element", F.lit("")))
    texts = rows.select(F.col("_element").alias("element")).distinct()
    found = told(_judged(texts.crossJoin(F.broadcast(only_one(spec)))).select("element", *shown)).withColumnRenamed("element", "_element")
    return rows.join(met(found), "_element").select(*elements.columns, *[c for c in found.columns if c != "_element"])


def by_worksheet(judged: DataFrame, filled: DataFrame, spec: DataFrame) -> DataFrame:
    """``judged`` with the verdicts of a filled worksheet (``canonical, element, verdict, evidence_span, confidence``) as
    its recall channel, looked up by record and by the element without white space around it.

    A row without a canonical number counts for that element of every record that has no row of its own. What isn't
    filled in is unclear and for review, and what is goes through ``coerce``, as the answers of every outside judge do.
    A worksheet may hold a row only once; of repeated rows the readers keep the last.
    """
    said = filled.filter(F.trim(F.coalesce("verdict", F.lit(""))) != "")
    payload = F.struct("verdict", F.col("confidence").cast("string").alias("confidence"), F.col("evidence_span").alias("span"))
    own = said.filter("canonical IS NOT NULL").select("canonical", F.trim("element").alias("_e"), payload.alias("_own"))
    any_of = said.filter("canonical IS NULL").select(F.trim("element").alias("_e"), payload.alias("_any"))
    rows = judged.withColumn("_e", F.trim("element")).join(own, ["canonical", "_e"], "left").join(any_of, "_e", "left")
    rows = rows.withColumn("_a", F.coalesce("_own", "_any")).crossJoin(F.broadcast(only_one(spec).select(F.col("spec").alias("_spec"))))
    answer = F.when(F.col("_a").isNull(), verdict(F.lit("UNCLEAR"), F.lit(None).cast("string"), F.lit(0.0))).otherwise(coerce(F.col("_a.verdict"), F.col("_a.confidence"), F.col("_a.span"), F.col("_spec")))
    terms = F.coalesce(F.regexp_extract("rationale", "^(.*); recall: ", 1), F.lit(""))
    told = F.concat(F.when(terms != "", F.concat(terms, F.lit("; "))).otherwise(""), F.when(F.col("_a").isNull(), "worksheet: not filled in").otherwise("worksheet: filled in"))
    return rows.withColumns({"recall": answer, "rationale": told}).select(*judged.columns)


def coverage(one: Column) -> Column:
    return F.when(one["verdict"] == "MISSING", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), one["confidence"])))


def channels() -> Column:
    """Coverage by channel of fused elements, names in order."""
    return F.create_map(*[x for name in sorted(CHANNELS) for x in (F.lit(name), F.col(f"p_{name}"))])


def fuse(judged: DataFrame) -> DataFrame:
    """Element coverage from both channels: mean, agreement, span, band, review flag and the terms both texts have."""
    a, b = coverage(F.col("strict")), coverage(F.col("recall"))
    p, agreement = (a + b) / 2, 1 - (F.greatest(a, b) - F.least(a, b))
    rows = judged.withColumns({"p_strict": a, "p_recall": b, "p_coverage": p, "confidence": agreement, "span": F.coalesce("strict.span", "recall.span")})
    band = F.when(F.col("p_coverage") >= COVERED, F.when(F.col("span").isNull(), "partial").otherwise("covered")).when(F.col("p_coverage") < GAP, "gap").otherwise("partial")
    rows = rows.withColumn("band", band)
    return rows.withColumn("needs_review", (F.col("band") == "partial") | (F.col("confidence") < AGREEMENT)).withColumn(
        "matched_terms", F.array_sort(F.array_intersect("element_tokens", "spec_tokens"))
    )


def judge_fused(elements: DataFrame, spec: DataFrame, **more: Column) -> DataFrame:
    """``fuse`` of what ``judge`` finds and more columns of what an element and it tell, worked out once a text."""
    return judge(elements, spec, told=lambda texts: fuse(texts).withColumns(more) if more else fuse(texts))
