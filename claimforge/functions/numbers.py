"""Patent numbers: one canonical form from many ways of writing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once, strip

# Japanese document types with their kind, and eras with the year before their first.
DOCUMENT_TYPES = (("特開", "publication", "A"), ("公開特許公報", "publication", "A"), ("特表", "publication", "A"), ("特公", "grant", "B"), ("特許", "grant", "B"))
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018, "明": 1867, "大": 1911, "昭": 1925, "平": 1988, "令": 2018}
ERA_LETTERS = {"M": 1867, "T": 1911, "S": 1925, "H": 1988, "R": 2018}
# Confidences.
SURE, ELEVEN, EP_SURE, WO_SURE, PLAIN, EP_PLAIN, ERA, ODD, LOST, BROKEN = 0.95, 0.9, 0.92, 0.88, 0.85, 0.8, 0.7, 0.5, 0.4, 0.3
# Notes.
NOTES = {
    "empty": "empty input",
    "lost": "no office prefix; jurisdiction cannot be determined from the number alone",
    "US": "US prefix but no digits",
    "EP": "EP prefix but no digits",
    "WO": "WO/PCT prefix but no digits",
    "JP": "JP prefix but could not parse a number",
    "us_kind": "kind code assumed A1 for 11-digit US publication",
    "wo_kind": "kind code assumed A1 for WO publication",
    "serial": "Japanese grant/registration serial: no year is encoded in the number; mapping to a publication requires a lookup, not string logic",
}
REVIEW_BELOW = 0.85

_DASH = r"[\-‐−]"
_KIND = r"(?s)^(.*\d[\s\-‐−]*?)[\s\-‐−]*([A-Z]\d?)\s*$"
_NAMED = rf"({'|'.join(ERAS)})\s*(\d{{1,2}}){_DASH}?(\d{{3,}})"
_LETTERED = rf"(?<![A-Z])([{''.join(ERA_LETTERS)}])\s*(\d{{1,2}}){_DASH}(\d{{3,}})"
_WEST = rf"((?:19|20)\d{{2}}){_DASH}?(\d{{3,}})"


def _note(when: Column, text: Column | str) -> Column:
    return F.when(when, F.lit(text) if isinstance(text, str) else text)


def _case(*pairs: tuple[Column, Column | str | float], otherwise: Column | str | float | None = None) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for when, value in reversed(pairs):
        out = F.when(when, value).otherwise(out)
    return out


def _bound(state: Column, names: tuple[str, ...], steps: list[Callable[[Column], dict[str, Column]]]) -> Column:
    """``state``, a struct of ``names``, after the steps, each of which adds fields made from those before it. Every step
    is bound to a lambda's variable, so what it names is worked out once and the expression grows by the step only,
    wherever filters on the result are pushed to."""
    if not steps:
        return state

    def step(v: Column) -> Column:
        more = steps[0](v)
        fields = [v[n].alias(n) for n in names if n not in more] + [c.alias(n) for n, c in more.items()]
        return _bound(F.struct(*fields), tuple(n for n in names if n not in more) + tuple(more), steps[1:])

    return F.transform(F.array(state), step)[0]


def _office(v: Column) -> dict[str, Column]:
    latin = lambda p: F.startswith(v["up"], F.lit(p))
    japanese = v["s"].rlike(r"[぀-ヿ一-鿿]")
    route = _case(
        (v["s"] == "", "empty"), (japanese, "JP"), (latin("US"), "US"), (latin("EP"), "EP"), (latin("WO"), "WO"), (latin("PCT"), "PCT"), (latin("JP"), "JP"),
        otherwise="lost",
    )
    return {"japanese": japanese, "route": route}


def _after_office(v: Column) -> dict[str, Column]:
    up = v["up"]
    behind = lambda k: F.substring(up, F.lit(k), F.length(up))
    return {"text": _case((v["japanese"], v["s"]), (v["route"] == "PCT", behind(4)), (v["route"].isin("lost", "empty"), up), otherwise=behind(3))}


def _document_type(v: Column) -> dict[str, Column]:
    found = F.regexp_extract(v["text"], f"^({'|'.join(p for p, _, _ in DOCUMENT_TYPES)})", 1)
    return {"type": F.when(v["route"] == "JP", found).otherwise("")}


def _body(v: Column) -> dict[str, Column]:
    rest = F.substring(v["text"], F.length(v["type"]) + 1, F.length(v["text"]))
    return {"body": F.when(v["route"] == "JP", F.regexp_replace(strip(rest), r"(?U)^[：:]+\s*", "")).otherwise(rest)}


def _kind_code(v: Column) -> dict[str, Column]:
    found = F.nullif(F.regexp_extract(F.upper(v["body"]), _KIND, 2), F.lit(""))
    return {"found": F.when(v["route"].isin("lost", "empty"), None).otherwise(found)}


def _head(v: Column) -> dict[str, Column]:
    return {"head": F.when(v["found"].isNotNull(), F.regexp_extract(F.upper(v["body"]), _KIND, 1)).otherwise(v["body"])}


def _digits(v: Column) -> dict[str, Column]:
    return {"n": F.regexp_replace(v["head"], r"[^0-9]", "")}


def _form(v: Column) -> dict[str, Column]:
    """Of Japanese numbers: whether the year is an era's, a western one or none."""
    head = v["head"]
    form = _case((head.rlike(_NAMED), "named"), (head.rlike(_LETTERED), "lettered"), (head.rlike(_WEST), "west"), (v["n"] != "", "serial"), otherwise="none")
    return {"form": F.when(v["route"] == "JP", form).otherwise("")}


def _year_parts(v: Column) -> dict[str, Column]:
    head, form = v["head"], v["form"]
    part = lambda k: _case((form == "named", F.regexp_extract(head, _NAMED, k)), (form == "lettered", F.regexp_extract(head, _LETTERED, k)))
    return {"era": part(1), "year": part(2), "serial": F.when(form == "west", F.regexp_extract(head, _WEST, 2)).otherwise(part(3))}


def _western(v: Column) -> dict[str, Column]:
    years = F.create_map(*[F.lit(x) for pair in {**ERAS, **ERA_LETTERS}.items() for x in pair])
    of_era = (F.try_element_at(years, v["era"]) + v["year"].try_cast("int")).cast("string")
    return {"western": F.when(v["form"] == "west", F.regexp_extract(v["head"], _WEST, 1)).otherwise(of_era)}


def _parts(v: Column) -> dict[str, Column]:
    found, form = v["found"], v["form"]
    filled = F.when(F.length(v["serial"]) < 6, F.lpad(v["serial"], 6, "0")).otherwise(v["serial"])
    named = _case(*[(v["type"] == p, t) for p, t, _ in DOCUMENT_TYPES])
    by_kind = F.when(found.isNotNull() & (v["route"] == "JP"), F.when(F.startswith(found, F.lit("B")), "grant").otherwise("publication"))
    return {
        "dated": form.isin("named", "lettered", "west"),
        "broken": v["route"].isin("US", "EP", "WO", "PCT") & (v["n"] == ""),
        "number": _case((form.isin("named", "lettered", "west"), F.concat(v["western"], filled)), (form == "none", ""), otherwise=v["n"]),
        "typed": F.coalesce(named, by_kind),
        "own": F.coalesce(found, _case(*[(v["type"] == p, k) for p, _, k in DOCUMENT_TYPES])),
    }


def _judged(v: Column) -> dict[str, Column]:
    route, found, n, form, broken, typed, own = (v[c] for c in ("route", "found", "n", "form", "broken", "typed", "own"))
    is_ = lambda *routes: route.isin(*routes)
    size, serial_type = F.length(n), F.coalesce(typed, F.lit("grant"))
    grown = size.between(6, 8)
    kind = _case(
        (broken | is_("lost", "empty"), found),
        (is_("US") & (size == 11) | is_("WO"), F.coalesce(found, F.lit("A1"))),
        (v["dated"], F.coalesce(own, F.lit("A"))),
        (form == "serial", F.coalesce(own, F.when(serial_type == "grant", "B").otherwise("A"))),
        (form == "none", own),
        otherwise=found,
    )
    doc_type = _case(
        (broken | is_("lost", "empty"), "unknown"),
        (is_("US"), _case((size == 11, "publication"), (grown, "grant"), otherwise="unknown")),
        (is_("EP"), _case((F.startswith(found, F.lit("B")), "grant"), (F.startswith(found, F.lit("A")), "publication"), otherwise="unknown")),
        (is_("WO"), "publication"),
        (is_("PCT"), "application"),
        (v["dated"], F.coalesce(typed, F.lit("publication"))),
        (form == "serial", serial_type),
        otherwise=F.coalesce(typed, F.lit("unknown")),
    )
    confidence = _case(
        (is_("empty"), 0.0),
        (is_("lost"), LOST),
        (broken | (form == "none"), BROKEN),
        (is_("US"), _case((size == 11, ELEVEN), (grown & found.isNotNull(), SURE), (grown, PLAIN), otherwise=ODD)),
        (is_("EP"), _case(((size == 7) & found.isNotNull(), EP_SURE), otherwise=EP_PLAIN)),
        (is_("WO", "PCT"), WO_SURE),
        (form == "west", PLAIN),
        otherwise=ERA,
    )
    era = F.concat(F.lit("Japanese era '"), v["era"], v["year"], F.lit("' converted to Western year "), v["western"], F.lit("; exact DOCDB string may differ — verify on retrieval"))
    notes = F.array_compact(F.array(
        _note(is_("empty"), NOTES["empty"]),
        _note(is_("lost"), NOTES["lost"]),
        *[_note(broken & is_(*routes), NOTES[routes[0]]) for routes in (("US",), ("EP",), ("WO", "PCT"))],
        _note(is_("US") & (size == 11) & found.isNull(), NOTES["us_kind"]),
        _note(is_("US") & ~broken & (size != 11) & ~grown, F.concat(F.lit("unexpected US number length ("), size.cast("string"), F.lit(" digits)"))),
        _note(is_("EP") & ~broken & (size != 7), F.concat(F.lit("EP publication numbers are typically 7 digits (got "), size.cast("string"), F.lit(")"))),
        _note(is_("WO") & ~broken & found.isNull(), NOTES["wo_kind"]),
        _note(form.isin("named", "lettered"), era),
        _note(form == "serial", NOTES["serial"]),
        _note(form == "none", NOTES["JP"]),
    ))
    return {
        "office": _case((is_("empty", "lost"), "UNKNOWN"), (is_("PCT"), "WO"), otherwise=route),
        "number": F.when(broken, "").otherwise(v["number"]),
        "kind": kind.cast("string"),
        "doc_type": doc_type,
        "confidence": confidence.cast("double"),
        "notes": notes.cast("array<string>"),
    }


def _canonical(v: Column) -> dict[str, Column]:
    whole = F.concat_ws("-", v["office"], v["number"], v["kind"])
    bare = _case((v["route"].isin("empty", "lost"), v["number"]), (v["broken"] | (v["form"] == "none"), F.concat(v["office"], F.lit("-"))), otherwise=whole)
    return {"canonical": bare}


_STEPS = [_office, _after_office, _document_type, _body, _kind_code, _head, _digits, _form, _year_parts, _western, _parts, _judged, _canonical]


def normalised(raw: Column) -> Column:
    """The canonical number as a struct with, among others, office, number, kind, doc_type, canonical, confidence, notes.

    Never fails: what can't be read has office UNKNOWN or a low confidence, and a note that says why. Null counts as
    empty.
    """
    s = strip(F.coalesce(raw, F.lit("")))
    return _bound(F.struct(s.alias("s"), F.upper(s).alias("up")), ("s", "up"), _STEPS)


def normalise(numbers: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``numbers`` with ``office, number, kind, doc_type, canonical, confidence, notes`` and ``needs_review``."""
    shown = ("office", "number", "kind", "doc_type", "canonical", "confidence", "notes")
    out = once(numbers, _n=normalised(F.col(raw_col))).select(*numbers.columns, *[F.col(f"_n.{c}").alias(c) for c in shown])
    return out.withColumn("needs_review", needs_review(F.col("confidence"), F.col("office")))


def needs_review(confidence: Column, office: Column) -> Column:
    return (confidence < REVIEW_BELOW) | (office == "UNKNOWN")
