"""Long runs of one character through every operator, and lines of rows that share an id or have none."""

from __future__ import annotations

import re
import time

import corpus_pipeline
import pytest
from claimforge.llm import exact_dedup, language, licences, line_dedup, mixing, ngram_join, packing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOX = "the quick brown fox jumps over the lazy dog again today"
OWN = "some entirely other line which is unique here and only here"
BREAD = "winter bread and copper kettles were sold at noon"


def spelled(text: str) -> set[str]:
    """Letters set apart, by trying every start and every end."""
    out = set()
    for m in re.finditer(r"(?<!\S)(?:[^\W_][\s.*_-]+){3,}[^\W_](?!\S)", text):
        out.add(re.sub(r"\W|_", "", m[0]))
    return out


@pytest.mark.parametrize("text", ["s t u p i d", "s.t.u.p.i d now", "x a b c d.e", "a b c", "a. b. c. d. e", "_ _ _ _", "a_b_c_d and w-o-r-d, f u n n y", "a b c d\n\ne f g h!", "1 2 3 4 5x", "a b c d.e f.g hh"])
def test_spelled_words(text):
    assert toxicity.text_words(text) == set(text.split()) | spelled(text)


@pytest.mark.parametrize("unit", ["_", "a ", "a. ", "a_", ". ", "- _", "a_. ", "é ", "1"])
def test_spelled_words_in_linear_time(unit):
    began = time.perf_counter()
    toxicity.text_words("Name: " + unit * (10**6 // len(unit)) + ".!")
    assert time.perf_counter() - began < 10


LONG = ["_", "a ", "1", "-", "x.", "@", "a@", "1.", "+1 ", "\n", "a\n", "the mit "]
OPERATORS = {
    "exact": exact_dedup.exact_dedup,
    "pack": packing.pack,
    "lines": line_dedup.drop_lines,
    "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))),
    "pii": pii.detect,
    "mix": mixing.mix,
    "language": lambda d: language.identify(d, language.profiles(d)),
    "licences": licences.scan,
    "ngram": ngram_join.ngram_join,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_long_runs(spark, name):
    """Texts of up to a million characters that repeat a short unit; line dedup takes 100,000, in lines of 2000."""
    size = 10**5 if name == "lines" else 10**6
    rows = [(i, (u * (size // len(u)))[: size if name != "lines" else 2000] + "!", "en", "s", size) for i, u in enumerate(LONG)]
    out = OPERATORS[name](spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["doc_id"] for r in out} == set(range(len(LONG)))


def stays(rows: list[tuple]) -> list[tuple]:
    """Brute force for lines that are equal or unlike: of equal lines the one of the first document stays."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    kept: dict[tuple, str] = {}
    seen: set[str] = set()
    for d in docs:
        lines = [x for x in d[1].split("\n") if not x.strip() or not (x.strip(" ") in seen or seen.add(x.strip(" ")))]
        kept[d] = "\n".join(lines)
    out = [(r[0], kept[r[0], r[1]]) for r in rows if r[1] is not None]
    return sorted(((i, t) for i, t in out if t.strip()), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(0, FOX), (1, OWN), (1, FOX)],
        [(None, FOX), (None, OWN + "\n" + FOX), (3, BREAD + "\n" + OWN), (None, FOX + "\n\n" + BREAD)],
        [(2, f"{FOX}\n{OWN}\n{FOX}\n{BREAD}\n{OWN}"), (2, f"{BREAD}\nshort\nend"), (7, "end\nend\nother end of it")],
    ],
)
def test_no_line_goes_by_the_number_of_another_row(spark, rows):
    full = [(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(spark.createDataFrame(full, SCHEMA)).collect()), key=str)
    held = {x.strip() for _, t in got for x in t.split("\n")} - {""}
    assert held == {x.strip() for _, t in rows for x in t.split("\n")} - {""}, "every line stays somewhere"
    if all(i is not None for i, _ in rows) and len({i for i, _ in rows}) == len(rows):
        assert got == stays(rows)
    assert sum(x.strip() != "" for _, t in got for x in t.split("\n")) == len(held), "and once only"


def test_lines_against_brute_force_with_own_ids(spark):
    rows = [(k, "\n".join([FOX, OWN, BREAD][a] for a in lines)) for k, lines in enumerate([(0, 1), (1, 2, 2), (0,), (2, 0)])]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)).collect()), key=str)
    assert got == stays(rows)


def test_stages_with_shared_and_null_ids(spark):
    """All stages but the last over rows of which no text has a copy: each of them comes through."""
    rows = [(1, FOX), (1, OWN), (None, BREAD), (None, "a fourth text that says nothing of what the others say to us")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == sorted((str(i), t) for i, t in rows), name
