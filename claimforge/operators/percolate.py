"""Many saved searches over arriving publications in one pass: an automaton of all their terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import Brief, _day

#: Characters of terms in one automaton; more briefs than that go in further passes.
LIMIT = 4_000_000
#: Parts that the hits of a brief are cut to its limit in, before they come together.
PARTS = 64

# Marks of the fields in the one text that is scanned: each value of a field stands after its mark, and a term with the
# mark before it is found at the start of a value only.
_TEXT, _CLAIM, _NAME, _CODE, _END = "\x02", "\x03", "\x04", "\x05", "\x06"


def requirements(brief: Brief) -> list[list[tuple[str, str]]]:
    """What a brief asks of texts: each a list of ``(field, term)`` of which one must be found. Every brief has one."""
    out = [[(f, t.strip().lower()) for t in group for f in (_TEXT, _CLAIM)[: 1 + brief.search_claims]] for group in brief.keywords]
    if brief.cpc:
        out.append([(_CODE, p.upper()) for p in brief.cpc])
    if brief.assignees:
        out.append([(_NAME, n.strip().lower()) for n in brief.assignees])
    return out


def chunks(briefs: list[Brief], limit: int = LIMIT) -> list[list[int]]:
    """The numbers of the briefs, cut so that the terms of each part, or of its one brief, are within ``limit``."""
    out, held = [[]], 0
    for i, brief in enumerate(briefs):
        size = sum(len(t) for need in requirements(brief) for _, t in need)
        if out[-1] and held + size > limit:
            out.append([])
            held = 0
        out[-1].append(i)
        held += size
    return [part for part in out if part]


class Percolator:
    """An automaton over the terms of some briefs, and which requirements each term meets. Built once a worker."""

    def __init__(self, briefs: dict[int, Brief]):
        import ahocorasick

        self.needs = {i: len(requirements(b)) for i, b in briefs.items()}
        places: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, brief in briefs.items():
            for k, need in enumerate(requirements(brief)):
                for key in need:
                    places.setdefault(key, []).append((i, k))
        self.automaton = ahocorasick.Automaton()
        words: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for (field, term), met in places.items():
            # A class is a prefix of the code, so it is looked for with the mark of a code before it.
            words.setdefault(field + term if field == _CODE else term, {})[field] = met
        for word, fields in words.items():
            self.automaton.add_word(word, (word, fields))
        self.automaton.make_automaton()

    def briefs(self, text: str) -> list[int]:
        """The briefs of which each requirement is met by ``text``, its fields and values after their marks."""
        marks = [(i, c) for i, c in enumerate(text) if _TEXT <= c <= _END]
        met, at, field = set(), 0, _END
        seen = set()
        for end, (word, fields) in self.automaton.iter(text):
            while at < len(marks) and marks[at][0] <= end:
                field, at = marks[at][1], at + 1
            if (field, word) not in seen:
                seen.add((field, word))
                met.update(fields.get(field, ()))
        count: dict[int, int] = {}
        for i, _ in met:
            count[i] = count.get(i, 0) + 1
        return sorted(i for i, n in count.items() if n == self.needs[i])


def _scanned(claims: bool) -> Column:
    """A publication's fields as one text, in lower case where the search looks so."""

    def values(mark: str, found: Column) -> Column:
        plain = F.transform(found, lambda v: F.concat(F.lit(mark), F.translate(F.coalesce(v, F.lit("")), _TEXT + _CLAIM + _NAME + _CODE + _END, "     ")))
        return F.array_join(F.coalesce(plain, F.array().cast("array<string>")), "")

    texts = [values(_TEXT, F.transform(c, lambda x: F.lower(x["text"]))) for c in ("title_localized", "abstract_localized")]
    if claims:
        texts.append(values(_CLAIM, F.transform("claims_localized", lambda x: F.lower(x["text"]))))
    names = values(_NAME, F.transform("assignee_harmonized", lambda x: F.lower(x["name"])))
    codes = values(_CODE, F.transform("cpc", lambda x: x["code"]))
    return F.concat(*texts, names, codes)


def _finder(held: Broadcast):
    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Percolator(held.value)
        for texts in batches:
            yield texts.map(own.briefs)

    return found


def percolate(rows: DataFrame, briefs: list[Brief], limit: int = LIMIT, key: str = "publication_number") -> DataFrame:
    """``brief, key`` for every brief (by its number in the list) and every row that ``search`` finds for it.

    One pass over the rows serves all briefs of a part (see ``chunks``): the automaton finds all their terms in time
    linear in the texts, and only briefs whose every group of terms is met leave the tasks. The terms are broadcast, a
    part at a time, so their size is bounded; conditions on country and date are columns. Of a brief with more rows than
    its limit, those of the smallest keys count, cut in parts first, so no task ever sorts all rows of a brief.
    """
    spark = rows.sparkSession
    if not briefs:
        return rows.select(F.lit(0).alias("brief"), key).limit(0)
    text, out = _scanned(any(b.search_claims for b in briefs)), None
    for part in chunks(briefs, limit):
        found = _finder(spark.sparkContext.broadcast({i: briefs[i] for i in part}))
        met = rows.select(key, "country_code", "publication_date", F.explode(found(text)).alias("brief"))
        out = met if out is None else out.unionByName(met)
    asked = [(i, [c.upper() for c in b.countries], _day(b.date_from) if b.date_from else None, _day(b.date_to) if b.date_to else None, b.limit) for i, b in enumerate(briefs)]
    asked = spark.createDataFrame(asked, "brief int, countries array<string>, day_from long, day_to long, most int")
    own = (F.size("countries") == 0) | F.array_contains("countries", F.col("country_code"))
    since = F.col("day_from").isNull() | (F.col("publication_date") >= F.col("day_from"))
    until = F.col("day_to").isNull() | (F.col("publication_date") <= F.col("day_to"))
    hits = out.join(asked, "brief").filter(own & since & until).select("brief", key, "most")
    first = Window.partitionBy("brief", "_part").orderBy(key)
    hits = hits.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_k", F.row_number().over(first)).filter("_k <= most")
    hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("brief").orderBy(key))).filter("_k <= most")
    return hits.select("brief", key)
