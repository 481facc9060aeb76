"""Source divergence audit: how far the terms of a source depart from its language and from the language's other sources."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, free
from .skew import salted_join

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms in the bytes of a text, all beyond ASCII being part of one, and what stands between them.
_TERM, _APART = re.compile(TERM.encode()), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Terms that a task counts before it tells them; bytes of a text taken apart at a time.
HELD, STRETCH = 500_000, 2**20
#: Documents of a language that a term must stand in; ranks of the terms that are given.
LEAST, TOP = 3, 200
#: Bits of a value, or of the bytes of a text, that one round of the selection looks at.
BITS = 16
#: Rows that a group may have left at its threshold for them to be put in order as they are.
SMALL = 4096

KEYS = ["lang", "source"]


def _words(said: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text, those of ``size`` bytes or little more at a time, cut where no term stands."""
    at = 0
    while at < len(said):
        edge = _APART.search(said, at + size)
        end = edge.start() if edge else len(said)
        yield _TERM.findall(said, at, end)
        at = end


def _tallied(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of rows ``lang, source, text``; what is counted goes out once it has ``most`` terms."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def told() -> Iterator[pa.RecordBatch]:
        for group, (n, docs) in held.items():
            for terms in itertools.batched(n, 2**15):
                said = pa.array(terms, pa.binary()).view(pa.string())
                keys = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in group]
                yield pa.RecordBatch.from_arrays([*keys, said, *(pa.array(list(map(c.__getitem__, terms)), pa.int64()) for c in (n, docs))], names=[*KEYS, "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
            (n, docs), seen = held[lang, source], set()
            size -= len(n)
            for words in _words(text.as_py().lower()):  # of bytes only A-Z
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n)
            if size >= most:
                yield from told()
                size = 0
    yield from told()


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term; both summed within the tasks first."""
    key = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(key(lang_col).alias("lang"), key(source_col).alias("source"), key(text_col).cast("binary").alias("text"))
    rows = rows.mapInArrow(_tallied, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*KEYS, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """``1 + floor(10**9 * (n + 1) / total)``, exact; null where the total is 0. Decimals only where a long is too small."""
    wide = f"CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)) div nullif(CAST({total} AS DECIMAL(20,0)), 0)"
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN 1000000000L * ({n} + 1) div nullif({total}, 0) ELSE {wide} END")


def _apart(p: str, q: str) -> Column:
    """``floor((p - q)**2 / q)``; shares are 10**9 + 1 at most, so the square fits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def top_ranked(rows: DataFrame, keys: list[str], value: str, tie: str, k: int, bits: int = BITS, small: int = SMALL) -> DataFrame:
    """The ``k`` rows of each group with the largest ``value``, of equal ones the smallest ``tie`` by UTF-8 bytes; and ``rank``.

    A radix selection. Every round counts a digit of ``bits`` bits of the rows still in doubt, as sums over tasks: rows
    of a greater digit than the one that holds the k-th place are in, those of a smaller one are out, and the rest go to
    the next round with what is still due. After the bits of the value come those of the text, two bytes a round. Once
    no group has over ``small`` rows in doubt they are put in order with the ones that are in, so no task ever sorts
    more than ``k + small`` rows of a group, whatever its size. ``value`` is a long of 0 or more, and no two rows of a
    group are equal in ``value`` and ``tie``. No rows give no rows.
    """
    shift = max((rows.agg(F.max(value)).first()[0] or 0).bit_length() - bits, 0)
    digit, left, at = F.shiftright(value, shift), rows.withColumn("_due", F.lit(k)), 0
    taken = None
    while True:
        counts = left.groupBy(*keys, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("n"), F.max("_due").alias("_due"))
        order = Window.partitionBy(*keys).orderBy(F.desc("_digit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_before", F.sum("n").over(order) - F.col("n")).filter("_before < _due")
        marks = cut(counts.withColumn("_open", F.expr("_before + n > _due")).withColumn("_due", F.expr("CAST(_due - _before AS INT)")).drop("_before"), "top-marks")
        met = salted_join(left.drop("_due").withColumn("_digit", digit), marks.drop("n"), [*keys, "_digit"], marks)
        met = cut(met.drop("_digit"), "top-met")
        most = marks.filter("_open").agg(F.max("n")).first()[0] or 0
        free(marks)
        ready = met if most <= small else met.filter("NOT _open")
        ready = ready.drop("_open", "_due")
        taken = ready if taken is None else taken.unionByName(ready)
        if most <= small:
            break
        left = met.filter("_open").drop("_open")
        if shift:
            width = min(bits, shift)
            shift -= width
            digit = F.shiftright(value, shift).bitwiseAND((1 << width) - 1)
        else:
            two = F.rpad(F.hex(F.substring(F.encode(tie, "UTF-8"), 2 * at + 1, 2)), 4, "0")
            digit, at = 65535 - F.conv(two, 16, 10).cast("int"), at + 1
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie)))
    return taken.withColumn("rank", rank).filter(F.col("rank") <= k)


def pair_values(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, in both directions.

    Most terms stand in neither of two sources, or in one, and then have the same share as all the others of that count.
    So the sum over all kept terms is that of a term in neither, times their number; plus corrections of the terms of
    the one and of the other, by how many have which count; plus what is still amiss for the terms in both, which meet
    by a join on the term.
    """
    groups = groups.withColumn("p0", _share("0", "total"))
    one = groups.select("lang", "source", "total", "kept", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("q_total"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").filter("source != item").withColumn("f00", _apart("p0", "q0"))
    wide = lambda c: c.cast("decimal(38,0)").alias("value")
    names = ("lang", "source", "item")
    parts = [pairs.select(*names, wide(F.coalesce(F.col("kept") * F.col("f00"), F.lit(0))))]

    counts = scored.groupBy(*KEYS, "n").agg(F.count(F.lit(1)).alias("terms"))
    own = pairs.join(counts, KEYS).withColumn("p", _share("n", "total")).withColumn("f", _apart("p", "q0"))
    parts.append(own.select(*names, wide(F.col("terms") * (F.col("f") - F.col("f00")))))
    theirs = pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("q", _share("n", "q_total")).withColumn("f", _apart("p0", "q"))
    parts.append(theirs.select(*names, wide(F.col("terms") * (F.col("f") - F.col("f00")))))

    a = scored.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    b = scored.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, ["lang", "term"]).filter("a < b")
    amiss = lambda p, p0, q, q0: _apart(p, q) - _apart(p0, q) - _apart(p, q0) + _apart(p0, q0)
    # sums go beyond a long, but those of the high and of the low 32 bits don't
    both = both.select("lang", "a", "b", amiss("p", "p0", "q", "q0").alias("ab"), amiss("q", "q0", "p", "p0").alias("ba"))
    halves = [F.sum(c).alias(name) for v in ("ab", "ba") for c, name in ((F.shiftright(v, 32), f"{v}_high"), (F.col(v).bitwiseAND(2**32 - 1), f"{v}_low"))]
    both = both.groupBy("lang", "a", "b").agg(*halves)
    both = both.select("lang", "a", "b", *[(F.col(f"{v}_high").cast("decimal(27,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col(f"{v}_low")).cast("decimal(38,0)").alias(v) for v in ("ab", "ba")])
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(v).alias("value")) for x, y, v in (("a", "b", "ab"), ("b", "a", "ba"))])
    parts.append(both.select("lang", F.explode(ways).alias("w")).select("lang", "w.*"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy(*names).agg(F.sum("value").cast("long").alias("value"))


def audit(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    small: int = SMALL,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Terms are runs of letters (and of anything beyond ASCII), A-Z in lower case; a language keeps those that stand in
    ``least`` of its documents. A group's share of a kept term is ``1 + floor(10**9 * (n + 1) / (N + V))``, of ``n``
    occurrences there among ``N`` of all ``V`` kept terms; the divergence of shares p and q is ``floor((p - q)**2 / q)``.
    ``part`` 'pair' sums it over all kept terms for every other source of the language, and ranks all; 'term' gives the
    terms that stand in the group and exceed their share in the language, up to rank ``top``. Larger values come first,
    then the smaller ``item`` by UTF-8 bytes, so no two rows tie. Whole numbers throughout.

    Null texts, languages and sources count as ''; a group without terms has pairs only, of value 0 where the language
    keeps no term. Texts are read whole, whatever their length. Rows that repeat count each, with or without an id; an
    empty table gives an empty result. Other columns are not read.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least)
    kept = cut(kept.drop("docs"), "divergence-kept")
    rows = cut(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-rows")
    free(counts)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_size"))
    sizes = rows.groupBy(*KEYS).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"))
    found = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    groups = found.join(sizes, KEYS, "left").join(langs, "lang", "left").fillna(0, ["size", "rows", "kept", "lang_size"])
    groups = cut(groups.withColumn("total", F.expr("size + kept")).withColumn("lang_total", F.expr("lang_size + kept")), "divergence-groups")

    shares = groups.select(*KEYS, "total", "lang_total", _share("0", "total").alias("p0"))
    scored = salted_join(rows, shares, KEYS, groups.select(*KEYS, F.col("rows").alias("n")))
    scored = scored.withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))
    scored = cut(scored.select(*KEYS, "term", "n", "p", "p0", "q"), "divergence-scored")
    free(rows, kept)

    pairs = pair_values(scored, groups)
    order = Window.partitionBy(*KEYS).orderBy(F.desc("value"), "item")  # a row for each source of a language
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = scored.filter("p > q").select(*KEYS, F.col("term").alias("item"), _apart("p", "q").alias("value"))
    terms = top_ranked(terms, KEYS, "value", "item", top, small=small).withColumn("part", F.lit("term"))
    names = [*KEYS, "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))
