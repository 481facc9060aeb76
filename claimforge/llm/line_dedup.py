"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact verification, components by union and find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .partners import completion, linked, ordered, prefixes
from .scratch import cut, free
from .skew import salted_join

#: Characters of a shingle; least length of a line compared by such shingles; similarity of near copies.
WIDTH, LEAST, SIMILAR = 10, 24, 0.8
#: Characters of a shingle where one of the two lines is shorter than that.
NARROW = 4
#: Bands and rows of a signature: a pair at the least similarity meets in some band with probability 0.997.
BANDS, ROWS = 8, 3
#: Least filled buckets of a signature, below which a band with a single filled bucket is a key too.
FILLED = 14
#: A bucket's least value is under so many times its mean but for one in e**5.
LOW = 5


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line, k1, k2`` of every line, null text having none; the keys are two hashes of the trimmed line."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    line = F.trim("line")
    return rows.select("id", "line_no", line.alias("line"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2"))


def _shingles(line: str, width: int) -> Column:
    """Hashes of the shingles of a line, with repeats. Four bytes to a character make each a slice of the bytes; the
    outer lambda holds them, so a line is coded once."""
    places = lambda b: F.sequence(F.lit(1), F.length(b) - 4 * width + 1, F.lit(4))
    slices = lambda b: F.transform(places(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * width))))
    hashes = F.transform(F.array(F.encode(F.col(line), "UTF-32")), slices)[0]
    return F.when(F.length(line) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def spread_shingles(lines: DataFrame, width: int, *keys: str) -> DataFrame:
    """``keys, h``: a row for the hash of every shingle of ``line``, with repeats. Rows of numbers, in generated code."""
    coded = lines.filter(F.length("line") >= width).select(*keys, F.encode("line", "UTF-32").alias("coded"), (F.length("line") - width).alias("last"))
    places = coded.select(*keys, "coded", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    return places.select(*keys, F.xxhash64(F.substring("coded", 4 * F.col("at") + 1, F.lit(4 * width))).alias("h"))


def bands(lines: DataFrame, width: int, kind: int = 0) -> DataFrame:
    """``k1, k2, tokens``: the band keys of each line's one-permutation MinHash.

    The high bits of a shingle's hash name its bucket, the low ones are its value, and each bucket's least value is a
    plain minimum over the rows of the line's shingles, so copies of a line fall together within their tasks. Values over
    ``LOW`` times the mean of a bucket's least one aren't looked at; a bucket with no other counts as empty, as it mostly
    does in near copies too. Bands without a shingle say nothing, and those with one say little, so they are keys of very
    short lines only.
    """
    buckets = BANDS * ROWS
    h = F.col("h")
    part = F.shiftright((F.shiftright(h, 40) + 2**23) * buckets, 24).cast("int")
    value = h.bitwiseAND(2**30 - 1)
    low = value * F.col("size") < LOW * buckets * 2**30
    lines = lines.select("line", "k1", "k2", F.length("line").alias("size"))
    rows = spread_shingles(lines, width, "k1", "k2", "size").filter(low).select("k1", "k2", part.alias("part"), value.cast("int").alias("value"))
    # a row touches only the minimum that its filter lets through
    signed = rows.groupBy("k1", "k2").agg(*[F.expr(f"min(value) FILTER (WHERE part = {j})").alias(f"m{j}") for j in range(buckets)])
    own = [[F.col(f"m{b * ROWS + r}") for r in range(ROWS)] for b in range(BANDS)]
    filled = lambda columns: sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    few = filled([c for o in own for c in o]) < FILLED
    keys = [F.when((filled(o) > 1) | ((filled(o) == 1) & few), F.xxhash64(F.lit(kind * BANDS + b), *[F.coalesce(c, F.lit(-1)) for c in o])) for b, o in enumerate(own)]
    return signed.select("k1", "k2", F.array_compact(F.array(*keys)).alias("tokens"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int, similar: float, least: int = LEAST, narrow: int = NARROW) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``similar`` at least, computed exactly:
    ``narrow`` shingles if one of the lines is shorter than ``least``. A ``b`` of very many pairs is dealt to many tasks."""
    short = F.least(F.length("la"), F.length("lb")) < least
    sets = lambda line: F.when(short, _shingles(line, narrow)).otherwise(_shingles(line, width))
    a = texts.select(F.col("rep").alias("a"), F.col("line").alias("la"))
    b = texts.select(F.col("rep").alias("b"), F.col("line").alias("lb"))
    both = salted_join(pairs.join(a, "a"), b, ["b"], pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    # sets come from a generator, so the filter stays behind it and doesn't spell them out again wherever it names them
    both = both.select("a", "b", F.inline(F.array(F.struct(sets("la").alias("sa"), sets("lb").alias("sb")))))
    return both.filter(F.size(F.array_intersect("sa", "sb")) >= similar * F.size(F.array_union("sa", "sb"))).select("a", "b")


def fuzzy_lines(
    docs: DataFrame,
    width: int = WIDTH,
    least: int = LEAST,
    similar: float = SIMILAR,
    id_col: str = "doc_id",
    text_col: str = "text",
    narrow: int = NARROW,
) -> DataFrame:
    """One row per line: ``id_col, line_no, keep_id, keep_line, group_lines, kept``.

    Lines (parted by ``\\n``, trimmed of spaces) of ``least`` characters or more are near copies when the Jaccard
    similarity of their sets of ``width``-character shingles is ``similar`` or more; of each component the line with
    the smallest id and number stays, and the rest go. Where one of two lines is shorter, their ``narrow`` shingles are
    compared; lines without any of those have exact copies only. Blank lines are not compared and stay. Equal lines
    are one class from the start, so a line in a third of all documents costs one row per task. Null texts have no
    lines; an empty text has one blank line. Rows with an equal id are lines of one document told apart by number only:
    equal rows then keep their lines twice. An empty table gives an empty result. Other columns are not read.
    """
    everything = lines_of(docs, id_col, text_col)
    visible, least = F.col("line").rlike(r"\S"), max(least, width)
    lines = everything.filter(visible)
    classes = lines.groupBy("k1", "k2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "lines-classes")
    # A line shorter than ``least`` has so few narrow shingles that a longer one with more than ``most`` can't be similar;
    # the start of a line has no more of them than the whole.
    most = int((least - narrow) / similar + 1e-9)
    few = lambda line: F.size(F.array_distinct(_shingles(line, narrow))) <= most
    start = F.substring("line", 1, most + narrow + 3)
    brief = lines.withColumn("start", start).filter(F.when(F.length("line") < least, F.length("line") >= narrow).otherwise(few("start") & few("line")))
    signed = bands(lines.filter(F.length("line") >= least), width).unionByName(bands(brief.select("line", "k1", "k2"), narrow, 1))
    signed = cut(signed.join(classes.select("k1", "k2", "rep", "n"), ["k1", "k2"]).select("rep", F.col("n").alias("core"), "tokens"), "lines-bands")
    tokens = signed.select("rep", "core", F.explode("tokens").alias("token"))
    shared = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lines-shared")
    postings = salted_join(tokens, shared.select("token"), ["token"], shared)
    postings = cut(postings.select("token", "rep", "core", F.lit(0).alias("about")), "lines-postings")
    free(signed, shared)

    place = F.xxhash64("id", "line_no").alias("place")
    met = postings.select("rep").distinct().join(classes, "rep").select("rep", "k1", "k2", F.xxhash64("first.id", "first.line_no").alias("place"))
    texts = lines.select("k1", "k2", place, "line").join(met, ["k1", "k2", "place"]).dropDuplicates(["k1", "k2", "place"])
    texts = cut(texts.select("rep", "line"), "lines-texts")
    verify = lambda pairs: similar_pairs(pairs, texts, width, similar, least, narrow)
    links, left = linked(postings, verify)
    if left is not None:
        # One table for both kinds of shingles: a rep's low bit tells the kind.
        percent, rest = int(100 * similar), texts.join(left, "rep")
        sets = lambda kind, w: F.struct(F.lit(kind).alias("kind"), F.array_distinct(_shingles("line", w)).alias("h"))
        brief = (F.length("line") < least) | few("line")
        kinds = F.array_compact(F.array(F.when(F.length("line") >= least, sets(0, width)), F.when(brief, sets(1, narrow))))
        spread = rest.select("rep", "component", F.explode(kinds).alias("of"))
        spread = spread.select((2 * F.col("rep") + F.col("of.kind")).alias("rep"), "component", F.size("of.h").alias("n"), "of.kind", F.explode("of.h").alias("h"))
        spread = cut(spread.select("rep", "component", "n", F.xxhash64("h", "kind").alias("token")), "lines-left")
        prefix = prefixes(ordered(spread, percent), percent).select("token", "rep", "component", "n", "rest")
        pairs = completion(cut(prefix, "lines-prefix"), percent)
        pairs = cut(pairs.select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b")).distinct(), "lines-pairs")
        links = links.unionByName(cut(verify(pairs), "lines-links"))
    found = components(links).withColumnRenamed("id", "rep")
    whole = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component_id", "rep"))
    whole = whole.select("k1", "k2", "first", "n", "component")
    kept = whole.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("group_lines"))
    fate = cut(whole.select("k1", "k2", "n", "component").join(kept, "component").select("k1", "k2", "n", "keep", "group_lines"), "lines-fate")
    judged = everything.select("id", "line_no", "k1", "k2", visible.alias("visible"))
    out = salted_join(judged.filter("visible"), fate.drop("n"), ["k1", "k2"], fate).select("id", "line_no", "keep", "group_lines")
    blank = judged.filter("NOT visible").select("id", "line_no", F.struct("id", "line_no").alias("keep"), F.lit(1).cast("long").alias("group_lines"))
    return out.unionByName(blank).select(
        F.col("id").alias(id_col),
        "line_no",
        F.col("keep.id").alias("keep_id"),
        F.col("keep.line_no").alias("keep_line"),
        "group_lines",
        (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("line_no") == F.col("keep.line_no"))).alias("kept"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` less those whose numbers stand in ``gone``: the stretches between, so each line is met once."""
    ends = lambda x: F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(x)))
    stretch = lambda x: F.transform(
        F.arrays_zip(F.slice(ends(x), 1, F.size(gone) + 1).alias("a"), F.slice(ends(x), 2, F.size(gone) + 1).alias("b")),
        lambda e: F.slice(x, e["a"] + 2, e["b"] - e["a"] - 1),
    )
    # The outer lambda holds the lines, so that the text is split once.
    return F.transform(F.array(lines), lambda x: F.flatten(stretch(x)))[0]


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, texts without the lines that go; a document left without visible text goes.

    A document is what its id and its text say: rows of one id (or of none) with unlike texts are documents of their
    own, so no line goes by the number of another row's. Rows equal in both share one fate. Of like lines the one of the
    smallest id stays, a null id being the smallest, then of the text with the smallest hash. Null texts pass.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), text_col).alias("h2"))
    gone = fuzzy_lines(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **how)
    gone = gone.filter("NOT kept").groupBy("_key").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.select(F.col("_key.id").alias("_id"), F.col("_key.h1").alias("_h1"), F.col("_key.h2").alias("_h2"), "_gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    same = F.col("_key.id").eqNullSafe(F.col("_id")) & (F.col("_key.h1") == F.col("_h1")) & (F.col("_key.h2") == F.col("_h2"))
    out = rows.join(gone, same, "left")
    text = F.col("_row").getField(text_col)
    left = F.array_join(_without(F.split(text, "\n", -1), F.col("_gone")), "\n")
    out = out.withColumn("_left", F.when(F.col("_gone").isNull(), text).otherwise(left))
    out = out.filter(F.col("_gone").isNull() | F.col("_left").rlike(r"\S"))
    return out.select(*[F.col("_left").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
