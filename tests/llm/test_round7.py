"""Work that was done more often than once, and is no more."""

from __future__ import annotations

import struct

from claimforge.llm import divergence, line_dedup, packing
from pyspark.sql import functions as F


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_of_a_pair_are_made_once(spark):
    texts = spark.createDataFrame([(1, "one line of some thirty characters"), (2, "one line of some thirty character"), (3, "another line of that many letters")], "rep long, line string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    found = line_dedup.similar_pairs(pairs, texts, 10, 0.8)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    assert optimized(found).count("encode(") <= 4  # two widths of two lines


def test_signatures_take_the_least_value_of_each_bucket(spark):
    lines = [f"line {i} of a text that says {'x' * (i % 40)} and {i * i} more" for i in range(60)] + ["kurz", "é日本 Ünïcode " * 5]
    table = line_dedup.lines_of(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text")
    signed = line_dedup.bands(table, 10)
    buckets, rows = line_dedup.BANDS * line_dedup.ROWS, line_dedup.spread_shingles(table.withColumn("size", F.length("line")), 10, "k1", "k2", "size")
    least: dict = {}
    for r in rows.collect():
        part, value = (((r["h"] >> 40) + 2**23) * buckets) >> 24, r["h"] & (2**30 - 1)
        if value * r["size"] < line_dedup.LOW * buckets * 2**30:
            own = least.setdefault((r["k1"], r["k2"]), {})
            own[part] = min(own.get(part, value), value)
    want = {}
    for key, own in least.items():
        few, tokens = len(own) < line_dedup.FILLED, []
        for b in range(line_dedup.BANDS):
            of = [own.get(b * line_dedup.ROWS + r) for r in range(line_dedup.ROWS)]
            filled = sum(x is not None for x in of)
            if filled > 1 or (filled == 1 and few):
                tokens.append((b, tuple(-1 if x is None else x for x in of)))
        want[key] = tokens
    made = sorted({t for ts in want.values() for t in ts})
    schema = ", ".join(["b int", *(f"m{r} int" for r in range(line_dedup.ROWS))])
    hashed = spark.createDataFrame([(b, *m) for b, m in made], schema).select("*", F.xxhash64("b", *[f"m{r}" for r in range(line_dedup.ROWS)]).alias("t")).collect()
    code = {(r[0], tuple(r[1:-1])): r["t"] for r in hashed}
    assert {(r["k1"], r["k2"]): list(r["tokens"]) for r in signed.collect()} == {k: [code[t] for t in ts] for k, ts in want.items()}


def test_known_chunks_are_looked_up_once_and_short_texts_learnt_together():
    encoder = packing.Encoder(None)
    texts = ["Some words, and some more words", "", "é 日本 <|x|>  ", "word " * 90_000, " ".join(encoder.added) + " and more", "Some words again\n\tand some"]
    calls, plain = [], encoder._encoded
    encoder._encoded = lambda said: calls.append(said) or plain(said)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    unpacked = lambda said: list(struct.unpack(f"<{len(said) // 4}I", said))
    assert [unpacked(ids) for ids in encoder.encode_each(texts)] == want
    assert len(calls) <= 5  # the first three together, the long one, the added one, the last one
    calls.clear()
    assert [unpacked(ids) for ids in encoder.encode_each(t for t in texts)] == want
    assert len(calls) == 1  # only the text with an added token
    encoder.held = packing.REMEMBERED + 1
    assert unpacked(next(encoder.encode_each(["Never seen beforehand, words"]))) == encoder.tokenizer.encode("Never seen beforehand, words", add_special_tokens=False).ids


def test_shares_and_sums_are_of_longs_where_these_suffice(spark):
    rows = [(0, 0), (0, 1), (5, 7), (8_999_999_999, 9 * 10**9), (9 * 10**9, 10**10), (10**15, 3 * 10**15)]
    table = spark.createDataFrame(rows, "n long, total long")
    assert [r[0] for r in table.select(divergence._share("n", "total")).collect()] == [None if not t else 1 + 10**9 * (n + 1) // t for n, t in rows]
    scored = spark.createDataFrame([("en", s, "t", 1, 9, 1) for s in "ab"], "lang string, source string, term string, n long, p long, p0 long")
    groups = spark.createDataFrame([("en", s, 1, 1) for s in "ab"], "lang string, source string, total long, kept long")
    longest = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert "shiftright" in optimized(divergence.pair_values(scored, groups))
    spark.conf.set("spark.sql.debug.maxToStringFields", longest)
