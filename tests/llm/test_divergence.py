"""The divergence audit against sums over every term of every group."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from claimforge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [((r[1] or "").translate(lower), r[2] or "", r[3] or "") for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        of = [(d[2], t) for d, t in zip(docs, terms, strict=True) if d[1] == lang]
        seen = Counter(w for _, t in of for w in set(t))
        kept = [w for w, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for source, t in of:
            counts[source].update(w for w in t if seen[w] >= least)
            counts[None].update(w for w in t if seen[w] >= least)
        share = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sorted(set(counts) - {None}):
            pairs = [(-sum(f(share[s][w], share[o][w]) for w in kept), o) for o in counts if o not in (None, s)]
            own = [(-f(share[s][w], share[None][w]), w.encode(), w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "Zé", "MO", "ß", "日本", "x") for b in ("ri", "nö", "ta", "\U0001f600", "", "aa")]
    rows = []
    for i in range(n):
        said = rng.choices(words, [1 + (k % 7) * (i % 3) for k in range(len(words))], k=rng.randrange(40))
        rows.append((i, rng.choice(" -1,\n_").join(said), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None]), 0))
    rows += [(n, None, "fr", "s1", 0), (n, "", "fr", "s2", 0), (None, "lonely words here", "it", "s1", 0), (None, "12 34", "en", "s9", 0)]
    return rows + rows[:2]


def got(out) -> list[tuple]:
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("seed, top, small", [(1, 200, 4096), (2, 3, 0), (3, 5, 1)])
def test_agrees_with_brute_force(spark, seed, top, small):
    rows = corpus(seed, 90)
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), top=top, small=small)) == brute(rows, top=top)


def test_a_source_with_most_rows(spark):
    rows = [(i, "common word " + "abcdefgh"[i % 8] * (i % 5) + " of many", "en", "hot" if i % 10 else f"s{i % 30}", 0) for i in range(600)]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


@pytest.mark.parametrize("bits", [4, 16])
def test_selection(spark, bits):
    """Groups of one value, of ties with long like prefixes, of few rows, and of values beyond 32 bits."""
    rng = random.Random(bits)
    rows = [("a", 7, f"{'same' * 9}{i:03d}") for i in range(60)] + [("b", rng.randrange(2**50), str(i)) for i in range(80)]
    rows += [("c", rng.randrange(3), "é" * (i % 9) + chr(97 + i)) for i in range(25)] + [("d", 0, ""), ("d", 0, "a"), (None, 1, "x")]
    table = spark.createDataFrame(rows, "g string, v long, t string").withColumn("g", divergence.F.coalesce("g", divergence.F.lit("")))
    out = divergence.top_ranked(table, ["g"], "v", "t", 10, bits=bits, small=2)
    want = []
    for g in ("a", "b", "c", "d", ""):
        own = sorted((r for r in rows if (r[0] or "") == g), key=lambda r: (-r[1], r[2].encode()))
        want += [(g, v, t, k) for k, (_, v, t) in enumerate(own[:10], 1)]
    assert sorted(tuple(r) for r in out.select("g", "v", "t", "rank").collect()) == sorted(want)


def test_large_counts_stay_exact(spark):
    """Sums beyond 64 bits on the way: a term 10**12 times over."""
    row = spark.createDataFrame([(10**12, 10**12 + 7)], "n long, total long").select(divergence._share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**12 + 1) // (10**12 + 7)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_awkward_columns(spark):
    rows = corpus(4, 40)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: divergence.F.lit("x") for c in ("term", "terms", "n", "docs", "kept", "p", "q", "value", "item", "rank", "_digit")})
    assert got(divergence.audit(table)) == brute(rows)


def test_texts_are_counted_in_the_bounds_of_a_task():
    import pyarrow as pa

    texts = ["Ab ab\x00ÄB äB 特許,x", "ab AB", "", "é" * 3 + " " + "zz " * 700_000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "a", "b", "b"]), pa.array([x.encode() for x in texts], pa.binary())], names=["lang", "source", "text"])
    want = {("a", "ab"): (4, 2), ("a", "Äb"): (1, 1), ("a", "äb"): (1, 1), ("a", "特許"): (1, 1), ("a", "x"): (1, 1), ("b", "ééé"): (1, 1), ("b", "zz"): (700_000, 1)}
    for most in (1, 3, 500_000):
        found: dict = {}
        for out in divergence._tallied(iter([batch]), most):
            for r in out.to_pylist():
                n, docs = found.get((r["source"], r["term"]), (0, 0))
                found[r["source"], r["term"]] = (n + r["n"], docs + r["docs"])
        assert found == want
    assert max(map(len, divergence._words(texts[3].encode(), 1000))) < 1100
