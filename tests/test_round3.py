"""The legal fold, saved searches in one pass, briefs as SQL, and evidence by rare tokens."""

from __future__ import annotations

import random
import time

import pytest
from claimforge.operators import evidence, judges, legal, percolate, search
from claimforge.streaming import legal_fold
from pyspark.sql import functions as F

PUBLICATION = (
    "publication_number string, country_code string, publication_date bigint, title_localized array<struct<text:string,language:string>>, "
    "abstract_localized array<struct<text:string,language:string>>, claims_localized array<struct<text:string,language:string>>, "
    "cpc array<struct<code:string>>, assignee_harmonized array<struct<name:string,country_code:string>>"
)
EVENTS = [
    ("A", 1, "2001-01-01", "GRANT", "PATENT GRANTED"),
    ("A", 3, "2003-01-01", "MM4A", "LAPSE DUE TO NON-PAYMENT"),
    ("A", 2, "2009-01-01", "RESTORE", "RIGHTS REINSTATED"),
    ("B", 1, None, None, "EXPIRED "),
    ("B", 2, "2002-01-01", "X", "FEE PAID"),
    ("C", 1, "2002-01-01", "X", "FEE PAID"),
    ("D", 5, "2002-01-01", "MM4A", "LAPSE"),
    ("D", 9, "2001-01-01", "R", "RESTORATION"),
]


def by_key(rows) -> dict:
    return {r["canonical"]: (r["status"], r["evidence"], r["needs_review"]) for r in rows}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_fold_in_any_order_with_restarts(spark, tmp_path, order):
    """Three batches, each run of the stream a new one on the same checkpoint; an event that comes twice counts once."""
    for k in order:
        part = [e for i, e in enumerate(EVENTS) if i % 3 == k] + EVENTS[:1]
        spark.createDataFrame(part, legal_fold.EVENT).write.mode("append").json(str(tmp_path / "in"))
        legal_fold.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = by_key(legal_fold.current(spark, str(tmp_path / "out")).collect())
    assert got == by_key(legal.classify(spark.createDataFrame(EVENTS, legal_fold.EVENT)).collect())
    assert got["A"] == ("LAPSED", "2003-01-01 MM4A: LAPSE DUE TO NON-PAYMENT", False)
    assert got["B"] == ("EXPIRED", "? : EXPIRED", False), "no white space at the ends"
    assert got["C"] == got["D"] == ("UNKNOWN", None, True)


def test_fold_tells_what_has_settled(spark, tmp_path):
    """A right of which nothing came for a while is told again by a timer, and that the stream was stopped in between
    changes nothing."""
    folders = [str(tmp_path / x) for x in ("in", "out", "mark")]
    for part, want in ((EVENTS[:4], 0), (EVENTS[5:6], 2)):  # a stream that starts again waits for data first
        spark.createDataFrame(part, legal_fold.EVENT).write.mode("append").json(folders[0])
        query, until = legal_fold.follow(spark, *folders, quiet=4000), time.time() + 60
        rows: dict = {}
        while time.time() < until and (len(rows) < 2 or sum(rows[k]["settled"] for k in "AB") < want):
            time.sleep(1)
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*/_SUCCESS")):
                rows = {r["canonical"]: r for r in legal_fold.current(spark, folders[1]).collect()}
        query.stop()
    assert rows["A"]["settled"] and rows["B"]["settled"]
    assert rows["A"]["status"] == "LAPSED" and rows["A"]["version"] == 2 and rows["B"]["evidence"] == "? : EXPIRED"


def publications(n: int) -> list[tuple]:
    rng = random.Random(n)
    words = ["coil", "Power", "it's", "50%", "a.b", "(x)", "re\\d", "wireless power", "État", "rod", "roof"]
    said = lambda k: " ".join(rng.choices(words, k=k))
    texts = lambda k: [(said(k), "en"), (None, "fr")][: rng.randrange(3)]
    return [
        (f"P{i:04d}", rng.choice(["US", "EP", None]), rng.choice([20010101, 20050505, None]), texts(3), texts(6), texts(4), [(rng.choice(["H02J/1", "H02K", "B60L"]),)] * rng.randrange(2), [(rng.choice(["Acme Corp", "O'Neil", None]), "US")] * rng.randrange(2))
        for i in range(n)
    ]


def briefs(n: int) -> list[search.Brief]:
    rng = random.Random(n)
    terms = ["coil", "POWER", "it's", "50%", "a.b", "(x)", "re\\d", "wireless", " rod ", "état", "er w", "oo", "zzz"]
    out = []
    for i in range(n):
        keywords = tuple(tuple(rng.sample(terms, rng.randrange(1, 3))) for _ in range(rng.randrange(3)))
        cpc = tuple(rng.sample(["h02j", "H02", "B60L", "02J"], rng.randrange(0 if keywords else 1, 3)))
        out.append(search.Brief(f"b{i}", keywords=keywords, cpc=cpc, assignees=rng.choice([(), ("acme",), ("o'neil ", "corp")]), countries=rng.choice([(), ("us",), ("EP", "US")]), date_from=rng.choice([None, "2002-01-01"]), date_to=rng.choice([None, "2004-01-01"]), limit=rng.choice([2, 5000]), search_claims=rng.random() < 0.3))
    return out


@pytest.mark.parametrize("limit", [percolate.LIMIT, 60])
def test_one_pass_equals_single_searches(spark, limit):
    rows = spark.createDataFrame(publications(60), PUBLICATION).cache()
    asked = briefs(40)
    assert (len(percolate.chunks(asked, limit)) > 1) == (limit == 60)
    got = {(r["brief"], r["publication_number"]) for r in percolate.percolate(rows, asked, limit).collect()}
    want = {(i, r["publication_number"]) for i, b in enumerate(asked) for r in search.search(rows, b).select("publication_number").collect()}
    assert got == want and len(want) > 40
    assert percolate.percolate(rows, []).count() == 0


def test_a_thousand_briefs(spark):
    """Against a plain loop over the same rules in Python."""
    data, asked = publications(200), briefs(1000)
    got = {(r["brief"], r["publication_number"]) for r in percolate.percolate(spark.createDataFrame(data, PUBLICATION), asked).collect()}

    def meets(p: tuple, b: search.Brief) -> bool:
        number, country, day, title, abstract, claims, cpc, names = p
        texts = [(t or "").lower() for t, _ in title + abstract + (claims if b.search_claims else [])]
        return (
            (not b.countries or country in [c.upper() for c in b.countries])
            and (not b.date_from or (day or 0) >= search._day(b.date_from))
            and (not b.date_to or (day is not None and day <= search._day(b.date_to)))
            and all(any(k.strip().lower() in t for k in g for t in texts) for g in b.keywords)
            and (not b.cpc or any(c.startswith(x.upper()) for (c,) in cpc for x in b.cpc))
            and (not b.assignees or any(a.strip().lower() in (n or "").lower() for n, _ in names for a in b.assignees))
        )

    want = {(i, p[0]) for i, b in enumerate(asked) for p in [p for p in data if meets(p, b)][: b.limit]}
    assert got == want


def test_brief_as_sql(spark):
    """The SQL path gives what the column path gives, for quotes and pattern marks too; and again from the log."""
    rows = spark.createDataFrame(publications(60), PUBLICATION).cache()
    for b in briefs(12):
        made = search.search_sql(b, ("publication_number",))
        assert search.SearchSql.from_log(made.logged()) == made
        got = [r[0] for r in search.SearchSql.from_log(made.logged()).run(rows).collect()]
        assert got == [r["publication_number"] for r in search.search(rows, b).collect()]
        assert "'" not in made.sql.replace("''", "")


def test_evidence_by_rare_tokens(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(60)]
    said = [(d, p, " ".join(rng.choices(words, [60 / (k + 1) for k in range(60)], k=9))) for d in range(60) for p in range(4)]
    asked = [(i, " ".join(rng.sample(words, 12))) for i in range(15)] + [(90, said[7][2]), (91, "nothing here"), (92, None), (93, "")]
    rows = spark.createDataFrame(said, "doc_id long, pos int, sentence string")
    got = {r["item_id"]: (r["doc_id"], r["pos"], r["n"]) for r in evidence.best_sentences(rows, spark.createDataFrame(asked, "item_id long, text string"), "item_id", "text").collect()}
    want = {}
    for i, t in asked:
        own = set((t or "").split())
        n, d, p = max((len(own & set(s.split())), -d, -p) for d, p, s in said)
        if n:
            want[i] = (-d, -p, n)
    assert got == want


def test_frequent_tokens_meet_few_sentences(spark, monkeypatch):
    """Where the best sentence has most of a text, under a tenth of the rows that a join of all tokens has."""
    rng = random.Random(9)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(400)]
    said = [(d, 0, " ".join(rng.choices(words, [400 / (k + 1) for k in range(400)], k=14))) for d in range(2000)]
    asked = spark.createDataFrame([(i, said[i * 7][2]) for i in range(40)], "item_id long, text string")
    met = []
    real = evidence.counted

    def watched(postings, own, prefix, key):
        met.append((postings.join(prefix.select(key, "token"), "token").count(), postings.join(own, "token").count()))
        return real(postings, own, prefix, key)

    monkeypatch.setattr(evidence, "counted", watched)
    assert evidence.best_sentences(spark.createDataFrame(said, "doc_id long, pos int, sentence string"), asked, "item_id", "text").count() == 40
    assert sum(m for m, _ in met) < 0.1 * met[0][1]


def test_stems_that_contain_others(spark):
    own, other = ["motor", "mot", "moto", "aaaa", "x", "bolt", "é日本語", ""], ["motor", "motors", "mo", "aaaaa", "aaab", "thunderbolt", "x", "日本語é日本語", "oto"]
    met = judges.stem_matches(spark.createDataFrame([(w,) for w in own + own[:2]], "own string"), spark.createDataFrame([(w,) for w in other], "other string"))
    want = {(a, b) for a in own for b in other if a == b or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a))}
    got = [tuple(r) for r in met.select("own", "other").collect()]
    assert set(got) == want and len(got) == len(want)


def test_lenient_over_many_equals_one_by_one(spark):
    said = ["the red housing holds motors", "blue carriers, rail mounted", "", None, "x"]
    elements = spark.createDataFrame([("a red motor housing",), ("rails carried by carriers",), ("a red motor housing",), ("the of",), (None,)], "element string")
    specs = spark.createDataFrame(list(enumerate(said)), "k int, spec string")
    got = {(r["element"], r["k"], r["n_matched"]) for r in judges.lenient_over(elements, specs, "k").collect()}
    want = set()
    for k, text in enumerate(said):
        one = judges.specification(spark, text or "")
        rows = elements.filter("element IS NOT NULL").distinct().crossJoin(one).withColumn("t", judges.tokens(F.col("element")))
        rows = rows.select("element", F.size("t").alias("n"), F.size(judges.lenient_matches(F.col("t"), F.col("spec_stems"))).alias("m"))
        want |= {(r["element"], k, r["m"]) for r in rows.collect() if r["n"] and r["m"] / r["n"] >= judges.LENIENT_SHARE}
    assert got == want and got
