"""Each operator against a brute-force version on a small fixture, and on awkward tables."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from claimforge.llm import embedding_dedup, exact_dedup, language, licences, line_dedup, mixing, ngram_join, packing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ba", "ri", "mo", "ten", "lu", "sha") for b in ("ko", "ner", "vi", "sta", "pe", "dol")]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]


def corpus() -> list[tuple]:
    rows = []
    for i in range(60):
        rows.append((i, " ".join(prose(i, 30 + i)), "en" if i % 2 else "de", "a" if i % 3 else "b"))
    for i in range(60, 90):  # copies, and near copies with one word changed
        words = prose(i % 7, 30 + i % 7)
        if i % 2:
            words[i % 20] = "changed"
        rows.append((i, " ".join(words), "en", "a"))
    rows += [(90, None, None, None), (91, "", "en", "c"), (92, " \n\t", "en", "c"), (93, "x", None, "c"), (94, "12 34", "en", None), (95, " ".join(prose(5, 4000)), "en", "a"), (96, "\n".join(["A line that stands in many a document, word by word."] * 3), "en", "a"), (97, "A line that stands in many a document, word by word!", "en", "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


ROWS = corpus()
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def classes(ids: list, links: list[tuple]) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in TEXT.items():
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(ROWS)
    for i, r in got.items():
        own = groups[TEXT[i] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((TEXT[i] or "").encode()).hexdigest()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, n, percent):
    sets = {}
    for i, t in TEXT.items():
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(ids, links)
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs, n=n, percent=percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}


def test_fuzzy_lines(docs):
    width, least = line_dedup.WIDTH, line_dedup.LEAST
    lines = {(i, k): line.strip(" ") for i, t in TEXT.items() if t is not None for k, line in enumerate(t.split("\n"))}
    sets = {k: {v[j : j + width] for j in range(len(v) - width + 1)} for k, v in lines.items() if len(v) >= least}
    keys = sorted(sets)
    links = [(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) >= line_dedup.SIMILAR * len(sets[a] | sets[b])]
    want = classes(sorted(lines), links)
    got = {(r["doc_id"], r["line_no"]): (r["keep_id"], r["keep_line"]) for r in line_dedup.fuzzy_lines(docs).collect()}
    assert set(got) == set(lines)
    agreed = sum(got[k] == want[k] for k in want)
    assert agreed >= 0.98 * len(want)  # banding finds a pair at the least similarity with probability 0.986
    dropped = {k for k in got if got[k] != k}
    assert dropped <= {k for k in want if want[k] != k}, "no line goes without a near copy"


def kept_of(spark, lines: list[str]) -> list[int]:
    """For each of the lines, documents of their own, the document whose line stays."""
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r["keep_id"] for r in sorted(line_dedup.fuzzy_lines(table).collect(), key=lambda r: r["doc_id"])]


def test_lines_that_differ_in_their_spaced_words_only(spark):
    rng = random.Random(4)
    body = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6000)) for _ in range(6)]
    words = lambda: "".join(" " + "".join(rng.choices("abcdefgh", k=4)) for _ in range(45))
    lines = [b + words() for b in body[:3] for _ in range(2)]
    for b in body[3:]:
        lines += [b, " ".join([b[k * 20 : k * 20 + 20] for k in range(40)] + [b[800:]])]
    assert kept_of(spark, lines) == [i - i % 2 for i in range(12)]


def test_lines_that_repeat_themselves(spark):
    sentence = "This sentence says again what it said. "
    lines = ["-" * 30, "-" * 60, ("ist " * 18).strip(), ("ist " * 50).strip(), (sentence * 3).strip(), (sentence * 5).strip()]
    assert kept_of(spark, lines) == [0, 0, 2, 2, 4, 4]


def test_short_lines(spark):
    lines = ["Les.", "Les.", "x", "x", "Go back to the start", "Go back to the start!", "Next page of results now", "Next page of results no", "", "", "-" * 9, "-" * 70, "Les!"]
    assert kept_of(spark, lines) == [0, 0, 2, 2, 4, 4, 6, 6, 8, 9, 10, 10, 12]


def test_line_dedup_keeps_columns_and_blank_lines(spark):
    rows = [(1, "First line of a text that is long enough.\n\nshort\nend", "x", 9), (2, "First line of a text that is long enough.", "y", 9), (3, None, "z", 9)]
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, line string, k1 int")).collect()}
    assert out[1]["text"] == rows[0][1] and 2 not in out and out[3]["text"] is None and out[3]["line"] == "z"


def test_mixing(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in TEXT.items()}
    source = {r[0]: r[3] for r in ROWS}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    rows = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in rows:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]])
        assert r["target"] == pytest.approx(target[source[i]])
        assert 0 <= r["taken"] <= 2 * size[i]
        taken[source[i]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(2)).collect())


def test_mixed_holds_what_the_mix_takes(spark):
    """Null and repeated ids and clashing column names too."""
    rows = [(None if i % 5 == 0 else i % 7, " ".join(prose(i, 20)), "en", "ab"[i % 2], i) for i in range(200)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: mixing.F.lit("x") for c in ("id", "size", "fine", "row", "taken", "m_source", "copies")})
    out = mixing.mixed(table)
    count = lambda ids: sorted((k is None, k or 0, n) for k, n in ids.items() if n)
    got, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    for r in mixing.mix(table).collect():
        want[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    assert out.columns == table.columns and got[None] and count(got) == count(want)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in TEXT.items()}
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= packing.CAPACITY
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for i, parts in by_doc.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and parts[0][1] == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False)) and parts[-1][1] + parts[-1][2] == len(ids[i])
        assert all(p[2] == packing.CAPACITY for p in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(TEXT)
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def test_filling_finds_the_exact_sum():
    left = {700: 1, 500: 2, 450: 1, 350: 3, 60: 1}
    waste, sizes = next(packing.fillings(760, sorted(left, reverse=True), left, 760))
    assert waste == 0 and sum(sizes) == 760
    assert list(packing.fillings(10, [], {}, 10)) == [(10, ())] and list(packing.fillings(10, [], {}, 9)) == []


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.5)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, rows[1][1], 1), (405, rows[1][1], 1), (406, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sound = [(i, np.array(v, float) / np.linalg.norm(v), y) for i, v, y in rows if y is not None and v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, x, y) in enumerate(sound) for b, z, w in sound[k + 1 :] if y == w and float(x @ z) >= 0.98]
    want, n = classes([r[0] for r in rows], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = embedding_dedup.near_duplicates(table).collect()
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= n[r["vec_id"]] for r in got), "no link below the threshold"
    assert found >= 0.9 * sum(n.values())
    assert sum(r["component_id"] == want[r["vec_id"]] for r in got) >= 0.95 * len(rows)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_shards_stay_bounded(spark):
    """A label that is one dense group, and one of many: sub-shards hold all its pairs, and none is too large."""
    rng = np.random.default_rng(5)
    dense, base = rng.normal(size=16), rng.normal(size=(200, 16))
    rows = [(i, [float(x) for x in (dense if i < 600 else base[i % 200]) + rng.normal(size=16) * 0.02], int(i >= 600)) for i in range(1800)]
    classes = spark.createDataFrame(rows, "rep long, vec array<double>, label int").withColumn("dim", embedding_dedup.F.lit(16))
    shards = embedding_dedup._shards(classes, 40).toPandas().groupby(["label", "shard", "pair"])["rep"].apply(set)
    assert max(map(len, shards)) <= 1.5 * embedding_dedup.MOST * 40
    assert shards[1].index.get_level_values("shard").nunique() > 1200 // 40 // 2
    together = {a: set().union(*(s for s in shards[0] if a in s)) for a in range(0, 600, 97)}
    assert all(met == set(range(600)) for met in together.values())


def test_recall_audit_over_several_shards(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(size=16) * 0.05], i % 2) for i in range(900)]
    rows += [(900, rows[1][1], 1), (950, rows[1][1], 1), (951, None, 1), (1000, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    result = embedding_dedup.near_duplicates(table, cluster=50).cache()
    sound = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if v]
    wanted = sum(float(x @ z) >= 0.98 for i, x, y in sound if i % 50 == 0 for j, z, w in sound if y == w and i != j)
    got = embedding_dedup.audit(table, result, block=100).first()
    assert (got["asked"], got["wanted"]) == (21, wanted) and wanted > 20
    assert 0.9 <= got["recall"] <= 1
    none = result.withColumn("n_links", embedding_dedup.F.lit(0))
    assert embedding_dedup.audit(table, none, block=100).first()["recall"] == 0


def test_personal_data(spark):
    texts = {1: "mail a.b@c.de, 10.0.0.7 and 999.1.1.1 or +1 (555) 010-2233", 2: "card 4111 1111 1111 1111 and 4111 1111 1111 1112", 3: None, 4: "", 5: "plain words", 6: "a\U0001f600 x@y.zz"}
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    counts = {i: tuple(got[i][f"n_{k}"] for k in pii.KINDS) for i in texts}
    assert counts == {1: (1, 1, 0, 1), 2: (0, 0, 1, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (1, 0, 0, 0)}
    assert got[6]["base_sha256"] == hashlib.sha256(b"email:3:9").hexdigest()
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["spans"] == ""
    assert set("email:5:13".split(",")) <= set(got[1]["spans"].split(","))


def test_licences_base(spark):
    texts = {1: "Used Under the MIT License, yes. under the mit\nlicense", 2: "cc-by-nc and Apache License, Version 2.0", 3: None, 4: "the mit licence", 5: "Under the MIT Licenseé"}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = ",".join(sorted({label for _, label in places}))
        assert got[i]["base_labels"] == base and set(filter(None, base.split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_language(spark):
    letters = {"aa": "bcdba efe", "bb": "xyzw vuv"}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(letters[lang].replace(" ", ""), k=6)) for _ in range(20)), lang) for i in range(80) for lang in ("aa" if i % 2 else "bb",)]
    rows += [(100, None, "aa"), (101, "12 !", "aa"), (102, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(table, language.profiles(table)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i < 100)
    assert all(got[i]["lang_pred"] == "und" for i in (100, 101, 102))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())


EMPTY_SAFE = {
    "exact": exact_dedup.exact_dedup,
    "ngram": ngram_join.ngram_join,
    "lines": line_dedup.fuzzy_lines,
    "drop_lines": line_dedup.drop_lines,
    "mix": mixing.mix,
    "mixed": mixing.mixed,
    "pack": packing.pack,
    "pii": pii.detect,
    "licences": licences.scan,
    "language": lambda d: language.identify(d, language.profiles(d)),
    "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, d.selectExpr("doc_id", "1 AS toxic"))),
}


@pytest.mark.parametrize("name", sorted(EMPTY_SAFE))
def test_empty_table(spark, name):
    assert EMPTY_SAFE[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(set(EMPTY_SAFE) - {"drop_lines", "mixed"}))
def test_awkward_columns_and_rows(spark, name):
    """Clashing column names, a null id, repeated rows."""
    extra = ("id", "digest", "n", "token", "rep", "line", "fine", "label", "size", "length", "_text", "rank", "component_id")
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1), (None, "other text", None, None, 0), (2, None, "en", "s", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        table = table.selectExpr("*", f"'x' AS {c}")
    least = len(rows) - (name == "lines")  # a null text has no lines
    assert len(EMPTY_SAFE[name](table).collect()) >= least


def test_models_are_plain_data():
    assert json.dumps(toxicity.fit([]) is None) == "true"
