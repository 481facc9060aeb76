"""Methods against their definitions: licence labels, the subsequence kernel, and language vectors, each by brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from claimforge.llm import language, licences, toxicity

WEIGHTS = {w: 1.0 + len(w) / 3 + (len(w) * 7919 % 5) / 10 for t in licences.TEMPLATES for w in t.text.split()}


def labels_of(words):
    """Labels and best share by trying every template at every place."""
    found, best = set(), 0.0
    for t in licences.TEMPLATES:
        own, key = t.text.split(), t.key.split()
        at, whole = licences.key_place(t), sum(WEIGHTS[w] for w in own)
        for start in range(-at, len(words)):
            there = [words[start + j] if 0 <= start + j < len(words) else None for j in range(len(own))]
            share = sum(WEIGHTS[w] for w, x in zip(own, there, strict=True) if w == x) / whole
            if there[at : at + len(key)] == key and share >= licences.SHARE:
                found.add(t.label)
                best = max(best, share)
    return ",".join(sorted(found)), best


def changed(rng, template):
    """A template with some words outside its key phrase changed, left out at an end, or none."""
    own, at, n = template.text.split(), licences.key_place(template), len(template.key.split())
    free = [i for i in range(len(own)) if not at <= i < at + n]
    for i in rng.sample(free, min(len(free), rng.choice([0, 1, 1, 2, 4]))):
        own[i] += "s"
    return own[rng.choice([0, 0, min(1, at)]) :]


def test_licence_labels_against_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(150):
        words = []
        for t in rng.choices(licences.TEMPLATES, k=rng.choice([0, 1, 2, 3])):
            words += rng.choices(sorted(WEIGHTS), k=rng.randrange(4)) + changed(rng, t)
        texts[i] = " ".join(words)
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), WEIGHTS).collect()}
    for i, text in texts.items():
        wanted, best = labels_of(text.split())
        assert (got[i]["labels"], got[i]["score"]) == (wanted, pytest.approx(best)), text
    assert len({r["labels"] for r in got.values()}) > 20


def test_any_word_outside_the_key_phrase_may_change(spark):
    """Every template with each of its other words changed in turn, wherever that word weighs less than what may be lost."""
    cases, rows = {}, []
    for t in licences.TEMPLATES:
        own, at, n = t.text.split(), licences.key_place(t), len(t.key.split())
        whole = sum(WEIGHTS[w] for w in own)
        for i in range(len(own)):
            if not at <= i < at + n and WEIGHTS[own[i]] / whole <= 1 - licences.SHARE - 1e-9:
                cases[len(rows)] = t.label
                rows.append((len(rows), "so " + " ".join([*own[:i], own[i] + "x", *own[i + 1 :]]) + " then"))
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), WEIGHTS).collect()}
    assert len(rows) > 100 and all(label in got[k] for k, label in cases.items())


def test_licences_in_a_very_long_text(spark):
    text = "word " * 300_000 + licences.TEMPLATES[4].text.upper() + " word" * 1000
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), WEIGHTS).first()
    assert got["labels"] == "mit" and got["score"] == pytest.approx(1.0) and got["n_words"] == 301_000 + len(licences.TEMPLATES[4].text.split())


def enumerated(word):
    """Weight of each subsequence of three letters within ``SPAN`` characters, over the length of all occurrences."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 3
    letters = [30, *map(code, word), 31]
    sums, square = {}, 0.0
    for a, b, c in combinations(range(len(letters)), 3):
        if c - a < toxicity.SPAN:
            weight = toxicity.DECAY ** (c - a - 2)
            key = (letters[a], letters[b], letters[c])
            sums[key] = sums.get(key, 0.0) + weight
            square += weight * weight
    return {k: v / square**0.5 for k, v in sums.items()}


def test_kernel_against_enumerated_subsequences():
    rng = random.Random(3)
    words = ["a", "idiot", "i.d.i.o.t", "idixot", "xidiot", "aaaaaaa", "straße", "漢字", "x" * 300]
    words += ["".join(rng.choices("abcdeé1", k=rng.randrange(1, 14))) for _ in range(60)]
    marks = ["idiot", "aaab", "bad", "é1é1"]
    got = toxicity.kernel(words, toxicity.index(marks))
    mine, theirs = [enumerated(w) for w in words], [enumerated(w) for w in marks]
    wanted = [[sum(v * y.get(k, 0.0) for k, v in x.items()) ** toxicity.POWER for y in theirs] for x in mine]
    assert np.allclose(got, wanted, rtol=1e-4, atol=1e-6)
    # Gapped and inserted characters stay near, other words don't.
    at = {w: got[i][0] for i, w in enumerate(words)}
    assert at["idiot"] > at["idixot"] > 0.1 and at["xidiot"] > 0.1 and at["aaaaaaa"] < 1e-6


def test_language_vectors_and_cosines_against_their_definition():
    letters = np.random.default_rng(language.SEED).choice(np.array([-1, 1], np.int8), (language.SYMBOLS, language.DIM)).astype(np.int64)

    def vector(text):
        """Gaps are symbol 0, at both ends too; each trigram's letters rotated by two, one and no place, multiplied, added."""
        symbols = [0]
        for c in text.lower():
            kind = int(language._symbols()[ord(c)])
            if kind or symbols[-1]:
                symbols.append(kind)
        symbols += [0] * bool(symbols[-1])
        out = np.zeros(language.DIM, np.int64)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    texts = ["The cat sat on the mat.", "der Hund -- läuft 3 Mal", "x", "a  b", "où est-il ?", "漢字 です", "zz" * 5000]
    for text in texts:
        assert (language.bundle(language.trigram_ids(text)) == vector(text)).all(), text
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(3, language.DIM)).astype(np.float32)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    for text in texts:
        v = vector(text)
        cosines = matrix.astype(np.float64) @ v / np.linalg.norm(v)
        name, score = language._judge(text, ["a", "b", "c"], matrix)
        assert name == "abc"[int(np.argmax(cosines))] and score == pytest.approx(max(0.0, cosines.max()), abs=1e-5)
