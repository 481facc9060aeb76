"""Packing against an exact solver and the tokenizer itself; personal data against the plain patterns and enumeration."""

import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from claimforge.llm import packing, pii
from tokenizers import Tokenizer


def fewest(items: list[int], capacity: int) -> int:
    """By trying every place for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_patterns_use_all_pieces_in_as_few_sequences_as_an_exact_solver():
    rng, better = random.Random(3), 0
    for _ in range(400):
        capacity = rng.choice([20, 30, 50])
        items = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(capacity // 6, capacity // 2) for _ in range(rng.randrange(1, 12))]
        histogram = {s: items.count(s) for s in set(items)}
        found = packing.patterns(histogram, capacity)
        used = [s for pattern, times in found for s in pattern * times]
        assert sorted(used) == sorted(items) and all(sum(p) <= capacity for p, _ in found)
        assert sum(n for _, n in found) == fewest(items, capacity)
        better += sum(n for _, n in packing.best_fit(histogram, capacity)) > sum(n for _, n in found)
    assert better, "some cases where best fit alone is not enough"


def test_patterns_of_large_histograms_keep_to_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (np.clip(rng.lognormal(5, 1, 50_000).astype(int), 1, 1024), rng.integers(60, 110, 50_000)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        found = packing.patterns(histogram, 1024)
        assert sum(n for _, n in found) <= 1.01 * packing.least_sequences(histogram, 1024)


def test_ids_are_those_of_the_tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b", "plain words, and more.", " lead", "trail ", "<|endoftext|> hello", "x<|endoftext|>", "tab\tand\nline \n end", "Ünï codé 😀 1234 don't", "　wide space", "a  b"]
    rng = random.Random(0)
    marks = " \t\n\r\v\f\x1c\x1f\x85\xa0\u180e\u2003\u200b\u2028\u3000\ufeff'sTab1é漢,-_.!{\u0301İ😀"
    texts += ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(2000)]
    encoder = packing.encoder(None)
    wanted = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == wanted
    cut = [b"".join(map(encoder.encode, packing.blocks(t, 3))) for t in texts if "<|" not in t]
    assert [np.frombuffer(b, "<u4").tolist() for b in cut] == [w for t, w in zip(texts, wanted, strict=True) if "<|" not in t]


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1209.@%+- ().-é") for _ in range(rng.randrange(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 2_000_000 + ".1.1.1", "a" * 2_000_000 + " @", "a@" * 500_000, "1." * 500_000, "+1" * 500_000, "word 1234 " * 20_000])
def test_long_runs_take_time_in_proportion(text):
    began = time.time()
    pii.spans([text], pii.trained())
    assert time.time() - began < 20


def test_decoding_finds_the_best_of_all_paths():
    field, rng = pii.trained(), random.Random(2)
    words = ["call", "+1", "(555)", "010-0199", "4111", "1111", "10.0.0.1", "x@y.org", "12", "2020"]
    runs = [[rng.choice(words) for _ in range(rng.randrange(1, 5))] for _ in range(25)]
    rows = [pii.features(r) for r in runs]
    after, before = np.array([rng.random() < 0.5 for _ in runs]), np.array([rng.random() < 0.5 for _ in runs])
    got = field.decode(rows, after, before)
    for fs, tags, a, b in zip(rows, got, after, before, strict=True):
        e = field.scores(fs)

        def weight(path, e=e, a=a, b=b):
            start = (field.pairs[0] if a else field.start)[path[0]] + e[0, path[0]]
            return start + sum(field.pairs[x, y] + e[i + 1, y] for i, (x, y) in enumerate(itertools.pairwise(path))) + (field.pairs[path[-1], 0] if b else 0)

        best = max(weight(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(fs)))
        assert weight(tuple(tags)) == pytest.approx(best)


def test_the_field_finds_what_the_patterns_miss():
    texts = ["ring (202) 555-0143 now", "nothing here", "", "his card 4111 1111 1111 1111 and ip 10.1.2.3"]
    out = pii.spans(texts, pii.trained())
    assert out[0][0] == [] and [s[0] for s in out[0][1]] == ["phone"]
    assert out[1] == out[2] == ([], []) and {s[0] for s in out[3][1]} >= {"card", "ip"}
