"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out

#: The kernel: subsequences of 3 letters within 6 characters, each character skipped costing a factor of 0.6.
SPAN, DECAY, POWER = 6, 0.6, 2
LETTERS = 32
#: Landmarks: words that mark toxic sentences, and clean words like them.
MARKING, CLEAN = 48, 16
#: Most labelled documents of each class to learn from.
SAMPLE = 1500
REMEMBERED = 300_000

_EDGE = ".,;:!?'\"()[]{}|*#%$&-_"
#: Letters that stand one by one are read as one word as well. Letters and what parts them have no character in common
#: and nothing is tried twice, so a search takes time linear in the text.
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_][\s.*_-]++){3,}+(?:[^\W_](?!\S))?")
_SPELLED_END = re.compile(r".*[^\W_](?!\S)", re.DOTALL)
_PATTERNS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def text_words(text: str) -> set[str]:
    """The distinct lower-cased words of all sentences of a text, as they stand."""
    text = text.lower()
    out = set(text.split())
    for run in _SPELLED.finditer(text):
        if end := _SPELLED_END.match(run[0]):
            letters = re.sub(r"\W|_", "", end[0])
            if len(letters) > 3:
                out.add(letters)
    return out


def _letters() -> np.ndarray:
    """Letter codes of the basic plane: a-z 1-26, others 27-29, the marks of a word's start and end 30 and 31; 0 parts
    words."""
    out = 27 + np.arange(65537, dtype=np.int32) % 3
    out[97:123] = np.arange(1, 27)
    out[0:3] = 0, 30, 31
    return out


_CODES = _letters()


def subsequences(words: list[str], lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words one after another: the word, the code and the weight of each subsequence, scaled per word; only
    codes in ``lead`` are returned, if given."""
    stripped = [f"\1{w.strip(_EDGE)}\2" for w in words]
    points = np.frombuffer(("\0" * SPAN).join([*stripped, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CODES[np.minimum(points, 65536)]
    own = np.repeat(np.arange(len(words)), [len(w) + SPAN for w in stripped])
    n = len(c) - SPAN
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    squares, at, codes, weights = np.zeros(n), [], [], []
    for i, j in _PATTERNS:
        a, b, d = c[:n], c[i : n + i], c[j : n + j]
        code = (a * LETTERS + b) * LETTERS + d
        hit = (a > 0) & (b > 0) & (d > 0)
        squares += hit * DECAY ** (2 * (j - 2))
        keep = np.flatnonzero(hit if lead is None else hit & lead[code])
        at.append(keep)
        codes.append(code[keep])
        weights.append(np.full(len(keep), DECAY ** (j - 2), np.float32))
    norm = np.sqrt(np.bincount(own[:n], weights=squares, minlength=len(words)))
    word = own[np.concatenate(at)]
    return word, np.concatenate(codes), (np.concatenate(weights) / norm[word]).astype(np.float32)


class Landmarks(NamedTuple):
    """Landmark words by subsequence: those of code ``c`` are ``word[start[c] : start[c + 1]]``, with their weights."""

    size: int
    lead: np.ndarray
    start: np.ndarray
    word: np.ndarray
    weight: np.ndarray


class Model(NamedTuple):
    landmarks: Landmarks
    alpha: np.ndarray
    bias: float
    slope: float
    shift: float


def index(landmarks: list[str]) -> Landmarks:
    word, code, weight = subsequences(landmarks)
    keys, inverse = np.unique(code * len(landmarks) + word, return_inverse=True)
    summed = np.bincount(inverse, weights=weight)
    codes = keys // len(landmarks)
    start = np.searchsorted(codes, np.arange(LETTERS**3 + 1))
    return Landmarks(len(landmarks), np.diff(start) > 0, start, keys % len(landmarks), summed)


def kernel(words: list[str], marks: Landmarks) -> np.ndarray:
    """Kernel of each word with each landmark."""
    out = np.zeros((len(words), marks.size))
    for at in range(0, len(words), 8192):
        word, code, weight = subsequences(words[at : at + 8192], marks.lead)
        n = marks.start[code + 1] - marks.start[code]
        entry = np.repeat(marks.start[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.repeat(word, n) * marks.size + marks.word[entry]
        some = min(8192, len(words) - at)
        out[at : at + some] = np.bincount(pairs, np.repeat(weight, n) * marks.weight[entry], some * marks.size).reshape(some, -1)
    return out**POWER


def fit(labelled: list[tuple[frozenset[str], int]]) -> Model | None:
    """Learn from ``(words of a text, 0 or 1)``; none without both classes.

    A toxic text says only that some word in some sentence of it is toxic. So each round takes of every toxic text the
    word that scores highest as its witness, and all words of clean texts, and trains the machine on these.
    """
    texts = sorted(set(labelled), key=lambda t: (t[1], sorted(t[0])))
    n_bad = sum(y for _, y in texts)
    if not n_bad or n_bad == len(texts):
        return None
    seen = [Counter(), Counter()]
    for words, y in texts:
        seen[y].update({w.strip(_EDGE) for w in words})
    n_good = len(texts) - n_bad
    odds = {
        w: np.log((k + 0.1) / (n_bad + 1)) - np.log((seen[0][w] + 0.5) / (n_good + 1)) + np.log(k)
        for w, k in seen[1].items()
        if len(w) > 2
    }
    marking: list[str] = []
    least = max(1.0, 0.55 * max(odds.values(), default=0.0))
    for w in sorted((w for w in odds if odds[w] > least), key=lambda w: (-odds[w], w))[: 8 * MARKING]:
        if len(marking) < MARKING and (not marking or kernel([w], index(marking)).max() < 0.8**POWER):
            marking.append(w)
    if not marking:
        return None
    common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:20_000] if odds.get(w, 0) <= 0.5]
    near = kernel(common, index(marking)).max(axis=1) if common else np.empty(0)
    landmarks = marking + [common[i] for i in np.argsort(-near, kind="stable")[:CLEAN]]
    marks = index(landmarks)
    gram = kernel(landmarks, marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2 * values.max()))

    words = sorted({w.strip(_EDGE) for ws, _ in texts for w in ws})
    place = {w: i for i, w in enumerate(words)}
    psi = kernel(words, marks) @ whiten
    bags = [np.array([place[w.strip(_EDGE)] for w in ws], int) for ws, _ in texts]
    far = np.abs(psi).max(axis=1) < 0.02
    good = np.unique(np.concatenate([b for b, (_, y) in zip(bags, texts, strict=True) if not y]))
    good = np.concatenate([good[~far[good]], good[far[good]][:1]])
    z = np.array([odds.get(w, -9.0) for w in words])
    for _ in range(4):
        witness = np.array([b[np.argmax(z[b])] for b, (_, y) in zip(bags, texts, strict=True) if y and len(b)])
        use = np.concatenate([witness, good])
        u, bias = _machine(psi[use], np.r_[np.ones(len(witness)), -np.ones(len(good))])
        z = psi @ u + bias
    best = np.array([z[b].max() if len(b) else bias for b in bags])
    slope, shift = _sigmoid(best, np.array([y for _, y in texts], float))
    return Model(marks, whiten @ u, float(bias), slope, shift)


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge machine, both classes weighing alike, by accelerated gradient steps."""
    w = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    xb, v = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    lip = 2 * np.linalg.eigvalsh((xb * w[:, None]).T @ xb).max() + ridge
    last, t = v.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = -2 * xb.T @ (w * y * slack) + ridge * np.r_[v[:-1], 0]
        new, t_new = v - grad / lip, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, last, t = new + (t - 1) / t_new * (new - last), new, t_new
    return last[:-1], float(last[-1])


def _sigmoid(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling with his smoothed targets; the slope is positive and at most 6."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = 1 / len(y)
    a, c = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        a = float(np.clip(a - 1.0 * (w * (p - target) * z).sum(), 0.1, 6.0))
        c -= 1.0 * float((w * (p - target)).sum())
    return a, c


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents of each class, in the order of a hash of the id, none of them held
    out. Of several labels the largest counts. Texts are read whole by the tasks; the driver gets their distinct words.
    """
    one = labels.filter(~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).dropna()
    pick = [one.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (1, 0)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = pa.array([" ".join(sorted(text_words(v.as_py()))) for v in b.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([said, b.column(1).cast(pa.int32())], ["words", "y"])

    rows = texts.join(chosen, "_id").select("_text", "_y").mapInArrow(words, "words string, y int").collect()
    return fit([(frozenset(r["words"].split()), r["y"]) for r in rows])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row: a text scores as the worst word of its sentences.

    Null and empty texts score as a text whose words are all like none of the landmarks; under no model every score is
    0. Texts of any length are read whole, in time linear in their length. Repeated rows are judged alike, and of words
    that tie for the worst each gives the same score; an empty table gives an empty result. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks are a fixed number

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value, {}
        for b in batches:
            texts = [text_words(v.as_py() or "") for v in b.column(2)]
            best = np.full(len(texts), 0.0)
            if model is not None:
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, list(set().union(*texts))
                known.update(zip(new, (kernel(new, model.landmarks) @ model.alpha).tolist(), strict=True))
                best = np.array([max((known[w] for w in ws), default=0.0) for ws in texts]) + model.bias
                best = 1 / (1 + np.exp(-np.clip(model.slope * best + model.shift, -40, 40)))
            predicted = pa.array((best >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.float64()), predicted], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return wanted.mapInArrow(judge, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
