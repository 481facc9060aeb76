"""Language ID by hyperdimensional letter trigram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a vector; letter symbols (0: no letter, 1-26: a-z, the rest: other letters, hashed); seed of the letter vectors.
DIM, SYMBOLS, SEED = 512, 48, 20_240_131
UNDETERMINED = "und"


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of each character of the basic plane; the last entry stands for all above it."""
    out = np.zeros(65537, np.int32)
    for i in range(65536):
        c = chr(i)
        if "a" <= c <= "z":
            out[i] = i - 96
        elif c.isalpha():
            out[i] = 27 + (i * 2654435761 % 2**32) % (SYMBOLS - 27)
    return out


@functools.cache
def _trigrams() -> np.ndarray:
    """Vector of every trigram: the letters' random +-1 vectors, rotated by place (the permutation) and multiplied (bound)."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    a, b = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    pairs = (a[:, None, :] * b[None, :, :]).reshape(-1, DIM)
    return (pairs[:, None, :] * letters[None, :, :]).reshape(-1, DIM)


def trigram_ids(text: str) -> np.ndarray:
    """Trigrams of the lower-cased letters, runs of anything else being one gap; none if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[np.minimum(points, 65536)]
    if (high := points > 65535).any():
        s[high] = [27 + p * 31 % (SYMBOLS - 27) if chr(p).isalpha() else 0 for p in points[high]]
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return np.empty(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bundle(ids: np.ndarray) -> np.ndarray:
    """Sum of the vectors of all trigrams, repeats counted."""
    kinds, counts = np.unique(ids, return_counts=True)
    out = np.zeros(DIM, np.float32)
    for at in range(0, len(kinds), 8192):
        out += counts[at : at + 8192].astype(np.float32) @ _trigrams()[kinds[at : at + 8192]].astype(np.float32)
    return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of all its learnable texts, less what all languages share, at length 1.

    Tasks sum trigram vectors by language, so the driver gets one vector per language and task.
    """
    learn = docs.filter(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = trigram_ids(text.as_py())
                if lang not in counts:
                    counts[lang] = np.zeros(SYMBOLS**3, np.int64)
                if len(ids) > 20_000:
                    counts[lang] += np.bincount(ids, minlength=SYMBOLS**3)
                else:
                    np.add.at(counts[lang], ids, 1)
        for lang, n in counts.items():
            kinds = np.flatnonzero(n)
            vector = bundle(np.empty(0, np.int64)).astype(np.float64)
            for at in range(0, len(kinds), 8192):
                part = kinds[at : at + 8192]
                vector += n[part].astype(np.float64) @ _trigrams()[part].astype(np.float64)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": [vector.tolist()]})

    found: dict[str, np.ndarray] = {}
    each = learn.mapInArrow(sums, "lang string, vector array<double>")
    summed = each.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    for r in summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("v")).collect():
        v = np.array(r["v"])
        found[r["lang"]] = v / max(np.linalg.norm(v), 1e-12)
    if len(found) > 1:
        shared = np.mean(list(found.values()), axis=0)
        found = {k: (v - shared) / max(np.linalg.norm(v - shared), 1e-12) for k, v in found.items()}
    return dict(sorted(found.items()))


def _judge(text: str | None, langs: list[str], matrix: np.ndarray) -> tuple[str, float]:
    ids = trigram_ids(text or "")
    if not len(ids) or not langs:
        return UNDETERMINED, 0.0
    v = bundle(ids)
    cos = matrix @ (v / max(float(np.linalg.norm(v)), 1e-12))
    k = int(np.argmax(cos))
    return langs[k], float(min(1.0, max(0.0, cos[k])))


def _matrix(model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    return list(model), np.array(list(model.values()), np.float32).reshape(len(model), DIM)


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row; ``score`` is the cosine with the nearest prototype, 0 at least.

    Null texts, texts without a letter and all texts under an empty model are ``und`` with score 0. Equal cosines go to
    the first language by name. Repeated rows are judged alike; an empty table gives an empty result.
    """
    langs, matrix = _matrix(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [_judge(text.as_py(), langs, matrix) for text in b.column(2)]
            names, scores = pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names, scores], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return wanted.mapInArrow(judge, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def determined(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, in one narrow pass; a null ``lang_col`` becomes the prediction."""
    langs, matrix = _matrix(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_judge(text.as_py(), langs, matrix)[0] for text in b.column(names.index(text_col))]
            old = b.column(names.index(lang_col)).to_pylist()
            lang = pa.array([o or f for o, f in zip(old, found, strict=True)], b.column(names.index(lang_col)).type)
            columns = [lang if n == lang_col else c for n, c in zip(names, b.columns, strict=True)]
            mask = pa.array([f != UNDETERMINED for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(mask)

    return docs.mapInArrow(keep, docs.schema)
