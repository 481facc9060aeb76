"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which equal starts are listed, and the patterns that are always kept.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in time that grows with the text only. No part of these patterns can give back what it took, and a
#: match that begins inside a run of digits would begin at its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(PATTERNS["card"])
_PHONE = re.compile(PATTERNS["phone"])
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: The labelled table, written by hand: sentences, with [kind words] around what is personal. Addresses and phone numbers
#: are those reserved for examples, cards the numbers that payment services publish for tests.
LABELLED = (
    "write to [email anna.k@mail.example.com] before noon",
    "mail [email joe77@host.org] or call [phone +1 (555) 010-2233] today",
    "her address [email m_lee-x@uni.ac.uk] is new and his [email b.o@firm.co] old",
    "[email kd.12@mail3.example.com] [phone +44 20 7946 0958] [ip 10.0.0.12]",
    "[email zq.5@a.net] [card 4012888888881881] and the rest",
    "the host [ip 192.168.10.45] was down at 10.30 on 12.05.2020",
    "from [ip 198.51.100.90] to [ip 8.8.4.4] in 20 ms",
    "[ip 203.0.113.77] [card 5500005555555559] [phone +1 (555) 010-0166]",
    "seen at [ip 198.51.100.133] twice",
    "card [card 4111 1111 1111 1111] was used",
    "card [card 5500-0055-5555-5559] was lost",
    "pay with [card 6011111111111117] now",
    "[phone +1 (555) 010-0166] [card 6011111111111117] here",
    "[phone +1 (555) 010-0133] [card 5105105105105100] [ip 198.51.100.90] que",
    "[card 4222222222222220] [phone +1 (555) 010-0105] on",
    "[card 4000056655665556] [ip 192.0.2.31] as before",
    "call [phone +1 (555) 010-0193] today",
    "call [phone +49 30 901820] or [phone +33 1 42 68 53 00] now",
    "ring [phone +1-202-555-0143] or [phone +1.202.555.0188] later",
    "dial [phone +12025550143] first",
    "[phone +1 (555) 010-0148] [email tt.9@mail5.example.com] [card 4242424242424242]",
    "number [phone (202) 555-0143] works",
    "[phone (212) 555-0100] [ip 172.16.0.9]",
    "in 1999 about 300 people paid 45.50 each",
    "version 2.0 and section 3.1.4 of the text",
    "chapter 12 , page 7 , line 3",
    "the year 2021 saw 1,200,300 cases and 35% more",
    "order 123456 item 99 box 7",
    "model x200 costs 1999 or 2.5 times more",
    "(see 3) and (4) but not (12) or + 5",
    "the quick brown fox jumps over the lazy dog",
    "Thing here , that There and of the",
    "a@b is short and @handle is not mail",
    "range 10-20 or 2010-2015 and 3-4",
    "word*** other### more%%% text$$$ here&&&",
    "version 3.",
    "Licensed under CC BY-NC 4.0.",
    "the 555-0199 extension and room 101",
)
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: Training: passes of gradient ascent, step, and strength of the Gaussian prior.
PASSES, STEP, PRIOR = 300, 0.5, 1e-3

_MARKED = re.compile(r"[0-9@]")
_EDGE = ".,;:!?'\"*#%$&|"


def luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern that pass its test."""
    out = [("email", a, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for kind, pattern, least, most in (("card", _CARD, 12, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text) if kind == "card" or "+" in text else ():
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, back over what may stand before it, though not into the match before, and on over the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            yield a, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def shape(token: str) -> tuple[str, ...]:
    """Features of a word: its shape, its shape with runs collapsed, digits by number, and marks. All words without a
    digit or @ have one and the same feature."""
    return _kept_shape(token) if len(token) <= 64 else _shape(token)


def _shape(token: str) -> tuple[str, ...]:
    token = token.strip(_EDGE)
    if not _MARKED.search(token):
        return ("plain",)
    long = "".join("d" if c.isdigit() else "x" if c.isalpha() else c for c in token)
    short = re.sub(r"(.)\1+", r"\1", long)
    digits = long.count("d")
    out = [f"s:{short[:24]}", f"n:{min(digits, 20) if digits < 12 else '12-19' if digits < 20 else '20+'}", f"first:{long[0]}", f"only:{''.join(sorted(set(long)))[:8]}"]
    if re.fullmatch(r"d{1,3}(\.d{1,3}){3}", long):
        out.append("quad")
    if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", token):
        out.append("mail")
    if 12 <= digits <= 19 and set(long) <= set("d -"):
        out.append("luhn" if luhn(re.sub(r"\D", "", token)) else "noluhn")
    return tuple(out)


_kept_shape = functools.lru_cache(100_000)(_shape)


def features(tokens: list[str]) -> list[tuple[str, ...]]:
    """A word's own features and its neighbours' collapsed shapes."""
    own = [shape(t) for t in tokens]
    side = [o[0] for o in own]
    return [
        (*o, *(() if o[0] == "plain" else (f"<{side[i - 1] if i else 'plain'}", f">{side[i + 1] if i + 1 < len(side) else 'plain'}")))
        for i, o in enumerate(own)
    ]


def _parse(sentence: str) -> tuple[list[str], list[int]]:
    tokens, tags, kind, first = [], [], "", False
    for t in sentence.split():
        if t.startswith("[") and t[1:] in KINDS:
            kind, first = t[1:], True
            continue
        last = bool(kind) and t.endswith("]")
        tokens.append(t.removesuffix("]") if last else t)
        tags.append(TAGS.index(f"{'B' if first else 'I'}-{kind}") if kind else 0)
        first = False
        kind = "" if last else kind
    return tokens, tags


class Field:
    """The trained field: weights by feature and tag, and by pairs of tags."""

    def __init__(self, table: tuple[str, ...] = LABELLED):
        rows = [_parse(s) for s in table]
        names = sorted({f for tokens, _ in rows for fs in features(tokens) for f in fs})
        self.index = {f: i for i, f in enumerate(names)}
        n, k = len(names), len(TAGS)
        self.emit, self.move = np.zeros((n, k)), np.zeros((k, k))
        #: An inner tag follows only tags of its own kind.
        self.allowed = np.array([[0.0 if b == "O" or b[0] == "B" or a[2:] == b[2:] else -1e4 for b in TAGS] for a in TAGS])
        self.start = np.array([0.0 if t[0] != "I" else -1e4 for t in TAGS])
        data = [([[self.index[f] for f in fs] for fs in features(tokens)], tags) for tokens, tags in rows]
        g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        h_emit, h_move = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(PASSES):
            g_emit[:], g_move[:] = -PRIOR * self.emit, -PRIOR * self.move
            for fs, tags in data:
                self._add_gradient(fs, tags, g_emit, g_move)
            h_emit += g_emit**2
            h_move += g_move**2
            self.emit += STEP * g_emit / np.sqrt(h_emit)
            self.move += STEP * g_move / np.sqrt(h_move)
        self.pairs = self.move + self.allowed
        #: No kind holds a plain word: such a word is O on every path. So the chain falls apart at plain words, and
        #: decoding the runs between them, each with its moves from and to O, gives the best path of the whole text.
        self.emit[self.index["plain"], 1:] = -1e6

    def scores(self, fs: list[tuple[str, ...]]) -> np.ndarray:
        return np.array([self.emit[[self.index[f] for f in x if f in self.index]].sum(axis=0) for x in fs])

    def _add_gradient(self, fs: list[list[int]], tags: list[int], g_emit: np.ndarray, g_move: np.ndarray) -> None:
        e = np.array([self.emit[x].sum(axis=0) for x in fs])
        pairs, n = self.move + self.allowed, len(fs)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[0] = self.start + e[0]
        for i in range(1, n):
            fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + pairs, axis=0) + e[i]
        for i in range(n - 2, -1, -1):
            bwd[i] = np.logaddexp.reduce(pairs + (e[i + 1] + bwd[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(fwd[-1])
        one = np.exp(fwd + bwd - total)
        for i, x in enumerate(fs):
            for f in x:
                g_emit[f] -= one[i]
                g_emit[f, tags[i]] += 1
        for i in range(1, n):
            g_move -= np.exp(fwd[i - 1][:, None] + pairs + (e[i] + bwd[i])[None, :] - total)
            g_move[tags[i - 1], tags[i]] += 1

    def decode(self, runs: list[list[tuple[str, ...]]], after_plain: np.ndarray, before_plain: np.ndarray) -> list[np.ndarray]:
        """The best path (Viterbi) of each run of words, all runs a step at a time; the flags tell which of them stand
        after or before a plain word."""
        sizes = np.array([len(r) for r in runs], int)
        order = np.argsort(-sizes, kind="stable")
        sizes, after, before = sizes[order], np.asarray(after_plain, bool)[order], np.asarray(before_plain, bool)[order]
        first = np.cumsum(sizes) - sizes
        e = self.scores([fs for k in order for fs in runs[k]])
        best = np.where(after[:, None], self.pairs[0], self.start) + e[first]
        back = np.zeros(e.shape, np.int8)
        upto = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # runs of each length at least
        for t in range(1, sizes[0]):
            m = upto[t]
            through = best[:m, :, None] + self.pairs
            back[first[:m] + t] = through.argmax(axis=1)
            best[:m] = through.max(axis=1) + e[first[:m] + t]
        here = (best + before[:, None] * self.pairs[:, 0]).argmax(axis=1)
        tags = np.zeros(len(e), int)
        for t in range(sizes[0] - 1, -1, -1):
            at = first[: upto[t]] + t
            tags[at] = here[: upto[t]]
            here[: upto[t]] = back[at, tags[at]]
        out: list = [None] * len(runs)
        for k, a, n in zip(order, first, sizes, strict=True):
            out[k] = tags[a : a + n]
        return out


@functools.cache
def trained() -> Field:
    return Field()


def found_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """For each text the spans of the best path over all its words."""
    rows = [(i, run) for i, text in enumerate(texts) for run in _runs(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    first = [len(t) - len(t.lstrip()) for t in texts]
    last = [len(t.rstrip()) for t in texts]
    after = np.array([run[0][0] > first[i] for i, run in rows])
    before = np.array([run[-1][1] < last[i] for i, run in rows])
    decoded = field.decode([features([w for _, _, w in run]) for _, run in rows], after, before)
    for (i, run), tags in zip(rows, decoded, strict=True):
        kind, start, end = "", 0, 0
        for (a, b, w), tag in zip(run, tags, strict=True):
            name = TAGS[tag]
            if name[0] != "I" and kind:
                out[i].append((kind, start, end))
                kind = ""
            if name[0] == "B":
                kind, start = name[2:], a + len(w) - len(w.lstrip(_EDGE))
            if kind:
                end = b - len(w) + len(w.rstrip(_EDGE))
        if kind:
            out[i].append((kind, start, end))
    return [[s for s in spans if s[1] < s[2]] for spans in out]


_SPACE = re.compile(r"\s")


def _runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of neighbouring words that aren't plain."""
    run: list[tuple[int, int, str]] = []
    at = 0
    while m := _MARKED.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, m.end())
        z = space.start() if space else len(text)
        word, at = text[a:z], z
        if shape(word)[0] == "plain":  # marks on its edge only
            continue
        if run and text[run[-1][1] : a].strip():
            yield run
            run = []
        run.append((a, z, word))
    if run:
        yield run


def spans(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text the spans of the patterns, and those with the field's that don't overlap any of them; each by start,
    then kind."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    out = []
    for text, found in zip(texts, found_spans(texts, field), strict=True):
        base = sorted(base_spans(text), key=key) if _MARKED.search(text) else []
        starts, upto = [b[1] for b in base], list(itertools.accumulate((b[2] for b in base), max))
        free = lambda s, starts=starts, upto=upto: not (i := bisect.bisect_left(starts, s[2])) or upto[i - 1] <= s[1]
        out.append((base, sorted(set(base) | {s for s in found if free(s)}, key=key)))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row (counts of all spans are those of
    the fixed patterns; ``spans`` also has what the field finds).

    Offsets are code points, ends exclusive. The time grows with the text only, however long its runs of digits or letters
    are, and the words of all texts of a batch are decoded together. Null and empty texts have no spans: counts 0, the hash of the empty
    string, ``spans`` empty. Repeated rows are judged each; an empty table gives an empty result. Other columns are
    not read.
    """
    trained()  # fails here, not in a task, if training does

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, listed = [], []
            for base, full in spans([value.as_py() or "" for value in b.column(1)], field):
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                hashes.append(hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest())
                listed.append(",".join(f"{k}:{a}:{z}" for k, a, z in full))
            columns = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(judge, schema)
