"""Packing documents into sequences by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

CAPACITY = 1024
END_ID = 2
#: Fillings that the search may try before it takes its incumbent.
NODES = 20_000
#: Characters of chunks whose ids a Python worker remembers; characters encoded at a time; characters looked up at a time.
REMEMBERED, BLOCK, STRETCH = 6_000_000, 2**18, 2**13

#: White space as the vocabulary's splitting pattern has it: U+001C to U+001F are none there.
_SPACE, _SEEN = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: A word of A-Z alone stands apart from the marks after it, so that fewer chunks are to be known.
_CHUNK = re.compile(f"{_SPACE}*+(?:[A-Za-z]++(?![^\\s!-/:-@\\[-`{{-~])|{_SEEN}++)|{_SPACE}+")
_EDGE = re.compile(f"(?<={_SEEN}){_SPACE}")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in parts of ``size`` characters or little more, cut before white space only."""
    at = 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Encoder:
    """Ids (little-endian 32 bit) of texts, by way of chunks: a word with the white space before it. Pieces of the
    vocabulary's splitting pattern never reach from a visible character into white space, nor look there, so chunks can
    be encoded one by one and memory is that of one block; texts with an added token are encoded whole."""

    def __init__(self, vocabulary: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        self.tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self.known))
        if new and self.held > REMEMBERED:
            self.known, self.held, new = {}, 0, list(chunks)
        if new:
            self.known.update(zip(new, self._encoded(new), strict=True))
            self.held += sum(map(len, new))

    def _looked_up(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.known.__getitem__, _CHUNK.findall(part))) for part in blocks(text, STRETCH)])

    def _all_known(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are a block at most together. Chunks are looked up once, a stretch that fits the processor's
        caches at a time; once one isn't known, what is new in all that is left is encoded in one go."""
        out = []
        for i, text in enumerate(texts):
            try:
                ids = self._looked_up(text)
            except KeyError:
                self._learn({c for rest in texts[i:] for part in blocks(rest, STRETCH) for c in _CHUNK.findall(part)})
                ids = self._looked_up(text)
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._encoded([text])[0]
        return b"".join(self._all_known([block])[0] for block in blocks(text))

    def encode_each(self, texts: Iterable[str], size: int = BLOCK) -> Iterator[bytes]:
        """Ids of each of the texts, in order; short ones are taken together."""
        held, chars = [], 0
        for text in texts:
            if held and (chars + len(text) > size or any(a in text for a in self.added)):
                yield from self._all_known(held)
                held, chars = [], 0
            if len(text) > size or any(a in text for a in self.added):
                yield self.encode(text)
            else:
                held.append(text)
                chars += len(text)
        if held:
            yield from self._all_known(held)


@functools.cache
def encoder(vocabulary: str | None) -> Encoder:
    return Encoder(vocabulary)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with ``end_id`` after them."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, said in zip(batch.column(0).to_pylist(), own.encode_each(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids = said + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fillings(room: int, sizes: list[int], left: dict[int, int], waste: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """``(waste, sizes)`` of fillings of ``room`` from ``left`` (size: how many), least waste first, up to ``waste``.

    Bit ``t`` of ``reach[i]`` tells whether the sizes from the i-th on can fill exactly ``t``, so each waste is met or
    ruled out before any size is tried. Of the fillings of one waste only the one with the largest sizes first is given,
    which mostly dominates the others: what it leaves for later are smaller pieces, which fit in more places. Fillings
    that others of that waste don't dominate in the strict sense aren't tried.
    """
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, count, step = reach[-1], min(left[s], room // s), 1
        while count:
            take = min(step, count)
            bits |= bits << (take * s) & mask
            count, step = count - take, 2 * step
        reach.append(bits)
    reach.reverse()
    for missed in range(min(waste, room) + 1):
        if not reach[0] >> (room - missed) & 1:
            continue
        got, goal = [], room - missed
        for i, s in enumerate(sizes):
            for k in range(min(left[s], goal // s), -1, -1):
                if reach[i + 1] >> (goal - k * s) & 1:
                    got += [s] * k
                    goal -= k * s
                    break
            if not goal:
                break
        yield missed, tuple(got)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used: the largest size left, then the largest that still goes in, and so on."""
    left, out = {s: n for s, n in histogram.items() if n > 0}, []
    while left:
        need, rest = {}, capacity
        for s in sorted(left, reverse=True):
            if k := min(left[s], rest // s):
                need[s] = k
                rest -= k * s
        _use(left, need, times := min(left[s] // k for s, k in need.items()))
        out.append((tuple(s for s, k in need.items() for _ in range(k)), times))
    return out


def _use(left: dict[int, int], need: dict[int, int], times: int) -> None:
    for s, k in need.items():
        left[s] = left.get(s, 0) - k * times
        if not left[s]:
            del left[s]


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """What no packing can go below: all tokens, or all pieces of which no two share a sequence."""
    total = sum(s * n for s, n in histogram.items())
    return max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))


def patterns(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of few sequences, by branch and bound over fillings around the largest size left.

    The incumbent is best fit. A branch takes the largest size left and a filling of its room, as often as the sizes
    last, so there are about as many patterns as sizes, whatever the number of pieces. A filling is tried only while the
    waste of the branch leaves a sequence less than the incumbent's. The search ends when the incumbent meets the bound
    that no packing goes below, when no branch is left, or after ``nodes`` fillings.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    best = best_fit(left, capacity)
    count = sum(n for _, n in best)
    total, bound = sum(s * n for s, n in left.items()), least_sequences(left, capacity)
    taken: list[tuple[tuple[int, ...], int]] = []
    wasted = 0

    def branches() -> Iterator[tuple[int, tuple[int, ...]]]:
        largest = max(left)
        left[largest] -= 1
        sizes = sorted((s for s, n in left.items() if n and s <= capacity - largest), reverse=True)
        room = (count - 1) * capacity - total - wasted
        found = fillings(capacity - largest, sizes, dict(left), room) if room >= 0 else iter(())
        left[largest] += 1
        return ((w, (largest, *got)) for w, got in found)

    stack = [branches()] if count > bound else []
    while stack and count > bound and nodes > 0:
        step = next(stack[-1], None)
        while step is not None and wasted + step[0] > (count - 1) * capacity - total:
            step = None  # fillings come by waste: all further ones waste more
        if step is None:
            stack.pop()
            if taken:
                pattern, times = taken.pop()
                wasted -= (capacity - sum(pattern)) * times
                _use(left, {s: pattern.count(s) for s in set(pattern)}, -times)
            continue
        nodes -= 1
        waste, pattern = step
        need = {s: pattern.count(s) for s in set(pattern)}
        times = min(left[s] // k for s, k in need.items())
        if waste:
            times = min(times, ((count - 1) * capacity - total - wasted) // waste)
        _use(left, need, times)
        taken.append((pattern, times))
        wasted += waste * times
        if left:
            stack.append(branches())
            continue
        count, best = sum(n for _, n in taken), list(taken)
        pattern, times = taken.pop()
        wasted -= waste * times
        _use(left, need, -times)
    return best


def plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """``(size, first rank, end rank, first sequence, offset)``: pieces of a size by rank, to places in sequences."""
    ranks, out, sequence = dict.fromkeys(histogram, 0), [], 0
    for pattern, times in patterns(histogram, capacity, nodes):
        offset = 0
        for s in pattern:
            out.append((s, ranks[s], ranks[s] + times, sequence, offset))
            ranks[s] += times
            offset += s
        sequence += times
    return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, its first piece taking what isn't a
    multiple. The driver sees the histogram of lengths alone (``capacity`` numbers at most) and plans patterns on it;
    tasks rank the pieces of a length, in salted parts whose sizes are summed first, and look up rank in the plan, a
    table bounded by ``capacity`` squared rows. Null and empty texts are one token; repeated rows are packed each;
    an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = cut(pieces(docs, id_col, text_col, capacity, end_id, vocabulary), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted(plan(histogram, capacity))
    shift = max(1, max(histogram.values(), default=0)).bit_length() + 1
    keys = np.array([(s << shift) + a for s, a, *_ in rows], dtype=np.int64)
    places = np.array([(a, q, o) for _, a, _, q, o in rows], dtype=np.int64).reshape(-1, 3)
    held = spark.sparkContext.broadcast((keys, places))

    salts = max(16, sum(histogram.values()) // 1_000_000)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select("length", "salt", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = held.value
        for b in batches:
            rank = b.column("rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, (b.column("length").to_numpy() << shift) + rank, side="right") - 1
            first, sequence, offset = places[at].T if len(rank) else np.empty((3, 0), np.int64)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(sequence + rank - first), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
