"""BPE encoding and decoding by way of a table of distinct words."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut_by

#: Characters of text that share a block of words, but for a single longer text.
BLOCK = 24_000_000
#: Words of a row of places, and ids that are decoded at a time, but for a single longer document.
ROW = 500_000
#: Words whose ids go back to their blocks together.
BACK = 200_000

#: Words as rows of the table: letters a-z apart from what follows them, if that is an ASCII mark, and else whatever
#: stands between ASCII white space. The vocabulary drops white space and never looks across it, nor past the end of a
#: run of letters, so what a word encodes to doesn't hang on its neighbours. An added token starts with a mark and so
#: lies within one word.
_WORD = re.compile(r"[A-Za-z]++(?![^\t-\r !-/:-@\[-`{-~])|[^\t-\r ]++")


@functools.cache
def tokenizer(vocabulary: str | None):
    """The tokenizer of a file, without truncation and padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
    found = Tokenizer.from_file(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    if found.decoder is not None:
        raise ValueError("the decoder of this vocabulary isn't a join of its pieces by spaces")
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def pieces(vocabulary: str | None) -> pa.Array:
    """The vocabulary's pieces, that of an id at its place."""
    known = {i: piece for piece, i in tokenizer(vocabulary).get_vocab(with_added_tokens=True).items()}
    return pa.array([known.get(i) for i in range(max(known) + 1)])


def _pack(places: np.ndarray) -> bytes:
    """32-bit numbers, mostly small ones, byte by byte of their weight and deflated."""
    return zlib.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of neighbours whose sizes sum up to ``most``, or of one that is larger."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def split(docs: DataFrame, id_col: str, text_col: str, block: int, row: int) -> DataFrame:
    """Texts as places in the word lists of their blocks.

    A row with ``word`` says that this is word ``no`` of ``block``. A row without has some documents: their ids, how
    many words each has, and the numbers of the words in order. A block is of ``block`` characters of texts that one
    task met, so neither its list nor its documents grow with the table; frequent words have small numbers.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, ids, texts, held, id_type = TaskContext.get().partitionId() << 32, {}, [], [], 0, None

        def rows(n: int, **columns) -> pa.RecordBatch:
            types = {"docs": pa.list_(id_type), "sizes": pa.list_(pa.int32()), "places": pa.binary(), "no": pa.int32(), "word": pa.string()}
            made = {c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()}
            return pa.RecordBatch.from_pydict({"block": pa.array([number] * n, pa.int64())} | made)

        def flush() -> Iterator[pa.RecordBatch]:
            often = np.zeros(len(known), np.int64)
            for a, b in _runs([len(t) for t in texts], 10 * row):
                often += np.bincount(np.concatenate(texts[a:b]), minlength=len(known))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[order] = np.arange(len(known), dtype=np.uint32)
            sizes = [len(t) for t in texts]
            for a, b in _runs(sizes, row):
                yield rows(1, docs=[ids[a:b]], sizes=[sizes[a:b]], places=[_pack(rank[np.concatenate(texts[a:b])])])
            words = sorted(known)  # neighbours that are alike pack well
            for at in range(0, len(words), 10_000):
                part = words[at : at + 10_000]
                yield rows(len(part), no=rank[[known[w] for w in part]].astype(np.int32), word=part)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = text.as_py() or ""
                words = _WORD.findall(said)
                for w in set(words).difference(known):
                    known[w] = len(known)
                ids.append(doc)
                texts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                held += len(said)
                if held >= block:
                    yield from flush()
                    number, known, ids, texts, held = number + 1, {}, [], [], 0
        if ids:
            yield from flush()

    wanted = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(blocks, f"block long, docs array<{kind}>, sizes array<int>, places binary, no int, word string")


def _sorted_out(blocks: np.ndarray, nos: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    """A row for each block: the numbers of its words as steps upwards, how many ids each has, and the ids, all packed."""
    order = np.lexsort((nos, blocks))
    blocks, nos, ids = blocks[order], nos[order], [ids[i] for i in order.tolist()]
    sizes = np.array([len(i) // 4 for i in ids], np.int64)
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    rows = [(blocks[a], _pack(np.diff(nos[a:b], prepend=0)), _pack(sizes[a:b]), _pack(np.frombuffer(b"".join(ids[a:b]), "<u4"))) for a, b in zip(edges, edges[1:], strict=False)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["of_block", "nos", "sizes", "ids"])


def encoded_words(listed: DataFrame, vocabulary: str | None = None, back: int = BACK) -> DataFrame:
    """``of_block, nos, sizes, ids`` from ``block, no, word``: equal words come together, and each distinct one is encoded
    once; the ids of about ``back`` words at a time are sorted out by block."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = tokenizer(vocabulary), {}
        blocks, nos, ids = [], [], []
        for batch in batches:
            words = batch.column(2).to_pylist()
            new = [w for w in dict.fromkeys(words) if w not in last]
            found = own.encode_batch_fast(new, add_special_tokens=False)
            known = last | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(new, found, strict=True)}
            last = {words[-1]: known[words[-1]]} if words else last
            blocks.append(batch.column(0).to_numpy())
            nos.append(batch.column(1).to_numpy().astype(np.int64))
            ids += [known[w] for w in words]
            if len(ids) >= back:
                yield _sorted_out(np.concatenate(blocks), np.concatenate(nos), ids)
                blocks, nos, ids = [], [], []
        if ids:
            yield _sorted_out(np.concatenate(blocks), np.concatenate(nos), ids)

    rows = listed.select("block", "no", "word").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(encode, "of_block long, nos binary, sizes binary, ids binary")


def word_ids(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows from ``encoded_words`` all ids, and by the number of a word where its ids start and how many."""
    whole = lambda c: [_unpack(x.as_py()).astype(np.int64) for x in lists[c]]
    none = [np.zeros(0, np.int64)]
    nos, sizes = np.concatenate([np.cumsum(x) for x in whole("nos")] or none), np.concatenate(whole("sizes") or none)
    starts, n = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
    starts[nos], n[nos] = np.cumsum(sizes) - sizes, sizes
    return np.concatenate(whole("ids") or none).astype("<u4"), starts, n


def encode(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    row: int = ROW,
) -> DataFrame:
    """One row per document: ``id_col, ids``; ids are little-endian unsigned 32-bit integers.

    Texts are split into words once, and kept as places in the word lists of blocks. The lists of all blocks make the
    table of words, dealt and sorted by word, where each distinct word of all texts is encoded once; its ids go back to
    each block that has it, and there to its places. So what is shuffled is a list of words for every ``block``
    characters, never a row for each word of each text, and a word in all texts is one row per block. The places aren't
    shuffled: they lie in buckets by block, and the lists come to them.

    The ids are those of the vocabulary's own tokenizer without special tokens added, for a vocabulary that drops white
    space and has no decoder (else ``ValueError``). Null and empty texts, and texts of white space, have no ids. Very
    long texts are read whole and are a block of their own. Rows that repeat, share an id or have none are encoded each;
    an empty table gives an empty result. Other columns are not read.
    """
    parts = cut_by(split(docs, id_col, text_col, block, row), "block", "bpe-blocks")
    lists = encoded_words(parts.filter("word IS NOT NULL"), vocabulary)
    texts = parts.filter("word IS NULL").select("block", "docs", "sizes", "places")
    id_type = texts.schema["docs"].dataType.elementType

    def join_back(texts: pa.Table, lists: pa.Table) -> pa.Table:
        (flat, starts, n), out = word_ids(lists), []
        for docs, sizes, packed in zip(texts["docs"], texts["sizes"], texts["places"], strict=True):
            places = _unpack(packed.as_py())
            long = n[places]
            ends = np.cumsum(long)
            ids = flat[np.repeat(starts[places] - ends + long, long) + np.arange(long.sum())]
            edges = 4 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])]
            buffers = [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]
            out.append(pa.table({"doc": docs.values, "ids": pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers)}))
        return pa.concat_tables(out)

    grouped = texts.groupBy("block").cogroup(lists.groupBy("of_block"))
    return grouped.applyInArrow(join_back, f"doc {id_type.simpleString()}, ids binary").withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", row: int = ROW) -> DataFrame:
    """``encoded`` with ``decoded``, the pieces of the ids in order with spaces between, special tokens too.

    Each id is joined with its piece within the task: ids count from 0, so the vocabulary's table, which doesn't grow
    with the data, is looked up by place. Null ids, and none, decode to an empty text. A vocabulary with a decoder is a
    ``ValueError``; an id beyond the vocabulary breaks the job.
    """

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy() // 4
            for a, b in _runs(sizes.tolist(), row):
                ids = np.frombuffer(b"".join(x or b"" for x in column[a:b].to_pylist()), "<u4")
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32), pieces(vocabulary).take(pa.array(ids)))
                columns = [*batch.slice(a, b - a).columns, pc.binary_join(lists, " ")]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join_pieces, f"{fields}, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded documents."""
    return encoded.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
