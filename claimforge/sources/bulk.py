"""Weekly bulk files as a Spark data source: ``spark.read.format("bulk_grants")``."""

from __future__ import annotations

import io
import re
import time
import warnings
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .readers import RECORD, _last, grant_record

#: Bytes of a plain file for one partition, and bytes that are read at a time.
SPLIT, BLOCK = 64 * 2**20, 2**20
PLACE = "_file string, _start bigint, _pos bigint"
_PROLOG = b"<?xml"
#: What a filter may ask for by equality, and the text that a document then holds somewhere.
_KEYS = ("canonical", "number", "pub_date")
_NAMED = re.compile(r"ipg(\d{2})(\d{2})(\d{2})\.", re.I)


@dataclass
class Part(InputPartition):
    """A member of an archive, or the documents that begin within a stretch of a plain file."""

    path: str
    member: str | None
    start: int
    end: int


def documents(read: Callable[[int], bytes], start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """The documents that begin from ``start`` on and before ``end``, with their places: what follows each prolog, up to
    the next. No more than a block and a document is held."""
    held, at, inside = b"", start, False
    while True:
        block = read(BLOCK)
        held += block
        while (cut := held.find(_PROLOG, len(_PROLOG) if inside else 0)) >= 0:
            if inside:
                yield at, held[:cut]
            at, held, inside = at + cut, held[cut:], True
            if end is not None and at >= end:
                return
        if not block:
            if inside:
                yield at, held
            return
        if not inside:  # a prolog may be cut by the block's end
            at, held = at + max(0, len(held) - len(_PROLOG) + 1), held[max(0, len(held) - len(_PROLOG) + 1) :]
            if end is not None and at >= end:
                return


class BulkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.attempts = max(1, int(options.get("attempts", "3")))
        self.split = int(options.get("split", str(SPLIT)))
        self.wanted: dict[str, set[Any]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality of a number or a date is decided here, document by document; all else is Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in _KEYS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def _tried(self, what: str, do: Callable[[], Any]) -> Any:
        """``do``, again after a failure of the store, each time a little later. Files that are broken are passed over."""
        for k in range(self.attempts):
            try:
                return do()
            except (zipfile.BadZipFile, zlib.error, ValueError, NotImplementedError, RuntimeError) as e:
                warnings.warn(f"{what}: {e}", stacklevel=1)
                return None
            except OSError as e:
                if k + 1 == self.attempts:
                    raise
                warnings.warn(f"{what}, attempt {k + 1}: {e}", stacklevel=1)
                time.sleep(0.1 * 2**k)

    def _dated(self, name: str) -> bool:
        """Whether a weekly file may hold a wanted date: its name says the day of all its grants."""
        found = _NAMED.search(name)
        return not found or "pub_date" not in self.wanted or "20{}-{}-{}".format(*found.groups()) in self.wanted["pub_date"]

    def partitions(self) -> list[Part]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            files = [store.get_file_info(root)]
        else:
            files = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not self._dated(f.base_name):
                continue
            if f.extension.lower() == "zip":
                names = self._tried(f.path, lambda f=f: zipfile.ZipFile(store.open_input_file(f.path)).namelist()) or []
                out += [Part(f.path, n, 0, 0) for n in names if n.lower().endswith((".xml", ".txt"))]
            elif f.extension.lower() in ("xml", "txt"):
                out += [Part(f.path, None, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        return out

    def _documents(self, part: Part) -> list[tuple[int, bytes]]:
        """The wanted documents of a partition: those that have a wanted number in their text, if one is asked for."""
        store, _ = fs.FileSystem.from_uri(self.path)
        marks = [str(v).encode() for v in self.wanted.get("number", ())]
        marks += [m.group().encode() for v in self.wanted.get("canonical", ()) if (m := re.search(r"\d+", str(v)))]
        with store.open_input_file(part.path) as file:
            if part.member is None:
                file.seek(part.start)
                found = documents(file.read, part.start, part.end)
                return [d for d in found if not marks or any(m in d[1] for m in marks)]
            with zipfile.ZipFile(io.BufferedReader(file)) as z, z.open(part.member) as member:
                return [d for d in documents(member.read, 0, None) if not marks or any(m in d[1] for m in marks)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition:
            return
        for pos, xml in self._tried(partition.path, lambda: self._documents(partition)) or []:
            try:
                text = xml.decode("utf-8")
            except UnicodeDecodeError:
                text = xml.decode("latin-1")
            found = grant_record(re.sub(r"^[^>]*\?>", "", text).strip())
            if found and all(found[k] in values for k, values in self.wanted.items()):
                yield (*(found[c.split()[0]] for c in RECORD.split(", ")), f"{partition.path}!{partition.member or ''}", partition.start, pos)


class BulkGrants(DataSource):
    """Records of weekly bulk files under ``path``: plain XML, several documents to a file, and ZIP archives of such.

    A partition is a member of an archive, or a stretch of ``split`` bytes of a plain file; documents go to the stretch
    that they begin in. Filters by equality on number, canonical number and date reach the reader (see ``register``):
    files whose name tells another date aren't opened, and documents without the number aren't parsed. A read that the store fails is tried ``attempts`` times; broken archives and
    documents are passed over. Paths are those that pyarrow's file systems reach (local, HDFS, S3, GCS); for any other
    store of Spark's there is ``readers.bulk_grants``.
    """

    @classmethod
    def name(cls) -> str:
        return "bulk_grants"

    def schema(self) -> str:
        return f"{RECORD}, {PLACE}"

    def reader(self, schema) -> BulkReader:
        return BulkReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it: a reader that takes them needs that setting."""
    spark.dataSource.register(BulkGrants)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def grants(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records by way of the data source, of equal numbers the last by file name and place."""
    register(spark)
    return _last(spark.read.format("bulk_grants").options(**options).load(path), "canonical")
