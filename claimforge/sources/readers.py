"""Readers. All of them go through Spark's own file readers, so any store that Spark reads will do."""

from __future__ import annotations

import io
import re
import warnings
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.legal import classify

RECORD = (
    "canonical string, office string, number string, title string, abstract string, claims array<string>, assignee string, pub_date string, "
    "legal_status string, family_id string, source string, source_url string, notes array<string>"
)
TEXTS = "array<struct<text:string,language:string>>"
PUBLICATION = (
    "publication_number string, country_code string, kind_code string, application_number string, publication_date bigint, filing_date bigint, "
    f"grant_date bigint, family_id string, title_localized {TEXTS}, abstract_localized {TEXTS}, claims_localized {TEXTS}, "
    "cpc array<struct<code:string>>, assignee_harmonized array<struct<name:string,country_code:string>>"
)
LEGAL = "map<string,struct<status:string,events:array<struct<date:string,code:string,description:string>>>>"
CASE = (
    "name string, description string, target_spec string, patent struct<canonical:string,office:string,number:string,title:string,claims:array<string>>, "
    "expected_verdicts array<struct<element_substring:string,expected:string,rationale:string>>"
)
WORKSHEET = "array<struct<canonical:string,element:string,verdict:string,evidence_span:string,confidence:string,rationale:string>>"


def number_list(spark: SparkSession, path: str) -> DataFrame:
    """``raw, note`` of a CSV with a header, blank numbers dropped."""
    rows = spark.read.option("header", True).csv(path)
    note = F.col("note") if "note" in rows.columns else F.lit(None).cast("string")
    return rows.select(strip(F.col("number")).alias("raw"), note.alias("note")).filter("raw <> ''")


def record_files(spark: SparkSession, directory: str) -> DataFrame:
    """Records, one JSON object per file; of files with one canonical number the last by name counts."""
    rows = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory).withColumn("_file", F.input_file_name())
    last = Window.partitionBy("canonical").orderBy(F.desc("_file"))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "_file")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """An export of publication rows: a JSON array, or one object a line. The first character tells which."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    rows = spark.read.schema(PUBLICATION).option("multiLine", bool(head) and head["c"] == "[").json(path)
    rows = rows.select("*", *_place()).filter("publication_number IS NOT NULL AND publication_number <> ''")
    return _last(rows, "publication_number")


def _place() -> list[Column]:
    """Where a row stands: file name, start of the part of the file that one task reads, and order within that."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_pos")]


def _last(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with one key the last by file name and place, however the files were split."""
    order = Window.partitionBy(*key).orderBy(F.desc("_file"), F.desc("_start"), F.desc("_pos"))
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_file", "_start", "_pos")


def legal_status(spark: SparkSession, path: str) -> DataFrame:
    """``canonical, status, evidence, needs_review`` of a JSON map; a given status counts, evidence comes from events."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LEGAL)).alias("canonical", "v"))
    events = rows.select("canonical", F.posexplode("v.events").alias("pos", "e")).select("canonical", "pos", "e.date", "e.code", "e.description")
    found = classify(events)
    status = F.coalesce(F.nullif("v.status", F.lit("")), found["status"], F.lit("UNKNOWN"))
    return rows.join(found, "canonical", "left").select("canonical", status.alias("status"), found["evidence"], (status == "UNKNOWN").alias("needs_review"))


def worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Filled verdict rows of a worksheet, of equal elements of a record the last: a JSON document (an object with
    ``elements``, or a bare list), or, where the path doesn't end in ``.json``, a folder of rows, one a line, as
    ``write_worksheet`` leaves it. Rows without an element are dropped."""
    if not path.endswith(".json"):
        row = WORKSHEET.removeprefix("array<struct<").removesuffix(">>").replace(":", " ")
        rows = spark.read.schema(row).json(path).select("*", *_place()).withColumn("element", F.trim("element")).filter("element <> ''")
        return _last(rows, "canonical", "element")
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.elements"), WORKSHEET), F.from_json("value", WORKSHEET))
    rows = text.select(F.posexplode(listed).alias("pos", "e")).select("pos", "e.*").withColumn("element", F.trim("element")).filter("element <> ''")
    last = Window.partitionBy("canonical", "element").orderBy(F.desc("pos"))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "pos")


def write_worksheet(elements: DataFrame, path: str) -> None:
    """Every element of every record once, a JSON line each, to be filled in: ``verdict``, ``evidence_span`` (copied from
    the specification to the letter, else empty), ``confidence`` from 0 to 1, ``rationale``."""
    blank = [F.lit("").alias(c) for c in ("verdict", "evidence_span", "confidence", "rationale")]
    rows = elements.groupBy("canonical", F.trim("element").alias("element")).agg(F.min("pos").alias("pos"))
    rows.select("canonical", "pos", "element", *blank).write.mode("overwrite").json(path)


def golden_cases(spark: SparkSession, directory: str) -> DataFrame:
    """``case, spec, claims, labels`` of labelled cases, one JSON object per file; of cases with one name the last by file
    name counts."""
    rows = spark.read.schema(CASE).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory).withColumn("_file", F.input_file_name())
    last = Window.partitionBy("name").orderBy(F.desc("_file"))
    rows = rows.filter("name IS NOT NULL").withColumn("_k", F.row_number().over(last)).filter("_k = 1")
    return rows.select(F.col("name").alias("case"), F.col("target_spec").alias("spec"), "patent.claims", F.col("expected_verdicts").alias("labels"))


def _text(node: ElementTree.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def grant_record(xml: str) -> dict | None:
    """One bulk grant document as a record; none if it doesn't parse."""
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", xml, flags=re.S))
    except ElementTree.ParseError:
        return None
    at = root.find(".//publication-reference/document-id")
    if at is None:
        return None
    number = _text(at.find("doc-number")).lstrip("0") or "0"
    day, kind = _text(at.find("date")), _text(at.find("kind"))
    texts = [" ".join(filter(None, map(_text, c.findall("claim-text")))) or _text(c) for c in root.findall(".//claims/claim")]
    title, abstract = _text(root.find(".//invention-title")), _text(root.find(".//abstract"))
    notes = [n for missing, n in ((not title, "title missing"), (not abstract, "abstract missing"), (not texts, "claims missing")) if missing]
    return {
        "canonical": f"US-{number}" + (f"-{kind}" if kind else ""), "office": _text(at.find("country")) or "US", "number": number, "title": title,
        "abstract": abstract, "claims": [t for t in texts if t], "assignee": _text(root.find(".//assignees/assignee/addressbook/orgname")) or None,
        "pub_date": f"{day[:4]}-{day[4:6]}-{day[6:]}" if re.fullmatch(r"[0-9]{8}", day) else None, "legal_status": None, "family_id": None,
        "source": "bulk", "source_url": None, "notes": notes,
    }


def bulk_grants(spark: SparkSession, path: str, plain_files: str = "*.xml") -> DataFrame:
    """Records of weekly bulk files: XML, several documents to a file, or ZIP files whose largest member is such a file.

    Plain files are cut at their prologs by Spark's text reader, so one file is read by many tasks; each ZIP is one.
    Broken documents, and files that can't be read, are passed over with a warning in the task's log; text that isn't
    UTF-8 is read as Latin-1. Of equal numbers the last counts, by file name and place.
    """
    plain = spark.read.option("lineSep", "<?xml").option("pathGlobFilter", plain_files).option("ignoreCorruptFiles", True).text(path)
    legible = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    plain = plain.select(F.regexp_replace(legible, r"^[^>]*\?>", "").alias("xml"), *_place())
    zipped = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("ignoreCorruptFiles", True).load(path).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        data = z.read(max(z.infolist(), key=lambda i: i.file_size))
                except (zipfile.BadZipFile, zlib.error, OSError, ValueError, NotImplementedError, RuntimeError) as e:
                    warnings.warn(f"{name}: {e}", stacklevel=1)
                    continue
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = data.decode("latin-1")
                parts = [re.sub(r"^[^>]*\?>", "", part) for part in text.split("<?xml")]
                yield pd.DataFrame({"xml": parts, "_file": name, "_start": 0, "_pos": range(len(parts))})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r | {p: x[p] for p in places} for x in b.to_dict("records") if (r := grant_record(x["xml"].strip()))]
            yield pd.DataFrame(found, columns=[*(c.split()[0] for c in RECORD.split(", ")), *places])

    places = ("_file", "_start", "_pos")
    where = "_file string, _start bigint, _pos bigint"
    documents = plain.unionByName(zipped.mapInPandas(members, f"xml string, {where}"))
    return _last(documents.filter(F.trim("xml") != "").mapInPandas(parse, f"{RECORD}, {where}"), "canonical")


def week_file(day) -> F.Column:
    """Name of the weekly file of a grant date."""
    return F.concat(F.lit("ipg"), F.date_format(day, "yyMMdd"), F.lit(".zip"))


def legal_xml(documents: DataFrame) -> DataFrame:
    """``canonical, pos, date, code, description`` of legal elements in any namespace; ``documents``: canonical, xml."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda e: e.tag.rpartition("}")[2]
        for b in batches:
            out = []
            for canonical, xml in zip(b["canonical"], b["xml"], strict=True):
                try:
                    found = [e for e in ElementTree.fromstring(xml).iter() if local(e) == "legal"]
                except ElementTree.ParseError:
                    continue
                for pos, e in enumerate(found):
                    said = [_text(c) for c in e.iter() if local(c) in ("L500EP", "pre", "legal-description", "text")]
                    day = e.get("date") or next((_text(c) for c in e.iter() if local(c) == "L007EP"), None)
                    out.append((canonical, pos, day, e.get("code"), " / ".join(filter(None, said))))
            yield pd.DataFrame(out, columns=["canonical", "pos", "date", "code", "description"])

    return documents.select("canonical", "xml").mapInPandas(parse, "canonical string, pos int, date string, code string, description string")


def retrying(fetch: Callable[[str], dict | None], attempts: int = 3) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas``: a live look-up per number, tried again on failure, each attempt in the log column."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for number in b["canonical"]:
                log, found = [], None
                for k in range(max(1, attempts)):
                    try:
                        found = fetch(number)
                        log.append("hit" if found else "miss")
                        break
                    except Exception as e:  # noqa: BLE001
                        log.append(f"error: {e}")
                        if k + 1 >= max(1, attempts):
                            raise
                out.append({**{n: None for n in names}, **(found or {}), "canonical": number, "attempts": log})
            yield pd.DataFrame(out, columns=[*names, "attempts"])

    return run


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fixture": record_files,
    "export": publications,
    "bulk": bulk_grants,
}
