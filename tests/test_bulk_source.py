"""The bulk data source: plain files in stretches, archives by member, pushed filters, broken files and failing stores."""

from __future__ import annotations

import io
import zipfile

import pytest
from claimforge.sources import bulk, readers
from pyspark.sql import functions as F


def grant(n: int, title: str, day: str = "20200107") -> str:
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE us-patent-grant SYSTEM "x.dtd" [ ]>
<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><country>US</country><doc-number>{n:08d}</doc-number>
<kind>B2</kind><date>{day}</date></document-id></publication-reference><invention-title>{title}</invention-title></us-bibliographic-data-grant>
<abstract><p>About {title}</p></abstract><claims><claim><claim-text>1. A {title}.</claim-text></claim></claims></us-patent-grant>
"""


@pytest.fixture
def weeks(tmp_path):
    folder = tmp_path / "weeks"
    folder.mkdir()
    (folder / "ipg200107.xml").write_text("junk before\n" + "".join(grant(i, f"title {i}") for i in range(1, 30)) + "<?xml broken <a>")
    with zipfile.ZipFile(folder / "ipg200114.zip", "w") as z:
        z.writestr("a.xml", "".join(grant(i, f"café {i}", "20200114") for i in range(20, 40)))
        z.writestr("b.xml", grant(50, "caf\xe9", "20200114").encode("latin-1"))
        z.writestr("readme.md", "no grants")
    (folder / "ipg200121.zip").write_bytes(b"PK not an archive")
    (folder / "_SUCCESS").write_text("")
    return str(folder)


@pytest.mark.parametrize("split", [100, 777, bulk.SPLIT])
def test_every_document_once(spark, weeks, split):
    bulk.register(spark)
    found = spark.read.format("bulk_grants").options(split=str(split)).load(weeks).collect()
    assert sorted(r["number"] for r in found) == sorted([str(i) for i in range(1, 30)] + [str(i) for i in range(20, 40)] + ["50"])
    assert {r["title"] for r in found if r["number"] == "50"} == {"café"}


@pytest.mark.parametrize("block", [7, 64, 2**20])
def test_stretches_part_a_file(monkeypatch, block):
    """Whatever the stretches and blocks, each document comes whole and once, at its place."""
    monkeypatch.setattr(bulk, "BLOCK", block)
    data = b"head<?xml a?><x/>\n<?xml b?><y>" + b"z" * 50 + b"</y><?xml c?>" + b"<?xm" + b"<?xml d?>"
    whole = list(bulk.documents(io.BytesIO(data).read, 0, None))
    assert b"".join(d for _, d in whole) == data[4:] and [data[a : a + 5] for a, _ in whole] == [b"<?xml"] * 4
    for size in (1, 5, 13, 40):
        got = []
        for a in range(0, len(data), size):
            file = io.BytesIO(data)
            file.seek(a)
            got += bulk.documents(file.read, a, a + size)
        assert got == whole


def test_last_of_equal_numbers_counts(spark, weeks):
    """As the other reader has it, over plain files and archives of one member."""
    got = {r["canonical"]: (r["title"], r["pub_date"], r["claims"]) for r in bulk.grants(spark, weeks).collect()}
    want = {r["canonical"]: (r["title"], r["pub_date"], r["claims"]) for r in readers.bulk_grants(spark, weeks).collect()}
    assert got.pop("US-50-B2")[0] == "café"  # that reader takes the largest member only
    assert got == want and got["US-25-B2"][0] == "café 25" and got["US-5-B2"][0] == "title 5"


def test_filters_reach_the_reader(spark, weeks):
    rows = bulk.grants(spark, weeks).filter(F.col("canonical").isin("US-7-B2", "US-33-B2", "US-999-B2"))
    assert {r["number"] for r in rows.collect()} == {"7", "33"}
    plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(canonical" in plan.replace("canonical IN", "In(canonical") or "canonical IN" in plan


def test_a_date_leaves_files_shut(weeks):
    reader = bulk.BulkReader({"path": weeks})
    assert list(reader.pushFilters([bulk.EqualTo(("pub_date",), "2020-01-14"), bulk.EqualTo(("title",), "x")])) == [bulk.EqualTo(("title",), "x")]
    assert {p.member for p in reader.partitions()} == {"a.xml", "b.xml"}
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 21


def test_a_failing_store_is_asked_again(weeks, monkeypatch):
    reader, calls = bulk.BulkReader({"path": weeks, "attempts": "3"}), []
    real = reader._documents

    def failing(part):
        calls.append(part)
        if len(calls) < 3:
            raise OSError("not now")
        return real(part)

    reader._documents = failing
    with pytest.warns(UserWarning, match="not now"):
        assert len(list(reader.read(bulk.Part(f"{weeks}/ipg200114.zip", "b.xml", 0, 0)))) == 1
    reader._documents = lambda part: (_ for _ in ()).throw(OSError("never"))
    with pytest.warns(UserWarning), pytest.raises(OSError, match="never"):
        list(reader.read(bulk.Part("x", None, 0, 0)))
