"""Readers on small files of our own."""

import json
import zipfile

import pytest
from claimforge.sources import readers

GRANT = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE us-patent-grant SYSTEM "grant.dtd" [ ]>
<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><country>US</country><doc-number>{number}</doc-number><kind>B1</kind><date>20240102</date></document-id></publication-reference>
<invention-title>A <b>bold</b> hinge</invention-title><assignees><assignee><addressbook><orgname>Hinge Works</orgname></addressbook></assignee></assignees></us-bibliographic-data-grant>
<abstract><p>It turns.</p></abstract><claims><claim><claim-text>1. A hinge, comprising:<claim-text>a pin.</claim-text></claim-text></claim><claim><claim-text>2. The hinge of claim 1.</claim-text></claim></claims></us-patent-grant>
"""


def test_number_list(spark, tmp_path):
    (tmp_path / "n.csv").write_text("number,note\n US7654321 ,x\n,\nEP1234567B1,\n")
    assert [r["raw"] for r in readers.number_list(spark, str(tmp_path / "n.csv")).collect()] == ["US7654321", "EP1234567B1"]


def test_record_files_last_wins(spark, tmp_path):
    for name, title in (("a", "old"), ("b", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"canonical": "US-1-B2", "title": title, "claims": ["1. A thing."]}, indent=1))
    assert [(r["canonical"], r["title"]) for r in readers.record_files(spark, str(tmp_path)).collect()] == [("US-1-B2", "new")]


@pytest.mark.parametrize("array", [True, False])
def test_publications_in_both_forms(spark, tmp_path, array):
    rows = [{"publication_number": "US-1-B2", "publication_date": 20240102, "title_localized": [{"text": "t", "language": "en"}]}, {"country_code": "US"}, {"publication_number": "EP-2-A1"}]
    path = tmp_path / "p.json"
    path.write_text(json.dumps(rows) if array else "\n\n".join(map(json.dumps, rows)))
    assert sorted(r["publication_number"] for r in readers.publications(spark, str(path)).collect()) == ["EP-2-A1", "US-1-B2"]


def test_bulk_grants_plain_and_zipped(spark, tmp_path):
    (tmp_path / "week.xml").write_text(GRANT.format(number="09876543") + GRANT.format(number="00000007") + '<?xml version="1.0"?>\n<broken>')
    with zipfile.ZipFile(tmp_path / "week.zip", "w") as z:
        z.writestr("small.txt", "x")
        z.writestr("week2.xml", GRANT.format(number="01111111"))
    got = {r["canonical"]: r for r in readers.bulk_grants(spark, str(tmp_path)).collect()}
    assert set(got) == {"US-9876543-B1", "US-7-B1", "US-1111111-B1"}
    one = got["US-9876543-B1"]
    assert (one["title"], one["assignee"], one["pub_date"], len(one["claims"])) == ("A bold hinge", "Hinge Works", "2024-01-02", 2)


def test_legal_status_map(spark, tmp_path):
    event = lambda code, text: {"date": "2020-01-01", "code": code, "description": text}
    (tmp_path / "l.json").write_text(json.dumps({"A": {"events": [event("GRANT", "granted")]}, "B": {"events": [event("X", "lapsed"), event("Y", "reinstated")]}, "C": {"events": [event("X", "lapsed due to fee")]}, "D": {"status": "ACTIVE", "events": []}}))
    got = {r["canonical"]: (r["status"], r["evidence"]) for r in readers.legal_status(spark, str(tmp_path / "l.json")).collect()}
    assert got == {"A": ("UNKNOWN", None), "B": ("UNKNOWN", None), "C": ("LAPSED", "2020-01-01 X: lapsed due to fee"), "D": ("ACTIVE", None)}


def test_bulk_grants_pass_over_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "old.xml").write_bytes(GRANT.format(number="0123").replace("hinge", "hing\u00e9").encode("latin-1"))
    (tmp_path / "new.xml").write_text(GRANT.format(number="0123").replace("hinge", "newer hinge"))
    got = readers.bulk_grants(spark, str(tmp_path)).collect()
    assert [(r["canonical"], r["title"]) for r in got] == [("US-123-B1", "A bold hing\u00e9")]


def test_legal_xml_in_any_namespace(spark):
    xml = '<r xmlns="urn:x"><legal code="MM4A" date="20200101"><pre>LAPSE</pre></legal></r>'
    rows = readers.legal_xml(spark.createDataFrame([("A", xml), ("B", "<broken")], "canonical string, xml string")).collect()
    assert [(r["canonical"], r["code"], r["description"]) for r in rows] == [("A", "MM4A", "LAPSE")]
