"""Every query of the catalogue against its SQL, on the driver's smallest tables."""

from pathlib import Path

import pytest
from claimforge.plans import catalogue

from .compare import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert differences(catalogue.queries()[name](spark, SF), SF, catalogue.oracle_sql()[name]) == ""


def test_fingerprint_does_not_depend_on_partitioning(spark):
    first = catalogue.queries()["fingerprint"](spark, SF).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert catalogue.queries()["fingerprint"](spark, SF).collect() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
