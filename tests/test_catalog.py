"""Every named query against its SQL, and the driver's entry points."""

from pathlib import Path

import pytest

import __spark_entry__
import catalog
from catalog import ingestion
from catalog.check import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) is None


def test_page_cap_lands_every_page_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingestion, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    ingestion.page_cap(spark, SF).collect()
    landed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(str(tmp_path))
    assert landed.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["priority", "total", "with_dmc", "without_dmc", "with_dmc_pct"]
