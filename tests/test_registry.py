"""Every registered query equals its SQL on the smallest given tables."""

import os

import pytest

from joblattice.plans.catalog import QUERIES
from tests.compare import checker, compare

SF_DIR = os.environ.get("JOBLATTICE_SF_DIR", "/root/testdata/sf0.001")

MAY_BE_EMPTY = {"feed_page_by_cycle"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return checker(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, QUERIES[name], SF_DIR)
    # the smallest tables hold nothing for these
    assert said.startswith(("ok", "rows only")) or name in MAY_BE_EMPTY and SF_DIR.endswith("sf0.001") and said == "EMPTY", said


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(q.sql is None for q in QUERIES.values()) <= 3


def test_the_gate_and_its_name_measure_are_checked_by_sql():
    assert all(QUERIES[n].sql for n in ("name_similarities", "name_edit_similarities", "verification_gate"))
    assert "levenshtein" not in QUERIES["verification_gate"].sql


def test_postings_are_stored_without_keys_for_queries_that_need_none(spark, monkeypatch):
    from joblattice.plans import bindings

    monkeypatch.setattr(bindings, "_STORED", {})
    for name in ("feed_page", "cycle_sweep", "description_shards", "due_descriptions", "batch_rebuild", "standardized_postings"):
        QUERIES[name].run(spark, SF_DIR)
    assert [k[2] for k in bindings._STORED] == ["postings-unkeyed"]
    plain = spark.read.parquet(*bindings._STORED.values())
    keyed = bindings.bound(spark, SF_DIR, "postings")
    assert keyed.columns == [*plain.columns, *bindings.KEYS] and bindings.unkeyed(spark, SF_DIR, "postings").columns == plain.columns
    assert keyed.drop(*bindings.KEYS).exceptAll(plain).count() == 0


def test_stages_longer_than_the_jvm_compiles_are_split(spark):
    from joblattice.plans import bindings

    bindings.prepare(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
