"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

import verify
from corvane.plans import catalogue, catalogue_batches, catalogue_rules  # noqa: F401  the others register more queries
from tests_support import shuffled


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, con, sf, name):
    assert verify.compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name), sf) == ""


@pytest.mark.parametrize("name", ["relation_sum_verdict", "asof_latest", "scope_select", "adjacent_windows", "owner_resolution", "align_groups"])
def test_row_order_and_partitions_do_not_matter(spark, sf, name, monkeypatch):
    df = catalogue.QUERIES[name](spark, sf)
    once = verify.rows_of(df.columns, [tuple(r) for r in df.collect()])
    monkeypatch.setattr(catalogue, "t", shuffled(catalogue.t))
    df = catalogue.QUERIES[name](spark, sf)
    assert verify.rows_of(df.columns, [tuple(r) for r in df.collect()]) == once
