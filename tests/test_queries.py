"""Every core query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

from lexgraph.constants import RELATIONS
from lexgraph.plans import queries as core
from tests.compare import connect, differing

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data_dir, con, name):
    assert differing(core.queries()[name](spark, data_dir), con, SQL[name]) == ""


def test_every_core_query_but_the_whole_pipeline_has_sql(spark, data_dir):
    assert set(core.queries()) - set(SQL) == {"pipeline_triples"}
    relations = {r.relation: r.n for r in core.queries()["pipeline_triples"](spark, data_dir).collect()}
    assert set(relations) <= set(RELATIONS) and sum(relations.values()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["relation", "a", "b"]
