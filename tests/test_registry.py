from __future__ import annotations

import pytest
from compare import connect, same

from tessera import registry

SF = "/root/testdata/sf0.001"
EMPTY_BY_INTENT = {"group_null_id_empty", "count_stage_empty"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    rows = registry.entry(spark, SF).collect()
    assert [tuple(r["_id"]) for r in rows] == sorted(tuple(r["_id"]) for r in rows) and len(rows) >= 4


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    n = same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
    if name not in EMPTY_BY_INTENT:
        assert n or name.startswith(("geo_", "match_and", "zset_range_score", "match_after_group")), "a vacuous comparison"


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, SF).collect()
