import pytest

from skuforge.plans import registry
from tests.oracle import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert differ(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


#: Checked at a larger scale too, where groups and orders differ.
LARGER = "/root/testdata/sf0.01"
AT_LARGER = ("page_reduce", "phrase_find", "conflict_typed", "conflict_resolve", "enum_snap", "similar_words", "scan_mixed", "graph_drawn", "consensus_fill", "merged_issues", "containment_join_all", "delivery_template")


@pytest.mark.parametrize("name", AT_LARGER)
def test_query_equals_its_sql_at_a_larger_scale(spark, name):
    assert differ(spark, connect(LARGER), LARGER, registry.queries()[name], registry.oracle_sql()[name]) is None
