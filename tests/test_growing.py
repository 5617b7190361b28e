"""Tables that grow with the records meet by a shuffle, and sources are dealt over tasks by their rows."""

import re

import pytest

from skuforge.operators import score
from skuforge.plans import registry
from skuforge.sources.tables import ROWS_A_TASK, save, spread

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    """How many tables the plan broadcasts that come from the part file."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+\-]*", line)[0])
    found = 0
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for x in plan[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            found += any("p_partkey" in x for x in below)
    return found


@pytest.mark.parametrize("name", ["audit_cells", "score_overall", "field_coverage", "issue_attach", "rule_missing_required", "judge_issues", "judge_review", "list_records", "shared_keys", "missing_keys"])
def test_no_table_of_records_is_broadcast(spark, name):
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and broadcasts(df) == 0


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    spark.range(2 * ROWS_A_TASK + 1).repartition(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    dealt = spread(rows, "id")
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 2 * ROWS_A_TASK + 1 == dealt.distinct().count()
    few = rows.limit(10)
    assert spread(few, "id") is few


@pytest.mark.parametrize("name", ["score_completeness", "score_overall", "batch_uplift", "judge_issues", "issue_attach", "rule_missing_required", "missing_required_counts", "missing_keys"])
def test_cells_meet_their_record_and_no_shuffle_is_by_record_and_key(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(record_id#\d+L?, key#", plan)


@pytest.mark.parametrize("name", ["peer_fill", "peer_fill_tiers", "consensus_fill", "find_outliers"])
def test_what_is_asked_of_groups_is_not_broadcast_as_it_runs(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    df.collect()
    # tables of groups, which stand on the right, may be
    assert "BuildLeft" not in df._jdf.queryExecution().executedPlan().toString()


def test_completeness_of_repeated_cells_and_records(spark):
    specs = spark.createDataFrame([("c", "a", 3, True), ("c", "b", 2, False), ("d", "a", 1, False)], "category string, key string, weight int, required boolean")
    cats = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d"), (4, "none"), (1, "c")], "record_id long, category string")
    cell = "record_id long, key string, confidence double, n_error int, n_warning int, n_info int"
    fields = spark.createDataFrame([(1, "a", 0.9, 0, 0, 0), (1, "a", 0.3, 0, 0, 0), (1, "z", 0.9, 0, 0, 0), (3, "a", 0.9, 0, 0, 0), (9, "a", 0.9, 0, 0, 0)], cell)
    got = {r.record_id: r.completeness for r in score.completeness(cats, fields, specs).collect()}
    assert got == {1: 64.3, 2: 0.0, 3: 100.0}  # record 1: (6 + 3) / (6 + 6 + 2)


def test_a_written_table_lets_garbage_go(spark):
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName()]
    before = sum(b.getCollectionCount() for b in beans)
    save(spark.range(3), "t")
    assert sum(b.getCollectionCount() for b in beans) > before
