import re

from skuforge.operators import score

CATS = "record_id long, category string, brand string"
CELLS = "record_id long, key string, confidence double, n_error int, n_warning int, n_info int"
SPECS = "category string, key string, weight double, required boolean"


def test_cells_meet_their_record_without_a_shuffle_by_record_and_key(spark):
    cats = spark.range(2000).selectExpr("id AS record_id", "'bolt' AS category", "'b' AS brand").repartition(5, "record_id")
    cells = spark.range(2000).selectExpr("id AS record_id", "explode(array('grit', 'finish')) AS key", "0.9D AS confidence", "0 AS n_error", "0 AS n_warning", "0 AS n_info").repartition(5, "record_id")
    specs = spark.createDataFrame([("bolt", "grit", 2.0, True), ("bolt", "finish", 1.0, False)], SPECS)
    done = score.completeness(cats, cells, specs)
    plan = done._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert not [x for x in dealt if "record_id" in x and "key" in x]
    assert {r.completeness for r in done.collect()} == {100.0}


def test_completeness_of_repeated_missing_and_unknown_cells(spark):
    cats = [(1, "bolt", "b"), (2, "bolt", None), (3, "bolt", "b"), (4, "none", "b"), (5, "bolt", "b")]
    # record 1 has a key twice, 3 a key without a spec, 5 a weak cell
    cells = [(1, "grit", 0.9, 0, 0, 0), (1, "grit", 0.1, 0, 0, 0), (3, "mass", 0.9, 0, 0, 0), (5, "grit", 0.9, 2, 0, 0), (5, "finish", 0.9, 0, 0, 0)]
    specs = spark.createDataFrame([("bolt", "grit", 2.0, True), ("bolt", "finish", 1.0, False)], SPECS)
    got = {r.record_id: r.completeness for r in score.completeness(spark.createDataFrame(cats, CATS), spark.createDataFrame(cells, CELLS), specs).collect()}
    assert got == {1: 66.7, 2: 0.0, 3: 0.0, 5: 60.0}
