import math
import random

import pytest
from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import catalogue_state as state
from skuforge.operators import score

FIELD = "record_id long, key string, value string, unit string, confidence double, n_warning int, n_error int, n_info int"


@pytest.fixture(scope="module")
def catalogue(spark):
    draw = random.Random(5)
    scored = spark.createDataFrame([(i, draw.choice(("fastener", "metal_panel")), draw.randint(0, 1000) / 10, draw.choice("ABCDF")) for i in range(3000)], "record_id long, category string, overall double, grade string").cache()
    fields = [(i, key, f"v{draw.randrange(900)}", "", draw.choice((0.3, 0.7, 0.95)), draw.randrange(2), draw.randrange(2), 0) for i in range(3000) for key in ("brand", "material", "diameter") if draw.random() < 0.7]
    return scored, spark.createDataFrame(fields, FIELD).cache()


def test_ten_batches_merge_to_what_one_pass_gives(spark, catalogue, tmp_path):
    scored, fields = catalogue
    folder = str(tmp_path / "states")
    for b in range(10):
        state.store(state.states(scored.filter(F.col("record_id") % 10 == b), fields, D.specs(spark), F.lit(b)), folder)
    state.store(state.states(scored.filter(F.col("record_id") % 10 == 3), fields, D.specs(spark), F.lit(3)), folder)  # again
    whole = state.merged(state.stored(spark, folder))
    one = score.field_coverage(scored, fields, D.specs(spark))
    assert sorted(map(tuple, state.coverage(whole).drop("distinct_values").collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
    for r in state.coverage(whole).collect():
        exact = scored.join(D.specs(spark).filter(F.col("key") == r.key).select("category"), "category").join(fields.filter(F.col("key") == r.key), "record_id").select("value").distinct().count()
        assert abs(r.distinct_values - exact) <= 4 * 0.016 * exact + 1
    want = {(r.category, r.grade): (r.records, math.floor(r.mean * 10 + 0.5) / 10) for r in scored.groupBy("category", "grade").agg(F.count("*").alias("records"), (F.sum(F.round(F.col("overall") * 10)) / 10 / F.count("*")).alias("mean")).collect()}
    assert {(r.category, r.grade): (r.records, r.mean_overall) for r in state.grades(whole).collect()} == want
    for r in state.quantiles(whole).collect():
        own = sorted(x.overall for x in scored.filter(F.col("category") == r.category).collect())
        for q in (10, 50, 90):
            rank = sum(x <= r[f"q{q}"] for x in own) / len(own)
            assert abs(rank - q / 100) < 0.03
    issues = fields.agg(F.sum("n_error").alias("error"), F.sum("n_warning").alias("warning")).first()
    totals = state.issue_totals(whole).groupBy("severity").agg(F.sum("n").alias("n")).collect()
    assert {r.severity: r.n for r in totals} == {"error": issues.error, "warning": issues.warning}


def test_no_records(spark, catalogue, tmp_path):
    scored, fields = catalogue
    none = state.merged(state.states(scored.limit(0), fields, D.specs(spark), F.lit(1)))
    assert none.count() == 0 and state.coverage(none).count() == 0 and state.quantiles(none).count() == 0
