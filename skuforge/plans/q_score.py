"""Scores and catalogue statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import catalogue_state as state
from skuforge.operators import review, score
from skuforge.plans.registry import query
from skuforge.sources import tables
from skuforge.sources import views as V

ALL = f"WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}, {score.SQL_COMPLETENESS}, {score.SQL_ACCURACY}, {score.SQL_CONSISTENCY}, {score.SQL_RICHNESS}, {score.SQL_OVERALL}"


def scored(spark, sf):
    return score.overall(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark)).drop("name")


@query("score_completeness", f"{ALL} SELECT record_id, completeness FROM completeness")
def score_completeness(spark, sf):
    return score.completeness(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark)).select("record_id", "completeness")


@query("score_accuracy", f"{ALL} SELECT * FROM accuracy")
def score_accuracy(spark, sf):
    return score.accuracy(V.fields(spark, sf))


@query("score_consistency", f"{ALL} SELECT * FROM consistency")
def score_consistency(spark, sf):
    return score.consistency(V.fields(spark, sf))


@query("score_richness", f"{ALL} SELECT * FROM richness")
def score_richness(spark, sf):
    return score.richness(V.categories(spark, sf), V.fields(spark, sf))


@query("score_overall", f"{ALL} SELECT record_id, category, brand, completeness, accuracy, consistency, richness, overall, grade FROM overall")
def score_overall(spark, sf):
    return scored(spark, sf).select("record_id", "category", "brand", "completeness", "accuracy", "consistency", "richness", "overall", "grade")


MEAN = "floor(CAST(sum(CAST(round({0} * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*) * 10 + 5e-1) / 10e0"


def mean(c: str):
    from skuforge.functions import scalars as S

    return S.half_up(F.sum(F.round(F.col(c) * 10).cast("long")).cast("double") / 10 / F.count("*"), 1)


@query("catalog_stats", f"{ALL} SELECT count(*) AS records, {MEAN.format('completeness')} AS avg_before, {MEAN.format('overall')} AS avg_after, min(overall) AS lowest, max(overall) AS highest FROM overall")
def catalog_stats(spark, sf):
    return scored(spark, sf).agg(F.count("*").alias("records"), mean("completeness").alias("avg_before"), mean("overall").alias("avg_after"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"))


@query("grade_mix", f"{ALL} SELECT grade, count(*) AS n FROM overall GROUP BY 1")
def grade_mix(spark, sf):
    return scored(spark, sf).groupBy("grade").agg(F.count("*").alias("n"))


@query("category_counts", f"WITH {V.SQL_CATEGORY} SELECT category, count(*) AS n FROM category GROUP BY 1")
def category_counts(spark, sf):
    return V.categories(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query("category_grade_rollup", f"{ALL} SELECT category, grade, count(*) AS n FROM overall GROUP BY ROLLUP (category, grade)")
def category_grade_rollup(spark, sf):
    return scored(spark, sf).rollup("category", "grade").agg(F.count("*").alias("n"))


COVERAGE = f"""{ALL}, j AS (SELECT key, CASE WHEN value IS NOT NULL THEN CAST(floor({score.SQL_PENALISED} * 1000 + 5e-1) AS BIGINT) END AS p FROM category JOIN spec USING (category) LEFT JOIN fields USING (record_id, key))
    SELECT key, count(*) AS applicable, count(p) AS filled, floor(count(p) * 100e0 / count(*) * 10 + 5e-1) / 10e0 AS fill_rate, floor(CAST(sum(p) AS DOUBLE) / 1000 / nullif(count(p), 0) * 100 + 5e-1) / 100e0 AS mean_confidence FROM j GROUP BY 1"""


@query("field_coverage", COVERAGE)
def field_coverage(spark, sf):
    return score.field_coverage(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark))


@query("issue_mix", f"WITH {V.SQL_FIELDS} SELECT key, 'error' AS severity, CAST(sum(n_error) AS BIGINT) AS n FROM fields GROUP BY 1 UNION ALL SELECT key, 'warning', CAST(sum(n_warning) AS BIGINT) FROM fields GROUP BY 1 UNION ALL SELECT key, 'info', CAST(sum(n_info) AS BIGINT) FROM fields GROUP BY 1")
def issue_mix(spark, sf):
    each = V.fields(spark, sf).groupBy("key").agg(F.sum("n_error").alias("error"), F.sum("n_warning").alias("warning"), F.sum("n_info").alias("info"))
    return each.unpivot("key", ["error", "warning", "info"], "severity", "n")


@query("top_issues", f"WITH {V.SQL_FIELDS} SELECT concat(key, '_ERROR') AS code, CAST(sum(n_error) AS BIGINT) AS n FROM fields GROUP BY 1 ORDER BY n DESC, code LIMIT 12")
def top_issues(spark, sf):
    return V.fields(spark, sf).groupBy(F.concat("key", F.lit("_ERROR")).alias("code")).agg(F.sum("n_error").alias("n")).orderBy(F.desc("n"), "code").limit(12)


@query("weakest_k", f"{ALL} SELECT record_id, overall, floor((overall - completeness) * 10 + 5e-1) / 10e0 AS uplift FROM overall ORDER BY overall, record_id LIMIT 15")
def weakest_k(spark, sf):
    uplift = F.floor((F.col("overall") - F.col("completeness")) * 10 + 0.5) / 10.0
    return scored(spark, sf).orderBy("overall", "record_id").limit(15).select("record_id", "overall", uplift.alias("uplift"))


@query("list_records", f"""{ALL}, f AS (SELECT record_id, count(*) AS flagged FROM fields WHERE n_error > 0 GROUP BY 1)
    SELECT record_id, brand, coalesce(flagged, 0) AS flagged, overall FROM overall LEFT JOIN f USING (record_id) WHERE brand LIKE '%#1%' AND grade IN ('B', 'C', 'D') ORDER BY coalesce(flagged, 0) DESC, overall, record_id LIMIT 500""")
def list_records(spark, sf):
    flagged = V.fields(spark, sf).filter("n_error > 0").groupBy("record_id").agg(F.count("*").alias("flagged"))
    rows = scored(spark, sf).filter(F.col("brand").contains("#1") & F.col("grade").isin("B", "C", "D")).join(tables.growing(flagged), "record_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))
    return rows.orderBy(F.desc("flagged"), "overall", "record_id").limit(500).select("record_id", "brand", "flagged", "overall")


@query("batch_summary", f"""{ALL}, r AS ({review.SQL_ROUTED}) SELECT (SELECT count(*) FROM overall) AS total, (SELECT count(*) FROM r) AS filled, (SELECT count(*) FROM r WHERE state = 'needs_review') AS flagged,
    (SELECT {MEAN.format('completeness')} FROM overall) AS avg_before, (SELECT {MEAN.format('overall')} FROM overall) AS avg_after""")
def batch_summary(spark, sf):
    cells = review.route(V.fields(spark, sf)).agg(F.count("*").alias("filled"), F.count(F.when(F.col("state") == "needs_review", 1)).alias("flagged"))
    records = scored(spark, sf).agg(F.count("*").alias("total"), mean("completeness").alias("avg_before"), mean("overall").alias("avg_after"))
    return records.crossJoin(F.broadcast(cells)).select("total", "filled", "flagged", "avg_before", "avg_after")


def _merged(spark, sf):
    """Statistics of ten batches, each stored by itself, merged."""
    folder = tables.shared_folder(spark) + f"/catalogue-state-{uuid.uuid4().hex}"
    # written, as each part of a state reads them
    done, cells = tables.save(scored(spark, sf), "scored"), tables.save(V.fields(spark, sf), "cells")
    state.store(state.states(done, cells, D.specs(spark), F.col("record_id") % 10), folder)
    return state.merged(state.stored(spark, folder))


@query("merged_coverage", COVERAGE)
def merged_coverage(spark, sf):
    return state.coverage(_merged(spark, sf)).drop("distinct_values")


@query("merged_grades", f"{ALL} SELECT category, grade, count(*) AS records, floor(CAST(sum(CAST(round(overall * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*) * 10 + 5e-1) / 10e0 AS mean_overall FROM overall GROUP BY 1, 2")
def merged_grades(spark, sf):
    return state.grades(_merged(spark, sf))


@query("merged_issues", f"WITH {V.SQL_FIELDS} SELECT * FROM (SELECT key, 'error' AS severity, CAST(sum(n_error) AS BIGINT) AS n FROM fields GROUP BY 1 UNION ALL SELECT key, 'warning', CAST(sum(n_warning) AS BIGINT) FROM fields GROUP BY 1 UNION ALL SELECT key, 'info', CAST(sum(n_info) AS BIGINT) FROM fields GROUP BY 1) WHERE n > 0")
def merged_issues(spark, sf):
    return state.issue_totals(_merged(spark, sf))
