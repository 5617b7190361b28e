"""Quality scores of records and statistics of a catalogue. Long cells joined with few specs; sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.sources.tables import growing

WEIGHTS = {"completeness": 0.35, "accuracy": 0.25, "consistency": 0.20, "richness": 0.20}
#: Content fields with the number of characters they should have.
RICHNESS_TARGETS = {"short_desc": 24, "series": 3, "finish": 6, "grit": 4}


def penalised() -> Column:
    """Confidence less 0.35, 0.12 and 0.02 for each open error, warning and note; from zero on, three digits."""
    x = F.col("confidence") - F.col("n_error") * 0.35 - F.col("n_warning") * 0.12 - F.col("n_info") * 0.02
    return S.half_up(F.greatest(F.lit(0.0), x), 3)


SQL_PENALISED = "floor(greatest(0e0, confidence - n_error * 35e-2 - n_warning * 12e-2 - n_info * 2e-2) * 1000 + 5e-1) / 1000e0"


def completeness(categories: DataFrame, fields: DataFrame, specs: DataFrame) -> DataFrame:
    """categories with completeness from 0 to 100: the weights (twice for required keys) of what is filled, half of it
    below a penalised confidence of 0.5."""
    wanted = specs.select("category", "key", (F.col("weight") * F.when(F.col("required"), 2).otherwise(1)).alias("w"))
    have = fields.select("record_id", "key", F.when(penalised() >= 0.5, 1.0).otherwise(0.5).alias("credit"))
    # cells meet their record, which needs no shuffle by record and key; what isn't filled counts in the category's total
    joined = categories.distinct().join(growing(have), "record_id", "left").join(F.broadcast(wanted), ["category", "key"], "left")
    each = joined.groupBy(*categories.columns, "key", "w").agg(F.sum("credit").alias("credit"), (F.count("*") - 1).alias("again"))
    got = each.groupBy(*categories.columns).agg(F.coalesce(F.sum(F.col("w") * F.col("credit")), F.lit(0.0)).alias("got"), F.coalesce(F.sum(F.col("w") * F.col("again")), F.lit(0.0)).alias("again"))
    total = wanted.groupBy("category").agg(F.sum("w").alias("total"))
    share = F.col("got") / (F.col("total") + F.col("again"))
    return got.join(F.broadcast(total), "category").select(*categories.columns, S.half_up(share * 100, 1).alias("completeness"))


SQL_COMPLETENESS = f"""completeness AS (
    SELECT record_id, floor(sum(weight * (CASE WHEN required THEN 2 ELSE 1 END) * (CASE WHEN value IS NULL THEN 0e0 WHEN {SQL_PENALISED} >= 5e-1 THEN 1e0 ELSE 5e-1 END))
        / sum(weight * (CASE WHEN required THEN 2 ELSE 1 END)) * 100 * 10 + 5e-1) / 10e0 AS completeness
    FROM category JOIN spec USING (category) LEFT JOIN fields USING (record_id, key) GROUP BY 1)"""


def accuracy(fields: DataFrame) -> DataFrame:
    """record_id, accuracy: mean penalised confidence, less 0.08 for each cell with an error (0.30 at most) and 0.02 for each
    cell without evidence (0.15 at most), times 100, from zero on. Thousandths are summed as whole numbers."""
    mean = F.sum((penalised() * 1000 + 0.5).cast("long")).cast("double") / 1000 / F.count("*")
    errors = F.least(F.lit(0.30), F.sum(F.when(F.col("n_error") > 0, 1).otherwise(0)) * 0.08)
    bare = F.least(F.lit(0.15), F.sum(F.when(F.col("source") == "inferred", 1).otherwise(0)) * 0.02)
    return fields.groupBy("record_id").agg(S.half_up(F.greatest(F.lit(0.0), mean - errors - bare) * 100, 1).alias("accuracy"))


SQL_ACCURACY = f"""accuracy AS (
    SELECT record_id, floor(greatest(0e0, CAST(sum(CAST(floor({SQL_PENALISED} * 1000 + 5e-1) AS BIGINT)) AS DOUBLE) / 1000 / count(*) - least(30e-2, sum(CASE WHEN n_error > 0 THEN 1 ELSE 0 END) * 8e-2)
        - least(15e-2, sum(CASE WHEN source = 'inferred' THEN 1 ELSE 0 END) * 2e-2)) * 100 * 10 + 5e-1) / 10e0 AS accuracy FROM fields GROUP BY 1)"""


def consistency(fields: DataFrame) -> DataFrame:
    """record_id, consistency: 100 less 18 an error and 6 a warning, times 0.85 and up to 0.15 more for cells in a unit."""
    units = F.sum(F.when(F.col("unit") != "", 1).otherwise(0)) / F.count("*")
    x = (100 - 18 * F.sum("n_error") - 6 * F.sum("n_warning")) * (F.lit(0.85) + F.lit(0.15) * units)
    return fields.groupBy("record_id").agg(S.half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), 1).alias("consistency"))


SQL_CONSISTENCY = """consistency AS (
    SELECT record_id, floor(least(100e0, greatest(0e0, (100 - 18 * sum(n_error) - 6 * sum(n_warning)) * (85e-2 + 15e-2 * (CAST(sum(CASE WHEN unit <> '' THEN 1 ELSE 0 END) AS DOUBLE) / count(*))))) * 10 + 5e-1) / 10e0 AS consistency
    FROM fields GROUP BY 1)"""


def richness(categories: DataFrame, fields: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """record_id, richness: over the target fields, 1 at the target length, 0.6 within 30 percent of it, 0.25 if there."""
    targets = targets or RICHNESS_TARGETS
    n = F.length("value")
    goal = F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, v)))[F.col("key")]
    credit = F.when(n >= goal, 1.0).when(n >= goal * 0.7, 0.6).otherwise(0.25)
    got = fields.filter(F.col("key").isin(*targets)).groupBy("record_id").agg(F.sum((credit * 100).cast("long")).alias("c"))
    return categories.select("record_id").join(growing(got), "record_id", "left").select("record_id", S.half_up(F.coalesce("c", F.lit(0)).cast("double") / len(targets), 1).alias("richness"))


_GOAL = "CASE key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RICHNESS_TARGETS.items()) + " END"
SQL_RICHNESS = f"""richness AS (
    SELECT record_id, floor(coalesce(c, 0) / {len(RICHNESS_TARGETS)}e0 * 10 + 5e-1) / 10e0 AS richness FROM category LEFT JOIN (
        SELECT record_id, sum(CASE WHEN length(value) >= {_GOAL} THEN 100 WHEN length(value) >= {_GOAL} * 7e-1 THEN 60 ELSE 25 END) AS c
        FROM fields WHERE key IN ({", ".join(f"'{k}'" for k in RICHNESS_TARGETS)}) GROUP BY 1) USING (record_id))"""


def overall(categories: DataFrame, fields: DataFrame, specs: DataFrame) -> DataFrame:
    """categories with the four components, overall and grade; a record without cells has accuracy 0 and consistency 100."""
    done = completeness(categories, fields, specs)
    for part in (accuracy(fields), consistency(fields), richness(categories, fields)):
        done = done.join(growing(part), "record_id", "left")
    done = done.withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0))).withColumn("consistency", F.coalesce("consistency", F.lit(100.0)))
    total = sum((F.col(c) * w for c, w in list(WEIGHTS.items())[1:]), F.col("completeness") * WEIGHTS["completeness"])
    return done.withColumn("overall", S.half_up(total, 1)).withColumn("grade", S.grade(F.col("overall")))


SQL_OVERALL = """overall AS (
    SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM (
        SELECT record_id, category, brand, completeness, coalesce(accuracy, 0e0) AS accuracy, coalesce(consistency, 100e0) AS consistency, richness,
            floor((completeness * 35e-2 + coalesce(accuracy, 0e0) * 25e-2 + coalesce(consistency, 100e0) * 20e-2 + richness * 20e-2) * 10 + 5e-1) / 10e0 AS overall
        FROM category JOIN completeness USING (record_id) LEFT JOIN accuracy USING (record_id) LEFT JOIN consistency USING (record_id) JOIN richness USING (record_id)))"""


def field_coverage(categories: DataFrame, fields: DataFrame, specs: DataFrame) -> DataFrame:
    """key, applicable, filled, fill_rate (percent, one digit), mean_confidence (two digits)."""
    wanted = categories.select("record_id", "category").join(F.broadcast(specs.select("category", "key")), "category")
    joined = wanted.join(growing(fields.select("record_id", "key", (penalised() * 1000 + 0.5).cast("long").alias("p"))), ["record_id", "key"], "left")
    n, m = F.count("*"), F.count("p")
    mean = F.sum("p").cast("double") / 1000 / F.nullif(m, F.lit(0))
    return joined.groupBy("key").agg(n.alias("applicable"), m.alias("filled"), S.half_up(m * 100 / n, 1).alias("fill_rate"), S.half_up(mean, 2).alias("mean_confidence"))


def uplift(before: DataFrame, after: DataFrame, routed: DataFrame) -> DataFrame:
    """total, avg_before, avg_after, uplift (one digit), filled and flagged cells: one row from the scores of the supplied
    cells alone, those of all cells, and the routed cells. Tenths are summed as whole numbers; no record gives nulls."""
    mean = lambda c: S.half_up(F.sum(F.round(F.col(c) * 10).cast("long")).cast("double") / 10 / F.count("*"), 1)
    both = after.select("record_id", F.col("overall").alias("after")).join(growing(before.select("record_id", F.col("overall").alias("before"))), "record_id")
    one = both.agg(F.count("*").alias("total"), mean("before").alias("avg_before"), mean("after").alias("avg_after"))
    cells = routed.agg(F.count("*").alias("filled"), F.count(F.when(F.col("state") == "needs_review", 1)).alias("flagged"))
    return one.crossJoin(F.broadcast(cells)).select("total", "avg_before", "avg_after", S.half_up(F.col("avg_after") - F.col("avg_before"), 1).alias("uplift"), "filled", "flagged")
