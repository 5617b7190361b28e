"""Catalogue statistics kept up to date: small states of each batch, stored, and merged instead of scanning records again.

A state has rows (part, k1, k2) with whole numbers that add up and sketches that merge. Counts, rates and means from merged
states equal those of one pass over all records. Distinct values are estimated (HyperLogLog, 2^12 registers: a standard error
of 1.6 %), quantiles of scores too (KLL, k = 200: the rank is off by 1.65 % at most, with 99 % confidence).

A record belongs to one batch. A batch that is stored again replaces what it stored before, so a job that runs twice, or after a
lost executor, changes nothing. States grow with keys and categories, not with records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.operators.score import penalised
from skuforge.sources.tables import growing

SCHEMA = "batch string, part string, k1 string, k2 string, n long, m long, total long, distinct binary, scores binary"


def _rows(part: str, df: DataFrame) -> DataFrame:
    """df with all columns of a state."""
    kinds = {"k1": "string", "k2": "string", "n": "long", "m": "long", "total": "long", "distinct": "binary", "scores": "binary"}
    return df.select("batch", F.lit(part).alias("part"), *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))


def states(scored: DataFrame, fields: DataFrame, specs: DataFrame, batch: Column) -> DataFrame:
    """SCHEMA of the batches of scored(record_id, category, overall, grade, ...) and their fields; batch: an expression of a
    scored record. Each part is one aggregate, summed before the shuffle."""
    records = scored.withColumn("batch", batch.cast("string")).select("batch", "record_id", "category", "overall", "grade")
    tenths = F.round(F.col("overall") * 10).cast("long")
    grades = records.groupBy("batch", F.col("category").alias("k1"), F.col("grade").alias("k2")).agg(F.count("*").alias("n"), F.sum(tenths).alias("total"), F.kll_sketch_agg_double("overall").alias("scores"))
    cells = fields.select("record_id", "key", "value", (penalised() * 1000 + 0.5).cast("long").alias("p"), "n_error", "n_warning", "n_info")
    wanted = records.select("batch", "record_id", "category").join(F.broadcast(specs.select("category", "key")), "category")
    told = wanted.join(growing(cells), ["record_id", "key"], "left").groupBy("batch", F.col("key").alias("k1"))
    coverage = told.agg(F.count("*").alias("n"), F.count("p").alias("m"), F.sum("p").alias("total"), F.hll_sketch_agg("value").alias("distinct"))
    each = F.inline(F.array(*(F.struct(F.lit(s).alias("k2"), F.col(f"n_{s}").cast("long").alias("c")) for s in ("error", "warning", "info"))))
    issues = records.select("batch", "record_id").join(growing(cells), "record_id").select("batch", F.col("key").alias("k1"), each).groupBy("batch", "k1", "k2").agg(F.sum("c").alias("n"))
    return _rows("grade", grades).unionByName(_rows("field", coverage)).unionByName(_rows("issue", issues))


def store(found: DataFrame, folder: str) -> None:
    """Writes states, a folder for each batch; batches stored before are replaced, others stay."""
    found.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def merged(found: DataFrame) -> DataFrame:
    """One state of all batches: part, k1, k2 and the columns of a state."""
    return found.groupBy("part", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("scores").alias("scores"))


def coverage(state: DataFrame) -> DataFrame:
    """key, applicable, filled, fill_rate, mean_confidence as score.field_coverage(), and about how many distinct values."""
    n, m = F.col("n"), F.col("m")
    mean = F.col("total").cast("double") / 1000 / F.nullif(m, F.lit(0))
    return state.filter("part = 'field'").select(F.col("k1").alias("key"), n.alias("applicable"), m.alias("filled"), S.half_up(m * 100 / n, 1).alias("fill_rate"), S.half_up(mean, 2).alias("mean_confidence"), F.hll_sketch_estimate("distinct").alias("distinct_values"))


def grades(state: DataFrame) -> DataFrame:
    """category, grade and records, their mean score (one digit)."""
    return state.filter("part = 'grade'").select(F.col("k1").alias("category"), F.col("k2").alias("grade"), F.col("n").alias("records"), S.half_up(F.col("total").cast("double") / 10 / F.col("n"), 1).alias("mean_overall"))


def quantiles(state: DataFrame, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """category, and about which score that share of its records doesn't pass, for each share."""
    whole = state.filter("part = 'grade'").groupBy(F.col("k1").alias("category")).agg(F.kll_merge_agg_double("scores").alias("scores"))
    return whole.select("category", *(F.kll_sketch_get_quantile_double("scores", F.lit(q)).alias(f"q{round(100 * q)}") for q in at))


def issue_totals(state: DataFrame) -> DataFrame:
    """key, severity and n, without those that never occurred."""
    return state.filter("part = 'issue' and n > 0").select(F.col("k1").alias("key"), F.col("k2").alias("severity"), "n")
