"""Values of cells made canonical by their spec: numbers to the spec's unit, options to their spelling, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.functions import units as U


def canonicalise(cells: DataFrame, specs: DataFrame, how: str = "inner") -> DataFrame:
    """cells(record_id, category, key, value, ...) joined with specs(category, key, dtype, unit, family, low, high), with
    canonical (text), number, unit_out, and issues: UNPARSEABLE_NUMBER, UNIT_UNKNOWN, UNIT_CONVERTED, RANGE_COLLAPSED,
    OUT_OF_RANGE, UNPARSEABLE_BOOLEAN. Cells without a spec are dropped, or with how="left" stay as they are. Specs and units are
    metadata, broadcast.
    """
    j = cells.join(F.broadcast(specs.select("category", "key", "dtype", F.col("unit").alias("spec_unit"), "family", "low", "high")), ["category", "key"], how)
    # bound once by the transform: a plain struct would be written out again at every use, past what one method can hold
    j = j.withColumn("q", F.get(F.transform(F.array(U.expand_fraction(F.col("value"))), U.parse_quantity), F.lit(0)))
    given = F.nullif(F.trim(F.coalesce(F.col("unit"), F.lit(""))), F.lit("")) if "unit" in cells.columns else F.lit(None).cast("string")
    j = j.withColumn("from_unit", F.lower(F.coalesce(F.nullif(F.col("q.unit"), F.lit("")), given, F.lit(""))))
    units = F.broadcast(U.unit_table(cells.sparkSession).select(F.col("family").alias("family"), F.col("unit").alias("from_unit"), "shift", "factor"))
    j = j.join(units, ["family", "from_unit"], "left")
    blank = F.col("from_unit") == ""
    number = F.when(F.col("dtype") == "number", F.round(F.when(F.col("factor").isNotNull(), (F.col("q.value") + F.col("shift")) * F.col("factor")).otherwise(F.col("q.value")), 6))
    is_number = F.col("dtype") == "number"
    flag = S.to_boolean(F.col("value"))
    text = F.when(is_number, S.shown(number)).when(F.col("dtype") == "boolean", F.when(flag, "true").when(~flag, "false").otherwise(F.col("value"))).when(F.col("dtype") == "list", F.array_join(S.to_list(F.col("value")), ", ")).otherwise(S.collapse(F.col("value")))
    issues = F.array_compact(F.array(
        F.when(is_number & F.col("q.value").isNull(), "UNPARSEABLE_NUMBER"), F.when(is_number & F.col("q.value").isNotNull() & ~blank & F.col("factor").isNull() & (F.col("family") != ""), "UNIT_UNKNOWN"),
        F.when(is_number & F.col("factor").isNotNull() & ((F.col("factor") != 1) | (F.col("shift") != 0)), "UNIT_CONVERTED"), F.when(is_number & (F.col("q.low") != F.col("q.high")), "RANGE_COLLAPSED"),
        F.when(is_number & ((number < F.col("low")) | (number > F.col("high"))), "OUT_OF_RANGE"), F.when((F.col("dtype") == "boolean") & flag.isNull(), "UNPARSEABLE_BOOLEAN"),
    ))
    text = F.when(F.col("dtype").isNull(), F.col("value")).otherwise(F.coalesce(text, F.col("value")))
    return j.select(*cells.columns, "dtype", text.alias("canonical"), number.alias("number"), F.when(is_number, F.col("spec_unit")).otherwise("").alias("unit_out"), F.array_join(issues, ",").alias("issues"))
