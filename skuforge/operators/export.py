"""Wide exports of long cells: pivots with stated columns, slots, lines and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.functions.dictionary import AUTO_APPROVE
from skuforge.operators.score import penalised
from skuforge.sources.tables import growing

#: Keys with columns of their own in a delivery, so they take no slot (fixed values).
DEDICATED = ("sku", "product_name", "brand", "manufacturer", "supplier", "category", "series", "model", "warranty_months", "upc", "unspsc_code", "country_of_origin", "short_desc")
#: Delivery columns that hold documents: the first document whose name has one of the words.
DOCUMENTS = {"spec_sheet": ("spec", "datasheet"), "manual": ("manual", "instruction"), "warranty_doc": ("warranty",), "sds": ("sds", "safety"), "brochure": ("brochure", "catalog")}


def flat(fields: DataFrame, keys: list[str], id_col: str = "record_id") -> DataFrame:
    """A row for each record and a column for each key and its unit; keys are stated, so there is no pass to find them."""
    values = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    units = [F.max(F.when((F.col("key") == k) & (F.col("unit") != ""), F.col("unit"))).alias(f"{k}__unit") for k in keys]
    return fields.groupBy(id_col).agg(*values, *units)


def publishable(fields: DataFrame, floor: float = 0.4) -> DataFrame:
    return fields.filter((penalised() >= floor) & F.col("value").isNotNull())


def slots(fields: DataFrame, specs: DataFrame, categories: DataFrame, most: int = 50, floor: float = 0.4) -> DataFrame:
    """record_id, slot, label, value, uom: publishable cells without a column of their own; required ones first, then by
    weight, confidence and key; `most` slots at most, as the template has."""
    rows = publishable(fields, floor).filter(~F.col("key").isin(*DEDICATED)).join(growing(categories.select("record_id", "category")), "record_id")
    rows = rows.join(F.broadcast(specs.select("category", "key", "label", "required", "weight")), ["category", "key"])
    over = Window.partitionBy("record_id").orderBy(F.desc("required"), F.desc("weight"), F.desc(penalised()), "key")
    return rows.withColumn("slot", F.row_number().over(over)).filter(F.col("slot") <= most).select("record_id", "slot", "label", "value", F.col("unit").alias("uom"))


def slot_columns(s: DataFrame, n: int) -> DataFrame:
    """record_id and label_i, value_i, uom_i for slots 1 to n."""
    return s.groupBy("record_id").agg(*(F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, n + 1) for c in ("label", "value", "uom")))


def features(c: Column, most: int = 20) -> list[Column]:
    """feature_1, feature_2, ... of a list column."""
    return [F.get(c, i).alias(f"feature_{i + 1}") for i in range(most)]


def document_columns(documents: DataFrame, id_col: str, name: str) -> DataFrame:
    """id_col and, for each document column, the first name (by text) with one of its words."""
    low = F.lower(F.col(name))
    return documents.groupBy(id_col).agg(*(F.min(F.when(low.rlike("|".join(words)), F.col(name))).alias(c) for c, words in DOCUMENTS.items()))


def sources_by_kind(documents: DataFrame, id_col: str, kind: str, url: str) -> DataFrame:
    """The first web source and the next five, the first image and the next four, by url; null where a kind has no source."""
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col(kind) == k, F.col(url))))
    rest = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.slice(c, 2, n), "|"))
    g = documents.groupBy(id_col).agg(pick("web").alias("w"), pick("image").alias("i"))
    return g.select(id_col, F.get("w", 0).alias("mfr_url"), rest("w", 5).alias("references"), F.get("i", 0).alias("image"), rest("i", 4).alias("more_images"))


def template(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with exactly the template's columns in its order; those that rows don't have are empty."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*(F.coalesce(F.col(f"`{have[c.lower()]}`").cast("string"), F.lit("")).alias(c) if c.lower() in have else F.lit("").alias(c) for c in columns))


def coverage(rows: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """block, columns, filled: percent of cells of each block of columns that aren't blank, one digit. One aggregate."""
    full = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0)
    one = rows.agg(F.count("*").alias("n"), *(F.sum(sum((full(c) for c in columns), F.lit(0))).alias(b) for b, columns in blocks.items()))
    parts = [F.struct(F.lit(b).alias("block"), F.lit(len(columns)).alias("columns"), (F.floor(F.col(b) * 1000 / F.nullif(F.col("n") * len(columns), F.lit(0)) + 0.5) / 10.0).alias("filled")) for b, columns in blocks.items()]
    return one.select(F.inline(F.array(*parts)))


def review_lines(routed: DataFrame) -> DataFrame:
    """One line for each cell that needs review, issues joined."""
    issue = lambda n: F.when(F.col(f"n_{n.lower()}") > 0, n)
    return routed.filter("state = 'needs_review'").select(F.concat_ws(";", F.col("record_id").cast("string"), "key", "value", issue("ERROR"), issue("WARNING"), issue("INFO")).alias("line"))


def audit(fields: DataFrame, id_col: str = "record_id") -> DataFrame:
    """A JSON object for each record with all its cells, by key. A record's cells are bounded by its specs."""
    cell = F.struct("key", "value", "unit", penalised().alias("confidence"), "method", "source")
    return fields.groupBy(id_col).agg(F.to_json(F.struct(F.array_sort(F.collect_list(cell)).alias("fields"))).alias("record"))


def audit_record(records: DataFrame, fields: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """record_id and a JSON object for each record: sku, category, its cells by key with penalised confidence and issues by
    severity, the scores before and after where given, and whether it needs review. A record without cells has an empty
    object of them; of a repeated key the greatest cell counts. Sources stay a table of their own, as they aren't bounded."""
    issues = F.struct(*(F.col(f"n_{s}").cast("int").alias(s) for s in ("error", "warning", "info")))
    cell = F.struct("value", "unit", penalised().alias("confidence"), "method", "source", issues.alias("issues"))
    each = fields.groupBy("record_id", "key").agg(F.max(cell).alias("cell"))
    flagged = (F.col("cell.issues.error") > 0) | (F.col("cell.confidence") < AUTO_APPROVE)
    cells = each.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "cell")))).alias("attributes"), F.max(flagged).alias("flagged"))
    rows = records.join(growing(cells), "record_id", "left")
    scores = {"quality_before": before, "quality_after": after}
    for name, df in scores.items():
        if df is not None:
            rows = rows.join(growing(df.select("record_id", F.struct("completeness", "accuracy", "consistency", "richness", "overall", "grade").alias(name))), "record_id", "left")
    state = F.when(F.coalesce("flagged", F.lit(False)), "needs_review").otherwise("auto_approved")
    nothing = F.create_map().cast(rows.schema["attributes"].dataType)
    parts = [F.col("record_id"), F.col("sku"), F.col("category"), F.coalesce("attributes", nothing).alias("attributes"), *(F.col(c) for c, df in scores.items() if df is not None), state.alias("review_state")]
    return rows.select("record_id", F.to_json(F.struct(*parts)).alias("record"))


def write_csv(df: DataFrame, folder: str, bom: bool = False) -> None:
    """CSV with a header; with bom, the first column's name begins with a byte order mark, as some spreadsheets want."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], f"﻿{df.columns[0]}")
    df.write.mode("overwrite").option("header", True).csv(folder)
