"""The whole batch: distributor rows in, mined, resolved, normalised, checked by rules before and after filling, scored; records and a delivery out. Every step is DataFrame to DataFrame.

Candidates, categories and fields are written and read again, which keeps plans short. Inference works on a snapshot taken before any filling, so the result doesn't depend on the order of rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import canonical, delivery, enrich, fusion, identity, ingest, mining, review, rules, score
from skuforge.sources import tables

NO_ISSUES = {"n_error": 0, "n_warning": 0, "n_info": 0}


@dataclasses.dataclass(frozen=True)
class Batch:
    records: DataFrame
    fields: DataFrame
    before: DataFrame
    after: DataFrame
    routed: DataFrame
    delivery: DataFrame
    summary: DataFrame


def told(codes: str) -> tuple[Column, Column]:
    """How many of what making a cell canonical found is worth an info, and how many a warning."""
    mild = F.size(F.filter(codes, lambda c: c.isin("UNIT_CONVERTED", "RANGE_COLLAPSED")))
    return mild, F.size(F.filter(codes, lambda c: (c != "") & ~c.isin("UNIT_CONVERTED", "RANGE_COLLAPSED")))


def normalised(cats: DataFrame, fields: DataFrame, specs: DataFrame) -> DataFrame:
    """fields with numbers in their spec's unit, options in their spelling, and what that found counted as warnings or infos."""
    cells = fields.join(tables.growing(cats.select("record_id", "category")), "record_id").select("record_id", "category", "key", "value", "unit")
    found = canonical.canonicalise(cells, specs).select("record_id", "key", "dtype", "canonical", "number", "unit_out", F.split("issues", ",").alias("codes"))
    mild, grave = told("codes")
    j = fields.join(tables.growing(found), ["record_id", "key"], "left")
    is_number = F.col("number").isNotNull()
    out = {"value": F.when(F.col("dtype").isNull(), F.col("value")).otherwise(F.col("canonical")), "unit": F.when(is_number, F.col("unit_out")).otherwise(F.col("unit"))}
    counts = {"n_warning": F.col("n_warning") + F.coalesce(grave, F.lit(0)), "n_info": F.col("n_info") + F.coalesce(mild, F.lit(0))}
    return j.select(*((out | counts).get(c, F.col(c)).alias(c) for c in fields.columns))


def ruled(cats: DataFrame, fields: DataFrame) -> DataFrame:
    """fields with the issues of cross-field rules counted at the record's first cell by key; a record without cells has none."""
    issues = rules.run_rules(rules.wide(cats, fields)).groupBy("record_id").agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(f"rule_{s}") for s in ("error", "warning", "info")))
    first = fields.groupBy("record_id").agg(F.min("key").alias("key")).join(tables.growing(issues), "record_id")
    j = fields.join(tables.growing(first), ["record_id", "key"], "left")
    added = {f"n_{s}": (F.col(f"n_{s}") + F.coalesce(F.col(f"rule_{s}"), F.lit(0))).cast("int") for s in ("error", "warning", "info")}
    return j.select(*(added.get(c, F.col(c)).alias(c) for c in fields.columns))


def run_batch(rows: DataFrame, *, id_col: str = "row_idx", sku: str = "mfg_part_num", text: str = "part_desc", brands: tuple[str, ...] = ("e1_brand", "alt_brand"), account: str = "part_manuf", keywords=D.KEYWORDS, slots: int = 50, peers: DataFrame | None = None, seed_brands: dict[str, tuple[str, ...]] | None = None, judge: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None) -> Batch:
    """rows with an id, a number, a description, brand columns and an account. peers: fields of records stored before, which
    count as peers (run_single). seed_brands: brands known from the start, with names that mean them. judge: fields after a last review, out of categories, fields and specs (operators.judge.review
    over providers); by default there is none."""
    spark = rows.sparkSession
    specs = D.specs(spark)
    named = ingest.unique_sku(ingest.classify(rows, text, keywords, D.GENERIC), sku, id_col)
    records = named.select(F.col(id_col).alias("record_id"), F.col("unique_sku").alias("sku"), "category", "category_confidence", F.col(text).alias("name"), ingest.first_real(*(F.col(b) for b in brands))["value"].alias("given_brand"))

    mined = mining.mine(rows.select(F.col(id_col).alias("record_id"), F.col(text).alias("text")), "record_id", "text")
    mined = mined.select("record_id", "key", "value", "unit", "method", F.lit("input").alias("source"), "confidence", (F.col("stage") + 1).alias("seq"))
    given = records.filter("given_brand is not null").select("record_id", F.lit("brand").alias("key"), F.col("given_brand").alias("value"), F.lit("").alias("unit"), F.lit("input_field").alias("method"), F.lit("input").alias("source"), F.lit(0.95).alias("confidence"), F.lit(0).alias("seq"))
    # written, as the next steps read it more than once and its expressions are long
    candidates = tables.save(given.unionByName(mined), "candidates")
    # candidates are made canonical first, so that numbers are compared in the spec's unit
    cells = canonical.canonicalise(candidates.join(tables.growing(records.select("record_id", "category")), "record_id"), specs, how="left")
    cells = cells.withColumn("unit_out", F.when(F.col("number").isNotNull(), F.col("unit_out")).otherwise(F.col("unit")))
    best = fusion.resolve_typed(cells)
    mild, grave = told("codes")
    kept_by_source = F.col("issue") == "SOURCE_CONFLICT_KEPT"
    warned, said = grave + F.when((F.col("issue") != "") & ~kept_by_source, 1).otherwise(0), mild + F.when(kept_by_source, 1).otherwise(0)
    fields = best.select("record_id", "key", "value", "unit", "method", "source", "confidence", warned.alias("n_warning"), F.lit(0).alias("n_error"), said.alias("n_info"))

    who = rows.select(F.col(id_col).alias("record_id"), *dict.fromkeys((*brands, text, account)))
    vocab = identity.vocabulary(spark, rows.select(F.col(brands[0]).alias("brand")), rows.select(F.col(account).alias("account")), seed_brands)
    resolved = identity.resolve(who, "record_id", list(brands), text, account, vocab)
    cell = lambda key, v, c: F.struct(F.lit(key).alias("key"), F.col(v).alias("value"), F.lit("").alias("unit"), F.col(f"{v}_method").alias("method"), F.lit("input").alias("source"), F.col(c).alias("confidence"), F.lit(0).alias("n_warning"))
    found = resolved.select("record_id", F.inline(F.array(cell("brand", "brand", "brand_confidence"), cell("manufacturer", "manufacturer", "manufacturer_confidence")))).filter("value is not null")
    found = found.join(tables.growing(fields.select("record_id", "key")), ["record_id", "key"], "left_anti").withColumns({"n_error": F.lit(0), "n_info": F.lit(0)})
    fields = fields.unionByName(normalised(records, found, specs))
    fields = tables.save(fields, "fields")

    cats = tables.save(records.select("record_id", "category").join(tables.growing(fields.filter("key = 'brand'").select("record_id", F.col("value").alias("brand"))), "record_id", "left"), "categories")
    before = score.overall(cats, ruled(cats, fields.filter("method = 'input_field'")), specs)
    known = fields if peers is None else fields.unionByName(peers.select(*fields.columns))
    filled = enrich.fill_from_peers(cats, known, specs, consensus=True).select("record_id", "key", "value", F.lit("").alias("unit"), F.lit("kg_infer").alias("method"), F.lit("catalog_sibling").alias("source"), "confidence", F.lit(0).alias("n_warning"), F.lit(0).alias("n_error"), F.lit(1).alias("n_info"))
    # rules run again, as cross-field checks must see what was filled
    fields = tables.save(ruled(cats, fields.unionByName(filled)), "filled")
    if judge is not None:
        fields = tables.save(judge(cats, fields, specs), "judged")
    routed = review.route(fields)
    after = score.overall(cats, fields, specs)
    delivered = delivery.deliver(records, fields, specs, raw=delivery.raw_rows(rows, id_col), columns=delivery.template(slots))
    uplift = after.select("record_id", F.col("overall").alias("after")).join(tables.growing(before.select("record_id", F.col("overall").alias("before"))), "record_id")
    summary = uplift.agg(F.count("*").alias("records"), F.round(F.avg("before"), 1).alias("avg_before"), F.round(F.avg("after"), 1).alias("avg_after")).crossJoin(F.broadcast(routed.agg(F.count("*").alias("filled"), F.count(F.when(F.col("state") == "needs_review", 1)).alias("flagged"))))
    return Batch(records, fields, before, after, routed, delivered, summary)


def run_single(row: DataFrame, stored_fields: DataFrame, **options) -> Batch:
    """One new record against the fields of stored ones, as a batch of one."""
    return run_batch(row, peers=stored_fields, **options)
