"""Steps that a language model takes part in, over any provider: payloads to candidates, gap filling, content, review.

What a model says arrives as a JSON column (from runtime.complete or a table); everything after that is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.sources.tables import growing

ITEMS = "array<struct<key:string,value:string,unit:string,evidence:string,uncertain:boolean,basis:string>>"
BASIS_CAPS = {"same_series": 0.72, "similar_products": 0.68, "domain_knowledge": 0.60}


def payload_candidates(answers: DataFrame, id_col: str, json_col: str, aliases: dict[str, str], base: float = 0.80, legibility: float = 1.0) -> DataFrame:
    """id_col, key, value, unit, confidence, issue from answers like {"items": [{"key", "value", "unit", "evidence", "uncertain"}]}.

    Keys are found by alias (unknown ones are dropped). Uncertain items count 0.7, items without evidence 0.6, and a picture's
    legibility scales them all. An answer that isn't JSON gives nothing.
    """
    text = S.json_salvage(F.col(json_col))
    items = F.from_json(F.get_json_object(text, "$.items"), ITEMS)
    rows = answers.select(id_col, F.explode(items).alias("i"))
    known = F.create_map(*(F.lit(x) for a, k in aliases.items() for x in (a.lower(), k)))
    bare = F.trim(F.coalesce("i.evidence", F.lit(""))) == ""
    unsure = F.coalesce("i.uncertain", F.lit(False))
    confidence = F.lit(base * legibility) * F.when(unsure, 0.7).otherwise(1.0) * F.when(bare, 0.6).otherwise(1.0)
    issue = F.when(bare, "NO_EVIDENCE").when(unsure, "MODEL_UNCERTAIN").otherwise("")
    out = rows.select(id_col, known[F.lower(F.trim("i.key"))].alias("key"), F.col("i.value").alias("value"), F.coalesce("i.unit", F.lit("")).alias("unit"), F.round(confidence, 4).alias("confidence"), issue.alias("issue"))
    return out.filter("key is not null and value is not null and value <> ''")


def model_fill(answers: DataFrame, id_col: str, json_col: str, aliases: dict[str, str], publish: float = 0.40) -> DataFrame:
    """Inferred values: confidence is capped by what they rest on (0.72, 0.68, 0.60, else 0.55); below `publish` they go."""
    text = S.json_salvage(F.col(json_col))
    rows = answers.select(id_col, F.explode(F.from_json(F.get_json_object(text, "$.items"), ITEMS)).alias("i"))
    caps = F.create_map(*(F.lit(x) for k, v in BASIS_CAPS.items() for x in (k, v)))
    cap = F.coalesce(caps[F.col("i.basis")], F.lit(0.55))
    confidence = F.when(F.coalesce("i.uncertain", F.lit(False)), cap * 0.7).otherwise(cap)
    known = F.create_map(*(F.lit(x) for a, k in aliases.items() for x in (a.lower(), k)))
    out = rows.select(id_col, known[F.lower(F.trim("i.key"))].alias("key"), F.col("i.value").alias("value"), F.round(confidence, 4).alias("confidence"))
    return out.filter((F.col("confidence") >= publish) & F.col("key").isNotNull() & (F.coalesce("value", F.lit("")) != ""))


def content_fields(answers: DataFrame, id_col: str, json_col: str, keys: list[str], confidence: float = 0.75) -> DataFrame:
    """id_col, key, value, confidence of generated content: the answer's entries for the keys, blank ones left out."""
    text = S.json_salvage(F.col(json_col))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object(text, f"$.{k}").alias("value")) for k in keys))
    return answers.select(id_col, F.inline(pairs)).filter("value is not null and trim(value) <> ''").withColumn("confidence", F.lit(confidence))


def neighbour_block(similar: DataFrame, fields: DataFrame, wanted: DataFrame, floor: float = 0.6) -> DataFrame:
    """record_id and what its similar records (record_id, other, score) say about wanted(record_id, key) cells, as lines."""
    have = fields.filter(F.col("confidence") >= floor).select(F.col("record_id").alias("other"), "key", "value")
    rows = similar.join(growing(wanted), "record_id").join(growing(have), ["other", "key"])
    line = F.concat(F.col("key"), F.lit(" = "), F.col("value"), F.lit(" (record "), F.col("other").cast("string"), F.lit(")"))
    return rows.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("block"))


def escalated(rows: DataFrame, confidence: str = "category_confidence", category: str = "category", generic: str = "general_product", floor: float = 0.6) -> Column:
    """Whether keywords leave a row's category to a model."""
    return (F.col(category) == generic) | (F.col(confidence) < floor)


def seeded_category(category: Column, confidence: Column, supplied: Column) -> Column:
    """struct(value, confidence within 0.5 to 0.95, alternative): a classified category as a cell; the supplier's spelling is kept."""
    return F.struct(category.alias("value"), F.greatest(F.lit(0.5), F.least(F.lit(0.95), confidence)).alias("confidence"), F.when(~S.is_placeholder(supplied) & (F.lower(supplied) != F.lower(category)), supplied).alias("alternative"))
