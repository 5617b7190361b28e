"""A judge's review of finished records: evidence lines in, issues and lowered confidences out. It never writes a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.operators import prompts, rules, runtime
from skuforge.sources.tables import growing, has_key, keys_of

# The codes and severities that count, and how many cells a judge is shown.
CODES = ("VALUE_CONTRADICTS_EVIDENCE", "IMPLAUSIBLE_MAGNITUDE", "INTERNAL_CONTRADICTION", "UNIT_SUSPECT", "WRONG_ATTRIBUTE", "MISSING_CRITICAL")
SEVERITIES = ("error", "warning", "info")
MOST_CELLS = 45

ISSUES = "array<struct<field_key:string,code:string,severity:string,message:string,suggestion:string>>"


def evidence_block(categories: DataFrame, fields: DataFrame, specs: DataFrame, most: int = MOST_CELLS, evidence: Column | None = None) -> DataFrame:
    """record_id, category, evidence: a line for each cell with a value, by key, `most` at most, with where it is from and the
    first 220 characters of its evidence. Records without such a cell have no row. A record's cells are bounded by its specs."""
    said = F.substring(F.regexp_replace(F.coalesce(evidence if evidence is not None else F.lit(None).cast("string"), F.lit("no evidence quoted")), "\n", " "), 1, 220)
    cells = fields.filter("value is not null and value <> ''").join(growing(categories.select("record_id", "category")), "record_id")
    cells = cells.join(F.broadcast(specs.select("category", "key", "label")), ["category", "key"], "left")
    unit = F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    line = F.concat(F.col("key"), F.lit(" ("), F.coalesce("label", "key"), F.lit(") = "), F.col("value"), unit, F.lit(" ["), F.col("source"), F.lit("/"), F.col("method"), F.lit('] "'), said, F.lit('"'))
    shown = F.slice(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), 1, most)
    return cells.groupBy("record_id", "category").agg(F.array_join(F.transform(shown, lambda x: x["line"]), "\n").alias("evidence"))


def judge_prompts(blocks: DataFrame) -> DataFrame:
    """blocks of evidence_block with prompt."""
    return blocks.withColumn("prompt", prompts.prompt("judge", category=F.col("category"), evidence=F.col("evidence"), codes=F.lit(", ".join(CODES))))


def issues(answers: DataFrame, json_col: str, fields: DataFrame) -> DataFrame:
    """record_id, key, code, severity, message, suggestion, raised_by out of answers(record_id, json_col).

    Only the known codes count; an unknown severity is a warning; messages end after 500 characters. An issue on a cell that
    isn't there is the record's (null key), but for MISSING_CRITICAL. An answer that isn't JSON has none.
    """
    text = S.json_salvage(F.col(json_col))
    rows = answers.select("record_id", F.explode(F.from_json(F.get_json_object(text, "$.issues"), ISSUES)).alias("i"))
    rows = rows.select("record_id", F.col("i.field_key").alias("key"), F.upper("i.code").alias("code"), F.lower(F.coalesce("i.severity", F.lit("warning"))).alias("said"), F.substring(F.coalesce("i.message", F.lit("")), 1, 500).alias("message"), F.col("i.suggestion").alias("suggestion"))
    rows = rows.filter(F.col("code").isin(*CODES))
    known = has_key("key") | (F.col("code") == "MISSING_CRITICAL")
    severity = F.when(F.col("said").isin(*SEVERITIES), F.col("said")).otherwise("warning")
    return rows.join(growing(keys_of(fields)), "record_id", "left").select("record_id", F.when(known, F.col("key")).alias("key"), "code", severity.alias("severity"), "message", "suggestion", F.lit("judge").alias("raised_by"))


def adjustments(answers: DataFrame, json_col: str) -> DataFrame:
    """record_id, key, proposed (0 to 1): confidences that an answer asks for; what isn't a number is left out."""
    wanted = F.from_json(F.get_json_object(S.json_salvage(F.col(json_col)), "$.confidence_adjustments"), "map<string,string>")
    rows = answers.select("record_id", F.explode(wanted).alias("key", "text"))
    rows = rows.withColumn("number", F.col("text").try_cast("double")).filter("number is not null and not isnan(number)")
    return rows.select("record_id", "key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("number"))).alias("proposed"))


def judged(fields: DataFrame, answers: DataFrame, json_col: str) -> DataFrame:
    """fields with confidences as the answers adjust them and the judge's issues counted: a record's own at its first cell."""
    told = issues(answers, json_col, fields)
    first = fields.groupBy("record_id").agg(F.min("key").alias("first_key"))
    placed = told.join(growing(fields.select("record_id", "key", F.lit(True).alias("there")).distinct()), ["record_id", "key"], "left").join(growing(first), "record_id")
    placed = placed.withColumn("key", F.when(F.coalesce("there", F.lit(False)), F.col("key")).otherwise(F.col("first_key")))
    counts = placed.groupBy("record_id", "key").agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(f"judge_{s}") for s in SEVERITIES))
    proposed = adjustments(answers, json_col).groupBy("record_id", "key").agg(F.min("proposed").alias("proposed"))
    j = fields.join(growing(counts), ["record_id", "key"], "left").join(growing(proposed), ["record_id", "key"], "left")
    new = {f"n_{s}": (F.col(f"n_{s}") + F.coalesce(F.col(f"judge_{s}"), F.lit(0))).cast("int") for s in SEVERITIES}
    new["confidence"] = F.when(F.col("proposed").isNull(), F.col("confidence")).otherwise(rules.adjust_confidence("confidence", "proposed"))
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in fields.columns))


def review(categories: DataFrame, fields: DataFrame, specs: DataFrame, providers: Callable[[], list[runtime.Provider]], provider: str, model: str, cache: DataFrame | None = None) -> DataFrame:
    """fields after a judge: a prompt for each record with cells, asked through the runtime, each distinct one once. A record
    without an answer stays as it is."""
    asked = judge_prompts(evidence_block(categories, fields, specs)).select("record_id", "prompt")
    return judged(fields, runtime.complete(asked, "prompt", providers, provider, model, cache).select("record_id", "response"), "response")
