"""Review routing, the queue, and reviewers' decisions applied to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuforge.functions.dictionary import AUTO_APPROVE, PUBLISH
from skuforge.operators.score import SQL_PENALISED, penalised
from skuforge.sources.tables import growing

SQL_ROUTED = f"""SELECT *, CASE WHEN n_error > 0 OR penalised < 75e-2 THEN 'needs_review' ELSE 'auto_approved' END AS state, penalised < 40e-2 AS below_publish
    FROM (SELECT *, {SQL_PENALISED} AS penalised FROM fields)"""


def route(fields: DataFrame, approve: float = AUTO_APPROVE, publish: float = PUBLISH) -> DataFrame:
    """fields with penalised, state and below_publish: an error or too little confidence needs review; states that a person
    set (column `state`, if there) stay."""
    p = fields.withColumn("penalised", penalised())
    machine = F.when((F.col("n_error") > 0) | (F.col("penalised") < approve), "needs_review").otherwise("auto_approved")
    if "state" in fields.columns:
        machine = F.when(F.col("state").startswith("human_"), F.col("state")).otherwise(machine)
    return p.withColumn("state", machine).withColumn("below_publish", F.col("penalised") < publish)


def record_state(routed: DataFrame) -> DataFrame:
    """record_id, flagged cells and the record's state."""
    flagged = F.count(F.when(F.col("state") == "needs_review", 1))
    return routed.groupBy("record_id").agg(flagged.alias("flagged"), F.when(flagged > 0, "needs_review").otherwise("auto_approved").alias("state"))


def queue(routed: DataFrame, limit: int | None = None) -> DataFrame:
    """What needs review: errors first, then the least confident; ties by record and key. With a limit no global sort."""
    rows = routed.filter(F.col("state") == "needs_review").orderBy(F.desc(F.col("n_error") > 0), "penalised", "record_id", "key")
    return rows if limit is None else rows.limit(limit)


def bulk_approve(routed: DataFrame, floor: float) -> DataFrame:
    """Cells without an error at or over a floor of confidence, as a person would approve them."""
    return routed.filter((F.col("state") == "needs_review") & (F.col("n_error") == 0) & (F.col("penalised") >= floor))


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision on each sku and field; of equal times, the larger id. An aggregate, no window."""
    rest = [c for c in decisions.columns if c not in ("sku", "field_key", "ts", "decision_id")]
    last = F.max(F.struct("ts", "decision_id", *rest)).alias("d")
    return decisions.groupBy("sku", "field_key").agg(last).select("sku", "field_key", "d.*")


def apply_decisions(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """fields(sku, key, value, confidence, n_error, ...) after the latest decision on each: approved raises confidence to 0.95
    and drops errors and warnings; edited sets the new value at confidence 1; rejected blanks it at 0. The machine's value is
    kept as previous where it changed."""
    d = latest(decisions).select("sku", F.col("field_key").alias("key"), "decision", "new_value")
    j = fields.join(growing(d), ["sku", "key"], "left")
    edited, rejected, approved = (F.col("decision").eqNullSafe(x) for x in ("edited", "rejected", "approved"))
    value = F.when(edited, F.col("new_value")).when(rejected, None).otherwise(F.col("value"))
    confidence = F.when(edited, 1.0).when(rejected, 0.0).when(approved, F.greatest(F.lit(0.95), F.col("confidence"))).otherwise(F.col("confidence"))
    settled = edited | approved
    state = F.when(settled, "human_approved").when(rejected, "human_rejected").otherwise("machine")
    return j.select("sku", "key", value.alias("value"), confidence.alias("confidence"), F.when(edited | rejected, F.col("value")).alias("previous"), F.when(settled, 0).otherwise(F.col("n_error")).alias("n_error"), F.when(approved, 0).otherwise(F.col("n_warning")).alias("n_warning"), state.alias("state"))


def decision_totals(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


def most_corrected(decisions: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    """Fields by their share of edited or rejected decisions, of those reviewed `least` times or more."""
    bad = F.count(F.when(F.col("decision") != "approved", 1))
    return decisions.groupBy("field_key").agg(F.count("*").alias("reviewed"), bad.alias("corrected")).filter(F.col("reviewed") >= least).orderBy(F.desc(F.col("corrected") / F.col("reviewed")), "field_key").limit(limit)


def approval_by_method(decisions: DataFrame) -> DataFrame:
    """method, reviewed, approved, rate in percent with one digit; decisions without a method are left out."""
    ok = F.count(F.when(F.col("decision") == "approved", 1))
    return decisions.filter("method is not null").groupBy("method").agg(F.count("*").alias("reviewed"), ok.alias("approved"), (F.floor(ok * 1000 / F.count("*") + 0.5) / 10.0).alias("rate"))


def agreement_rate(decisions: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("decision") == "approved", 1))
    return decisions.agg(F.count("*").alias("reviewed"), ok.alias("approved"), (F.floor(ok * 1000 / F.nullif(F.count("*"), F.lit(0)) + 0.5) / 10.0).alias("rate"))


def feedback_examples(decisions: DataFrame, field_key: str | None = None, limit: int = 8) -> DataFrame:
    """The newest edits, of one field if given."""
    rows = decisions.filter(F.col("decision") == "edited")
    rows = rows if field_key is None else rows.filter(F.col("field_key") == field_key)
    return rows.orderBy(F.desc("ts"), F.desc("decision_id")).limit(limit)


def sliding_rate(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """events with in_window (calls of the key in the seconds up to each) and allowed (within the limit)."""
    over = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(over)).withColumn("allowed", F.col("in_window") <= limit)
