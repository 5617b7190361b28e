"""Review routing and the decision log."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.operators import export, review
from skuforge.plans.registry import query
from skuforge.sources import views as V

ROUTED = f"WITH {V.SQL_FIELDS}, r AS ({review.SQL_ROUTED})"
DEC = f"WITH {V.SQL_DECISIONS}"


def routed(spark, sf):
    return review.route(V.fields(spark, sf))


def decided(spark, sf):
    return V.decisions(V.table(spark, sf, "events"))


@query("route_review", f"{ROUTED} SELECT record_id, key, penalised, state, below_publish FROM r")
def route_review(spark, sf):
    return routed(spark, sf).select("record_id", "key", "penalised", "state", "below_publish")


@query("record_state", f"{ROUTED} SELECT record_id, count(CASE WHEN state = 'needs_review' THEN 1 END) AS flagged, CASE WHEN count(CASE WHEN state = 'needs_review' THEN 1 END) > 0 THEN 'needs_review' ELSE 'auto_approved' END AS state FROM r GROUP BY 1")
def record_state(spark, sf):
    return review.record_state(routed(spark, sf))


@query("review_queue", f"{ROUTED} SELECT record_id, key, penalised FROM r WHERE state = 'needs_review' ORDER BY (n_error > 0) DESC, penalised, record_id, key LIMIT 200")
def review_queue(spark, sf):
    return review.queue(routed(spark, sf), 200).select("record_id", "key", "penalised")


@query("bulk_approve", f"{ROUTED} SELECT record_id, key FROM r WHERE state = 'needs_review' AND n_error = 0 AND penalised >= 6e-1")
def bulk_approve(spark, sf):
    return review.bulk_approve(routed(spark, sf), 0.6).select("record_id", "key")


@query("review_filter", f"{ROUTED} SELECT record_id, key FROM r WHERE state = 'needs_review' AND key = 'length' AND n_error > 0")
def review_filter(spark, sf):
    return routed(spark, sf).filter("state = 'needs_review' and key = 'length' and n_error > 0").select("record_id", "key")


@query("review_queue_export", f"{ROUTED} SELECT concat_ws(';', CAST(record_id AS VARCHAR), key, value, CASE WHEN n_error > 0 THEN 'ERROR' END, CASE WHEN n_warning > 0 THEN 'WARNING' END, CASE WHEN n_info > 0 THEN 'INFO' END) AS line FROM r WHERE state = 'needs_review'")
def review_queue_export(spark, sf):
    return export.review_lines(routed(spark, sf))


LATEST = f"{DEC}, l AS (SELECT *, row_number() OVER (PARTITION BY sku, field_key ORDER BY ts DESC, decision_id DESC) AS n FROM decisions)"


@query("upsert_latest", f"{LATEST} SELECT sku, field_key, ts, decision, new_value FROM l WHERE n = 1")
def upsert_latest(spark, sf):
    return review.latest(decided(spark, sf)).select("sku", "field_key", "ts", "decision", "new_value")


@query("apply_decisions", f"""{LATEST}, {V.SQL_FIELDS}, f AS (SELECT concat('P', lpad(CAST(record_id AS VARCHAR), 6, '0')) AS sku, key, value, confidence, n_error, n_warning FROM fields)
    SELECT f.sku, f.key, CASE d.decision WHEN 'edited' THEN d.new_value WHEN 'rejected' THEN NULL ELSE f.value END AS value, CASE d.decision WHEN 'edited' THEN 1e0 WHEN 'rejected' THEN 0e0 WHEN 'approved' THEN greatest(95e-2, f.confidence) ELSE f.confidence END AS confidence,
    CASE WHEN d.decision IN ('edited', 'rejected') THEN f.value END AS previous, CASE WHEN d.decision IN ('edited', 'approved') THEN 0 ELSE f.n_error END AS n_error, CASE WHEN d.decision = 'approved' THEN 0 ELSE f.n_warning END AS n_warning,
    CASE WHEN d.decision IN ('edited', 'approved') THEN 'human_approved' WHEN d.decision = 'rejected' THEN 'human_rejected' ELSE 'machine' END AS state FROM f LEFT JOIN l d ON d.n = 1 AND d.sku = f.sku AND d.field_key = f.key""")
def apply_decisions(spark, sf):
    f = V.fields(spark, sf).withColumn("sku", F.concat(F.lit("P"), F.lpad(F.col("record_id").cast("string"), 6, "0")))
    return review.apply_decisions(f, decided(spark, sf))


@query("decision_totals", f"{DEC} SELECT decision, count(*) AS n FROM decisions GROUP BY 1")
def decision_totals(spark, sf):
    return review.decision_totals(decided(spark, sf))


@query("most_corrected", f"{DEC} SELECT field_key, count(*) AS reviewed, count(CASE WHEN decision <> 'approved' THEN 1 END) AS corrected FROM decisions GROUP BY 1 HAVING count(*) >= 2 ORDER BY CAST(corrected AS DOUBLE) / reviewed DESC, field_key LIMIT 10")
def most_corrected(spark, sf):
    return review.most_corrected(decided(spark, sf))


RATE = "floor(count(CASE WHEN decision = 'approved' THEN 1 END) * 1000e0 / count(*) + 5e-1) / 10e0"


@query("approval_by_method", f"{DEC} SELECT method, count(*) AS reviewed, count(CASE WHEN decision = 'approved' THEN 1 END) AS approved, {RATE} AS rate FROM decisions WHERE method IS NOT NULL GROUP BY 1")
def approval_by_method(spark, sf):
    return review.approval_by_method(decided(spark, sf))


@query("agreement_rate", f"{DEC} SELECT count(*) AS reviewed, count(CASE WHEN decision = 'approved' THEN 1 END) AS approved, {RATE} AS rate FROM decisions")
def agreement_rate(spark, sf):
    return review.agreement_rate(decided(spark, sf))


@query("feedback_examples", f"{DEC} SELECT sku, field_key, new_value FROM decisions WHERE decision = 'edited' AND field_key = 'grit' ORDER BY ts DESC, decision_id DESC LIMIT 8")
def feedback_examples(spark, sf):
    return review.feedback_examples(decided(spark, sf), "grit").select("sku", "field_key", "new_value")


@query("point_lookup", f"{DEC} SELECT decision_id, decision FROM decisions WHERE sku = 'P000042'")
def point_lookup(spark, sf):
    return decided(spark, sf).filter(F.col("sku") == "P000042").select("decision_id", "decision")


@query("latest_runs", "SELECT o_orderkey AS run_id, o_orderdate AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def latest_runs(spark, sf):
    return V.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"))


@query("count_records", "SELECT count(*) AS n FROM part")
def count_records(spark, sf):
    return V.table(spark, sf, "part").agg(F.count("*").alias("n"))


@query("sliding_rate", "SELECT event_id, in_window, in_window <= 5 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events)")
def sliding_rate(spark, sf):
    return review.sliding_rate(V.table(spark, sf, "events"), "user_id", "ts", 3600, 5).select("event_id", "in_window", "allowed")
