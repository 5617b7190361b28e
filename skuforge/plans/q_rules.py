"""Fusion and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import canonical, fusion, rules
from skuforge.plans.registry import query
from skuforge.sources import tables
from skuforge.sources import views as V

CAND = f"WITH {V.SQL_CANDIDATES}"
PREC = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.PRECEDENCE.items()) + " ELSE 0 END"


@query("value_agreement", f"{CAND} SELECT a.record_id, count(*) AS pairs FROM candidates a JOIN candidates b ON a.record_id = b.record_id AND a.seq < b.seq AND abs(a.value - b.value) <= 2e-2 * greatest(abs(a.value), abs(b.value)) WHERE a.record_id < 200 AND b.record_id < 200 GROUP BY 1".replace(" WHERE a.record_id < 200 AND b.record_id < 200", ""))
def value_agreement(spark, sf):
    c = V.candidates(spark, sf)
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.record_id") == F.col("b.record_id")) & (F.col("a.seq") < F.col("b.seq")) & fusion.numbers_agree(F.col("a.value"), F.col("b.value")))
    return pairs.groupBy(F.col("a.record_id").alias("record_id")).agg(F.count("*").alias("pairs"))


@query("golden_rank", f"{CAND} SELECT record_id, seq, value, {PREC} AS precedence, CAST(row_number() OVER (PARTITION BY record_id, key ORDER BY {PREC} DESC, confidence DESC, seq, value) AS INTEGER) AS rank FROM candidates")
def golden_rank(spark, sf):
    return fusion.ranked(V.candidates(spark, sf)).select("record_id", "seq", "value", "precedence", "rank")


@query("list_union", f"""{CAND}, c AS (SELECT record_id, source, concat('v', CAST(CAST(value AS BIGINT) % 5 AS VARCHAR)) AS v, lpad(CAST(seq AS VARCHAR), 20, '0') AS s FROM candidates),
    u AS (SELECT record_id, source AS item, concat(s, v, '1') AS place FROM c UNION ALL SELECT record_id, v, concat(s, v, '2') FROM c), f AS (SELECT record_id, item, min(place) AS place FROM u GROUP BY 1, 2),
    n AS (SELECT record_id, least(15, 6 * (count(*) - 1)) AS bonus_percent FROM c GROUP BY 1)
    SELECT record_id, string_agg(item, '|' ORDER BY place) AS items, any_value(bonus_percent) AS bonus_percent FROM f JOIN n USING (record_id) GROUP BY record_id""")
def list_union(spark, sf):
    c = V.candidates(spark, sf).withColumn("value", F.array("source", F.concat(F.lit("v"), (F.col("value").cast("long") % 5).cast("string"))))
    return fusion.union_of_lists(c).select("record_id", F.array_join("items", "|").alias("items"), F.col("bonus_percent").cast("long").alias("bonus_percent"))


RESOLVED = f"""{CAND}, p AS (SELECT *, {PREC} AS precedence FROM candidates), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY precedence DESC, confidence DESC, seq, value) AS rank FROM p),
    t AS (SELECT record_id, key, value AS tv, source AS ts, precedence AS tp, confidence AS tc FROM r WHERE rank = 1), j AS (SELECT r.*, tv, ts, tp, tc, abs(value - tv) <= 2e-2 * greatest(abs(value), abs(tv)) AS agrees FROM r JOIN t USING (record_id)),
    g AS (SELECT record_id, any_value(key) AS key, any_value(tv) AS value, any_value(ts) AS source, any_value(tp) AS tp, any_value(tc) AS tc, count(DISTINCT CASE WHEN agrees AND source <> ts THEN source END) AS support,
        count(CASE WHEN NOT agrees THEN 1 END) AS alternatives, arg_min(CASE WHEN NOT agrees THEN value END, CASE WHEN NOT agrees THEN rank END) AS rv, arg_min(CASE WHEN NOT agrees THEN precedence END, CASE WHEN NOT agrees THEN rank END) AS rp FROM j GROUP BY 1),
    b AS (SELECT *, greatest(abs(rv), abs(value)) / nullif(least(abs(rv), abs(value)), 0) AS big FROM g),
    i AS (SELECT *, CASE WHEN alternatives = 0 THEN '' WHEN tp - rp >= 20 THEN 'SOURCE_CONFLICT_KEPT' WHEN abs(big - 10) <= 2e-2 * 10 OR abs(big - 100) <= 2e-2 * 100 OR abs(big - 1000) <= 2e-2 * 1000 THEN 'UNIT_SUSPECT' ELSE 'SOURCE_CONFLICT' END AS issue FROM b)
    SELECT record_id, key, value, source, floor(least(least(1e0, tc + least(15, support * 6) / 100e0), CASE issue WHEN '' THEN 1e0 WHEN 'SOURCE_CONFLICT_KEPT' THEN 85e-2 WHEN 'UNIT_SUSPECT' THEN 5e-1 ELSE 55e-2 END) * 1000 + 5e-1) / 1000e0 AS confidence,
        CAST(support AS INTEGER) AS support, CAST(alternatives AS INTEGER) AS alternatives, issue FROM i"""


@query("conflict_resolve", RESOLVED)
def conflict_resolve(spark, sf):
    return fusion.resolve(V.candidates(spark, sf))


#: Diameters of a fastener in several units: inches, centimetres, a range in millimetres, and ten times too much from some.
TYPED = (("0", "input", "0.9", "concat(CAST(p_size AS VARCHAR(20)), ' in')", "p_partkey % 2 = 0"), ("1", "pdf", "0.8", "concat(CAST(p_size * 3 AS VARCHAR(20)), ' cm')", "p_partkey % 3 > 0"), ("2", "pdf", "0.7", "CAST(p_size * 10 AS VARCHAR(20))", "p_partkey % 5 = 0"), ("3", "web", "0.95", "concat(CAST(p_size * 25 AS VARCHAR(20)), ' to ', CAST(p_size * 25 + 1 AS VARCHAR(20)), ' mm')", "p_partkey % 7 > 1"), ("4", "image", "0.4", "'about'", "p_partkey % 4 = 1"))
TYPED_SQL = " UNION ALL ".join(f"SELECT p_partkey AS record_id, {q} AS seq, '{s}' AS source, CAST({c} AS DOUBLE) AS confidence, {v} AS value FROM part WHERE {w}" for q, s, c, v, w in TYPED)
NUMBER_SQL = "CASE seq WHEN 0 THEN p_size WHEN 1 THEN round(p_size * 3 * CAST(0.393701 AS DOUBLE), 6) WHEN 2 THEN p_size * 10 WHEN 3 THEN round((p_size * 25e0 + p_size * 25e0 + 1) / 2 * CAST(0.0393701 AS DOUBLE), 6) END"
SHOWN_SQL = "CASE WHEN n IS NULL THEN value WHEN n = floor(n) THEN CAST(CAST(floor(n) AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END"


@query("conflict_typed", f"""WITH c AS ({TYPED_SQL}), p AS (SELECT c.*, CAST({NUMBER_SQL} AS DOUBLE) AS n, {PREC} AS precedence FROM c JOIN part ON p_partkey = record_id), r AS (SELECT *, {SHOWN_SQL} AS v, row_number() OVER (PARTITION BY record_id ORDER BY precedence DESC, confidence DESC, seq) AS rank FROM p),
    t AS (SELECT record_id, n AS tn, v AS tv, source AS ts, precedence AS tp, confidence AS tc FROM r WHERE rank = 1), j AS (SELECT r.*, tn, tv, ts, tp, tc, CASE WHEN n IS NOT NULL AND tn IS NOT NULL THEN abs(n - tn) <= 2e-2 * greatest(abs(n), abs(tn)) ELSE lower(v) = lower(tv) END AS agrees FROM r JOIN t USING (record_id)),
    g AS (SELECT record_id, any_value(tn) AS number, any_value(ts) AS source, any_value(tp) AS tp, any_value(tc) AS tc, count(DISTINCT CASE WHEN agrees AND source <> ts THEN source END) AS support, count(CASE WHEN NOT agrees THEN 1 END) AS alternatives,
        arg_min(CASE WHEN NOT agrees THEN coalesce(n, -1) END, CASE WHEN NOT agrees THEN rank END) AS rn, arg_min(CASE WHEN NOT agrees THEN precedence END, CASE WHEN NOT agrees THEN rank END) AS rp FROM j GROUP BY 1),
    q AS (SELECT record_id, n, lag(n) OVER (PARTITION BY record_id ORDER BY n) AS before FROM r WHERE n IS NOT NULL), f AS (SELECT record_id, count(CASE WHEN before IS NULL OR abs(n - before) > 2e-2 * greatest(abs(n), abs(before)) THEN 1 END) AS facts FROM q GROUP BY 1),
    b AS (SELECT g.*, coalesce(f.facts, 1) AS facts, CASE WHEN rn >= 0 THEN greatest(rn, number) / nullif(least(rn, number), 0) END AS big FROM g LEFT JOIN f ON f.record_id = g.record_id),
    i AS (SELECT *, CASE WHEN alternatives = 0 THEN '' WHEN tp - rp >= 20 THEN 'SOURCE_CONFLICT_KEPT' WHEN abs(big - 10) <= 2e-1 OR abs(big - 100) <= 2 OR abs(big - 1000) <= 20 THEN 'UNIT_SUSPECT' ELSE 'SOURCE_CONFLICT' END AS issue FROM b)
    SELECT record_id, number, source, floor(least(least(1e0, tc + least(15, support * 6) / 100e0), CASE issue WHEN '' THEN 1e0 WHEN 'SOURCE_CONFLICT_KEPT' THEN 85e-2 WHEN 'UNIT_SUSPECT' THEN 5e-1 ELSE 55e-2 END) * 1000 + 5e-1) / 1000e0 AS confidence, CAST(support AS INTEGER) AS support, CAST(alternatives AS INTEGER) AS alternatives, CAST(facts AS INTEGER) AS facts, issue FROM i""")
def conflict_typed(spark, sf):
    V.table(spark, sf, "part").createOrReplaceTempView("part_of_typed")
    cells = spark.sql(TYPED_SQL.replace("FROM part", "FROM part_of_typed")).withColumns({"key": F.lit("diameter"), "category": F.lit("fastener"), "unit": F.lit(""), "method": F.lit("regex")})
    found = fusion.resolve_typed(canonical.canonicalise(cells, D.specs(spark)))
    return found.select("record_id", "number", "source", "confidence", "support", "alternatives", "facts", "issue")


@query("corroboration", f"SELECT support, count(*) AS records FROM ({RESOLVED}) GROUP BY 1")
def corroboration(spark, sf):
    return fusion.resolve(V.candidates(spark, sf)).groupBy("support").agg(F.count("*").alias("records"))


@query("conflict_count", f"SELECT issue, count(*) AS records, sum(alternatives) AS losers FROM ({RESOLVED}) GROUP BY 1")
def conflict_count(spark, sf):
    return fusion.resolve(V.candidates(spark, sf)).groupBy("issue").agg(F.count("*").alias("records"), F.sum("alternatives").alias("losers"))


#: Wide specimens for the rules: category and columns, plain SQL over part.
SPECIMEN = {
    "record_id": "p_partkey",
    "category": "CASE p_partkey % 7 WHEN 0 THEN 'electric_motor' WHEN 1 THEN 'ball_bearing' WHEN 2 THEN 'power_cable' WHEN 3 THEN 'centrifugal_pump' WHEN 4 THEN 'circuit_breaker' WHEN 5 THEN 'industrial_valve' ELSE 'proximity_sensor' END",
    "temp_min": "CAST(p_size - 20 AS DOUBLE)", "temp_max": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 60 AS DOUBLE) END",
    "length_mm": "CAST(p_size * 10 AS DOUBLE)", "width_mm": "CAST(p_partkey % 40 AS DOUBLE)", "height_mm": "CAST(p_partkey % 13 + 1 AS DOUBLE)", "weight_kg": "CAST(p_partkey % 100 AS DOUBLE) / 10",
    "power_kw": "CAST(p_size AS DOUBLE)", "volts": "CAST(230 AS DOUBLE)", "amps": "CAST(p_partkey % 200 AS DOUBLE)", "power_factor": "CAST(8 AS DOUBLE)", "phase_factor": "CASE WHEN p_partkey % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END / 10",
    "rpm": "CAST(p_size * 70 AS DOUBLE)", "hertz": "CAST(50 AS DOUBLE)", "poles": "CAST(p_partkey % 3 * 2 + 2 AS DOUBLE)", "power_factor_raw": "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / 50 ELSE CAST(p_size + 40 AS DOUBLE) END",
    "bore_mm": "CAST(p_size AS DOUBLE)", "outer_mm": "CAST(p_partkey % 70 AS DOUBLE)", "static_kn": "CAST(p_size AS DOUBLE)", "dynamic_kn": "CAST(p_partkey % 30 AS DOUBLE)",
    "area_mm2": "CAST(p_size % 16 AS DOUBLE)", "conductor": "CASE WHEN p_partkey % 2 = 0 THEN 'aluminium' ELSE 'copper' END", "cores": "CAST(p_partkey % 4 + 1 AS DOUBLE)",
    "flow_m3h": "CAST(p_partkey % 90 AS DOUBLE)", "head_m": "CAST(p_size AS DOUBLE)", "inlet_mm": "CAST(p_size AS DOUBLE)", "outlet_mm": "CAST(p_partkey % 50 AS DOUBLE)",
    "breaking_ka": "CAST(p_partkey % 15 AS DOUBLE) / 100", "breaker_type": "CASE WHEN p_partkey % 2 = 0 THEN 'MCB' ELSE 'MCCB' END", "dn_mm": "CAST(p_size * 10 AS DOUBLE)", "bar": "CAST(p_partkey % 400 AS DOUBLE)",
    "sensor_type": "CASE WHEN p_partkey % 3 = 0 THEN 'inductive' ELSE 'capacitive' END", "range_mm": "CAST(p_size AS DOUBLE)", "barrel_mm": "CAST(p_partkey % 30 AS DOUBLE)",
}
SQL_SPECIMEN = "specimen AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SPECIMEN.items()) + " FROM part)"


def specimens(spark, sf):
    return V.table(spark, sf, "part").select(*(F.expr(v).alias(k) for k, v in SPECIMEN.items()))


@query("rule_issues", f"WITH {SQL_SPECIMEN} {rules.rules_sql('specimen')}")
def rule_issues(spark, sf):
    return rules.run_rules(specimens(spark, sf))


@query("rule_summary", f"WITH {SQL_SPECIMEN}, i AS ({rules.rules_sql('specimen')}) SELECT code, severity, count(*) AS fired, count(DISTINCT record_id) AS records FROM i GROUP BY 1, 2")
def rule_summary(spark, sf):
    return rules.run_rules(specimens(spark, sf)).groupBy("code", "severity").agg(F.count("*").alias("fired"), F.countDistinct("record_id").alias("records"))


def _one(rule: rules.Rule) -> None:
    @query(f"rule_{rule.name}", f"WITH {SQL_SPECIMEN} {rules.rules_sql('specimen', (rule,))}")
    def run(spark, sf):
        return rules.run_rules(specimens(spark, sf), (rule,))


for _rule in rules.RULES:
    _one(_rule)

REQUIRED = f"WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}, missing AS (SELECT record_id, key FROM category JOIN spec USING (category) WHERE required AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.record_id = category.record_id AND f.key = spec.key))"


@query("rule_missing_required", f"{REQUIRED} SELECT record_id, key, 'MISSING_REQUIRED' AS code FROM missing")
def rule_missing_required(spark, sf):
    return rules.missing_required(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark)).withColumn("code", F.lit("MISSING_REQUIRED"))


@query("missing_required_counts", f"{REQUIRED} SELECT key, count(*) AS n FROM missing GROUP BY 1")
def missing_required_counts(spark, sf):
    return rules.missing_required(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark)).groupBy("key").agg(F.count("*").alias("n"))


@query("issue_attach", f"WITH {V.SQL_FIELDS}, i AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 2 = 0 THEN 'finish' ELSE 'grit' END AS key, 'CHECK' AS code FROM part) SELECT record_id, key, code, CASE WHEN EXISTS (SELECT 1 FROM fields f WHERE f.record_id = i.record_id AND f.key = i.key) THEN 'field' ELSE 'record' END AS attached FROM i")
def issue_attach(spark, sf):
    k = F.col("p_partkey")
    issues = tables.spread(V.table(spark, sf, "part"), "p_partkey").select(k.alias("record_id"), F.when(k % 2 == 0, "finish").otherwise("grit").alias("key"), F.lit("CHECK").alias("code"))
    return rules.attach(issues, V.fields(spark, sf))


@query("issue_replace", "SELECT p_partkey AS record_id, 'OLD' AS code, 'judge' AS raised_by FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'NEW', 'rule_engine' FROM part WHERE p_size > 25")
def issue_replace(spark, sf):
    part = V.table(spark, sf, "part")
    old = part.select(F.col("p_partkey").alias("record_id"), F.lit("OLD").alias("code"), F.when(F.col("p_partkey") % 2 == 0, "rule_engine").otherwise("judge").alias("raised_by"))
    new = part.filter("p_size > 25").select(F.col("p_partkey").alias("record_id"), F.lit("NEW").alias("code"), F.lit("rule_engine").alias("raised_by"))
    return rules.replace_issues(old, new, "rule_engine")


@query("confidence_adjust", "SELECT p_partkey AS record_id, greatest(0e0, least(1e0, p_partkey % 11 / 10e0, p_size / 50e0 + 5e-2)) AS confidence FROM part")
def confidence_adjust(spark, sf):
    rows = V.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") / 50.0).alias("now"), (F.col("p_partkey") % 11 / 10.0).alias("said"))
    return rows.select("record_id", rules.adjust_confidence("now", "said").alias("confidence"))
