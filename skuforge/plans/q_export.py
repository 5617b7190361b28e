"""Exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.functions import scalars as S
from skuforge.operators import export, score
from skuforge.plans.registry import query
from skuforge.sources import views as V

BASE = f"WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}"
KEYS = ["brand", "diameter", "length", "grit", "material"]
#: Every key that a cell can have.
ALL_KEYS = [key for key, *_ in V.FIELD_RULES]


def _pivot(where: str = "", keys: list[str] = KEYS) -> str:
    values = ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}, max(CASE WHEN key = '{k}' AND unit <> '' THEN unit END) AS {k}__unit" for k in keys)
    return f"SELECT record_id, {values} FROM fields {where} GROUP BY 1"


@query("flat_pivot", f"{BASE} {_pivot(keys=ALL_KEYS)}")
def flat_pivot(spark, sf):
    return export.flat(V.fields(spark, sf), ALL_KEYS)


@query("flat_publishable", f"{BASE} {_pivot(f'WHERE {score.SQL_PENALISED} >= 4e-1')}")
def flat_publishable(spark, sf):
    return export.flat(export.publishable(V.fields(spark, sf)), KEYS)


N_SLOTS = 50
SLOTS = f"""{BASE}, s AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY required DESC, weight DESC, {score.SQL_PENALISED} DESC, key) AS slot, label, value, fields.unit AS uom
    FROM fields JOIN category USING (record_id) JOIN spec USING (category, key) WHERE {score.SQL_PENALISED} >= 4e-1 AND key NOT IN {export.DEDICATED})"""


@query("attribute_slots", f"{SLOTS} SELECT record_id, CAST(slot AS INTEGER) AS slot, label, value, uom FROM s WHERE slot <= {N_SLOTS}")
def attribute_slots(spark, sf):
    return export.slots(V.fields(spark, sf), D.specs(spark), V.categories(spark, sf), N_SLOTS)


def _filled(columns: list[str]) -> str:
    return f"floor(sum({' + '.join(f'CASE WHEN trim({c}) <> {chr(39) * 2} THEN 1 ELSE 0 END' for c in columns)}) * 1000e0 / (count(*) * {len(columns)}) + 5e-1) / 10e0"


#: The delivery with all slots of the template.
SLOT_COLUMNS = [f"{c}_{i}" for i in range(1, N_SLOTS + 1) for c in ("label", "value", "uom")]
TEMPLATE_FULL = ["sku", "brand", "category", *SLOT_COLUMNS, "video_link"]
BLOCKS_FULL = {"identity": ["sku", "brand"], "taxonomy": ["category"], "attributes": SLOT_COLUMNS, "media": ["video_link"]}
DELIVERY_FULL = f"""{SLOTS}, p AS (SELECT record_id, {', '.join(f"max(CASE WHEN slot = {i} THEN {c} END) AS {c}_{i}" for i in range(1, N_SLOTS + 1) for c in ('label', 'value', 'uom'))} FROM s GROUP BY 1),
    delivery AS (SELECT CAST(record_id AS VARCHAR) AS sku, brand, category, {', '.join(f"coalesce({c}, '') AS {c}" for c in SLOT_COLUMNS)}, '' AS video_link FROM category LEFT JOIN p USING (record_id))"""


def delivery_full(spark, sf):
    s = export.slot_columns(export.slots(V.fields(spark, sf), D.specs(spark), V.categories(spark, sf), N_SLOTS), N_SLOTS)
    return export.template(V.categories(spark, sf).join(s, "record_id", "left").withColumn("sku", F.col("record_id")), TEMPLATE_FULL)


@query("delivery_row", f"{DELIVERY_FULL} SELECT * FROM delivery")
@query("delivery_row_full", f"{DELIVERY_FULL} SELECT * FROM delivery")
def delivery_row_full(spark, sf):
    return delivery_full(spark, sf)


COVERAGE = f"{DELIVERY_FULL} " + " UNION ALL ".join(f"SELECT '{b}' AS block, {len(c)} AS columns, {_filled(c)} AS filled FROM delivery" for b, c in BLOCKS_FULL.items())


@query("coverage_report", COVERAGE)
@query("coverage_report_full", COVERAGE)
def coverage_report_full(spark, sf):
    return export.coverage(delivery_full(spark, sf), BLOCKS_FULL)


@query("feature_slots", "SELECT p_partkey AS id, p_name AS feature_1, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS feature_2, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS feature_3 FROM part")
def feature_slots(spark, sf):
    items = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_brand", "p_type")).otherwise(F.array("p_name"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *export.features(items, 3))


@query("document_columns", """SELECT p_partkey % 10 AS id, min(CASE WHEN p_name LIKE '%bolt%' THEN concat(p_name, ' spec.pdf') END) AS spec_sheet, min(CASE WHEN p_name LIKE '%gear%' THEN concat(p_name, ' Manual.pdf') END) AS manual, CAST(NULL AS VARCHAR) AS warranty_doc,
    CAST(NULL AS VARCHAR) AS sds, CAST(NULL AS VARCHAR) AS brochure FROM part GROUP BY 1""")
def document_columns(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_name").contains("bolt"), " spec.pdf").when(F.col("p_name").contains("gear"), " Manual.pdf").otherwise(".pdf"))
    return export.document_columns(V.table(spark, sf, "part").select((F.col("p_partkey") % 10).alias("id"), name.alias("name")), "id", "name")


@query("sources_by_kind", """WITH d AS (SELECT page_id % 25 AS id, CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'web' END AS kind, url FROM pages), g AS (SELECT id, list_sort(list(DISTINCT url) FILTER (WHERE kind = 'web')) AS w, list_sort(list(DISTINCT url) FILTER (WHERE kind = 'image')) AS i FROM d GROUP BY 1)
    SELECT id, w[1] AS mfr_url, array_to_string(w[2:6], '|') AS references, i[1] AS image, array_to_string(i[2:5], '|') AS more_images FROM g""".replace("AS references", 'AS "references"'))
def sources_by_kind(spark, sf):
    d = V.table(spark, sf, "pages").select((F.col("page_id") % 25).alias("id"), F.when(F.col("page_id") % 3 == 0, "image").otherwise("web").alias("kind"), "url")
    return export.sources_by_kind(d, "id", "kind", "url")


@query("export_scope", f"{BASE} SELECT count(*) AS everything, count(CASE WHEN n_error = 0 AND {score.SQL_PENALISED} >= 75e-2 THEN 1 END) AS ready FROM fields")
def export_scope(spark, sf):
    ready = F.count(F.when((F.col("n_error") == 0) & (score.penalised() >= 0.75), 1))
    return V.fields(spark, sf).agg(F.count("*").alias("everything"), ready.alias("ready"))


@query("audit_json")
def audit_json(spark, sf):
    return export.audit(V.fields(spark, sf))


@query("prompt_dedupe", "SELECT sha256(concat('stub|v1|', text)) AS prompt_key, count(*) AS calls FROM conversations WHERE role = 'user' GROUP BY 1")
def prompt_dedupe(spark, sf):
    from skuforge.operators import runtime

    return runtime.distinct_prompts(V.table(spark, sf, "conversations").filter("role = 'user'"), "text", "stub", "v1").select("prompt_key", "calls")


@query("retry_hint", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(value) / 10 WHEN 1 THEN floor(value) END AS seconds FROM events")
def retry_hint(spark, sf):
    n = F.floor("value")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("429: Please retry in "), (n / 10).cast("string"), F.lit("s."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("\"retryDelay\": \""), n.cast("string"), F.lit("s\""))).otherwise("busy")
    return V.table(spark, sf, "events").select("event_id", S.retry_hint(text).alias("seconds"))


@query("json_salvage", """SELECT event_id, props AS json FROM events""")
def json_salvage(spark, sf):
    fenced = F.concat(F.lit("Here you go:\n```json\n"), "props", F.lit("\n```\nDone"))
    text = F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" ok")))
    return V.table(spark, sf, "events").select("event_id", S.json_salvage(text).alias("json"))
