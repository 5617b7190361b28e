"""The delivery in all its columns, prompts, the judge, the store and the record audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import delivery, export, judge, prompts, review, score, store
from skuforge.plans import q_score
from skuforge.plans.registry import query
from skuforge.sources import tables
from skuforge.sources import views as V

BASE = f"WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}"

_DOCS = """docs AS (SELECT page_id % 400 AS record_id, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'web' ELSE 'pdf' END AS kind, url,
    concat('p', CAST(page_id AS VARCHAR), CASE page_id % 5 WHEN 0 THEN ' Datasheet.pdf' WHEN 1 THEN ' user manual.pdf' WHEN 2 THEN ' SDS.pdf' WHEN 3 THEN ' Line Drawing.pdf' ELSE '.pdf' END) AS name FROM pages)"""


def documents(spark, sf):
    p = F.col("page_id")
    kind = F.when(p % 3 == 0, "image").when(p % 3 == 1, "web").otherwise("pdf")
    end = F.when(p % 5 == 0, " Datasheet.pdf").when(p % 5 == 1, " user manual.pdf").when(p % 5 == 2, " SDS.pdf").when(p % 5 == 3, " Line Drawing.pdf").otherwise(".pdf")
    return V.table(spark, sf, "pages").select((p % 400).alias("record_id"), kind.alias("kind"), "url", F.concat(F.lit("p"), p.cast("string"), end).alias("name"))


def supplied(spark, sf):
    return delivery.raw_rows(V.catalogue(spark, sf).withColumnRenamed("part_desc", "Part_Desc"), "row_idx")


def full(spark, sf):
    records = V.categories(spark, sf).select("record_id", F.concat(F.lit("P"), F.col("record_id").cast("string")).alias("sku"), "category")
    return delivery.deliver(records, V.fields(spark, sf), D.specs(spark), documents=documents(spark, sf), raw=supplied(spark, sf))


def _levels(i: int) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN '{x[i]}'" for c, x in D.TAXONOMY.items()) + " END"


def _full_sql() -> str:
    cells = ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS c_{k}" for k in ("brand", "short_desc", "warranty_months"))
    slots = ", ".join(f"max(CASE WHEN slot = {i} THEN {c} END) AS {c}_{i}" for i in range(1, 51) for c in ("label", "value", "uom"))
    words = lambda ws: " OR ".join(f"contains(lower(name), '{w}')" for w in ws)
    papers = ", ".join(f"min(CASE WHEN {words(ws)} THEN name END) AS d_{i}" for i, ws in enumerate(delivery.PAPER_WORDS.values()))
    dedicated = ", ".join(f"'{k}'" for k in (*delivery.DEDICATED, *delivery.CONTENT))
    made = {
        "PART_NUMBER": "sku", "Mfg_Part_Num": "sku", "MANUFACTURER_PART_NUMBER": "sku", "Dept": _levels(0), "Class": _levels(1), "Fine": _levels(2), "Product Name": _levels(2), "BRAND_NAME": "c_brand", "SHORT_DESC": "c_short_desc",
        "Classpath": f"array_to_string(list_filter([{_levels(0)}, {_levels(1)}, {_levels(2)}], lambda x: x <> ''), ' > ')", "Part_Desc": "trim(part_desc)", "E1_Brand": "trim(e1_brand)", "Part_Manuf": "trim(part_manuf)",
        "Warranty": "CASE CAST(c_warranty_months AS INTEGER) WHEN 0 THEN '' WHEN 12 THEN '1 Year Limited' WHEN 24 THEN '2 Years Limited' ELSE concat(c_warranty_months, ' Months Limited') END",
        "MFR URL": "w[1]", "Product Image": "i[1]", "Actual Image (Yes/No)": "CASE WHEN len(i) > 0 THEN 'Yes' END",
    }
    made["Warranty"] = f"CASE WHEN c_warranty_months IS NULL THEN '' ELSE {made['Warranty']} END"
    made |= {f"Ref URL {n}": f"w[{n + 1}]" for n in range(1, 6)} | {f"Alternate Image {n}": f"i[{n + 1}]" for n in range(1, 5)}
    made |= {f"ATTRIBUTE_{c.upper()} {n}": f"{c}_{n}" for n in range(1, 51) for c in ("label", "value", "uom")} | {c: f"d_{n}" for n, c in enumerate(delivery.PAPER_WORDS)}
    select = ", ".join(f"""coalesce({made.get(c, "''")}, '') AS "{c}\"""" for c in delivery.template())
    return f"""{BASE}, {V.SQL_CATALOGUE}, {_DOCS}, c AS (SELECT record_id, {cells} FROM fields GROUP BY 1),
    s AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY required DESC, weight DESC, {score.SQL_PENALISED} DESC, key) AS slot, label, value, spec.unit AS uom FROM fields JOIN category USING (record_id) JOIN spec USING (category, key)
        WHERE {score.SQL_PENALISED} >= 4e-1 AND key NOT IN ({dedicated})), p AS (SELECT record_id, {slots} FROM s GROUP BY 1),
    u AS (SELECT record_id, list_sort(list(DISTINCT url) FILTER (WHERE kind = 'web')) AS w, list_sort(list(DISTINCT url) FILTER (WHERE kind = 'image')) AS i FROM docs GROUP BY 1), d AS (SELECT record_id, {papers} FROM docs WHERE kind = 'pdf' GROUP BY 1),
    r AS (SELECT *, concat('P', CAST(record_id AS VARCHAR)) AS sku FROM category)
    SELECT record_id, {select} FROM r LEFT JOIN c USING (record_id) LEFT JOIN p USING (record_id) LEFT JOIN u USING (record_id) LEFT JOIN d USING (record_id) LEFT JOIN cat ON row_idx = record_id"""


@query("delivery_template", _full_sql())
def delivery_template(spark, sf):
    return full(spark, sf)


@query("raw_echo", f"WITH {V.SQL_CATALOGUE} SELECT row_idx AS record_id, trim(part_desc) AS part_desc, trim(e1_brand) AS e1_brand, CAST(NULL AS VARCHAR) AS absent FROM cat")
def raw_echo(spark, sf):
    r = F.col("raw")
    return supplied(spark, sf).select("record_id", delivery.echoed(r, "PART_DESC").alias("part_desc"), delivery.echoed(r, "e1_brand").alias("e1_brand"), delivery.echoed(r, "List Price").alias("absent"))


_LINE = """concat(key, ' (', coalesce(label, key), ') = ', value, CASE WHEN fields.unit <> '' THEN concat(' ', fields.unit) ELSE '' END, ' [', source, '/', method, '] "no evidence quoted"')"""
BLOCK = f"{BASE}, b AS (SELECT record_id, category, string_agg({_LINE}, chr(10) ORDER BY key) AS evidence FROM fields JOIN category USING (record_id) LEFT JOIN spec USING (category, key) GROUP BY 1, 2)"


def blocks(spark, sf):
    return judge.evidence_block(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark))


@query("judge_evidence", f"{BLOCK} SELECT * FROM b")
def judge_evidence(spark, sf):
    return blocks(spark, sf)


@query("judge_prompts", f"{BLOCK} SELECT record_id, sha256({prompts.prompt_sql('judge', category='category', evidence='evidence', codes=chr(39) + ', '.join(judge.CODES) + chr(39))}) AS prompt FROM b")
def judge_prompts(spark, sf):
    return judge.judge_prompts(blocks(spark, sf)).select("record_id", F.sha2("prompt", 256).alias("prompt"))


def _answers(spark, sf):
    """A judge's answers by rule: an issue on diameter, one with an unknown code, one on a cell that isn't there, and two confidences."""
    k = F.col("p_partkey")
    first = F.concat(F.lit('{"field_key": "diameter", "code": "unit_suspect", "severity": "'), F.when(k % 2 == 0, "error").otherwise("grave"), F.lit('", "message": "m"}'))
    rest = F.lit('{"field_key": "grit", "code": "NO_SUCH_CODE", "severity": "error"}, {"field_key": "voltage", "code": "WRONG_ATTRIBUTE", "severity": "info"}, {"field_key": "voltage", "code": "MISSING_CRITICAL"}')
    text = F.concat(F.lit('Here: {"issues": ['), first, F.lit(", "), rest, F.lit('], "verdict": "minor_issues", "confidence_adjustments": {"brand": "0.3", "grit": "1", "length": "low"}}'))
    return tables.spread(V.table(spark, sf, "part"), "p_partkey").select(k.alias("record_id"), F.when(k % 7 == 0, "no answer").otherwise(text).alias("answer"))


_JUDGE = f"""WITH {V.SQL_FIELDS}, a AS (SELECT p_partkey AS record_id FROM part WHERE p_partkey % 7 <> 0), d AS (SELECT record_id FROM fields WHERE key = 'diameter'),
    i AS (SELECT record_id, 'diameter' AS key, 'UNIT_SUSPECT' AS code, CASE WHEN record_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM a JOIN d USING (record_id)
    UNION ALL SELECT record_id, NULL, 'UNIT_SUSPECT', CASE WHEN record_id % 2 = 0 THEN 'error' ELSE 'warning' END FROM a WHERE record_id NOT IN (SELECT record_id FROM d)
    UNION ALL SELECT record_id, NULL, 'WRONG_ATTRIBUTE', 'info' FROM a UNION ALL SELECT record_id, 'voltage', 'MISSING_CRITICAL', 'warning' FROM a)"""


@query("judge_issues", f"{_JUDGE} SELECT record_id, key, code, severity FROM i")
def judge_issues(spark, sf):
    return judge.issues(_answers(spark, sf), "answer", V.fields(spark, sf)).select("record_id", "key", "code", "severity")


@query("judge_review", f"""{_JUDGE}, f AS (SELECT record_id, min(key) AS first_key FROM fields GROUP BY 1), n AS (SELECT record_id, CASE WHEN key = 'diameter' THEN key ELSE first_key END AS key, count(CASE WHEN severity = 'error' THEN 1 END) AS e, count(CASE WHEN severity = 'warning' THEN 1 END) AS w, count(CASE WHEN severity = 'info' THEN 1 END) AS o FROM i JOIN f USING (record_id) GROUP BY 1, 2)
    SELECT record_id, key, CASE WHEN record_id % 7 <> 0 AND key = 'brand' THEN greatest(0e0, least(1e0, 3e-1, confidence + 5e-2)) WHEN record_id % 7 <> 0 AND key = 'grit' THEN greatest(0e0, least(1e0, 1e0, confidence + 5e-2)) ELSE confidence END AS confidence,
    n_error + coalesce(e, 0) AS n_error, n_warning + coalesce(w, 0) AS n_warning, n_info + coalesce(o, 0) AS n_info FROM fields LEFT JOIN n USING (record_id, key)""")
def judge_review(spark, sf):
    return judge.judged(V.fields(spark, sf), _answers(spark, sf), "answer").select("record_id", "key", "confidence", "n_error", "n_warning", "n_info")


_FILLED = {"options": ("p_type", "p_type"), "text": ("p_name", "p_name"), "source": ("p_brand", "p_brand"), "category": ("p_type", "p_type"), "brand": ("p_brand", "p_brand"), "sku": ("CAST(p_partkey AS VARCHAR)", "p_partkey"), "product": ("p_name", "p_name"), "label": ("p_size", "p_size")}


def _value(place: str) -> tuple[str, str]:
    return _FILLED.get(place, ("p_name", "p_name"))


@query("prompt_builders", "SELECT p_partkey AS id, " + ", ".join(f"sha256({prompts.prompt_sql(t, **{p: _value(p)[0] for p in prompts.places(t)})}) AS {t}" for t in prompts.TEXTS) + " FROM part")
def prompt_builders(spark, sf):
    built = [F.sha2(prompts.prompt(t, **{p: F.col(_value(p)[1]) for p in prompts.places(t)}), 256).alias(t) for t in prompts.TEXTS]
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *built)


@query("load_all", "SELECT o_orderkey AS record_id, o_orderdate AS updated FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000")
def load_all(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("updated"))
    return store.load_all(orders, "updated", "record_id")


@query("clear_tables", "SELECT count(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM part")
def clear_tables(spark, sf):
    folder = tables.stored(V.table(spark, sf, "part").select("p_partkey", "p_name"), "products")
    removed = store.clear(spark, folder)
    return spark.read.parquet(folder).agg(F.lit(removed).cast("long").alias("removed"), F.count("*").alias("remaining"))


_SCORES = f"{score.SQL_COMPLETENESS}, {score.SQL_ACCURACY}, {score.SQL_CONSISTENCY}, {score.SQL_RICHNESS}, {score.SQL_OVERALL}"
_MEAN = q_score.MEAN.format("overall")


@query("batch_uplift", f"""WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS.replace('fields AS (', 'all_fields AS (', 1)}, {D.specs_sql()},
    b AS (SELECT {_MEAN} AS x FROM (WITH fields AS (SELECT * FROM all_fields WHERE method = 'input_field'), {_SCORES} SELECT overall FROM overall)), a AS (SELECT {_MEAN} AS x, count(*) AS total FROM (WITH fields AS (SELECT * FROM all_fields), {_SCORES} SELECT overall FROM overall)),
    r AS (WITH fields AS (SELECT * FROM all_fields) {review.SQL_ROUTED}) SELECT total, b.x AS avg_before, a.x AS avg_after, floor((a.x - b.x) * 10 + 5e-1) / 10e0 AS uplift, (SELECT count(*) FROM r) AS filled, (SELECT count(*) FROM r WHERE state = 'needs_review') AS flagged FROM a, b""")
def batch_uplift(spark, sf):
    fields, cats, specs = V.fields(spark, sf), V.categories(spark, sf), D.specs(spark)
    return score.uplift(score.overall(cats, fields.filter("method = 'input_field'"), specs), score.overall(cats, fields, specs), review.route(fields))


@query("audit_cells", f"WITH {V.SQL_FIELDS} SELECT record_id, key, value, unit, {score.SQL_PENALISED} AS confidence, method, source, n_error + n_warning + n_info AS issues FROM fields")
def audit_cells(spark, sf):
    records = V.categories(spark, sf).select("record_id", F.concat(F.lit("P"), F.col("record_id").cast("string")).alias("sku"), "category")
    told = export.audit_record(records, V.fields(spark, sf))
    kept = F.from_json("record", "struct<attributes:map<string,struct<value:string,unit:string,confidence:double,method:string,source:string,issues:struct<error:int,warning:int,info:int>>>>")
    rows = told.select("record_id", F.explode(kept["attributes"]).alias("key", "c"))
    i = F.col("c.issues")
    return rows.select("record_id", "key", "c.value", "c.unit", "c.confidence", "c.method", "c.source", (i["error"] + i["warning"] + i["info"]).alias("issues"))
