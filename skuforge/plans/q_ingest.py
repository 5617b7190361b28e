"""Queries over catalogue rows: scans, header mapping, filters, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.functions import pages
from skuforge.functions import scalars as S
from skuforge.functions import units as U
from skuforge.operators import ingest, score
from skuforge.plans.registry import query
from skuforge.sources import views as V

CAT = f"WITH {V.SQL_CATALOGUE}"
PLACEHOLDER = "(lower(trim(coalesce({0}, ''))) IN ('', " + ", ".join(f"'{p}'" for p in S.PLACEHOLDERS) + ") OR regexp_full_match(lower(trim(coalesce({0}, ''))), '--.*--'))"
CODE = r"'\s*\([A-Z0-9]{3,8}\)\s*$'"


@query("limit_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def limit_head(spark, sf):
    return V.table(spark, sf, "part").orderBy("p_partkey").limit(100).select("p_partkey", "p_name")


@query("placeholder_filter", f"{CAT} SELECT row_idx, e1_brand FROM cat WHERE NOT {PLACEHOLDER.format('e1_brand')}")
def placeholder_filter(spark, sf):
    return V.catalogue(spark, sf).filter(~S.is_placeholder(F.col("e1_brand"))).select("row_idx", "e1_brand")


@query("vendor_code_strip", rf"{CAT} SELECT row_idx, trim(regexp_replace(part_manuf, {CODE}, '')) AS account, regexp_extract(part_manuf, '\s*\(([A-Z0-9]{{3,8}})\)\s*$', 1) AS code FROM cat")
def vendor_code_strip(spark, sf):
    m = F.col("part_manuf")
    return V.catalogue(spark, sf).select("row_idx", S.without_vendor_code(m).alias("account"), S.vendor_code(m).alias("code"))


@query("brand_coalesce", f"""{CAT} SELECT row_idx, CASE WHEN NOT {PLACEHOLDER.format('e1_brand')} THEN e1_brand WHEN NOT {PLACEHOLDER.format('alt_brand')} THEN alt_brand END AS brand,
    CASE WHEN NOT {PLACEHOLDER.format('e1_brand')} AND NOT {PLACEHOLDER.format('alt_brand')} THEN alt_brand ELSE '' END AS alternatives FROM cat""")
def brand_coalesce(spark, sf):
    pick = ingest.first_real(F.col("e1_brand"), F.col("alt_brand"))
    return V.catalogue(spark, sf).select("row_idx", pick.alias("b")).select("row_idx", F.col("b.value").alias("brand"), F.array_join("b.alternatives", "|").alias("alternatives"))


@query("unpivot_cells", f"""{CAT}, long AS (
    UNPIVOT (SELECT row_idx, part_desc, e1_brand, alt_brand, part_manuf FROM cat) ON part_desc, e1_brand, alt_brand, part_manuf INTO NAME key VALUE value)
    SELECT row_idx, key, value, concat('input#row=', CAST(row_idx AS VARCHAR), '&col=', key) AS source_ref FROM long WHERE NOT {PLACEHOLDER.format('value')}""")
def unpivot_cells(spark, sf):
    return ingest.cells(V.catalogue(spark, sf), "row_idx", ["part_desc", "e1_brand", "alt_brand", "part_manuf"])


@query("unmapped_tail", f"""{CAT} SELECT row_idx, array_to_string(list_filter([CASE WHEN NOT {PLACEHOLDER.format('e1_brand')} THEN concat('e1_brand: ', e1_brand) END,
    CASE WHEN NOT {PLACEHOLDER.format('alt_brand')} THEN concat('alt_brand: ', alt_brand) END], lambda x: x IS NOT NULL), chr(10)) AS tail FROM cat""")
def unmapped_tail(spark, sf):
    return V.catalogue(spark, sf).select("row_idx", ingest.unmapped_tail(["e1_brand", "alt_brand"]).alias("tail"))


@query("dedupe_suffix", f"""{CAT}, n AS (SELECT *, row_number() OVER (PARTITION BY mfg_part_num ORDER BY row_idx) - 1 AS k FROM cat)
    SELECT row_idx, CASE WHEN k = 0 THEN mfg_part_num ELSE concat(mfg_part_num, '--dup', CAST(k AS VARCHAR)) END AS unique_sku FROM n""")
def dedupe_suffix(spark, sf):
    return ingest.unique_sku(V.catalogue(spark, sf), "mfg_part_num", "row_idx").select("row_idx", "unique_sku")


@query("catalog_search", f"{CAT} SELECT row_idx, mfg_part_num FROM cat WHERE contains(lower(concat_ws(' ', mfg_part_num, part_desc, e1_brand)), 'bolt') AND e1_brand <> 'Brand#1'")
def catalog_search(spark, sf):
    rows = V.catalogue(spark, sf)
    return rows.filter(ingest.contains_text("Bolt", "mfg_part_num", "part_desc", "e1_brand") & (F.col("e1_brand") != "Brand#1")).select("row_idx", "mfg_part_num")


ATTACHED = """WITH f AS (SELECT page_id, upper(regexp_extract(url, '([^/?]*)(?:\\?|$)', 1)) AS stem FROM pages), k AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS sku FROM part)
    SELECT page_id, stem, min(sku) AS sku FROM f JOIN k ON contains(stem, sku) GROUP BY 1, 2"""


@query("containment_join", ATTACHED)
@query("containment_join_all", ATTACHED)
def containment_join_all(spark, sf):
    files = V.table(spark, sf, "pages").select("page_id", F.upper(F.regexp_extract("url", r"([^/?]*)(?:\?|$)", 1)).alias("stem"))
    return ingest.attach_by_name(files, V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sku")))


def _votes(column: str) -> str:
    names = list(dict.fromkeys(c for c, _ in D.KEYWORDS))
    return ", ".join("(" + " + ".join(f"CASE WHEN contains(lower({column}), '{k}') THEN {len(k.split())} ELSE 0 END" for c, k in D.KEYWORDS if c == n) + f") AS v_{n}" for n in names)


@query("classify_keyword_vote", f"""WITH v AS (SELECT p_partkey, {_votes('p_name')} FROM part), b AS (SELECT *, greatest(v_fastener, v_motion_part, v_metal_panel) AS best, v_fastener + v_motion_part + v_metal_panel AS total FROM v)
    SELECT p_partkey, CASE WHEN best = 0 THEN 'general_product' WHEN v_fastener = best THEN 'fastener' WHEN v_motion_part = best THEN 'motion_part' ELSE 'metal_panel' END AS category,
    CASE WHEN best = 0 THEN CAST(0 AS DOUBLE) ELSE floor(best / total * 100 + 0.5) / 100.0 END AS category_confidence FROM b""")
def classify_keyword_vote(spark, sf):
    return ingest.classify(V.table(spark, sf, "part"), "p_name", D.KEYWORDS, D.GENERIC).select("p_partkey", "category", "category_confidence")


@query("classify_escalation", f"""WITH v AS (SELECT p_partkey, {_votes('p_name')} FROM part), b AS (SELECT *, greatest(v_fastener, v_motion_part, v_metal_panel) AS best, v_fastener + v_motion_part + v_metal_panel AS total FROM v)
    SELECT CASE WHEN best > 0 AND floor(best / total * 100 + 0.5) / 100.0 >= 0.6 THEN 'accepted' ELSE 'escalated' END AS outcome, count(*) AS n FROM b GROUP BY 1""")
def classify_escalation(spark, sf):
    rows = ingest.classify(V.table(spark, sf, "part"), "p_name", D.KEYWORDS, D.GENERIC)
    outcome = F.when((F.col("category") != D.GENERIC) & (F.col("category_confidence") >= 0.6), "accepted").otherwise("escalated")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


TAXON = " ".join(f"WHEN '{c}' THEN '{'>'.join(filter(None, t))}'" for c, t in D.TAXONOMY.items())


@query("taxonomy_path", f"WITH {V.SQL_CATEGORY} SELECT record_id, CASE category {TAXON} END AS path FROM category")
def taxonomy_path(spark, sf):
    paths = F.create_map(*(F.lit(x) for c, t in D.TAXONOMY.items() for x in (c, ">".join(filter(None, t)))))
    return V.categories(spark, sf).select("record_id", paths[F.col("category")].alias("path"))


@query("spec_expand", f"WITH {V.SQL_CATEGORY}, {D.specs_sql()} SELECT record_id, key, label, required, weight FROM category JOIN spec USING (category)")
def spec_expand(spark, sf):
    return V.categories(spark, sf).join(F.broadcast(D.specs(spark)), "category").select("record_id", "key", "label", "required", "weight")


@query("flagship_quality_by_category", f"""WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}, {score.SQL_COMPLETENESS}
    SELECT category, count(*) AS records, CAST(sum(CAST(round(completeness * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*) AS completeness FROM completeness JOIN category USING (record_id) GROUP BY 1""")
def flagship_quality_by_category(spark, sf):
    done = score.completeness(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark))
    mean = F.sum(F.round(F.col("completeness") * 10).cast("long")).cast("double") / 10 / F.count("*")
    return done.groupBy("category").agg(F.count("*").alias("records"), mean.alias("completeness"))


# ---- texts and documents ------------------------------------------------------------------------------------------------


@query("truncate_head_tail", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 700), chr(10), '[... truncated ...]', chr(10), substr(text, length(text) - 299)) ELSE text END AS text FROM documents")
def truncate_head_tail(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.truncated(F.col("text"), 1000).alias("text"))


@query("evidence_locator", "SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN concat(source, '#offset=', CAST(instr(text, 'the') - 1 AS VARCHAR)) ELSE source END AS locator FROM documents")
def evidence_locator(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.located(F.col("text"), F.lit("the"), F.col("source")).alias("locator"))


@query("page_locator", r"SELECT doc_id, CASE WHEN instr(text, 'en') > 0 THEN CAST(len(string_split(substr(text, 1, instr(text, 'en')), chr(10))) - 1 AS INTEGER) ELSE 0 END AS page FROM documents")
def page_locator(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.page_of(F.col("text"), F.lit("en"), "\n").alias("page"))


@query("doc_fingerprint", "SELECT doc_id, substr(sha256(concat(text, coalesce(source, ''))), 1, 16) AS fingerprint FROM documents")
def doc_fingerprint(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.fingerprint(F.col("text"), F.col("source")).alias("fingerprint"))


@query("doc_exact_groups", "SELECT substr(sha256(text), 1, 16) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_groups(spark, sf):
    grouped = V.table(spark, sf, "documents").groupBy(S.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return grouped.filter("n > 1")


def _html_sql(c: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg"):
        c = f"regexp_replace({c}, '(?is)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\t\n\r]+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", S.html_text(F.col("html")).alias("text"))


def _page_lines_sql(c: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg"):
        c = f"regexp_replace({c}, '(?is)<{tag}[ >].*?</{tag}>', chr(1), 'g')"
    c = f"string_split(regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', chr(1), 'g'), '(?s)<[^>]*>', chr(1), 'g'), chr(1))"
    # as in HTML, these six references count without their semicolon too (a title cut short ends in "&amp"); & comes last, as nothing is replaced twice
    for name, said in (("&middot", "·"), ("&copy", "©"), ("&quot", '"'), ("&lt", "<"), ("&gt", ">"), ("&amp", "&")):
        c = f"list_transform({c}, lambda x: regexp_replace(x, '{name};?', '{said}', 'g'))"
    c = f"list_filter(list_transform({c}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
    return rf"regexp_replace(array_to_string({c}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') || chr(10)"


#: The pages of the test tables have neither tables nor definition lists; tests/test_pages.py has those.
@query("page_reduce", f"SELECT page_id, {_page_lines_sql('html')} AS text FROM pages")
def page_reduce(spark, sf):
    return pages.reduce_pages(V.table(spark, sf, "pages"), "page_id", "html").select("page_id", "text")


# ---- units and coercion --------------------------------------------------------------------------------------------------

QUANTITY = """q AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS value,
    CASE p_partkey % 7 WHEN 0 THEN 'mm' WHEN 1 THEN 'Inch' WHEN 2 THEN 'ft' WHEN 3 THEN 'meters' WHEN 4 THEN '' WHEN 5 THEN 'furlong' ELSE 'cm' END AS unit,
    CASE WHEN p_partkey % 2 = 0 THEN 'length' ELSE 'length_in' END AS family FROM part)"""


def quantities(spark, sf):
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ("mm", "Inch", "ft", "meters", "", "furlong", "cm"))), (k % 7 + 1).cast("int"))
    return V.table(spark, sf, "part").select(k.alias("id"), F.col("p_size").cast("double").alias("value"), unit.alias("unit"), F.when(k % 2 == 0, "length").otherwise("length_in").alias("family"))


@query("unit_convert", f"""WITH {QUANTITY}, {U.unit_sql()} SELECT id, q.unit AS unit, canonical, round(CASE WHEN u.unit IS NOT NULL THEN (value + shift) * factor ELSE value END, 4) AS converted,
    u.unit IS NOT NULL OR trim(q.unit) = '' AS known FROM q LEFT JOIN units u ON u.family = q.family AND u.unit = lower(trim(q.unit))""")
def unit_convert(spark, sf):
    return U.convert(quantities(spark, sf)).select("id", "unit", "canonical", "converted", "known")


@query("temperature_convert", f"""WITH {U.unit_sql()}, q AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS value, CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'degC' ELSE 'Kelvin' END AS unit FROM part)
    SELECT id, round((value + shift) * factor, 4) AS converted FROM q JOIN units u ON u.family = 'temperature' AND u.unit = lower(q.unit)""")
def temperature_convert(spark, sf):
    k = F.col("p_partkey")
    q = V.table(spark, sf, "part").select(k.alias("id"), F.col("p_size").cast("double").alias("value"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "degC").otherwise("Kelvin").alias("unit"), F.lit("temperature").alias("family"))
    return U.convert(q).select("id", "converted")


@query("parse_quantity", r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), ' mm') WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ' to ', CAST(p_size + 10 AS VARCHAR), ' kg') ELSE concat(CAST(p_size AS VARCHAR), '-', CAST(p_size + 5 AS VARCHAR), 'V') END AS s, p_size FROM part)
    SELECT id, CAST(p_size AS DOUBLE) AS low, CAST(p_size + CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 5 END AS DOUBLE) AS high, p_size + CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 2.5 END AS value_mid, lower(regexp_extract(s, '([A-Za-z]+)$', 1)) AS unit FROM t""".replace("AS value_mid", "AS value_mid"))
def parse_quantity(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 3 == 0, F.concat(n, F.lit(" mm"))).when(k % 3 == 1, F.concat(n, F.lit(" to "), (F.col("p_size") + 10).cast("string"), F.lit(" kg"))).otherwise(F.concat(n, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("V")))
    q = V.table(spark, sf, "part").select(k.alias("id"), U.parse_quantity(t).alias("q"))
    return q.select("id", "q.low", "q.high", F.col("q.value").cast("double").alias("value_mid"), "q.unit")


@query("fraction_expand", "SELECT p_partkey AS id, CAST(p_size % 9 AS DOUBLE) + 0.5 AS value FROM part")
def fraction_expand(spark, sf):
    t = F.concat((F.col("p_size") % 9).cast("string"), F.lit("-1/2\""))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract(U.expand_fraction(t), r"([0-9.]+)", 1).cast("double").alias("value"))


@query("awg_lookup", "SELECT p_partkey AS id, round(3.141592653589793 / 4.0 * pow(0.127 * pow(92.0, (36 - p_size % 20) / 39.0), 2), 2) AS mm2 FROM part")
def awg_lookup(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), U.awg_area(F.concat(F.lit("wire AWG-"), (F.col("p_size") % 20).cast("string"))).alias("mm2"))


@query("coerce_bool", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part")
def coerce_bool(spark, sf):
    t = F.element_at(F.array(*map(F.lit, ("Yes", " none ", "flame retardant", "maybe"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.to_boolean(t).alias("flag"))


@query("coerce_list", "SELECT p_partkey AS id, concat(p_name, '|', lower(p_brand), '|', 'CE') AS items FROM part")
def coerce_list(spark, sf):
    t = F.concat("p_name", F.lit("; "), F.lower("p_brand"), F.lit(", CE / "), F.upper("p_name"), F.lit(" and ce"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(S.to_list(t), "|").alias("items"))


@query("coerce_enum", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Single Phase' WHEN 1 THEN 'Three Phase' WHEN 2 THEN 'Three Phase' WHEN 3 THEN 'Single Phase' END AS phase FROM part")
def coerce_enum(spark, sf):
    t = F.element_at(F.array(*map(F.lit, ("single phase", "3", "415 V 3 ph", "1~ Single", "dc"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.to_enum(t, ["Single Phase", "Three Phase"], {"1": "Single Phase", "3": "Three Phase"}).alias("phase"))


@query("coerce_number", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 3 <> 0 THEN 'UNPARSEABLE_NUMBER' WHEN p_size > 40 THEN 'OUT_OF_RANGE' ELSE '' END AS issue FROM part")
def coerce_number(spark, sf):
    k = F.col("p_partkey")
    v = S.number(F.when(k % 3 == 0, F.col("p_size").cast("string")).otherwise("about"))
    issue = F.when(v.isNull(), "UNPARSEABLE_NUMBER").when(v > 40, "OUT_OF_RANGE").otherwise("")
    return V.table(spark, sf, "part").select(k.alias("id"), v.alias("value"), issue.alias("issue"))


@query("coerce_string", r"SELECT p_partkey AS id, concat(p_name, ' ', p_type) AS value, regexp_full_match(p_type, '[A-M].*') AS matches FROM part")
def coerce_string(spark, sf):
    t = S.collapse(F.concat(F.lit(' . "'), "p_name", F.lit(" \t "), "p_type", F.lit(" ;-")))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.alias("value"), F.col("p_type").rlike("^(?:[A-M].*)$").alias("matches"))


@query("fmt_value", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE concat(CAST(p_size // 2 AS VARCHAR), '.5') END AS shown FROM part")
def fmt_value(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.shown(F.col("p_size") / 2).alias("shown"))


@query("warranty_text", """SELECT p_partkey AS id, CASE WHEN p_size % 5 * 6 = 0 THEN '' WHEN p_size % 5 * 6 = 12 THEN '1 Year Limited' WHEN p_size % 5 * 6 % 12 = 0 THEN concat(CAST(p_size % 5 * 6 // 12 AS VARCHAR), ' Years Limited')
    ELSE concat(CAST(p_size % 5 * 6 AS VARCHAR), ' Months Limited') END AS warranty FROM part""")
def warranty_text(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.warranty(F.col("p_size") % 5 * 6).alias("warranty"))


@query("confidence_bar", "SELECT p_partkey AS id, concat(repeat('█', CAST(floor(p_size / 50.0 * 5 + 0.5) AS INTEGER)), repeat('░', 5 - CAST(floor(p_size / 50.0 * 5 + 0.5) AS INTEGER))) AS bar FROM part")
def confidence_bar(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.bar(F.col("p_size") / 50.0).alias("bar"))


@query("grade_of", "SELECT p_partkey AS id, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 75 THEN 'B' WHEN p_size * 2 >= 60 THEN 'C' WHEN p_size * 2 >= 40 THEN 'D' ELSE 'F' END AS grade FROM part")
def grade_of(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.grade(F.col("p_size") * 2).alias("grade"))
