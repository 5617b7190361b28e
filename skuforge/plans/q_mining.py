"""Mining of descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import mining
from skuforge.plans.registry import query
from skuforge.sources import views as V

CAT = f"WITH {V.SQL_CATALOGUE}"


@query("shorthand_decode", rf"""{CAT} SELECT row_idx, regexp_extract(part_desc, '\bP([0-9]{{2,4}})\b', 1) AS grit, regexp_extract(part_desc, '\b([0-9]+) pc/box', 1) AS pack_quantity, 'box' AS selling_uom FROM cat""")
def shorthand_decode(spark, sf):
    by = {d.key: d for d in mining.SHORTHAND}
    t = F.col("part_desc")
    return V.catalogue(spark, sf).select("row_idx", *(mining.decode(t, by[k]).alias(k) for k in ("grit", "pack_quantity", "selling_uom")))


@query("dimension_decode", rf"""{CAT} SELECT row_idx, CAST(regexp_extract(part_desc, ' ([0-9]+)x[0-9]+-[0-9]+''', 1) AS DOUBLE) AS thickness, CAST(regexp_extract(part_desc, ' [0-9]+x([0-9]+)-[0-9]+''', 1) AS DOUBLE) AS width,
    CAST(regexp_extract(part_desc, ' [0-9]+x[0-9]+-([0-9]+)''', 1) AS DOUBLE) AS length_ft FROM cat""")
def dimension_decode(spark, sf):
    m = V.catalogue(spark, sf).select("row_idx", mining.dimensions(F.col("part_desc")).alias("d"))
    return m.select("row_idx", *(F.col("d")[k].alias(k) for k in ("thickness", "width", "length_ft")))


@query("regex_extract_named", "SELECT p_partkey AS id, concat('IP', CAST(p_size % 7 AS VARCHAR), CAST(p_size % 9 AS VARCHAR)) AS ip_rating, concat('IE', CAST(p_size % 5 + 1 AS VARCHAR)) AS efficiency_class, CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'F' ELSE 'H' END AS insulation_class FROM part")
def regex_extract_named(spark, sf):
    n = F.col("p_size")
    t = F.concat(F.lit("motor, IP"), (n % 7).cast("string"), (n % 9).cast("string"), F.lit(" IE"), (n % 5 + 1).cast("string"), F.lit(" insulation class "), F.element_at(F.array(*map(F.lit, "BFH")), n % 3 + 1))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *(F.regexp_extract(t, mining.NAMED[k], 1).alias(k) for k in ("ip_rating", "efficiency_class", "insulation_class")))


@query("multi_match_set", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'CE, UL' WHEN 1 THEN 'CSA' END AS marks FROM part")
def multi_match_set(spark, sf):
    t = F.element_at(F.array(*map(F.lit, ("UL listed; CE; ul", "csa certified", "none"))), F.col("p_size") % 3 + 1)
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mining.certifications(t).alias("marks"))


@query("color_lookup", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Black' WHEN 1 THEN 'Stainless Steel' END AS color FROM part")
def color_lookup(spark, sf):
    t = F.element_at(F.array(*map(F.lit, ("sink BLK 20", "ss hinge", "plain"))), F.col("p_size") % 3 + 1)
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mining.color(t).alias("color"))


@query("lamp_base", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'E12' WHEN 1 THEN 'E26' END AS base FROM part")
def lamp_base(spark, sf):
    t = F.element_at(F.array(*map(F.lit, ("40W cand base", "BR30 lamp", "plain"))), F.col("p_size") % 3 + 1)
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mining.lamp_base(t).alias("base"))


@query("labelled_quantity", "SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS width FROM part")
def labelled_quantity(spark, sf):
    n = F.col("p_size")
    t = F.when(n % 3 == 0, F.concat(F.lit("Width (overall): "), n.cast("string"), F.lit(" mm"))).when(n % 3 == 1, F.concat(n.cast("string"), F.lit("mm width"))).otherwise(F.concat(F.lit("width "), n.cast("string")))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mining.labelled_quantity(t, "width", "mm|cm").alias("width"))


@query("temperature_range", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN CAST(-p_size AS DOUBLE) END AS low, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 40 AS DOUBLE) END AS high FROM part")
def temperature_range(spark, sf):
    n = F.col("p_size")
    rng = F.concat((-n).cast("string"), F.lit("..+"), (n + 40).cast("string"))
    t = F.when(n % 2 == 0, F.concat(F.lit("Operating temp "), rng, F.lit("°C"))).otherwise(F.concat(F.lit("range "), rng, F.lit(" units")))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mining.temperature_range(t).alias("r")).select("id", "r.low", "r.high")


@query("unique_unit_owner", f"WITH {D.specs_sql()} SELECT category, unit, min(key) AS key FROM spec WHERE unit <> '' GROUP BY 1, 2 HAVING count(DISTINCT key) = 1")
def unique_unit_owner(spark, sf):
    return mining.unique_units(D.specs(spark))


@query("candidate_first_wins", rf"""{CAT} SELECT key, count(*) AS n FROM (SELECT unnest(['grit', 'pack_quantity', 'selling_uom', 'thickness', 'width', 'length_ft']) AS key FROM cat UNION ALL SELECT 'color' FROM cat WHERE regexp_matches(part_desc, '(?i)\b(blk|wht|gry|brn|red|blu|grn|ylw|org|slv|brz|ss)\b')) GROUP BY 1""")
def candidate_first_wins(spark, sf):
    return mining.mine(V.catalogue(spark, sf), "row_idx", "part_desc").groupBy("key").agg(F.count("*").alias("n"))


@query("row_text", f"{CAT} SELECT row_idx, concat('part_desc: ', part_desc, chr(10), 'e1_brand: ', e1_brand, chr(10), 'part_manuf: ', part_manuf) AS text FROM cat WHERE length(e1_brand) >= 4")
def row_text(spark, sf):
    line = lambda c: F.concat(F.lit(f"{c}: "), F.col(c))
    return V.catalogue(spark, sf).filter(F.length("e1_brand") >= 4).select("row_idx", F.concat_ws("\n", *map(line, ("part_desc", "e1_brand", "part_manuf"))).alias("text"))
