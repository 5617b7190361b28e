"""Catalogue-shaped views of the star-schema tables, as DataFrames and as the same thing in SQL.

Each view is a function of (spark, sf_dir); SQL_* holds a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.sources.tables import growing, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_CATALOGUE = """cat AS (
    SELECT p_partkey AS row_idx, concat('P', lpad(CAST(p_partkey % 1900 AS VARCHAR), 6, '0')) AS mfg_part_num,
        concat(CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' ') ELSE '' END, p_name, ' ', CAST(p_size AS VARCHAR), 'x', CAST(p_size % 7 + 1 AS VARCHAR), '-',
            CAST(p_size % 4 * 4 + 8 AS VARCHAR), '''', ' P', CAST(p_size % 5 * 40 + 80 AS VARCHAR), ' ', CAST(p_partkey % 6 * 5 + 5 AS VARCHAR), ' pc/box') AS part_desc,
        CASE WHEN p_partkey % 5 = 0 THEN '-- Unbranded --' ELSE p_brand END AS e1_brand,
        CASE WHEN p_partkey % 4 = 0 THEN '-- No Brand --' ELSE lower(p_brand) END AS alt_brand,
        concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ' Supply LLC (' WHEN s_suppkey % 3 = 1 THEN ' Tools Inc (' ELSE ' Lighting Mfg Co (' END,
            lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), ')') AS part_manuf
    FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributor rows: row_idx, mfg_part_num, part_desc, e1_brand, alt_brand, part_manuf."""
    part, supplier = spread(table(spark, sf_dir, "part"), "p_partkey"), table(spark, sf_dir, "supplier")
    k, size, s = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    n = supplier.agg(F.count("*").alias("n"))
    rows = part.crossJoin(n).join(growing(supplier), s == k % F.col("n"))
    desc = F.concat(
        F.when(k % 3 == 0, F.concat("p_brand", F.lit(" "))).otherwise(""), "p_name", F.lit(" "), text(size), F.lit("x"), text(size % 7 + 1), F.lit("-"),
        text(size % 4 * 4 + 8), F.lit("' P"), text(size % 5 * 40 + 80), F.lit(" "), text(k % 6 * 5 + 5), F.lit(" pc/box"),
    )
    kind = F.when(s % 3 == 0, " Supply LLC (").when(s % 3 == 1, " Tools Inc (").otherwise(" Lighting Mfg Co (")
    return rows.select(
        k.alias("row_idx"), F.concat(F.lit("P"), F.lpad(text(k % 1900), 6, "0")).alias("mfg_part_num"), desc.alias("part_desc"),
        F.when(k % 5 == 0, "-- Unbranded --").otherwise(F.col("p_brand")).alias("e1_brand"), F.when(k % 4 == 0, "-- No Brand --").otherwise(F.lower("p_brand")).alias("alt_brand"),
        F.concat("s_name", kind, F.lpad(text(s), 4, "0"), F.lit(")")).alias("part_manuf"),
    )


#: key, value, unit, method, source, confidence and when it is there: plain SQL that both engines read the same way.
FIELD_RULES = (
    ("brand", "p_brand", "''", "'input_field'", "'input'", "0.95", "p_partkey % 5 <> 0"),
    ("diameter", "CAST(p_size AS VARCHAR(20))", "'in'", "'regex'", "'input'", "0.92", "p_partkey % 7 <> 0"),
    ("length", "CAST(p_size % 4 * 4 + 8 AS VARCHAR(20))", "'ft'", "'unit_convert'", "'pdf'", "0.9", "p_partkey % 3 <> 0"),
    ("grit", "concat('P', CAST(p_size % 5 * 40 + 80 AS VARCHAR(20)))", "''", "'regex'", "'web'", "0.88", "p_partkey % 11 <> 0"),
    ("finish", "lower(p_type)", "''", "'kg_infer'", "'catalog_sibling'", "0.55", "p_partkey % 4 = 1"),
    ("material", "CASE WHEN p_size % 10 < 8 THEN 'steel' ELSE 'brass' END", "''", "'llm_extract'", "'web'", "0.8", "p_partkey % 6 <> 0"),
    ("series", "concat('S', CAST(p_partkey % 40 AS VARCHAR(20)))", "''", "'web_extract'", "'web'", "0.72", "p_partkey % 2 = 0"),
    ("warranty_months", "CAST(p_size % 5 * 6 AS VARCHAR(20))", "'month'", "'table_extract'", "'pdf'", "0.88", "p_partkey % 8 <> 0"),
    ("short_desc", "concat(p_name, ' of size ', CAST(p_size AS VARCHAR(20)))", "''", "'llm_generate'", "'inferred'", "0.6", "p_partkey % 3 = 0"),
)

SQL_FIELDS = (
    "fields AS ("
    + " UNION ALL ".join(
        f"SELECT p_partkey AS record_id, {i} AS seq, '{k}' AS key, {v} AS value, {u} AS unit, {m} AS method, {s} AS source, CAST({c} AS DOUBLE) - p_partkey % 4 / 10.0 AS confidence, "
        f"CASE WHEN (p_partkey + {i}) % 13 = 0 THEN 1 ELSE 0 END AS n_error, CASE WHEN (p_partkey + {i}) % 5 = 0 THEN 1 ELSE 0 END AS n_warning, CASE WHEN (p_partkey + {i}) % 3 = 0 THEN 1 ELSE 0 END AS n_info "
        f"FROM part WHERE {w}"
        for i, (k, v, u, m, s, c, w) in enumerate(FIELD_RULES)
    )
    + ")"
)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of records, long: record_id, seq, key, value, unit, method, source, confidence, n_error, n_warning, n_info."""
    k = F.col("p_partkey")
    sql = lambda x: F.expr(x.replace("VARCHAR(20)", "STRING"))
    flag = lambda i, m: F.when((k + i) % m == 0, 1).otherwise(0)
    cells = [
        F.when(sql(w), F.struct(F.lit(i).alias("seq"), F.lit(key).alias("key"), sql(v).alias("value"), sql(u).alias("unit"), sql(m).alias("method"), sql(s).alias("source"),
            (F.lit(float(c)) - (k % 4) / 10.0).alias("confidence"), flag(i, 13).alias("n_error"), flag(i, 5).alias("n_warning"), flag(i, 3).alias("n_info")))
        for i, (key, v, u, m, s, c, w) in enumerate(FIELD_RULES)
    ]
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("record_id"), F.inline(F.array_compact(F.array(*cells))))


SQL_CATEGORY = """category AS (
    SELECT p_partkey AS record_id, p_brand AS brand, p_name AS name,
        CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%rod%' THEN 'fastener' WHEN p_name LIKE '%gear%' OR p_name LIKE '%ring%' THEN 'motion_part'
             WHEN p_name LIKE '%plate%' OR p_name LIKE '%anvil%' THEN 'metal_panel' ELSE 'general_product' END AS category
    FROM part)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, brand, name, category."""
    n = F.col("p_name")
    has = lambda *w: F.expr(" OR ".join(f"p_name LIKE '%{x}%'" for x in w))
    kind = F.when(has("bolt", "rod"), "fastener").when(has("gear", "ring"), "motion_part").when(has("plate", "anvil"), "metal_panel").otherwise("general_product")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("brand"), n.alias("name"), kind.alias("category"))


SQL_CANDIDATES = """candidates AS (
    SELECT l_partkey AS record_id, 'price' AS key, l_orderkey * 10 + l_linenumber AS seq, floor(l_extendedprice / l_quantity * (CASE WHEN l_linenumber = 6 THEN 10 ELSE 1 END)) AS value,
        CASE l_linenumber % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'input' WHEN 2 THEN 'pdf' WHEN 3 THEN 'image' WHEN 4 THEN 'catalog_sibling' ELSE 'inferred' END AS source,
        0.5 + l_linenumber % 5 / 10.0 AS confidence
    FROM lineitem)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing values of a record's key: record_id, key, seq, value, source, confidence."""
    n = F.col("l_linenumber")
    source = F.element_at(F.array(*map(F.lit, ("web", "input", "pdf", "image", "catalog_sibling", "inferred"))), (n % 6 + 1).cast("int"))
    value = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * F.when(n == 6, 10).otherwise(1)).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("record_id"), F.lit("price").alias("key"), (F.col("l_orderkey") * 10 + n).alias("seq"), value.alias("value"), source.alias("source"), (F.lit(0.5) + n % 5 / 10.0).alias("confidence")
    )


SQL_DECISIONS = """decisions AS (
    SELECT event_id AS decision_id, ts, concat('P', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS sku,
        CASE event_id % 4 WHEN 0 THEN 'brand' WHEN 1 THEN 'grit' WHEN 2 THEN 'length' ELSE 'finish' END AS field_key,
        CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'edited' ELSE 'rejected' END AS decision,
        CASE event_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'llm_extract' ELSE NULL END AS method, concat('v', CAST(floor(value) AS BIGINT)) AS new_value
    FROM events WHERE event_type IN ('purchase', 'click', 'error'))"""


def decisions(events: DataFrame) -> DataFrame:
    """Reviewers' decisions out of an event table or stream: decision_id, ts, sku, field_key, decision, method, new_value."""
    e, t = F.col("event_id"), F.col("event_type")
    key = F.element_at(F.array(*map(F.lit, ("brand", "grit", "length", "finish"))), (e % 4 + 1).cast("int"))
    decision = F.when(t == "purchase", "approved").when(t == "click", "edited").otherwise("rejected")
    method = F.when(e % 3 == 0, "regex").when(e % 3 == 1, "llm_extract")
    return events.filter(t.isin("purchase", "click", "error")).select(
        e.alias("decision_id"), "ts", F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("sku"), key.alias("field_key"), decision.alias("decision"), method.alias("method"),
        F.concat(F.lit("v"), F.floor("value").cast("string")).alias("new_value"),
    )
