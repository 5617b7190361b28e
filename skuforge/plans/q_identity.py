"""Identity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.operators import alias_trie, identity
from skuforge.plans.registry import query
from skuforge.sources import views as V

ACCOUNT = r"trim(regexp_replace(part_manuf, '\s*\([A-Z0-9]{3,8}\)\s*$', ''))"
TRADE = rf"""trim(regexp_replace(regexp_replace({ACCOUNT}, '(?i)(\s+(inc|llc|co)[.,]*)+$', ''), '(?i)(\s+(tools|lighting|mfg|supply)[.,]*)+$', ''))"""
MAKER = "s_suppkey % 3 <> 0"
BASE = f"""WITH {V.SQL_CATALOGUE}, a AS (SELECT *, {ACCOUNT} AS account, contains(lower(part_manuf), 'supply') AS distributor FROM cat),
    t AS (SELECT *, CASE WHEN NOT distributor THEN regexp_extract(account, '^(Supplier#[0-9]+)', 1) END AS maker, CASE WHEN e1_brand <> '-- Unbranded --' THEN e1_brand WHEN alt_brand <> '-- No Brand --' THEN alt_brand END AS col,
        nullif(regexp_extract(part_desc, '(Brand#[0-9]+)', 1), '') AS described FROM a)"""


@query("is_distributor", f"{BASE} SELECT row_idx, distributor FROM t")
def is_distributor(spark, sf):
    return V.catalogue(spark, sf).select("row_idx", identity.is_distributor(F.col("part_manuf")).alias("distributor"))


@query("account_to_brand", f"{BASE} SELECT row_idx, CASE WHEN distributor THEN concat(regexp_extract(account, '^(Supplier#[0-9]+)', 1), ' Supply') ELSE maker END AS trade_name FROM t")
def account_to_brand(spark, sf):
    return V.catalogue(spark, sf).select("row_idx", identity.trade_name(F.col("part_manuf")).alias("trade_name"))


def vocab(spark, rows):
    return identity.vocabulary(spark, rows.select(F.col("e1_brand").alias("brand")), rows.select(F.col("part_manuf").alias("account")))


@query("brand_vocab", f"{BASE}, o AS (SELECT DISTINCT lower(e1_brand) AS alias, e1_brand AS brand FROM cat WHERE e1_brand <> '-- Unbranded --' UNION SELECT lower(maker), maker FROM t WHERE maker IS NOT NULL) SELECT alias, brand FROM o")
def brand_vocab(spark, sf):
    rows = V.catalogue(spark, sf)
    return identity.vocabulary(spark, rows.select(F.col("e1_brand").alias("brand")), rows.select(F.col("part_manuf").alias("account")), seed={})


@query("brand_find", f"{BASE} SELECT row_idx, described AS brand, lower(described) AS alias FROM t WHERE described IN (SELECT DISTINCT e1_brand FROM cat)")
def brand_find(spark, sf):
    rows = V.catalogue(spark, sf)
    return identity.find_brand(rows, "row_idx", "part_desc", vocab(spark, rows))


RESOLVED = f"""{BASE}, b AS (SELECT *, coalesce(col, CASE WHEN described IN (SELECT DISTINCT e1_brand FROM cat) THEN described END, maker) AS brand FROM t)
    SELECT row_idx, brand, CASE WHEN col IS NOT NULL THEN 'input_field' WHEN described IS NOT NULL THEN 'regex' WHEN maker IS NOT NULL THEN 'BRAND_FROM_SUPPLIER' ELSE '' END AS brand_method,
    CASE WHEN col IS NOT NULL THEN 95e-2 WHEN described IS NOT NULL THEN 88e-2 WHEN maker IS NOT NULL THEN 65e-2 ELSE 0e0 END AS brand_confidence, CASE WHEN NOT distributor THEN account ELSE brand END AS manufacturer,
    CASE WHEN NOT distributor THEN 'input_field' WHEN brand IS NOT NULL THEN 'MANUFACTURER_FROM_BRAND' ELSE '' END AS manufacturer_method, CASE WHEN NOT distributor THEN 80e-2 WHEN brand IS NOT NULL THEN 70e-2 ELSE 0e0 END AS manufacturer_confidence FROM b"""


def resolved(spark, sf):
    rows = V.catalogue(spark, sf)
    return identity.resolve(rows, "row_idx", ["e1_brand", "alt_brand"], "part_desc", "part_manuf", vocab(spark, rows))


@query("identity_resolve", RESOLVED)
def identity_resolve(spark, sf):
    return resolved(spark, sf)


@query("identity_counts", f"SELECT brand_method, manufacturer_method, count(*) AS n FROM ({RESOLVED}) GROUP BY 1, 2")
def identity_counts(spark, sf):
    return resolved(spark, sf).groupBy("brand_method", "manufacturer_method").agg(F.count("*").alias("n"))


#: Aliases that grow with nothing, in texts that grow: the first three tokens of each benchmark item, in all documents.
TOKENS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}#&.+-]+'), lambda x: x <> '')"


@query("phrase_find", f"""WITH v AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS alias FROM (SELECT {TOKENS.format("text")} AS w FROM benchmark) WHERE len(w) >= 3),
    d AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format("text")}, ' ') || ' ' AS t FROM documents), m AS (SELECT doc_id, alias, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias) AS r FROM d JOIN v ON contains(t, ' ' || alias || ' '))
    SELECT doc_id, alias FROM m WHERE r = 1""")
def phrase_find(spark, sf):
    words = identity.tokens(F.col("text"))
    known = V.table(spark, sf, "benchmark").select(words.alias("w")).filter(F.size("w") >= 3).select(F.array_join(F.slice("w", 1, 3), " ").alias("alias")).distinct()
    return alias_trie.longest_alias(V.table(spark, sf, "documents"), "doc_id", words, known, F.split("alias", " "))
