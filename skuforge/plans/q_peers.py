"""Similarity, graph, peers and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import enrich, graph, score, similarity
from skuforge.plans.registry import query
from skuforge.sources import views as V
from skuforge.sources.tables import growing

BASE = f"WITH {V.SQL_CATEGORY}, {V.SQL_FIELDS}, {D.specs_sql()}"

#: Texts to compare: names of all records, within the real category.
TFIDF = r"""WITH d AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_#][a-z0-9_#.\-/]*') AS w FROM benchmark), t AS (
    SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM d),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
    raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n), norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY 1),
    weights AS (SELECT id, term, x / norm AS weight FROM raw JOIN norm USING (id))"""


TFIDF_RECORDS = TFIDF.replace("item_id AS id", "record_id AS id").replace("coalesce(text, '')", "coalesce(name, '')").replace("FROM benchmark", "FROM category").replace("WITH d AS", f"WITH {V.SQL_CATEGORY}, d AS")


WEIGHTS_SQL = f"{TFIDF_RECORDS} SELECT id, term, round(weight, 6) AS weight FROM weights"


@query("tfidf_weights", WEIGHTS_SQL)
@query("tfidf_weights_records", WEIGHTS_SQL)
def tfidf_weights_records(spark, sf):
    w = similarity.weights(V.categories(spark, sf).withColumnRenamed("record_id", "id"), "id", "name")
    return w.withColumn("weight", F.round("weight", 6))


TOPK_SQL = f"""{TFIDF_RECORDS}, p AS (SELECT a.id AS id, b.id AS other, round(sum(a.weight * b.weight), 6) AS score FROM weights a JOIN category c ON c.record_id = a.id JOIN weights b ON a.term = b.term AND a.id <> b.id JOIN category o ON o.record_id = b.id AND o.category = c.category GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INTEGER) AS rank FROM p WHERE score >= 12e-2) SELECT * FROM r WHERE rank <= 5"""


@query("similar_topk", TOPK_SQL)
@query("similar_topk_records", TOPK_SQL)
def similar_topk_records(spark, sf):
    return similarity.top_similar_bounded(V.categories(spark, sf).withColumnRenamed("record_id", "id"), "id", "name", "category")


@query("shared_keys", f"""{BASE}, k AS (SELECT record_id, list(DISTINCT key) AS keys FROM fields GROUP BY 1) SELECT p_partkey AS a, p_partkey + 1 AS b,
    array_to_string(list_sort(list_intersect(coalesce(x.keys, []), coalesce(y.keys, []))), ',') AS shared FROM part LEFT JOIN k x ON x.record_id = p_partkey LEFT JOIN k y ON y.record_id = p_partkey + 1""")
def shared_keys(spark, sf):
    pairs = V.table(spark, sf, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return similarity.shared_keys(pairs, V.fields(spark, sf), "a", "b")


@query("series_consensus", f"""{BASE}, series AS (SELECT record_id, value AS series FROM fields WHERE key = 'series' AND value <> ''),
    asks AS (SELECT DISTINCT category, brand FROM category c WHERE brand <> '' AND NOT EXISTS (SELECT 1 FROM series WHERE series.record_id = c.record_id)),
    s AS (SELECT c.record_id, c.category, 'series' AS level, series AS grp FROM category c JOIN series USING (record_id) UNION ALL SELECT c.record_id, c.category, 'brand', c.brand FROM category c JOIN asks USING (category, brand)),
    m AS (SELECT category, level, grp, count(*) AS members FROM s GROUP BY 1, 2, 3), v AS (SELECT category, level, grp, key, f.value, count(*) AS support FROM s JOIN fields f USING (record_id) GROUP BY 1, 2, 3, 4, 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, level, grp, key ORDER BY support DESC, value) AS n FROM v)
    SELECT category, CASE WHEN level = 'series' THEN grp END AS series, CASE WHEN level = 'brand' THEN grp END AS brand, key, value, support, round(CAST(support AS DOUBLE) / members, 6) AS share FROM r JOIN m USING (category, level, grp)
    WHERE n = 1 AND support >= 3 AND round(CAST(support AS DOUBLE) / members, 6) >= 6e-1""")
def series_consensus(spark, sf):
    fields = V.fields(spark, sf)
    members = similarity.consensus_groups(V.categories(spark, sf), fields)
    of = lambda level: F.when(F.col("level") == level, F.col("grp")).alias(level)
    return similarity.group_consensus(members, fields, ["category", "level", "grp"]).select("category", of("series"), of("brand"), "key", "value", "support", "share")


KEYS = ("brand", "material", "finish", "series")
EDGES = f"""{BASE}, edges AS (SELECT concat('product:', CAST(record_id AS VARCHAR)) AS product, concat('category:', category) AS node, 'category' AS kind FROM category
    UNION ALL SELECT concat('product:', CAST(record_id AS VARCHAR)), concat(key, ':', lower(trim(value))), key FROM fields WHERE key IN {KEYS})"""


def _edges(spark, sf):
    return graph.edges(V.categories(spark, sf), V.fields(spark, sf), KEYS)


@query("graph_edges", f"{EDGES} SELECT * FROM edges")
def graph_edges(spark, sf):
    return _edges(spark, sf)


@query("graph_nodes", f"{EDGES} SELECT DISTINCT * FROM (SELECT product AS node, 'product' AS kind FROM edges UNION ALL SELECT node, kind FROM edges)")
def graph_nodes(spark, sf):
    return graph.nodes(_edges(spark, sf))


@query("graph_stats", f"{EDGES} SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT product AS node, 'product' AS kind FROM edges UNION ALL SELECT node, kind FROM edges)) GROUP BY 1")
def graph_stats(spark, sf):
    return graph.nodes(_edges(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("products_sharing", f"{EDGES} SELECT product FROM edges WHERE node = 'series:s4'")
def products_sharing(spark, sf):
    return _edges(spark, sf).filter(F.col("node") == "series:s4").select("product")


RELATED = f"""{EDGES}, p AS (SELECT a.product, b.product AS other, count(*) AS shared FROM edges a JOIN edges b ON a.node = b.node AND a.product <> b.product GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY shared DESC, other) AS INTEGER) AS rank FROM p) WHERE rank <= 8"""


@query("related_products", RELATED)
@query("related_products_all", RELATED)
def related_products_all(spark, sf):
    return graph.related_sets(_edges(spark, sf))


@query("ego_subgraph", f"{EDGES} SELECT 'product:4' AS node, 0 AS distance UNION ALL SELECT DISTINCT node, 1 FROM edges WHERE product = 'product:4'")
def ego_subgraph(spark, sf):
    return graph.ego(_edges(spark, sf), "product:4", 1)


@query("graph_export", f"""{EDGES} SELECT concat('{{"source":"', product, '","target":"', node, '","kind":"', kind, '"}}') AS element FROM edges""")
def graph_export(spark, sf):
    return _edges(spark, sf).select(F.to_json(F.struct(F.col("product").alias("source"), F.col("node").alias("target"), "kind")).alias("element"))


NEAR = f"""{EDGES}, adj AS (SELECT product AS a, node AS b FROM edges UNION SELECT node, product FROM edges), d0 AS (SELECT DISTINCT product AS start, product AS node FROM edges WHERE node = 'brand:brand#12'),
    d1 AS (SELECT DISTINCT start, b AS node FROM d0 JOIN adj ON a = node), d2 AS (SELECT DISTINCT start, b AS node FROM d1 JOIN adj ON a = node), d3 AS (SELECT DISTINCT start, b AS node FROM d2 JOIN adj ON a = node),
    near AS (SELECT start, node, CAST(min(d) AS INTEGER) AS distance FROM (SELECT *, 0 AS d FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY 1, 2)"""


@query("neighbourhoods", f"{NEAR} SELECT * FROM near")
def neighbourhoods(spark, sf):
    e = _edges(spark, sf)
    return graph.neighbourhoods(e, e.filter("node = 'brand:brand#12'").select(F.col("product").alias("start")), 3)


LABEL = "CASE WHEN kind IN ('product', 'category') THEN regexp_replace(node, '^[^:]*:', '') ELSE concat(split_part(node, ':', 1), '=', regexp_replace(node, '^[^:]*:', '')) END"


@query("graph_drawn", f"""{EDGES}, n AS (SELECT DISTINCT product AS node, 'product' AS kind FROM edges UNION SELECT node, CASE WHEN kind = 'category' THEN kind ELSE 'attribute' END FROM edges)
    SELECT 'node' AS part, concat('{{"data":{{"id":"', node, '","label":"', {LABEL}, '","kind":"', kind, '"}}}}') AS element FROM n
    UNION ALL SELECT DISTINCT 'edge', concat('{{"data":{{"source":"', product, '","target":"', node, '","relation":"', CASE WHEN kind = 'category' THEN 'in_category' ELSE 'has_attribute' END, '"}}}}') FROM edges""")
def graph_drawn(spark, sf):
    return graph.drawn(_edges(spark, sf)).select("part", "element")


PEERS = f"""{BASE}, g0 AS (SELECT c.*, f.value AS series FROM category c LEFT JOIN fields f ON f.record_id = c.record_id AND f.key = 'series'),
    g1 AS (SELECT *, CASE WHEN series IS NOT NULL THEN count(*) OVER (PARTITION BY series) END AS ns, count(*) OVER (PARTITION BY brand, category) AS nb FROM g0),
    peers AS (SELECT record_id, CASE WHEN ns >= 3 THEN 'series' WHEN nb >= 3 THEN 'brand' ELSE 'category' END AS level, CASE WHEN ns >= 3 THEN series WHEN nb >= 3 THEN concat(brand, '|', category) ELSE category END AS grp FROM g1)"""


@query("peer_group", f"{PEERS} SELECT * FROM peers")
def peer_group(spark, sf):
    return graph.peer_groups(V.categories(spark, sf), V.fields(spark, sf))


VOTES = """, votes AS (SELECT level, grp, key, value, count(*) AS c FROM peers JOIN fields USING (record_id) {0} GROUP BY 1, 2, 3, 4), best AS (
    SELECT level, grp, key, sum(c) OVER (PARTITION BY level, grp, key) AS total, value AS majority, c AS support, row_number() OVER (PARTITION BY level, grp, key ORDER BY c DESC, value) AS r FROM votes)"""


@query("find_outliers", f"""{PEERS}{VOTES.format('')} SELECT record_id, key, value, majority, support, CAST(total - 1 AS BIGINT) AS peers FROM peers JOIN fields USING (record_id) JOIN best USING (level, grp, key)
    WHERE r = 1 AND value <> majority AND total - 1 >= 4 AND support >= 8e-1 * (total - 1)""")
def find_outliers(spark, sf):
    fields = V.fields(spark, sf)
    return graph.outliers(graph.peer_groups(V.categories(spark, sf), fields), fields)


INFER = f"""{PEERS}{VOTES.format('WHERE confidence >= 6e-1')}, wanted AS (SELECT c.record_id, key, weight FROM category c JOIN spec USING (category) WHERE key NOT IN {D.NEVER_INFER} AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.record_id = c.record_id AND f.key = spec.key)),
    inferred AS (SELECT record_id, key, majority AS value, support, round(CAST(support AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM wanted JOIN peers USING (record_id) JOIN best USING (level, grp, key)
    WHERE r = 1 AND NOT (level = 'category' AND key IN ('brand', 'series', 'warranty_months')) AND support >= 3 AND CAST(support AS DOUBLE) / CAST(total AS DOUBLE) >= 75e-2)"""


@query("missing_keys", f"{INFER} SELECT record_id, key, weight FROM wanted")
def missing_keys(spark, sf):
    return enrich.missing(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark))


@query("peer_inference", f"{INFER} SELECT * FROM inferred")
def peer_inference(spark, sf):
    cats, fields = V.categories(spark, sf), V.fields(spark, sf)
    return graph.infer(graph.peer_groups(cats, fields), fields, enrich.missing(cats, fields, D.specs(spark)).select("record_id", "key"))


@query("peer_fill", f"{INFER} SELECT record_id, key, value, round(least(70e-2, 45e-2 + 3e-1 * share), 6) AS confidence, support FROM inferred")
def peer_fill(spark, sf):
    return enrich.fill_from_peers(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark))


TIERS = f"""{INFER}, s0 AS (SELECT c.record_id, c.category, lower(c.brand) AS brand, s.series FROM category c LEFT JOIN (SELECT record_id, min(lower(value)) AS series FROM fields WHERE key = 'series' GROUP BY 1) s ON s.record_id = c.record_id),
    pg AS (SELECT record_id, category, 'series' AS how, series AS grp FROM s0 WHERE series <> '' UNION ALL SELECT record_id, category, 'brand', brand FROM s0 WHERE brand <> ''),
    ask AS (SELECT record_id, category, CASE WHEN series <> '' THEN 'series' ELSE 'brand' END AS how, CASE WHEN series <> '' THEN series ELSE brand END AS grp FROM s0 WHERE series <> '' OR brand <> ''),
    sz AS (SELECT category, how, grp, count(*) - 1 AS n_peers FROM pg GROUP BY 1, 2, 3), vt AS (SELECT category, how, grp, key, value, count(*) AS c FROM pg JOIN fields USING (record_id) WHERE confidence >= 6e-1 GROUP BY 1, 2, 3, 4, 5),
    bt AS (SELECT *, row_number() OVER (PARTITION BY category, how, grp, key ORDER BY c DESC, value) AS r FROM vt),
    agreed AS (SELECT w.record_id, w.key, b.value, b.c AS support, round(CAST(b.c AS DOUBLE) / n_peers, 6) AS share FROM wanted w JOIN ask a ON a.record_id = w.record_id JOIN bt b ON b.r = 1 AND b.category = a.category AND b.how = a.how AND b.grp = a.grp AND b.key = w.key
        JOIN sz ON sz.category = a.category AND sz.how = a.how AND sz.grp = a.grp WHERE b.c >= 3 AND round(CAST(b.c AS DOUBLE) / n_peers, 6) >= 6e-1)"""


@query("consensus_fill", f"{TIERS} SELECT * FROM agreed")
def consensus_fill(spark, sf):
    cats, fields = V.categories(spark, sf), V.fields(spark, sf)
    return enrich.series_consensus(cats, fields, enrich.missing(cats, fields, D.specs(spark)))


@query("peer_fill_tiers", f"{TIERS}, every AS (SELECT * FROM inferred UNION ALL SELECT * FROM agreed a WHERE NOT EXISTS (SELECT 1 FROM inferred i WHERE i.record_id = a.record_id AND i.key = a.key)) SELECT record_id, key, value, round(least(70e-2, 45e-2 + 3e-1 * share), 6) AS confidence, support FROM every")
def peer_fill_tiers(spark, sf):
    return enrich.fill_from_peers(V.categories(spark, sf), V.fields(spark, sf), D.specs(spark), consensus=True)


@query("content_length", f"{BASE} SELECT record_id, key, CAST(length(value) AS INTEGER) AS chars, CASE WHEN length(value) * 10 < 25 * 8 THEN 'CONTENT_TOO_SHORT' ELSE 'CONTENT_TOO_LONG' END AS code FROM fields WHERE key = 'short_desc' AND (length(value) * 10 < 25 * 8 OR length(value) * 10 > 18 * 12)".replace("25 * 8", "25 * 8"))
def content_length(spark, sf):
    return enrich.content_length(V.fields(spark, sf), {"short_desc": (25, 18)})


@query("verified_block", f"{BASE}, v AS (SELECT record_id, concat(key, ': ', value, CASE WHEN unit <> '' THEN concat(' ', unit) ELSE '' END) AS line FROM fields WHERE {score.SQL_PENALISED} >= 6e-1) SELECT record_id, string_agg(line, chr(10) ORDER BY line) AS block FROM v GROUP BY 1")
def verified_block(spark, sf):
    return enrich.verified_block(V.fields(spark, sf))
