"""Scans of files written from the tables, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.functions import fuzzy
from skuforge.functions import scalars as S
from skuforge.operators import fuzzy_join
from skuforge.plans.registry import query
from skuforge.sources import readers, tables
from skuforge.sources import views as V
from skuforge.streaming import decisions as stream


def _folder(spark, name: str) -> str:
    base = tables.shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


PART = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, coalesce(p_brand, '') AS brand FROM part"


def _part(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


@query("scan_csv", PART)
def scan_csv(spark, sf):
    to = _folder(spark, "csv")
    _part(spark, sf).write.option("header", True).option("sep", ";").csv(to)
    return readers.read_delimited(spark, to)


@query("scan_jsonl", PART)
def scan_jsonl(spark, sf):
    to = _folder(spark, "jsonl")
    _part(spark, sf).write.json(to)
    return readers.read_json_lines(spark, to)


@query("scan_json", PART)
def scan_json(spark, sf):
    to = _folder(spark, "json")
    line = F.concat(F.lit('{"products": ['), F.to_json(F.struct("id", "name", "brand")), F.lit("]}"))
    _part(spark, sf).select(line.alias("value")).write.text(to)
    return spark.read.option("primitivesAsString", True).json(to).select(F.inline("products"))


@query("source_dispatch", "SELECT CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'web' ELSE 'table' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def source_dispatch(spark, sf):
    path = F.element_at(F.array(*map(F.lit, ("a.PDF", "b.jpeg", "http://c/d", "e.csv"))), (F.col("page_id") % 4 + 1).cast("int"))
    return V.table(spark, sf, "pages").groupBy(readers.kind_of(path).alias("kind")).agg(F.count("*").alias("n"))


@query("messy_sample")
def messy_sample(spark, sf):
    return readers.messy_sample(spark)


@query("scan_mixed", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ', "large"; x' ELSE '' END) AS p_name, p_brand, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part""")
def scan_mixed(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ', "large"; x').otherwise("")).alias("p_name"), "p_brand", F.col("p_size").alias("size"))
    folder = _folder(spark, "mixed")
    for k, (sep, columns) in enumerate(((",", ("p_partkey", "p_name", "p_brand", "size")), (";", ("p_brand", "p_partkey", "p_name")), ("\t", ("size", "p_name", "p_partkey", "p_brand")))):
        part.filter(F.col("p_partkey") % 3 == k).select(*columns).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(f"{folder}/{k}")
    return readers.read_mixed(spark, folder).select("p_partkey", "p_name", "p_brand", "size")


@query("alias_exact", "SELECT * FROM (VALUES ('Brand Name', 'brand'), ('guarantee', 'warranty_months'), ('Dia', 'diameter'), ('xyz', NULL)) t(header, key)")
def alias_exact(spark, sf):
    return spark.createDataFrame([(h, D.resolve_header(h)) for h in ("Brand Name", "guarantee", "Dia", "xyz")], "header string, key string")


@query("alias_fuzzy")
def alias_fuzzy(spark, sf):
    names = V.table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", F.round(fuzzy.similar(F.col("p_name"), F.lit("large bolt")), 4).alias("score"))


@query("alias_resolve")
def alias_resolve(spark, sf):
    return D.resolve_names(V.table(spark, sf, "part"), "p_type").select("p_type", "key", F.to_json("closest").alias("closest"))


PLAIN = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TEXT = PLAIN.format("text")
WORDS = f"SELECT DISTINCT unnest(string_split({TEXT}, ' ')) AS x FROM"
#: DuckDB's levenshtein counts bytes: letters outside ASCII become capitals, which these words have none of.
BYTES = "translate({0}, 'áâäàçéèêëíîïñóôöòúûüùßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


def _alike(a: str, b: str) -> str:
    return f"round(100 * (1 - CAST(levenshtein({BYTES.format(a)}, {BYTES.format(b)}) AS DOUBLE) / greatest(length({a}), length({b}))), 4)"


def _words(spark, sf, name: str, *more: str):
    return V.table(spark, sf, name).select(F.explode(F.split(fuzzy_join.plain(F.col("text")), " ")).alias("word"), *more).filter("word <> ''")


@query("similar_words", f"""WITH w AS (SELECT x FROM ({WORDS} benchmark) WHERE x <> ''), p AS (SELECT a.x AS a, b.x AS b, {_alike("a.x", "b.x")} AS score FROM w a, w b WHERE a.x < b.x) SELECT * FROM p WHERE score >= 75""")
def similar_words(spark, sf):
    words = _words(spark, sf, "benchmark").withColumnRenamed("word", "text")
    return fuzzy_join.similar_texts(words, words, 75).filter("a < b")


@query("alias_resolve_words", f"""WITH t AS (SELECT x FROM ({WORDS} conversations) WHERE x <> ''), k AS (SELECT alias, min(key) AS key FROM (SELECT unnest(string_split({TEXT}, ' ')) AS alias, CAST(item_id AS VARCHAR) AS key FROM benchmark) WHERE alias <> '' GROUP BY 1),
    p AS (SELECT x, alias, key, {_alike("x", "alias")} AS score FROM t, k WHERE abs(length(x) - length(alias)) <= 2e-1 * greatest(length(x), length(alias))), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, alias) AS r FROM p WHERE score >= 84),
    f AS (SELECT x, alias, key, score FROM r WHERE r = 1), d AS (SELECT f.x, max(CASE WHEN r.key <> f.key AND f.score - r.score < 4 THEN 1 ELSE 0 END) AS rival, string_agg(r.alias, ' ' ORDER BY r.r) AS closest FROM f JOIN r ON r.x = f.x AND r.r <= 3 GROUP BY 1)
    SELECT t.x AS word, CASE WHEN f.x = f.alias OR rival = 0 THEN key END AS key, CASE WHEN f.x = f.alias OR rival = 0 THEN score END AS score, coalesce(closest, '') AS closest FROM t LEFT JOIN f ON f.x = t.x LEFT JOIN d ON d.x = t.x""")
def alias_resolve_words(spark, sf):
    known = _words(spark, sf, "benchmark", F.col("item_id").cast("string").alias("key")).withColumnRenamed("word", "alias")
    found = fuzzy_join.resolve_aliases(_words(spark, sf, "conversations"), "word", known)
    return found.withColumn("closest", F.array_join("closest.alias", " "))


OPTIONS = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY")
SNAPPED = ", ".join(f"{{'less': -100 * (1 - CAST(levenshtein(low, '{o.lower()}') AS DOUBLE) / greatest(length(low), {len(o)})), 'i': {i}, 'o': '{o}'}}" for i, o in enumerate(OPTIONS))


@query("enum_snap", f"""WITH v AS (SELECT p_partkey, translate(p_type, 'UN', 'VM') AS v, lower(translate(p_type, 'UN', 'VM')) AS low FROM part), s AS (SELECT *, list_sort(list_filter([{SNAPPED}], lambda x: x.less <= -82)) AS s FROM v)
    SELECT p_partkey, v, coalesce({", ".join(f"CASE WHEN low = '{o.lower()}' THEN '{o}' END" for o in OPTIONS)}, {", ".join(f"CASE WHEN contains(low, '{o.lower()}') OR contains('{o.lower()}', low) THEN '{o}' END" for o in OPTIONS)}, s[1].o) AS option FROM s""")
def enum_snap(spark, sf):
    v = F.translate("p_type", "UN", "VM")
    return V.table(spark, sf, "part").select("p_partkey", v.alias("v"), S.to_enum(v, list(OPTIONS), snap=82.0).alias("option"))


@query("agreement_tumbling", f"WITH {V.SQL_DECISIONS} SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS reviewed, count(CASE WHEN decision = 'approved' THEN 1 END) AS approved FROM decisions GROUP BY 1")
def agreement_tumbling(spark, sf):
    return stream.agreement(V.decisions(V.table(spark, sf, "events")))


@query("agreement_sliding", f"""WITH {V.SQL_DECISIONS}, w AS (SELECT *, unnest([0, 1]) AS k FROM decisions) SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS window_start, count(*) AS reviewed, count(CASE WHEN decision = 'approved' THEN 1 END) AS approved FROM w GROUP BY 1""")
def agreement_sliding(spark, sf):
    return stream.agreement(V.decisions(V.table(spark, sf, "events")), "1 day", "12 hours")


@query("agreement_sessions", f"""WITH {V.SQL_DECISIONS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM decisions), s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(ts) AS window_start, count(*) AS reviewed, count(CASE WHEN decision = 'approved' THEN 1 END) AS approved FROM s GROUP BY sid""")
def agreement_sessions(spark, sf):
    return stream.agreement(V.decisions(V.table(spark, sf, "events")), "10 minutes", "session")
