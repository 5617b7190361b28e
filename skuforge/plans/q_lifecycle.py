"""The whole batch, and the steps that use a model's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import canonical, model, runtime
from skuforge.plans import lifecycle
from skuforge.plans.registry import query
from skuforge.sources import views as V


@query("lifecycle_batch")
def lifecycle_batch(spark, sf):
    b = lifecycle.run_batch(V.catalogue(spark, sf))
    return b.after.select("record_id", "category", "completeness", "accuracy", "consistency", "richness", "overall", "grade")


@query("lifecycle_delivery")
def lifecycle_delivery(spark, sf):
    return lifecycle.run_batch(V.catalogue(spark, sf)).delivery


@query("lifecycle_summary")
def lifecycle_summary(spark, sf):
    return lifecycle.run_batch(V.catalogue(spark, sf)).summary


@query("canonicalise", f"""WITH {D.specs_sql()}, {V.SQL_CATEGORY}, c AS (SELECT p_partkey AS record_id, category, CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), ' ft') WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ' to ', CAST(p_size + 2 AS VARCHAR), ' in') ELSE 'about' END AS value, p_size
    FROM part JOIN category ON record_id = p_partkey), n AS (SELECT *, CASE record_id % 3 WHEN 0 THEN p_size * 12e0 WHEN 1 THEN p_size + 1e0 END AS number FROM c WHERE category IN ('fastener', 'motion_part'))
    SELECT record_id, number, concat_ws(',', CASE WHEN record_id % 3 = 2 THEN 'UNPARSEABLE_NUMBER' END, CASE WHEN record_id % 3 = 0 THEN 'UNIT_CONVERTED' END, CASE WHEN record_id % 3 = 1 THEN 'RANGE_COLLAPSED' END, CASE WHEN number < 1e-1 OR number > 100 THEN 'OUT_OF_RANGE' END) AS issues FROM n""")
def canonicalise(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    value = F.when(k % 3 == 0, F.concat(n, F.lit(" ft"))).when(k % 3 == 1, F.concat(n, F.lit(" to "), (F.col("p_size") + 2).cast("string"), F.lit(" in"))).otherwise("about")
    cells = V.table(spark, sf, "part").select(k.alias("record_id"), F.lit("diameter").alias("key"), value.alias("value")).join(V.categories(spark, sf).select("record_id", "category"), "record_id")
    return canonical.canonicalise(cells, D.specs(spark)).select("record_id", "number", "issues")


ALIASES = {"dia": "diameter", "mat": "material"}


def _answers(spark, sf):
    item = F.concat(F.lit('{"items": [{"key": "Dia", "value": "'), F.col("p_size").cast("string"), F.lit('", "unit": "in", "evidence": "'), F.when(F.col("p_partkey") % 2 == 0, "seen").otherwise(""), F.lit('", "uncertain": '), F.when(F.col("p_partkey") % 3 == 0, "true").otherwise("false"), F.lit(', "basis": "same_series"}, {"key": "zzz", "value": "1"}]}'))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.concat(F.lit("Sure:\n```json\n"), item, F.lit("\n```")).alias("answer"))


@query("payload_candidates", """SELECT p_partkey AS record_id, 'diameter' AS key, CAST(p_size AS VARCHAR) AS value, 'in' AS unit, round(8e-1 * CASE WHEN p_partkey % 3 = 0 THEN 7e-1 ELSE 1e0 END * CASE WHEN p_partkey % 2 = 0 THEN 1e0 ELSE 6e-1 END, 4) AS confidence,
    CASE WHEN p_partkey % 2 = 1 THEN 'NO_EVIDENCE' WHEN p_partkey % 3 = 0 THEN 'MODEL_UNCERTAIN' ELSE '' END AS issue FROM part""")
def payload_candidates(spark, sf):
    return model.payload_candidates(_answers(spark, sf), "record_id", "answer", ALIASES)


@query("model_fill", "SELECT p_partkey AS record_id, 'diameter' AS key, CAST(p_size AS VARCHAR) AS value, round(CASE WHEN p_partkey % 3 = 0 THEN 72e-2 * 7e-1 ELSE 72e-2 END, 4) AS confidence FROM part")
def model_fill(spark, sf):
    return model.model_fill(_answers(spark, sf), "record_id", "answer", ALIASES)


@query("content_generate", "SELECT p_partkey AS record_id, 'short_desc' AS key, concat('A ', p_name) AS value, 75e-2 AS confidence FROM part")
def content_generate(spark, sf):
    prompts = V.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), runtime.build_prompt("content", "Write short_desc.", ("Product", "p_name")).alias("prompt"))
    stub = lambda: [runtime.Provider("stub", lambda p: '{"short_desc": "A ' + p.rsplit("\n", 1)[1] + '", "long_desc": " "}')]
    return model.content_fields(runtime.complete(prompts, "prompt", stub, "stub", "v1"), "record_id", "response", ["short_desc", "long_desc"])


@query("neighbour_block", f"""WITH {V.SQL_FIELDS} SELECT p.p_partkey AS record_id, concat('grit = ', f.value, ' (record ', CAST(f.record_id AS VARCHAR), ')') AS block FROM part p JOIN fields f ON f.record_id = p.p_partkey + 1 AND f.key = 'grit' AND f.confidence >= 6e-1""")
def neighbour_block(spark, sf):
    part = V.table(spark, sf, "part")
    similar = part.select(F.col("p_partkey").alias("record_id"), (F.col("p_partkey") + 1).alias("other"), F.lit(1.0).alias("score"))
    wanted = part.select(F.col("p_partkey").alias("record_id"), F.lit("grit").alias("key"))
    return model.neighbour_block(similar, V.fields(spark, sf), wanted)


@query("category_seed", f"WITH {V.SQL_CATEGORY} SELECT record_id, category AS value, CASE WHEN record_id % 2 = 0 THEN 95e-2 ELSE 5e-1 END AS confidence, CASE WHEN record_id % 3 = 0 THEN 'Hardware' END AS alternative FROM category")
def category_seed(spark, sf):
    r = F.col("record_id")
    seed = model.seeded_category(F.col("category"), F.when(r % 2 == 0, 1.0).otherwise(0.2), F.when(r % 3 == 0, "Hardware").otherwise("N/A"))
    return V.categories(spark, sf).select("record_id", seed.alias("s")).select("record_id", "s.value", "s.confidence", "s.alternative")
