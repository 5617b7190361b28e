"""Hard negatives of all vectors whose id is divisible by 50."""

from pyspark.sql import functions as F

from skuforge.llm import common
from skuforge.llm.hard_negatives import hard_negatives

NAME = "op11_hard_negatives"
SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), e AS (
    SELECT vec_id, label, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v
), s AS (
    SELECT q.vec_id AS a, q.label = c.label AS same, c.vec_id AS id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM e q JOIN e c ON q.i = c.i AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    GROUP BY 1, 2, 3
), p AS (
    SELECT a, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5
), n AS (
    SELECT p.a, p.id AS positive_id, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS r
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, positive_id, CAST(r AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM n WHERE r <= 3
"""


def run(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)
