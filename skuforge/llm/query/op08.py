"""The 20 vectors of highest integer inner product for every vector whose id is divisible by 20."""

from pyspark.sql import functions as F

from skuforge.llm import common
from skuforge.llm.topk_pivots import exact_topk

NAME = "op8_topk_pivots"
SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), e AS (
    SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM e q JOIN e c ON q.i = c.i AND q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    GROUP BY 1, 2
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def run(spark, sf_dir):
    return exact_topk(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
