import random

from skuforge.operators import graph
from skuforge.plans import q_peers

SF = "/root/testdata/sf0.001"


def test_related_sets_against_pairs(spark):
    draw = random.Random(3)
    rows = {(f"product:{p}", f"{kind}:{draw.randint(0, 3)}", kind) for p in range(120) for kind in ("category", "brand", "material", "finish") if draw.random() < 0.8}
    e = spark.createDataFrame(sorted(rows), "product string, node string, kind string")
    assert sorted(map(tuple, graph.related_sets(e, 3).collect())) == sorted(map(tuple, graph.related(e, 3).collect()))


def test_every_part_has_related_products(spark):
    rows = q_peers.related_products_all(spark, SF).collect()
    assert {r.product for r in rows} == {r.product for r in q_peers._edges(spark, SF).select("product").distinct().collect()}
    assert max(r.shared for r in rows) > 1
