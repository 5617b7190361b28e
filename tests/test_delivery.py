from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import export
from skuforge.plans import q_export
from skuforge.sources import views as V

SF = "/root/testdata/sf0.001"


def test_every_publishable_attribute_is_delivered(spark):
    d = q_export.delivery_full(spark, SF)
    n = sum((F.when(F.col(f"label_{i}") != "", 1).otherwise(0) for i in range(1, q_export.N_SLOTS + 1)), F.lit(0))
    delivered = {r.sku: r.n for r in d.select("sku", n.alias("n")).filter("n > 0").collect()}
    every = export.slots(V.fields(spark, SF), D.specs(spark), V.categories(spark, SF), 10**6)
    assert delivered == {str(r.record_id): r["count"] for r in every.groupBy("record_id").count().collect()}
    assert max(delivered.values()) == 3
