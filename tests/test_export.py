from skuforge.plans import registry
from skuforge.sources import views

SF = "/root/testdata/sf0.001"


def test_flat_rows_have_every_cell(spark):
    # nine kinds of cells, of which five had a column
    flat = registry.queries()["flat_pivot"](spark, SF).collect()
    cells = views.fields(spark, SF).collect()
    got = {(r.record_id, k, r[k], r[f"{k}__unit"] or "") for r in flat for k in flat[0].asDict() if f"{k}__unit" in flat[0] and r[k] is not None}
    assert got == {(c.record_id, c.key, c.value, c.unit) for c in cells} and len(got) == len(cells)
