import duckdb
import pytest

from skuforge.operators import similarity
from skuforge.plans import registry
from tests.oracle import connect, differ

SF = "/root/testdata/sf0.01"


def test_consensus_equals_its_sql_at_a_larger_scale(spark):
    assert differ(spark, connect(SF), SF, registry.queries()["series_consensus"], registry.oracle_sql()["series_consensus"]) is None


@pytest.mark.parametrize("name", ("spark", "sql"))
def test_records_without_a_series_have_consensus_by_brand(spark, tmp_path, name):
    # odd keys have no series; 0 and 40 have one, and are of the brand too
    rows = [(k, "small rod", "B", "STEEL", 1) for k in (1, 3, 7, 0, 40)] + [(k, "small rod", None, "STEEL", 1) for k in (5, 9, 11)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    if name == "spark":
        got = [r.asDict() for r in registry.queries()["series_consensus"](spark, str(tmp_path)).collect()]
    else:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        con.execute(registry.oracle_sql()["series_consensus"])
        got = [dict(zip([c[0] for c in con.description], r, strict=True)) for r in con.fetchall()]
    assert {(r["category"], r["brand"], r["series"]) for r in got} == {("fastener", "B", None)}
    # of five, two (0 and 40) have no brand cell of their own
    assert {r["key"]: (r["value"], r["support"], r["share"]) for r in got if r["key"] in ("brand", "diameter")} == {"brand": ("B", 3, 0.6), "diameter": ("1", 3, 0.6)}


def test_every_record_has_one_group_to_ask(spark):
    cats = spark.createDataFrame([(1, "c", "B"), (2, "c", "B"), (3, "c", "D"), (4, "c", None), (5, "c", ""), (6, "d", "B"), (7, "c", "D")], "record_id long, category string, brand string")
    fields = spark.createDataFrame([(1, "series", "S"), (3, "series", "S"), (6, "series", ""), (7, "series", "T"), (2, "finish", "S")], "record_id long, key string, value string")
    got = sorted(tuple(r) for r in similarity.consensus_groups(cats, fields).collect())
    # no record of brand D asks by it
    assert got == [(1, "c", "brand", "B"), (1, "c", "series", "S"), (2, "c", "brand", "B"), (3, "c", "series", "S"), (6, "d", "brand", "B"), (7, "c", "series", "T")]
