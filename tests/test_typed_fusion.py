from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import canonical, fusion


def fused(spark, rows, specs):
    cells = spark.createDataFrame([(r, "c", k, i, s, c, "regex", v, u) for i, (r, k, s, c, v, u) in enumerate(rows)], "record_id long, category string, key string, seq int, source string, confidence double, method string, value string, unit string")
    return {(r.record_id, r.key): r for r in fusion.resolve_typed(canonical.canonicalise(cells, D.specs(spark, specs, ("c",)), how="left")).collect()}


SPECS = (D.Spec("width", "Width", dtype="number", unit="mm", family="length"), D.Spec("mass", "Mass", dtype="number", unit="kg", family="mass"), D.Spec("marks", "Marks", dtype="list"), D.Spec("name", "Name"))


def test_numbers_agree_in_the_unit_of_their_spec(spark):
    rows = [(1, "width", "input", 0.9, "20", "mm"), (1, "width", "pdf", 0.8, "20.0", ""), (1, "width", "web", 0.7, "2 cm", "")]
    rows += [(2, "width", "input", 0.9, "20", ""), (2, "width", "pdf", 0.8, "200", "mm"), (3, "width", "pdf", 0.9, "20", ""), (3, "width", "web", 0.9, "31 mm", "")]
    rows += [(4, "width", "web", 0.9, "20", ""), (4, "width", "image", 0.9, "26", ""), (5, "width", "human", 0.9, "20", ""), (5, "width", "input", 0.9, "99", "")]
    rows += [(6, "width", "pdf", 0.9, "100", ""), (6, "width", "pdf", 0.8, "101.5", ""), (6, "width", "pdf", 0.7, "103", ""), (7, "mass", "input", 0.9, "0", ""), (7, "mass", "pdf", 0.9, "0 g", "")]
    got = fused(spark, rows, SPECS)
    first = got[1, "width"]
    assert (first.value, first.number, first.unit, first.support, first.alternatives, first.facts, first.issue, first.confidence) == ("20", 20.0, "mm", 2, 0, 1, "", 1.0)
    assert (got[2, "width"].issue, got[2, "width"].confidence, got[2, "width"].facts) == ("UNIT_SUSPECT", 0.5, 2)
    assert (got[3, "width"].issue, got[3, "width"].confidence) == ("SOURCE_CONFLICT_KEPT", 0.85)
    assert (got[4, "width"].issue, got[4, "width"].confidence) == ("SOURCE_CONFLICT", 0.55)
    assert (got[5, "width"].issue, got[5, "width"].alternatives, got[5, "width"].confidence) == ("", 1, 0.9)
    assert (got[6, "width"].facts, got[6, "width"].alternatives) == (1, 1)  # each agrees with the next, the last not with the first
    assert (got[7, "mass"].issue, got[7, "mass"].alternatives) == ("", 0)


def test_lists_texts_and_keys_without_a_spec(spark):
    rows = [(1, "marks", "pdf", 0.8, "CE; ul", ""), (1, "marks", "web", 0.9, "UL, ISO", ""), (1, "name", "pdf", 0.8, "Drill ", ""), (1, "name", "web", 0.8, "drill", ""), (1, "odd", "pdf", 0.8, "20", "cm"), (1, "odd", "web", 0.8, "20.0", "cm"), (2, "name", "pdf", 0.8, None, ""), (2, "name", "web", 0.6, "x", ""), (3, "width", "pdf", 0.8, "wide", ""), (3, "width", "web", 0.8, "5", "")]
    got = fused(spark, rows, SPECS)
    assert (got[1, "marks"].value, got[1, "marks"].issue, got[1, "marks"].confidence) == ("CE, ul, ISO", "", 0.86)
    assert (got[1, "name"].value, got[1, "name"].support, got[1, "name"].issue) == ("Drill", 1, "")
    assert (got[1, "odd"].value, got[1, "odd"].issue, got[1, "odd"].facts) == ("20", "SOURCE_CONFLICT_KEPT", 2)
    assert (got[2, "name"].value, got[2, "name"].source) == ("x", "web")
    assert got[3, "width"].codes == ["UNPARSEABLE_NUMBER"] and got[3, "width"].issue == "SOURCE_CONFLICT_KEPT"


def test_no_candidates(spark):
    assert fused(spark, [(1, "name", "pdf", 0.8, None, "")], SPECS) == {}


def test_how_many_facts(spark):
    rows = spark.createDataFrame([([],), ([1.0, None],), ([3.0, 1.0, 3.01, 300.0],), ([0.0, 0.0, -1.0],)], "x array<double>")
    assert [r[0] for r in rows.select(fusion.facts(F.col("x"))).collect()] == [0, 1, 3, 2]
