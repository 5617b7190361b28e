from skuforge.functions import dictionary as D
from skuforge.operators import graph, ingest, rules, score
from skuforge.plans import lifecycle

FIELD = "record_id long, key string, value string, unit string, method string, source string, confidence double, n_warning int, n_error int, n_info int"


def cell(record, key, value, unit=""):
    return (record, key, value, unit, "regex", "input", 0.9, 0, 0, 0)


def test_a_rule_error_lowers_the_grade(spark):
    cats = spark.createDataFrame([(i, "ball_bearing", "b") for i in (1, 2)], "record_id long, category string, brand string")
    fields = spark.createDataFrame([cell(1, "bore_mm", "20"), cell(1, "outer_mm", "47"), cell(2, "bore_mm", "50"), cell(2, "outer_mm", "47"), cell(2, "width_mm", "60")], FIELD)
    checked = lifecycle.ruled(cats, fields)
    got = {(r.record_id, r.key): r.n_error for r in checked.collect()}
    assert got == {(1, "bore_mm"): 0, (1, "outer_mm"): 0, (2, "bore_mm"): 2, (2, "outer_mm"): 0, (2, "width_mm"): 0}
    scored = {r.record_id: r.consistency for r in score.consistency(checked).collect()}
    assert scored[2] < scored[1]


def test_numbers_are_normalised(spark):
    cats = spark.createDataFrame([(1, "fastener", "b")], "record_id long, category string, brand string")
    fields = spark.createDataFrame([cell(1, "diameter", "2 ft"), cell(1, "colour_code_that_has_no_spec", " x ")], FIELD)
    got = {r.key: r for r in lifecycle.normalised(cats, fields, D.specs(spark)).collect()}
    assert (got["diameter"].value, got["diameter"].unit, got["diameter"].n_info) == ("24", "in", 1)
    assert got["colour_code_that_has_no_spec"].value == " x "


def test_a_broken_rule_ends_no_other(spark):
    records = spark.createDataFrame([(1, "x", 5.0, 3.0)], "record_id long, category string, temp_min double, temp_max double")
    broken = rules.Rule("bad", "BAD", "error", "*", "no_such_column > 1")
    got = {(r.code, r.severity) for r in rules.run_rules(records, (rules.RULES[0], broken)).collect()}
    assert got == {("TEMP_RANGE_INVERTED", "error"), ("RULE_ERROR", "info")}


def test_names_resolve_with_floor_and_margin(spark):
    texts = spark.createDataFrame([("Brand Name",), ("brnd name",), ("zzzzqq",), (None,), ("brnd name",)], "header string")
    got = {r.header: r for r in D.resolve_names(texts, "header").collect()}
    assert got["Brand Name"].key == "brand" and got["zzzzqq"].key is None and len(got) == 3
    assert got["brnd name"].key == D.resolve_header("brnd name") and len(got["brnd name"].closest) == 3


def test_records_without_number_or_series_gather_nowhere(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, " "), (5, None)], "o int, sku string")
    assert {r.o: r.unique_sku for r in ingest.unique_sku(rows, "sku", "o").collect()} == {1: "a", 2: "a--dup1", 3: "UNKNOWN-00003", 4: "UNKNOWN-00004", 5: "UNKNOWN-00005"}
    cats = spark.createDataFrame([(i, "c", None if i > 3 else "b") for i in range(6)], "record_id long, category string, brand string")
    fields = spark.createDataFrame([(i, "series", "s") for i in range(3)], "record_id long, key string, value string")
    got = {r.record_id: (r.level, r.grp) for r in graph.peer_groups(cats, fields).collect()}
    assert got == {0: ("series", "s"), 1: ("series", "s"), 2: ("series", "s"), 3: ("brand", "b|c"), 4: ("category", "c"), 5: ("category", "c")}
