import json

import pytest
from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.operators import delivery, export, judge, prompts, runtime, score, store
from skuforge.plans import q_delivery
from skuforge.sources import tables

FIELD = "record_id long, key string, value string, unit string, method string, source string, confidence double, n_error int, n_warning int, n_info int"


def cell(record, key, value, confidence=0.9, unit="", n_error=0):
    return (record, key, value, unit, "regex", "input", confidence, n_error, 0, 0)


def cats(spark, *ids):
    return spark.createDataFrame([(i, f"S{i}", "metal_panel") for i in ids], "record_id long, sku string, category string")


def test_a_judge_lowers_freely_and_raises_a_little(spark):
    fields = spark.createDataFrame([cell(1, "grit", "P80"), cell(1, "length", "3", unit="ft"), cell(2, "grit", "P80"), cell(3, "grit", None)], FIELD)
    answer = {"issues": [{"field_key": "grit", "code": "unit_suspect", "severity": "ERROR"}, {"field_key": None, "code": "WRONG_ATTRIBUTE"}, {"code": "X"}], "confidence_adjustments": {"grit": 0.2, "length": 7, "colour": 1}}

    def provider():
        return [runtime.Provider("stub", lambda p: "```json\n" + json.dumps(answer) + "\n```" if "length" in p else "sorry")]

    got = {(r.record_id, r.key): r for r in judge.review(cats(spark, 1, 2, 3), fields, D.specs(spark), provider, "stub", "v1").collect()}
    assert len(got) == 4
    assert (got[1, "grit"].confidence, got[1, "grit"].n_error, got[1, "grit"].n_warning) == (0.2, 1, 1)
    assert got[1, "length"].confidence == pytest.approx(0.95) and got[1, "length"].n_error == 0
    assert got[2, "grit"].confidence == 0.9 and got[3, "grit"].confidence == 0.9


def test_evidence_is_bounded_and_named(spark):
    fields = spark.createDataFrame([cell(1, f"k{i:03}", "v") for i in range(60)] + [cell(2, "length", "3", unit="ft"), cell(2, "grit", "")], FIELD)
    got = {r.record_id: r.evidence.split("\n") for r in judge.evidence_block(cats(spark, 1, 2, 3), fields, D.specs(spark)).collect()}
    assert len(got[1]) == 45 and got[2] == ['length (Length) = 3 ft [input/regex] "no evidence quoted"'] and 3 not in got


def test_prompts_name_their_places(spark):
    assert len(prompts.TEXTS) == 7
    with pytest.raises(ValueError):
        prompts.prompt("conflict", label=F.lit("x"))
    got = spark.range(1).select(prompts.prompt("conflict", label=F.lit("Grit"), candidates=F.lit(None)).alias("p")).first().p
    assert got.startswith("Sources disagree on Grit.\nCandidates:\n\nAnswer")


def test_shares_of_a_limit_keep_to_it():
    assert runtime.share(0, 8).rpm == 0
    for rpm in (1, 5, 13, 60):
        one = runtime.share(rpm, 8)
        assert 8 * one.rpm * 60 / one.window <= rpm + 1e-9


def test_template_and_header(spark, tmp_path):
    assert len(delivery.template()) == len(set(delivery.template())) == 252
    (tmp_path / "h.csv").write_text('﻿PART_NUMBER,"Price, list", ,ATTRIBUTE_LABEL 1,extra\n1,2,3,4,5\n')
    (tmp_path / "empty.csv").write_text("")
    assert delivery.header(spark, str(tmp_path / "h.csv")) == ["PART_NUMBER", "Price, list", "ATTRIBUTE_LABEL 1", "extra"]
    assert delivery.header(spark, str(tmp_path / "empty.csv")) == delivery.template()


def test_delivery_of_odd_records(spark):
    fields = [cell(1, "item_features", "a | b"), cell(1, "certifications", "UL|CE"), cell(1, "warranty_months", "24"), cell(1, "grit", "P80"), cell(1, "material", "steel"), cell(1, "length", "3"), cell(1, "finish", "x"), cell(1, "series", "s", 0.1), cell(1, "length", "2")]
    raw = spark.createDataFrame([(1, "  desc ", None)], "id long, part_desc string, E1_Brand string")
    docs = spark.createDataFrame([(1, "web", f"u{i}", None) for i in (3, 1, 2, 1)] + [(1, "pdf", None, "Install.pdf"), (1, "web", None, None)], "record_id long, kind string, url string, name string")
    columns = ["PART_NUMBER", "Part_Desc", "E1_Brand", "MFR URL", "Ref URL 1", "Ref URL 3", "Warranty", "Standard/Approvals", "ITEM_FEATURES_2", "Instruction/Installation Manual", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_VALUE 2", "ATTRIBUTE_LABEL 3", "ATTRIBUTE_LABEL 4", "nothing"]
    got = delivery.deliver(cats(spark, 1, 2), spark.createDataFrame(fields, FIELD), D.specs(spark), documents=docs, raw=delivery.raw_rows(raw, "id"), columns=columns)
    one, two = got.orderBy("record_id").collect()
    assert tuple(one)[1:] == ("S1", "desc", "", "u1", "u2", "", "2 Years Limited", "UL | CE", "b", "Install.pdf", "Panel Material", "Length", "2", "Length", "Grit", "")
    assert tuple(two)[1:] == ("S2", *[""] * (len(columns) - 1))
    empty = delivery.deliver(cats(spark, 1).limit(0), spark.createDataFrame([], FIELD), D.specs(spark))
    assert empty.count() == 0 and len(empty.columns) == 253


def test_store_loads_newest_first_and_clears(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "c"), (3, "c"), (4, None)], "id long, updated string")
    assert [r.id for r in store.load_all(rows, "updated", "id", 3).collect()] == [3, 2, 1] and store.load_all(rows, "updated", "id", None).count() == 4
    folder = tables.stored(rows, "products")
    assert store.clear(spark, folder) == 4 and spark.read.parquet(folder).schema == rows.schema and store.clear(spark, folder) == 0


def test_audit_holds_scores_and_bare_records(spark):
    fields = spark.createDataFrame([cell(1, "grit", "P80", n_error=1), cell(1, "grit", "P80", n_error=1)], FIELD)
    c = cats(spark, 1, 2).withColumn("brand", F.lit("b"))
    scores = score.overall(c, fields, D.specs(spark))
    got = {r.record_id: json.loads(r.record) for r in export.audit_record(c, fields, scores, scores).collect()}
    assert got[1]["attributes"]["grit"]["issues"]["error"] == 1 and got[1]["review_state"] == "needs_review" and got[1]["quality_after"]["grade"]
    assert got[2]["attributes"] == {} and got[2]["review_state"] == "auto_approved"


def test_a_judge_is_a_step_of_the_batch(spark):
    from skuforge.plans import lifecycle
    from skuforge.sources import views as V

    answer = json.dumps({"issues": [{"code": "INTERNAL_CONTRADICTION", "severity": "error"}]})
    rows = V.catalogue(spark, "/root/testdata/sf0.001").limit(20)
    review = lambda c, f, s: judge.review(c, f, s, lambda: [runtime.Provider("stub", lambda p: answer)], "stub", "v1")
    plain, judged = lifecycle.run_batch(rows), lifecycle.run_batch(rows, judge=review)
    errors = lambda b: b.fields.agg(F.sum("n_error")).first()[0]
    assert errors(judged) == errors(plain) + judged.fields.select("record_id").distinct().count()


def test_the_query_delivers_supplied_columns(spark):
    got = q_delivery.full(spark, "/root/testdata/sf0.001")
    assert got.filter("Part_Desc = ''").count() == 0 and len(got.columns) == 253
