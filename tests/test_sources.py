import zipfile

from pyspark.sql import functions as F

from skuforge.functions import dictionary, fuzzy
from skuforge.operators import ingest, review
from skuforge.sources import readers
from skuforge.sources import views as V
from skuforge.streaming import decisions as stream


def test_tables_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Part No ; Desc\n1;"x; y"\n2;\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    (tmp_path / "c.json").write_text('{"products": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "d.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    (tmp_path / "e.json").write_text('[{"a": 1}, {"a": 2}]')
    got = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["Part No", "Desc"] and sorted(map(tuple, got.collect())) == [("1", "x; y"), ("2", "")]
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "b.jsonl")).collect())) == [("1", "x"), ("2", "")]
    for name in "cde":
        assert sorted(r.a for r in readers.read_table(spark, str(tmp_path / f"{name}.json")).collect()) == ["1", "2"]


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>sku</t></si><si><t>name</t></si><si><t>bolt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    got = readers.read_table(spark, str(tmp_path / "t.xlsx"))
    assert [tuple(r) for r in got.select("sku", "name").collect()] == [("7", "bolt")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hi <b>you</b></p><script>x</script>")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_text("x" * 50)
    got = {r.kind: r for r in readers.read_documents(spark, str(tmp_path), limit=20).collect()}
    assert got["web"].text == "Hi you" and (got["image"].width, got["image"].height) == (640, 480) and got["pdf"].text is None
    assert got["text"].text.startswith("x" * 14 + "\n[")


def test_headers():
    assert ingest.sku_column(["Width", "Part Number"]) == "Part Number" and ingest.sku_column(["Width", "Item No"]) == "Item No" and ingest.sku_column(["Width"]) is None
    assert ingest.asset_kind("Datasheet URL") == "pdf" and ingest.asset_kind("Photo") == "image" and ingest.asset_kind("Notes") is None
    assert dictionary.resolve_header("warrenty") == "warranty_months" and dictionary.resolve_header("zzz") is None
    assert fuzzy.ratio("large bolt", "Bolt large") > 90 > fuzzy.ratio("large bolt", "plate")


def test_stream_gives_the_batch_result(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = stream.decisions(stream.read_events(spark, str(tmp_path / "in"), "*.parquet"), "1000 days")
    q = rows.writeStream.foreachBatch(stream.upsert(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))[-1]
    got = spark.read.parquet(str(last))
    want = review.latest(V.decisions(events))
    assert sorted(map(str, got.select("sku", "field_key", "decision").collect())) == sorted(map(str, want.select("sku", "field_key", "decision").collect()))
    q = stream.agreement(rows).writeStream.format("memory").queryName("agreed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in stream.agreement(V.decisions(events)).collect()}
    assert {tuple(r) for r in spark.table("agreed").collect()} == want


def test_peer_inference_does_not_depend_on_row_order(spark):
    from skuforge.functions import dictionary as D
    from skuforge.operators import enrich

    sf = "/root/testdata/sf0.001"
    cats, fields = V.categories(spark, sf), V.fields(spark, sf)
    a = enrich.fill_from_peers(cats, fields, D.specs(spark)).collect()
    b = enrich.fill_from_peers(cats.orderBy(F.rand(1)), fields.orderBy(F.rand(2)), D.specs(spark)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and all(0 <= r.confidence <= 0.7 for r in a)
