from skuforge.sources import readers


def test_files_of_several_separators_encodings_and_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sku,name, price\n1,"bolt, large",2\n2,"say ""hi""",\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_bytes("﻿price;sku;name\r\n3,5;3;Mutter\r\n\r\n4;4\r\n".encode())
    (tmp_path / "c.tsv").write_bytes("name\tsku\tname\nSchlüssel\t5\tzwei\n\t6\n".encode("latin-1"))
    (tmp_path / "d.txt").write_text('"sku|x"|name\n7|plain|more\n')
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("sku,only header\n")
    got = readers.read_mixed(spark, str(tmp_path))
    assert set(got.columns) == {"source_file", "sku", "name", "price", "sku|x", "only header"}
    rows = {(r["source_file"].rsplit("/", 1)[1], r["sku"] or r["sku|x"]): (r["name"], r["price"]) for r in got.collect()}
    assert rows == {("a.csv", "1"): ("bolt, large", "2"), ("a.csv", "2"): ('say "hi"', ""), ("b.csv", "3"): ("Mutter", "3,5"), ("b.csv", "4"): ("", "4"), ("c.tsv", "5"): ("Schlüssel", ""), ("c.tsv", "6"): ("", ""), ("d.txt", "7"): ("plain", "")}


def test_a_file_read_in_several_pieces_has_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;text\n" + "".join(f"{i};line {i}\n" for i in range(20_000)))
    (tmp_path / "b.csv").write_text("text,id\n" + "".join(f"line {i},{i}\n" for i in range(20_000, 40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = readers.read_mixed(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert {(r.id, r.text) for r in got.collect()} == {(str(i), f"line {i}") for i in range(40_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
