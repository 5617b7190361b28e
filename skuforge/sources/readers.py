"""Sources: delimited text, spreadsheets, JSON, JSON lines, pages and binary documents. Every cell is read as a string."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.functions.pages import reduce_page
from skuforge.sources import tables


def sniff(line: str) -> str:
    """The most frequent of tab, semicolon, bar and comma outside quotes; comma in doubt."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max((",", ";", "\t", "|"), key=lambda d: bare.count(d))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A file or folder with a header line; the separator is found in the first line. Blanks stay empty strings, headers are
    stripped. Only one line is read ahead."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = "\t" if path.endswith(".tsv") else sniff(first[0][0]) if first else ","
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.na.fill("")


SEPARATORS = (",", ";", "\t", "|")


def read_mixed(spark: SparkSession, path: str, file_col: str = "source_file") -> DataFrame:
    """All delimited files under path as one table of strings: each file has its own separator, encoding and order of columns, and
    columns are put together by name (trimmed; of a name that a file has twice, the first). A column that a file hasn't is
    empty, as is a missing cell; cells beyond the header are left out. file_col names the file.

    Lines are read by Spark, so large files are split and any store that Spark reads will do. A file's first line that isn't
    blank is its header and shows its separator; a file with a line that isn't UTF-8 is Latin-1. Cells in quotes may hold the
    separator, not line ends. The driver gets the names and number of columns only."""
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", meta["file_path"].alias("file"), F.struct(meta["file_block_start"], F.monotonically_increasing_id()).alias("at"))
    lines = lines.filter(F.trim("value") != "")
    files = lines.groupBy("file").agg(F.min(F.struct("at", "value")).alias("first"), F.min(F.is_valid_utf8("value")).alias("utf8"))
    text = lambda value: F.regexp_replace(F.when(F.col("utf8"), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1")), "^\ufeff|\r$", "")
    files = files.select("file", "utf8", F.col("first.at").alias("header_at"), text(F.col("first.value")).alias("header"))
    bare = F.regexp_replace("header", '"[^"]*"', "")
    count = lambda s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))
    sep = F.array_max(F.array(*(F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS))))["sep"]
    files = files.withColumn("sep", sep)
    files = tables.save(files.withColumn("names", F.transform(F.split("header", _outside_quotes(F.col("sep"))), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))), "files")
    width = files.agg(F.max(F.size("names"))).first()[0] or 0
    found = files.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).filter("name <> ''").orderBy("i", "name")
    names = [r["name"] for r in found.toLocalIterator()]
    data = lines.join(files, "file").filter(F.col("at") != F.col("header_at")).withColumn("line", text(F.col("value")))
    schema = ", ".join(f"c{i} string" for i in range(width)) or "c0 string"
    read = lambda s: F.from_csv("line", schema, {"sep": s, "quote": '"', "escape": '"'})
    cells = F.coalesce(*(F.when(F.col("sep") == s, read(s)) for s in SEPARATORS))
    data = data.withColumn("cells", cells).select("file", "names", F.array(*(F.col(f"cells.c{i}") for i in range(max(width, 1)))).alias("cells"))
    one = lambda name: F.coalesce(F.get("cells", F.array_position("names", name).cast("int") - 1), F.lit(""))
    return data.select(F.col("file").alias(file_col), *(one(n).alias(n) for n in names))


def _outside_quotes(sep: Column) -> Column:
    """A pattern for the separator outside quotes."""
    return F.concat(F.when(sep == "|", "\\|").otherwise(sep), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object on each line; values as strings, missing ones empty."""
    df = spark.read.option("primitivesAsString", True).json(path)
    return df.na.fill("")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects; or an object with `products` or `items`; or an object whose values are the rows."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    for name in ("products", "items"):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return df.select(F.inline(name)).na.fill("")
    kinds = {f.dataType.simpleString() for f in df.schema}
    if df.columns and all(k.startswith("struct<") for k in kinds):
        if len(kinds) == 1:
            return df.select(F.inline(F.array(*(F.col(f"`{c}`") for c in df.columns)))).na.fill("")
        parts = [df.select(f"`{c}`.*") for c in df.columns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out.na.fill("")
    return df.na.fill("")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(content: bytes) -> list[list[str]]:
    """Rows of the first sheet of an .xlsx file, as text; blank cells are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                v, text = c.find(f"{_NS}v"), "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                value = v.text or "" if v is not None else text
                cells[_column(c.get("r")) if c.get("r") else k] = shared[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """file, row and cells (array of strings) of the first sheets of .xlsx files; the header is row 0. One file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse_xlsx(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, cells array<string>")


def with_header(cells: DataFrame, header: list[str]) -> DataFrame:
    """Rows after the header as columns of its names."""
    return cells.filter("row > 0").select("file", "row", *(F.coalesce(F.get("cells", i), F.lit("")).alias(h.strip()) for i, h in enumerate(header)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .csv and .txt, .tsv, .jsonl, .json, .xlsx."""
    low = path.lower()
    if low.endswith(".jsonl"):
        return read_json_lines(spark, path)
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith((".xlsx", ".xlsm")):
        cells = read_xlsx(spark, path)
        first = cells.filter("row = 0").select("cells").first()
        return with_header(cells, first[0] if first else []).drop("file", "row")
    return read_delimited(spark, path)


def parse_pdf(content: bytes) -> str:
    """Text of a PDF where a reader is installed; without one an error says so."""
    raise NotImplementedError("no PDF library is installed: pass a parser of your own to read_documents")


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF or JPEG from its header."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:4] == b"GIF8":
        return int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    if content[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(content) and content[i] == 0xFF:
            if 0xC0 <= content[i + 1] <= 0xCF and content[i + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(content[i + 7 : i + 9], "big"), int.from_bytes(content[i + 5 : i + 7], "big")
            i += 2 + int.from_bytes(content[i + 2 : i + 4], "big")
    return None


def kind_of(path: Column) -> Column:
    """pdf, image, web, table or text by a path's extension."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(png|jpe?g|gif|webp|bmp)$"), "image").when(low.rlike(r"\.html?$|^https?://"), "web").when(low.rlike(r"\.(csv|tsv|xlsx?|jsonl?)$"), "table").otherwise("text")


def read_documents(spark: SparkSession, path: str, pdf=parse_pdf, limit: int = 24_000, lines: bool = False) -> DataFrame:
    """path, kind, text, width, height, fingerprint of the files under path. Pages are reduced to text, with lines to lines of
    text with tables and definition lists after them (see functions.pages); images have their size, PDFs go through `pdf`; a
    file that can't be read has a null text. Long texts keep their head and tail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").withColumn("kind", kind_of(F.col("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = image_size(content) if kind == "image" else None
                try:
                    text = pdf(content) if kind == "pdf" else None if kind == "image" else content.decode("utf-8", "replace")
                    text = reduce_page(text)[0] if lines and kind == "web" else text
                except Exception:
                    text = None
                out.append((text, *(size or (None, None))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))], ["path", "kind", "text", "width", "height"])

    read = files.mapInArrow(run, "path string, kind string, text string, width int, height int")
    text = F.col("text") if lines else F.when(F.col("kind") == "web", S.html_text(F.col("text"))).otherwise(F.col("text"))
    return read.withColumn("text", S.truncated(text, limit)).withColumn("fingerprint", S.fingerprint(F.col("text"), F.col("path")))


def messy_sample(spark: SparkSession, rows: int = 40, seed: int = 42) -> DataFrame:
    """A made-up distributor catalogue with missing, odd and repeated cells; the same rows for the same seed, at any size."""
    seeds = [("AB-1", "Flap disc 4-1/2\"x7/8\" P80", "Diablo", "4\" x 3\" x 2\"", "2,300 g", "-10..+70°C", "UL listed; CE"), ("CD-2", "20V brushless drill kit", "DeWalt", "12 mm", "3 HP", "-20 to 60 C", "CE"), ("EF-3", "Decking 1x6-16' grooved", "Trex", "1x6x16", "12 lb", "", "UL"), ("GH-4", "AWG-14 wire 500 ft", "", "500 ft", "AWG-14", "-40..90°C", "RoHS")]
    i = F.col("id")
    pick = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(seeds))).cast("int")
    cell = lambda k: F.get(F.array(*(F.lit(s[k]) for s in seeds)), pick)
    lost = lambda k, c: F.when(F.pmod(F.xxhash64(i, F.lit(seed + k)), F.lit(7)) == 0, F.element_at(F.array(*map(F.lit, ("", "N/A", "-- Unbranded --"))), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(3)) + 1).cast("int"))).otherwise(c)
    base = spark.range(rows).select(F.concat(cell(0), F.lit("-"), i.cast("string")).alias("Part No"), lost(1, cell(1)).alias("Description"), lost(2, cell(2)).alias("Manufacturer"), lost(3, cell(3)).alias("Dimensions"), lost(4, cell(4)).alias("Rating"), lost(5, cell(5)).alias("Temp Range"), lost(6, cell(6)).alias("Certs"))
    return base.unionByName(base.filter(F.col("Part No").endswith("-0")).limit(1))
