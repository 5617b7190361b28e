"""The delivery: one wide row of text for each record, in the order of a template's header.

Everything known of a record comes from one aggregate over its cells; a record's cells are bounded by its specs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuforge.functions import dictionary as D
from skuforge.functions import scalars as S
from skuforge.operators.score import penalised
from skuforge.sources.tables import growing

# The names and order of the delivery format's columns, and the cells that they hold.
FRONT = ("PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand")
NAMES = ("Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath")
TEXTS = ("MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION")
CLAUSES = ("With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name")
TRADE = ("UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information")
SIZES = ("LENGTH", "HEIGHT", "WIDTH", "WEIGHT", "VOLUME")
PAPERS = (
    "SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS",
    "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert",
)
LAST = ("Video Link", "Video Link 1", "Country Of Origin", "Discontinued", "Actual Image (Yes/No)")
PAPER_WORDS = {
    "Specification Sheet": ("spec", "specification", "datasheet", "data sheet"),
    "Instruction/Installation Manual": ("install", "instruction"),
    "Service Manual": ("service",),
    "Owners/User Manual": ("owner", "user manual", "manual"),
    "Warranty Information": ("warranty",),
    "SDS": ("sds", "msds", "safety data"),
    "Line Drawing": ("line drawing", "drawing", "dimension"),
    "Catalog": ("catalog", "catalogue"),
    "Submittal": ("submittal",),
    "Technical Bulletin": ("bulletin",),
}
CELL_OF = {
    "MANUFACTURER_NAME": "manufacturer", "BRAND_NAME": "brand", "MOBILE_DESC": "mobile_desc", "INVOICE_DESC": "invoice_desc", "SHORT_DESC": "short_desc", "LONG_DESC1": "long_desc", "LONG_DESC": "long_desc",
    "RETAIL_DESC": "retail_desc", "MARKETING_DESCRIPTION": "marketing_description", "With": "with_clause", "Includes": "includes", "Application": "application", "UPC": "upc", "GTIN": "upc", "UNSPSC": "unspsc_code",
    "Selling Qty": "pack_quantity", "Selling UOM": "selling_uom", "LENGTH": "length_in", "WIDTH": "width_in", "HEIGHT": "height_in", "WEIGHT": "weight_lb", "Country Of Origin": "country_of_origin",
}
UNIT_OF = {"LENGTH": "in", "WIDTH": "in", "HEIGHT": "in", "WEIGHT": "lb"}
DEDICATED = (
    "sku", "product_name", "brand", "manufacturer", "category", "certifications", "warranty_months", "upc", "unspsc_code", "country_of_origin", "discontinued", "pack_quantity", "selling_uom",
    "length_in", "width_in", "height_in", "weight_lb",
)
#: Cells that are content: they have columns of their own, never a slot.
CONTENT = ("product_name_generic", "mobile_desc", "invoice_desc", "short_desc", "long_desc", "retail_desc", "marketing_description", "item_features", "with_clause", "includes", "application")
#: What separates the entries of a cell that holds a list.
LIST = "|"


def template(slots: int = 50, features: int = 20, brands: tuple[str, ...] = ("Brand_2", "Brand_3")) -> list[str]:
    """The format's columns by rule; brands: the names of supplied brand columns beside the first."""
    attributes = [f"ATTRIBUTE_{c} {i}" for i in range(1, slots + 1) for c in ("LABEL", "VALUE", "UOM")]
    sizes = [c for s in SIZES for c in (s, f"{s}_UOM")]
    links, images = [f"Ref URL {i}" for i in range(1, 6)], [f"Alternate Image {i}" for i in range(1, 5)]
    return ["MFR URL", *links, *FRONT, *brands, *NAMES, *TEXTS, *(f"ITEM_FEATURES_{i}" for i in range(1, features + 1)), *CLAUSES, *attributes, *TRADE, *sizes, "Product Image", *images, *PAPERS, *LAST]


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in a CSV file's first line, trimmed, blank ones left out; one row reaches the driver. Where there
    is no name, the columns of the format by rule."""
    first = spark.read.option("encoding", "UTF-8").text(path).limit(1).collect()
    if not first:
        return template()
    # a one-line CSV parse by Spark, as names may be quoted
    line = first[0].value.removeprefix("\ufeff")
    names = spark.createDataFrame([(line,)], "line string").select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(line.count(",") + 1)))).first()[0]
    return [n.strip() for n in names if n and n.strip()] or template()


def raw_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """record_id and raw: a map from every other supplied column's name to its text, as it came (null where it was null)."""
    names = [c for c in rows.columns if c != id_col]
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("text")) for c in names]
    return rows.select(F.col(f"`{id_col}`").alias("record_id"), F.map_from_entries(F.array(*pairs)).alias("raw"))


def echoed(raw: Column, name: str) -> Column:
    """What came in the column of that name; else in the last one whose name differs in case only; else null."""
    alike = F.map_values(F.map_filter(raw, lambda k, v: F.lower(k) == name.lower()))
    return F.trim(F.when(F.map_contains_key(raw, F.lit(name)), F.element_at(raw, F.lit(name))).otherwise(F.try_element_at(alike, F.lit(-1))))


def _first(documents: DataFrame, kind: str, n: int) -> DataFrame:
    """record_id and urls: the first n different ones of a kind, by text. Each task passes on n of a record at most."""
    some = documents.filter((F.col("kind") == kind) & F.col("url").isNotNull()).select("record_id", "url").distinct()
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("record_id").orderBy("url"))).filter(F.col("r") <= n)
    return top.groupBy("record_id").agg(F.array_sort(F.collect_list("url")).alias(kind))


def _papers(documents: DataFrame) -> DataFrame:
    low = F.lower("name")
    words = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))
    return documents.filter("kind = 'pdf'").groupBy("record_id").agg(*(F.min(F.when(words(ws), F.col("name"))).alias(c) for c, ws in PAPER_WORDS.items()))


def deliver(
    records: DataFrame, fields: DataFrame, specs: DataFrame, *, documents: DataFrame | None = None, raw: DataFrame | None = None, columns: list[str] | None = None, supplied: tuple[str, ...] = ("Part_Desc", "E1_Brand", "Brand_2", "Brand_3", "Part_Manuf"), floor: float = D.PUBLISH, taxonomy=None
) -> DataFrame:
    """record_id and the template's columns, all text, empty where nothing is known.

    records(record_id, sku, category), fields as everywhere (of a repeated key the greatest text counts), documents(record_id,
    kind, url, name), raw(record_id, raw) of raw_rows. Attributes take slots by whether they are required, weight, penalised
    confidence and key, from `floor` on; as many as the columns have. Columns in `supplied` are what came in; a column that
    no rule knows is empty. A record without cells, documents or raw row is there too.
    """
    columns, taxonomy = columns or template(), taxonomy or D.TAXONOMY
    own = fields.filter("value is not null and trim(value) <> ''").join(growing(records.select("record_id", "category")), "record_id")
    told = specs.select("category", "key", "label", "required", "weight", F.col("unit").alias("spec_unit"))
    own = own.join(F.broadcast(told), ["category", "key"], "left")
    fit = F.col("label").isNotNull() & (penalised() >= floor) & ~F.col("key").isin(*DEDICATED, *CONTENT)
    slot = F.struct((~F.col("required")).alias("later"), (-F.col("weight")).alias("weight"), (-penalised()).alias("confidence"), "key", "label", "value", F.coalesce("spec_unit", F.lit("")).alias("uom"))
    keys = sorted({*CELL_OF.values(), "certifications", "product_name", "product_name_generic", "warranty_months", "item_features", "discontinued"})
    cells = own.groupBy("record_id").agg(F.array_sort(F.collect_list(F.when(fit, slot))).alias("slots"), *(F.max(F.when(F.col("key") == k, F.trim("value"))).alias(f"cell_{k}") for k in keys))
    wide = records.select("record_id", "sku", "category").join(growing(cells), "record_id", "left")
    for part in [_first(documents, "web", 6), _first(documents, "image", 5), _papers(documents)] if documents is not None else []:
        wide = wide.join(growing(part), "record_id", "left")
    if raw is not None:
        wide = wide.join(growing(raw.select("record_id", "raw")), "record_id", "left")

    cell = lambda k: F.col(f"cell_{k}")
    path = lambda i: F.create_map(*(F.lit(x) for c, levels in taxonomy.items() for x in (c, levels[i])))[F.col("category")]
    came = lambda c: echoed(F.col("raw"), c) if raw is not None and c in supplied else F.lit(None)
    or_else = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    made: dict[str, Column] = {c: cell(k) for c, k in CELL_OF.items()}
    made |= {f"{c}_UOM": F.when(cell(CELL_OF[c]).isNotNull(), u) for c, u in UNIT_OF.items()}
    made |= dict.fromkeys(("PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER"), F.col("sku"))
    made |= {c: path(i) for i, c in enumerate(("Dept", "Class", "Fine"))}
    made["Classpath"] = F.array_join(F.filter(F.array(path(0), path(1), path(2)), lambda x: x != ""), " > ")
    made |= {c: came(c) for c in supplied}
    made["Part_Desc"], made["Part_Manuf"] = or_else(came("Part_Desc"), cell("product_name")), or_else(came("Part_Manuf"), cell("manufacturer"))
    made["Standard/Approvals"] = F.array_join(F.transform(F.split(cell("certifications"), F.lit(r"\|")), lambda x: F.trim(x)), " | ")
    made["Application"] = F.array_join(F.transform(F.split(cell("application"), F.lit(r"\|")), lambda x: F.trim(x)), ", ")
    made["Product Name"] = or_else(cell("product_name_generic"), path(2))
    made["Warranty"] = S.warranty(cell("warranty_months").try_cast("double").cast("int"))
    made["Discontinued"] = F.when(F.lower(cell("discontinued")) == "true", "Yes").when(F.lower(cell("discontinued")) == "false", "No").otherwise(cell("discontinued"))
    features = F.transform(F.split(cell("item_features"), F.lit(r"\|")), lambda x: F.trim(x))
    for c in columns:
        if numbered := re.fullmatch(r"ITEM_FEATURES_(\d+)", c):
            made[c] = F.get(features, F.lit(int(numbered[1]) - 1))
        elif numbered := re.fullmatch(r"ATTRIBUTE_(LABEL|VALUE|UOM) (\d+)", c):
            made[c] = F.get("slots", F.lit(int(numbered[2]) - 1))[numbered[1].lower()]
    if documents is not None:
        made |= {c: F.col(f"`{c}`") for c in PAPER_WORDS} | {"MFR URL": F.get("web", F.lit(0)), "Product Image": F.get("image", F.lit(0)), "Actual Image (Yes/No)": F.when(F.size("image") > 0, "Yes")}
        made |= {f"Ref URL {i}": F.get("web", F.lit(i)) for i in range(1, 6)} | {f"Alternate Image {i}": F.get("image", F.lit(i)) for i in range(1, 5)}
    known = {c.lower(): x for c, x in made.items()}
    return wide.select("record_id", *(F.coalesce(known[c.lower()].cast("string"), F.lit("")).alias(c) if c.lower() in known else F.lit("").alias(c) for c in columns))
