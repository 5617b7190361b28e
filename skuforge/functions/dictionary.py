"""The attribute dictionary of this package: categories, keywords, specs. Users can pass their own of the same shape."""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Spec:
    key: str
    label: str
    dtype: str = "string"
    unit: str = ""
    family: str = ""
    required: bool = False
    weight: int = 1
    low: float | None = None
    high: float | None = None
    scope: str = "common"
    aliases: tuple[str, ...] = ()


SPECS = (
    Spec("brand", "Brand", required=True, weight=3, aliases=("brand name", "make")),
    Spec("material", "Material", dtype="enum", weight=2, aliases=("mat", "made of")),
    Spec("series", "Series", weight=1, aliases=("product line",)),
    Spec("warranty_months", "Warranty", dtype="number", unit="month", family="time", weight=1, low=0, high=240, aliases=("warranty", "guarantee")),
    Spec("short_desc", "Short Description", weight=1, scope="content"),
    Spec("diameter", "Diameter", dtype="number", unit="in", family="length_in", required=True, weight=3, low=0.1, high=100, scope="fastener", aliases=("dia", "diam")),
    Spec("length", "Length", dtype="number", unit="ft", family="length_ft", required=True, weight=2, low=0.1, high=60, scope="fastener", aliases=("len",)),
    Spec("diameter", "Diameter", dtype="number", unit="in", family="length_in", required=True, weight=3, low=0.1, high=100, scope="motion_part", aliases=("dia", "bore")),
    Spec("finish", "Finish", weight=1, scope="motion_part", aliases=("coating",)),
    Spec("length", "Length", dtype="number", unit="ft", family="length_ft", required=True, weight=3, low=0.1, high=60, scope="metal_panel", aliases=("len",)),
    Spec("grit", "Grit", weight=2, scope="metal_panel", aliases=("grain",)),
    Spec("material", "Panel Material", dtype="enum", required=True, weight=4, scope="metal_panel", aliases=("mat",)),
)

CATEGORIES = ("fastener", "motion_part", "metal_panel", "general_product")
GENERIC = "general_product"
TAXONOMY = {"fastener": ("Hardware", "Fasteners", "Bolts and Rods"), "motion_part": ("Industrial", "", "Gears and Rings"), "metal_panel": ("Building", "Panels", "Metal Panels"), "general_product": ("General", "", "")}
#: Category, keyword, in the order in which they were declared.
KEYWORDS = (("fastener", "bolt"), ("fastener", "rod"), ("motion_part", "gear"), ("motion_part", "ring"), ("metal_panel", "plate"), ("metal_panel", "anvil"), ("fastener", "large bolt"), ("metal_panel", "hot plate"), ("motion_part", "cold"))

METHOD_CONFIDENCE = {"human_edit": 1.0, "input_field": 0.95, "regex": 0.92, "unit_convert": 0.9, "table_extract": 0.88, "llm_extract": 0.8, "web_extract": 0.72, "vlm": 0.7, "llm_generate": 0.6, "kg_infer": 0.55}
PRECEDENCE = {"human": 100, "input": 80, "pdf": 70, "web": 50, "image": 40, "catalog_sibling": 25, "inferred": 10}
NEVER_INFER = ("sku", "upc", "unspsc_code", "short_desc", "series", "brand")
AUTO_APPROVE, PUBLISH = 0.75, 0.40


def specs(spark: SparkSession, rows: tuple[Spec, ...] = SPECS, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row for each category and key: the category's own specs before common ones. Dozens of rows: metadata."""
    out = []
    for category in categories:
        own = {s.key: s for s in rows if s.scope in ("common", "content")} | {s.key: s for s in rows if s.scope == category}
        out += [(category, s.key, s.label, s.dtype, s.unit, s.family, s.required, s.weight, *(None if x is None else float(x) for x in (s.low, s.high))) for s in own.values()]
    return spark.createDataFrame(out, "category string, key string, label string, dtype string, unit string, family string, required boolean, weight int, low double, high double")


def specs_sql() -> str:
    """The same rows as a common table expression."""
    rows = []
    for category in CATEGORIES:
        own = {s.key: s for s in SPECS if s.scope in ("common", "content")} | {s.key: s for s in SPECS if s.scope == category}
        rows += [f"('{category}', '{s.key}', '{s.label}', '{s.dtype}', '{s.unit}', {str(s.required).lower()}, {s.weight})" for s in own.values()]
    return f"spec(category, key, label, dtype, unit, required, weight) AS (VALUES {', '.join(rows)})"


def ranked_keys(name: str, names: dict[str, str]) -> list[tuple[str, float]]:
    """Keys by the similarity of their closest name, best first."""
    from skuforge.functions.fuzzy import ratio

    best: dict[str, float] = {}
    for x, key in names.items():
        best[key] = max(best.get(key, 0.0), ratio(name, x))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def resolve_names(texts: DataFrame, column: str, fuzzy: float = 84.0, margin: float = 4.0, rows: tuple[Spec, ...] = SPECS) -> DataFrame:
    """column, key and the three closest keys with scores, for the different texts of a column: an exact name of a key, else
    the closest by similarity of at least `fuzzy`, unless another is within `margin` of it; else null. Each different text is
    compared once with the dictionary, which is metadata of bounded size."""
    names: dict[str, str] = {}
    for s in rows:
        for x in (s.key.replace("_", " "), s.label.lower(), *s.aliases):
            names.setdefault(x, s.key)

    @F.pandas_udf("array<struct<key:string,score:double>>")
    def closest(name: pd.Series) -> pd.Series:
        return name.map(lambda x: [{"key": names[x], "score": 100.0}] if x in names else [{"key": k, "score": v} for k, v in ranked_keys(x, names)[:3]])

    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.col(column), "_", " ")), r"\s+", " "))
    each = texts.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().select(column, closest(plain).alias("closest"))
    top, next_ = F.get("closest", F.lit(0)), F.get("closest", F.lit(1))
    sure = (top["score"] >= fuzzy) & (next_.isNull() | (top["score"] - next_["score"] >= margin))
    return each.select(column, F.when(sure, top["key"]).alias("key"), "closest")


def resolve_header(header: str, fuzzy: float = 84.0, margin: float = 4.0, rows: tuple[Spec, ...] = SPECS) -> str | None:
    """The key that a column header means: exact key, label or alias; else the closest by similarity of at least `fuzzy`,
    unless another key is within `margin` of it. Headers are few, so this is plain Python on the driver."""
    name = " ".join(header.strip().lower().replace("_", " ").split())
    names: dict[str, str] = {}
    for s in rows:
        for x in (s.key.replace("_", " "), s.label.lower(), *s.aliases):
            names.setdefault(x, s.key)
    if name in names:
        return names[name]
    ranked = ranked_keys(name, names)
    if not ranked or ranked[0][1] < fuzzy or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < margin):
        return None
    return ranked[0][0]
