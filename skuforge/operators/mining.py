"""Attribute mining from descriptions: every miner is an expression that gives candidates, without UDFs or shuffles.

A candidate is struct(key, value, unit, method, confidence, stage); miners of earlier stages win for the same key.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = "array<struct<key:string,value:string,unit:string,method:string,confidence:double,stage:int>>"

#: Named patterns: key and expression with the value in group 1.
NAMED = {
    "ip_rating": r"(?i)\b(IP[0-9]{2}[A-Z]?)\b",
    "unspsc_code": r"(?i)\bUNSPSC[: ]*([0-9]{8})\b",
    "upc": r"(?i)\bUPC[: ]*([0-9]{12})\b",
    "efficiency_class": r"\b(IE[1-5])\b",
    "insulation_class": r"(?i)\b(?:insulation )?class ([BFH])\b",
    "trip_curve": r"(?i)\b([BCDKZ])[- ]curve\b",
    "bulb_shape": r"\b((?:A|BR|PAR|MR|G|T)[0-9]{1,2})\b",
    "mortar_type": r"(?i)\btype ([MNSO]) mortar\b",
    "board_type": r"(?i)\b(type X|moisture resistant|fire rated)\b",
}
CERTIFICATIONS = r"(?i)\b(UL|CE|CSA|RoHS|ETL|FCC|NSF|ISO ?9001|REACH|ATEX|FM)\b"


@dataclasses.dataclass(frozen=True)
class Decoder:
    key: str
    pattern: str
    unit: str = ""
    scale: float | None = None
    constant: str | None = None
    low: float | None = None
    high: float | None = None


#: Shorthand of the trade: value in group 1, times scale; constant where the pattern itself says the value.
SHORTHAND = (
    Decoder("grit", r"(?i)\bP([0-9]{2,4})\b", low=12, high=5000),
    Decoder("color_temperature", r"(?i)\b([2-6][0-9])k\b", "K", 100, low=1800, high=7000),
    Decoder("wattage", r"(?i)(?<!max )\b([0-9]+(?:\.[0-9]+)?) ?w(?:att)?s?\b", "W", 1, low=0.1, high=5000),
    Decoder("max_wattage", r"(?i)max ([0-9]+) ?w\b", "W", 1),
    Decoder("battery_voltage", r"(?i)\b(12|18|20|24|36|40|60|80) ?v(?: max)?\b", "V", 1),
    Decoder("capacity_ah", r"(?i)\b([0-9]+(?:\.[0-9])?) ?ah\b", "Ah", 1),
    Decoder("gauge", r"(?i)\b([0-9]{1,2}) ?ga\b", "ga", 1, low=1, high=40),
    Decoder("pack_quantity", r"(?i)\b([0-9]+) ?(?:pc|pcs|pk|ct|disc|discs|pack)\b(?:/(?:box|pk|pack))?", "", 1, low=1, high=10000),
    Decoder("selling_uom", r"(?i)\b(?:pc|pcs|disc|discs|ct)/(box|pack|case|roll)\b"),
    Decoder("light_count", r"(?i)\b([0-9]{1,3})[- ]light\b", "", 1),
    Decoder("apparel_size", r"\b(XS|S|M|L|XL|XXL|2XL|3XL)\b(?= (?:glove|jacket|vest|shirt))"),
    Decoder("tooth_count", r"(?i)\b([0-9]{2,3}) ?(?:t|tooth|teeth)\b", "", 1, low=4, high=400),
    Decoder("attachment", r"(?i)\b(hook (?:and|&) loop|psa|quick change)\b"),
    Decoder("brushless", r"(?i)\bbrushless\b", constant="true"),
    Decoder("battery_included", r"(?i)\b(?:kit|battery included)\b", constant="true"),
    Decoder("heated", r"(?i)\bheated\b", constant="true"),
    Decoder("energy_star", r"(?i)\benergy ?star\b", constant="true"),
    Decoder("fuel", r"(?i)\b(natural gas|propane|electric|dual fuel)\b"),
    Decoder("edge_profile", r"(?i)\b(square edge|tapered edge|grooved|beveled)\b"),
    Decoder("abrasive_form", r"(?i)\b(disc|belt|sheet|roll|sponge)s?\b"),
    Decoder("max_rpm", r"(?i)\b([0-9]{3,5}) ?rpm\b", "rpm", 1),
)
COLORS = {"blk": "Black", "wht": "White", "gry": "Gray", "brn": "Brown", "red": "Red", "blu": "Blue", "grn": "Green", "ylw": "Yellow", "org": "Orange", "slv": "Silver", "brz": "Bronze", "ss": "Stainless Steel"}
LAMP_BASES = {"med": "E26", "cand": "E12", "mog": "E39"}
SHAPE_BASES = {"A": "E26", "BR": "E26", "PAR": "E26", "G": "E26", "MR": "GU10", "T": "G13"}
ROUND = r"(?i)\b(disc|wheel|blade|cut-?off)\b"


def _candidate(key: Column | str, value: Column, unit: str, method: str, confidence: float, stage: int) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(value.isNotNull(), F.struct(key.alias("key"), value.cast("string").alias("value"), F.lit(unit).alias("unit"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(stage).alias("stage")))


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def tidy(x: Column) -> Column:
    """A double as text, whole numbers without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def named(text: Column) -> list[Column]:
    return [_candidate(k, _group(text, p), "", "regex", 0.92, 0) for k, p in NAMED.items()]


def certifications(text: Column) -> Column:
    """Every mark once, upper-case, sorted; null without any."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CERTIFICATIONS), F.lit(1)), lambda x: F.upper(x))))
    return F.nullif(F.array_join(found, ", "), F.lit(""))


def decode(text: Column, d: Decoder) -> Column:
    """The decoder's value, or null where it isn't there or out of bounds."""
    if d.constant is not None:
        return F.when(text.rlike(d.pattern), d.constant)
    raw = _group(text, d.pattern)
    if d.scale is None and d.low is None:
        return F.lower(raw)
    x = raw.try_cast("double") * (d.scale or 1)
    ok = F.lit(True)
    if d.low is not None:
        ok = ok & (x >= d.low)
    if d.high is not None:
        ok = ok & (x <= d.high)
    return F.when(ok, tidy(x))


def color(text: Column) -> Column:
    token = F.lower(_group(text, rf"(?i)\b({'|'.join(COLORS)})\b"))
    return F.create_map(*(F.lit(x) for k, v in COLORS.items() for x in (k, v)))[token]


def lamp_base(text: Column) -> Column:
    """From its own token, else from the bulb's shape."""
    token = F.lower(_group(text, r"(?i)\b(med|cand|mog)(?:ium|elabra|ul)?\b(?: base)?"))
    shape = _group(text, r"\b(A|BR|PAR|MR|G|T)[0-9]{1,2}\b")
    lookup = lambda m, k: F.create_map(*(F.lit(x) for a, b in m.items() for x in (a, b)))[k]
    return F.coalesce(lookup(LAMP_BASES, token), lookup(SHAPE_BASES, shape))


_N = r"((?:[0-9]+[- ])?[0-9]+/[0-9]+|[0-9]*\.?[0-9]+)"
_MARK = r"\s*(\"|''|in\b|'|mm\b)?"


def measure(text: Column, mark: Column, unit: str) -> Column:
    """A number, fraction or mixed fraction with its mark, in inches or feet; without a mark as it stands."""
    p = r"^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$"
    whole, top, bottom = (_group(text, p, i).try_cast("double") for i in (1, 2, 3))
    x = F.coalesce(F.when(text.rlike(p), F.coalesce(whole, F.lit(0.0)) + top / F.nullif(bottom, F.lit(0.0))), text.try_cast("double"))
    inches = F.when(mark == "'", x * 12).when(mark == "mm", x / 25.4).otherwise(x)
    feet = F.when(mark.isin('"', "''", "in"), x / 12).when(mark == "mm", x / 304.8).otherwise(x)
    return inches if unit == "in" else feet


def dimensions(text: Column) -> Column:
    """map of keys to numbers: AxBxC as length, width, height (round: diameter, thickness, bore); board stock AxB-L' as
    thickness, width, length in feet; AxB as width and length (round: diameter, thickness); a lone inch measure as diameter."""
    triple, board, pair = rf"{_N}{_MARK}\s*[xX]\s*{_N}{_MARK}\s*[xX]\s*{_N}{_MARK}", rf"\b([0-9]+(?:/[0-9]+)?)x([0-9]+)-([0-9]+)'", rf"{_N}{_MARK}\s*[xX]\s*{_N}{_MARK}"
    lone = rf"(?:^|\s){_N}\s*(\"|''|in\b)"
    g = lambda p, i, u="in": measure(_group(text, p, i), F.coalesce(_group(text, p, i + 1), F.lit("")), u)
    round_ = text.rlike(ROUND)
    num = lambda p, i: measure(_group(text, p, i), F.lit(""), "in")
    three = F.when(round_, F.create_map(F.lit("diameter"), g(triple, 1), F.lit("thickness"), g(triple, 3), F.lit("bore"), g(triple, 5))).otherwise(F.create_map(F.lit("length"), g(triple, 1), F.lit("width"), g(triple, 3), F.lit("height"), g(triple, 5)))
    plank = F.create_map(F.lit("thickness"), num(board, 1), F.lit("width"), num(board, 2), F.lit("length_ft"), num(board, 3))
    two = F.when(round_, F.create_map(F.lit("diameter"), g(pair, 1), F.lit("thickness"), g(pair, 3))).otherwise(F.create_map(F.lit("width"), g(pair, 1), F.lit("length"), g(pair, 3)))
    return F.when(text.rlike(triple), three).when(text.rlike(board), plank).when(text.rlike(pair), two).when(text.rlike(lone), F.create_map(F.lit("diameter"), g(lone, 1)))


def labelled_quantity(text: Column, label: str, units: str) -> Column:
    """`label ... number unit` with up to 20 characters without digits between, or `number unit label`; null otherwise."""
    first, second = rf"(?i)\b{label}\b[^0-9]{{0,20}}([0-9]+(?:\.[0-9]+)?)\s*(?:{units})\b", rf"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:{units})\s+{label}\b"
    return F.coalesce(_group(text, first), _group(text, second)).try_cast("double")


def temperature_range(text: Column) -> Column:
    """struct(low, high) of a range with a word or sign of temperature within 40 characters of it."""
    p = r"(?s)([+-]?[0-9]+(?:\.[0-9]+)?)\s*(?:°?\s*[CF]?\s*)(?:to|\.\.+|–|~)\s*([+-]?[0-9]+(?:\.[0-9]+)?)"
    near = rf"(?is)(?:temp|°|deg|operating).{{0,40}}{p}|{p}.{{0,40}}(?:temp|°|deg|celsius)"
    ok = text.rlike(near)
    return F.struct(F.when(ok, _group(text, p, 1)).try_cast("double").alias("low"), F.when(ok, _group(text, p, 2)).try_cast("double").alias("high"))


def mine(rows: DataFrame, id_col: str, text_col: str, least_chars: int = 20) -> DataFrame:
    """id_col, key, value, unit, method, confidence, stage: the first stage's candidate for each key of each row.

    Named patterns come before shorthand, then dimensions. Texts under least_chars give nothing. Candidates of a row are
    settled within the row's own array, so there is no shuffle.
    """
    t = F.col(text_col)
    sizes = F.coalesce(F.transform(F.map_entries(dimensions(t)), lambda e: F.struct(e["key"].alias("key"), tidy(e["value"]).alias("value"), F.lit("in").alias("unit"), F.lit("regex").alias("method"), F.lit(0.82).alias("confidence"), F.lit(2).alias("stage"))), F.array().cast(CANDIDATE))
    single = [*named(t), _candidate("certifications", certifications(t), "", "regex", 0.85, 0), *(_candidate(d.key, decode(t, d), d.unit, "regex", 0.88, 1) for d in SHORTHAND), _candidate("color", color(t), "", "regex", 0.80, 1), _candidate("lamp_base", lamp_base(t), "", "regex", 0.80, 1)]
    every = F.concat(F.array_compact(F.array(*single)), F.filter(sizes, lambda c: c["value"].isNotNull()))
    rows = rows.filter(F.length(t) >= least_chars).select(id_col, every.alias("all"))
    first = F.filter("all", lambda c: ~F.exists("all", lambda d: (d["key"] == c["key"]) & (d["stage"] < c["stage"])))
    return rows.select(id_col, F.inline(first))


def unique_units(specs: DataFrame) -> DataFrame:
    """category, unit, key of units that one key of the category alone has."""
    g = specs.filter("unit <> ''").groupBy("category", "unit").agg(F.countDistinct("key").alias("n"), F.min("key").alias("key"))
    return g.filter("n = 1").select("category", "unit", "key")
