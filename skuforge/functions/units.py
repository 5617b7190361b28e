"""Unit families and quantity parsing. Spellings come from rules (names, plurals, metric prefixes), not from a list of all."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Family: canonical unit and, by factor to it, spellings; names over three letters also have their plural in s.
FAMILIES: dict[str, tuple[str, dict[float, str]]] = {
    "length": ("mm", {1.0: "mm millimeter millimetre", 10.0: "cm centimeter centimetre", 1000.0: "m meter metre", 25.4: "in inch inches \"", 304.8: "ft foot feet '", 0.0254: "mil thou", 0.001: "um micron"}),
    "length_in": ("in", {1.0: "in inch inches \" ''", 12.0: "ft foot feet '", 36.0: "yd yard", 0.0393701: "mm", 0.393701: "cm", 39.3701: "m"}),
    "length_ft": ("ft", {1.0: "ft foot feet '", 0.0833333: "in inch inches \"", 3.0: "yd yard", 3.28084: "m", 0.00328084: "mm"}),
    "mass_lb": ("lb", {1.0: "lb lbs pound #", 0.0625: "oz ounce", 2.20462: "kg", 0.00220462: "g", 2000.0: "ton"}),
    "power_w": ("W", {1.0: "w watt", 1000.0: "kw kilowatt", 745.7: "hp horsepower"}),
    "luminous_flux": ("lm", {1.0: "lm lumen", 1000.0: "klm"}),
    "color_temperature": ("K", {1.0: "k kelvin"}),
    "sound_level": ("dB", {1.0: "db dba decibel"}),
    "volume_cuft": ("cu ft", {1.0: "cuft cu.ft ft3", 0.0005787: "cuin in3", 35.3147: "m3", 0.0353147: "l liter litre", 0.133681: "gal gallon"}),
    "area_sqft": ("sq ft", {1.0: "sqft sf ft2", 100.0: "square", 10.7639: "m2 sqm", 0.00694444: "in2 sqin"}),
    "length_large": ("m", {1.0: "m meter metre", 1000.0: "km kilometer kilometre", 0.01: "cm", 0.001: "mm", 0.3048: "ft foot feet", 1609.344: "mi mile"}),
    "mass": ("kg", {1.0: "kg kilogram", 0.001: "g gram", 1000.0: "t tonne", 0.453592: "lb lbs pound", 0.0283495: "oz ounce"}),
    "power": ("kW", {1.0: "kw kilowatt", 0.001: "w watt", 1000.0: "mw megawatt", 0.7457: "hp horsepower", 0.7355: "ps"}),
    "voltage": ("V", {1.0: "v volt vac vdc", 1000.0: "kv kilovolt", 0.001: "mv millivolt"}),
    "current": ("A", {1.0: "a amp ampere", 0.001: "ma milliamp", 1000.0: "ka kiloamp"}),
    "current_large": ("kA", {1.0: "ka kiloamp", 0.001: "a amp ampere"}),
    "pressure": ("bar", {1.0: "bar", 0.0689476: "psi", 0.01: "kpa", 10.0: "mpa", 0.00001: "pa pascal", 1.01325: "atm", 0.980665: "kgf/cm2"}),
    "speed": ("rpm", {1.0: "rpm r/min rev/min", 60.0: "rps"}),
    "frequency": ("Hz", {1.0: "hz hertz", 1000.0: "khz", 1000000.0: "mhz"}),
    "flow": ("m3/h", {1.0: "m3/h m3/hr cmh", 0.06: "l/min lpm", 3.6: "l/s", 0.227125: "gpm", 1.699: "cfm"}),
    "force": ("kN", {1.0: "kn kilonewton", 0.001: "n newton", 0.00444822: "lbf", 0.00980665: "kgf"}),
    "area": ("mm2", {1.0: "mm2 sqmm", 100.0: "cm2", 645.16: "in2"}),
    "time": ("month", {1.0: "month mo", 12.0: "year yr", 0.25: "week"}),
}
#: Affine: degrees Celsius = (value + shift) * factor.
TEMPERATURE = ("degC", {"c": (0.0, 1.0), "degc": (0.0, 1.0), "°c": (0.0, 1.0), "celsius": (0.0, 1.0), "f": (-32.0, 5 / 9), "degf": (-32.0, 5 / 9), "°f": (-32.0, 5 / 9), "fahrenheit": (-32.0, 5 / 9), "k": (-273.15, 1.0), "kelvin": (-273.15, 1.0)})
#: Diameter of American wire gauge n in inches: 0.005 * 92^((36 - n) / 39).
AWG_SQL = "round(acos(-1.0) / 4.0 * pow(0.127 * pow(92.0, (36 - {n}) / 39.0), 2), 2)"


@functools.cache
def factors() -> tuple[tuple[str, str, float, float, str], ...]:
    """(family, spelling, shift, factor, canonical unit)"""
    out = []
    for family, (canonical, by_factor) in FAMILIES.items():
        for factor, spellings in by_factor.items():
            for s in spellings.split(" "):
                out.append((family, s, 0.0, factor, canonical))
                if len(s) > 3 and s.isalpha() and s not in ("inches", "feet", "foot", "inch", "horsepower", "hertz"):
                    out.append((family, f"{s}s", 0.0, factor, canonical))
    out += [("temperature", s, shift, factor, TEMPERATURE[0]) for s, (shift, factor) in TEMPERATURE[1].items()]
    return tuple(dict(((r[0], r[1]), r) for r in reversed(out)).values())


def unit_table(spark: SparkSession) -> DataFrame:
    """Some hundred rows of metadata, the same whatever the data: small enough to broadcast."""
    return spark.createDataFrame(list(factors()), "family string, unit string, shift double, factor double, canonical string")


def unit_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({text(a)}, {text(b)}, CAST({c!r} AS DOUBLE), CAST({d!r} AS DOUBLE), {text(e)})" for a, b, c, d, e in factors())
    return f"units(family, unit, shift, factor, canonical) AS (VALUES {rows})"


def convert(quantities: DataFrame, value: str = "value", unit: str = "unit", family: str = "family") -> DataFrame:
    """quantities with canonical, converted and known: a missing unit is taken as canonical, an unknown one leaves the value."""
    units = F.broadcast(unit_table(quantities.sparkSession)).alias("u")
    q = quantities.alias("q")
    joined = q.join(units, (F.col(f"q.{family}") == F.col("u.family")) & (F.lower(F.trim(F.col(f"q.{unit}"))) == F.col("u.unit")), "left")
    blank = F.coalesce(F.trim(F.col(f"q.{unit}")), F.lit("")) == ""
    known = F.col("u.unit").isNotNull() | blank
    out = F.when(F.col("u.unit").isNotNull(), (F.col(f"q.{value}") + F.col("u.shift")) * F.col("u.factor")).otherwise(F.col(f"q.{value}"))
    return joined.select("q.*", F.col("u.canonical").alias("canonical"), F.round(out, 4).alias("converted"), known.alias("known"))


def expand_fraction(c: Column) -> Column:
    """The first mixed (2-3/4) or simple (1/2) fraction of a text as a decimal; a zero denominator stays as it is."""
    p = r"(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)"
    whole, top, bottom = (F.coalesce(F.nullif(F.regexp_extract(c, p, i), F.lit("")).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3))
    x = whole + top / F.nullif(bottom, F.lit(0.0))
    text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_number(x, 6), "0+$", ""))
    return F.when(c.rlike(p) & (bottom != 0), F.regexp_replace(c, F.regexp_replace(F.regexp_extract(c, p, 0), r"([.\-/])", r"\\$1"), F.regexp_replace(text, ",", ""))).otherwise(c)


def parse_quantity(c: Column) -> Column:
    """struct(low, high, value, unit) of `number [unit]` or a range `a - b unit`, `a to b unit`, `a..b unit`; value is the midpoint."""
    n = r"([+-]?[0-9]+(?:\.[0-9]+)?)"
    rng = rf"^\s*{n}\s*(?:\.\.+|to|–|-|~)\s*{n}\s*([^0-9\s]\S*)?"
    one = rf"^\s*{n}\s*([^0-9\s]\S*)?"
    g = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    is_range = c.rlike(rng)
    low = F.when(is_range, g(rng, 1)).otherwise(g(one, 1)).try_cast("double")
    high = F.when(is_range, g(rng, 2)).otherwise(g(one, 1)).try_cast("double")
    unit = F.lower(F.when(is_range, g(rng, 3)).otherwise(g(one, 2)))
    return F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("value"), F.coalesce(unit, F.lit("")).alias("unit"))


def awg_area(c: Column) -> Column:
    """Cross-section in mm2 of the wire gauge that a text names, from the gauge's definition; null without one."""
    n = F.nullif(F.regexp_extract(c, r"(?i)\b([0-9]{1,2})\s*AWG|AWG[\s-]*([0-9]{1,2})\b", 1), F.lit(""))
    m = F.nullif(F.regexp_extract(c, r"(?i)\b([0-9]{1,2})\s*AWG|AWG[\s-]*([0-9]{1,2})\b", 2), F.lit(""))
    gauge = F.coalesce(n, m).try_cast("int")
    return F.round(F.lit(3.141592653589793) / 4.0 * F.pow(F.lit(0.127) * F.pow(F.lit(92.0), (36 - gauge) / 39.0), 2), 2)
