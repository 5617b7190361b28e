"""Cross-field rules over a wide record, as null-safe expressions. A rule fires where its condition is true; a condition
with a missing value is null and doesn't. Conditions are SQL that any engine reads, so users can register their own."""

from __future__ import annotations

import dataclasses
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.sources.tables import growing, has_key, keys_of


@dataclasses.dataclass(frozen=True)
class Rule:
    name: str
    code: str
    severity: str
    category: str
    condition: str


RULES = (
    Rule("temperature_order", "TEMP_RANGE_INVERTED", "error", "*", "temp_min > temp_max"),
    Rule("dimension_ratio", "DIMENSION_RATIO_EXTREME", "warning", "*", "greatest(length_mm, width_mm, height_mm) / nullif(least(length_mm, width_mm, height_mm), 0) > 500"),
    Rule("density_high", "IMPLAUSIBLE_DENSITY", "warning", "*", "weight_kg / nullif(length_mm * width_mm * height_mm / 1000000000, 0) > 20000"),
    Rule("density_low", "IMPLAUSIBLE_DENSITY", "info", "*", "weight_kg / nullif(length_mm * width_mm * height_mm / 1000000000, 0) < 20"),
    Rule("motor_power_far", "MOTOR_POWER_MISMATCH", "error", "electric_motor", "power_kw > 0 AND NOT (volts * amps * power_factor * phase_factor * 9 / 10000 / power_kw BETWEEN 0.4 AND 2.5)"),
    Rule("motor_power", "MOTOR_POWER_MISMATCH", "warning", "electric_motor", "power_kw > 0 AND volts * amps * power_factor * phase_factor * 9 / 10000 / power_kw BETWEEN 0.4 AND 2.5 AND NOT (volts * amps * power_factor * phase_factor * 9 / 10000 / power_kw BETWEEN 0.65 AND 1.5)"),
    Rule("motor_speed", "SPEED_FREQUENCY_MISMATCH", "warning", "electric_motor", "rpm > 0 AND NOT (1 - rpm / (120 * hertz / poles) BETWEEN -0.02 AND 0.12)"),
    Rule("power_factor_percent", "POWER_FACTOR_AS_PERCENT", "warning", "electric_motor", "power_factor_raw BETWEEN 50 AND 100"),
    Rule("power_factor", "POWER_FACTOR_INVALID", "error", "electric_motor", "NOT (power_factor_raw BETWEEN 0.5 AND 1) AND NOT (power_factor_raw BETWEEN 50 AND 100)"),
    Rule("bearing_bore", "BEARING_BORE_TOO_LARGE", "error", "ball_bearing", "bore_mm >= outer_mm"),
    Rule("bearing_wall", "BEARING_WALL_TOO_THIN", "warning", "ball_bearing", "bore_mm < outer_mm AND (outer_mm - bore_mm) / 2 < 1.5"),
    Rule("bearing_width", "BEARING_WIDTH_EXCEEDS_OD", "error", "ball_bearing", "width_mm > outer_mm"),
    Rule("bearing_loads", "BEARING_LOAD_RATINGS_SUSPECT", "warning", "ball_bearing", "static_kn > dynamic_kn * 1.6"),
    Rule("bearing_speed", "BEARING_SPEED_IMPLAUSIBLE", "warning", "ball_bearing", "rpm * (bore_mm + outer_mm) / 2 > 1200000"),
    Rule("cable_ampacity", "CABLE_AMPACITY_IMPLAUSIBLE", "warning", "power_cable", "amps > area_mm2 * 8 * 1.3 * (CASE WHEN conductor = 'aluminium' THEN 0.78 ELSE 1 END)"),
    Rule("cable_diameter", "CABLE_DIAMETER_TOO_SMALL", "warning", "power_cable", "outer_mm < 0.85 * (2 * sqrt(area_mm2 * cores / 3.141592653589793) * 1.4 + 2)"),
    Rule("pump_power_low", "PUMP_POWER_TOO_LOW", "error", "centrifugal_pump", "power_kw > 0 AND 9.81 * flow_m3h * head_m / 3600 / power_kw > 0.92"),
    Rule("pump_power_high", "PUMP_POWER_OVERSIZED", "warning", "centrifugal_pump", "power_kw > 0 AND 9.81 * flow_m3h * head_m / 3600 / power_kw < 0.10"),
    Rule("pump_ports", "PUMP_PORTS_SUSPECT", "info", "centrifugal_pump", "inlet_mm < outlet_mm"),
    Rule("breaker_capacity", "BREAKING_CAPACITY_TOO_LOW", "error", "circuit_breaker", "breaking_ka * 1000 <= amps"),
    Rule("breaker_class", "MCB_RATING_OUT_OF_CLASS", "warning", "circuit_breaker", "breaker_type = 'MCB' AND amps > 125"),
    Rule("valve_rating", "VALVE_RATING_IMPLAUSIBLE", "warning", "industrial_valve", "dn_mm >= 300 AND bar > 250"),
    Rule("sensor_range", "SENSOR_RANGE_IMPLAUSIBLE", "warning", "proximity_sensor", "sensor_type = 'inductive' AND range_mm > barrel_mm * 1.2"),
)


#: Columns of the rules that hold text; the others hold numbers.
TEXTS = ("conductor", "breaker_type", "sensor_type")
_NOT_COLUMNS = {"greatest", "least", "nullif", "sqrt"}


def columns(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The columns that the rules' conditions read."""
    bare = (re.sub(r"'[^']*'", "", r.condition) for r in rules)
    return sorted({x for c in bare for x in re.findall(r"\b[a-z][a-z0-9_]*\b", c)} - _NOT_COLUMNS)


def wide(categories: DataFrame, fields: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """record_id, category and a column for each that the rules read, from cells of that key (null where there is none).

    power_factor_raw is the factor as given, power_factor as a share; phase_factor comes from the cell `phases`.
    """
    cell = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    number = lambda k: cell(k).try_cast("double")
    made = {
        "power_factor_raw": number("power_factor"),
        "power_factor": F.when(number("power_factor") > 1, number("power_factor") / 100).otherwise(number("power_factor")),
        "phase_factor": F.when(number("phases") == 3, 3**0.5).when(number("phases") == 1, 1.0),
    }
    cells = [made.get(c, cell(c) if c in TEXTS else number(c)).alias(c) for c in columns(rules)]
    return categories.select("record_id", "category").join(growing(fields.groupBy("record_id").agg(*cells)), "record_id", "left")


def _fails(records: DataFrame, rule: Rule) -> bool:
    try:
        return records.select(F.expr(rule.condition)).schema is None
    except AnalysisException:
        return True


def run_rules(records: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "record_id") -> DataFrame:
    """id_col, code, severity, rule for every rule that fires on records(category, ...). One narrow pass: no shuffle.

    A rule that can't be read, or reads a column that isn't there, doesn't end the others: it is RULE_ERROR (info) for each
    record of its category.
    """
    broken = {r for r in rules if _fails(records, r)}
    rules = tuple(dataclasses.replace(r, code="RULE_ERROR", severity="info", condition="true") if r in broken else r for r in rules)
    fired = [
        F.when((F.lit(r.category == "*") | (F.col("category") == r.category)) & F.coalesce(F.expr(f"try_cast(({r.condition}) AS boolean)"), F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule")))
        for r in rules
    ]
    return records.select(id_col, F.inline(F.array_compact(F.array(*fired))))


def rules_sql(table: str, rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL over a table or common table expression."""
    parts = []
    for r in rules:
        where = f"({r.condition})" if r.category == "*" else f"category = '{r.category}' AND ({r.condition})"
        parts.append(f"SELECT record_id, '{r.code}' AS code, '{r.severity}' AS severity, '{r.name}' AS rule FROM {table} WHERE {where}")
    return " UNION ALL ".join(parts)


def missing_required(categories: DataFrame, fields: DataFrame, specs: DataFrame) -> DataFrame:
    """record_id and key of required cells that aren't there (MISSING_REQUIRED errors)."""
    have = keys_of(fields.filter("value is not null and value <> ''"))
    known = categories.select("record_id", "category").join(growing(have), "record_id", "left")
    wanted = known.join(F.broadcast(specs.filter("required").select("category", "key")), "category")
    return wanted.filter(~has_key("key")).select("record_id", "key")


def attach(issues: DataFrame, fields: DataFrame) -> DataFrame:
    """issues(record_id, key, code) with attached: field where that cell exists, else record."""
    return issues.join(growing(keys_of(fields)), "record_id", "left").withColumn("attached", F.when(has_key("key"), "field").otherwise("record")).drop("keys")


def replace_issues(old: DataFrame, new: DataFrame, producer: str) -> DataFrame:
    """old issues without those raised by the producer, and the new ones."""
    return old.filter(F.col("raised_by") != producer).unionByName(new)


def adjust_confidence(current: str, suggested: str, most_up: float = 0.05):
    """A judge's confidence: lower as it says, higher by no more than most_up, within 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(suggested), F.col(current) + most_up))
