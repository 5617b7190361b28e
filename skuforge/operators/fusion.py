"""Candidate fusion: one value out of competing ones, by precedence of the source, confidence and agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.functions.dictionary import PRECEDENCE


def precedence(source: str = "source") -> Column:
    """Rank of a source type; unknown ones are 0. A literal map: no join."""
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in PRECEDENCE.items() for x in (k, v)))[F.col(source)], F.lit(0))


def numbers_agree(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Within the relative tolerance of the larger."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def texts_agree(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def lists_agree(a: Column, b: Column) -> Column:
    norm = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda y: F.lower(F.trim(y)))))
    return norm(a) == norm(b)


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates(record_id, key, seq, value, source, confidence) with precedence and rank: source first, then confidence,
    then the order in which they came, then the value."""
    rows = candidates.withColumn("precedence", precedence())
    over = Window.partitionBy("record_id", "key").orderBy(F.desc("precedence"), F.desc("confidence"), "seq", "value")
    return rows.withColumn("rank", F.row_number().over(over))


def union_of_lists(candidates: DataFrame, value: str = "value") -> DataFrame:
    """record_id, key, items (all distinct parts by first place), bonus (0.06 for each further candidate, 0.15 at most)."""
    one = F.struct("seq", F.col(value).alias("v"))
    g = candidates.groupBy("record_id", "key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    items = F.array_distinct(F.flatten(F.transform("all", lambda x: x["v"])))
    return g.select("record_id", "key", items.alias("items"), F.least(F.lit(15), 6 * (F.size("all") - 1)).alias("bonus_percent"))


def resolve(candidates: DataFrame, agree: Callable[[Column, Column], Column] = numbers_agree, numeric: bool = True) -> DataFrame:
    """One row for each record and key: the value of the best candidate and how sure it is.

    With a = other source types that agree, confidence rises by 0.06 each, 0.15 at most. If the best candidate of another
    value differs: a lead of 20 or more in precedence keeps the top at 0.85 at most (SOURCE_CONFLICT); a ratio near 10, 100
    or 1000 is UNIT_SUSPECT at 0.5 at most (numeric values); else SOURCE_CONFLICT at 0.55 at most. A person's value stands. One shuffle: the
    best candidate comes from a max aggregate, and the rest from one pass over the group's own array of structs.
    """
    rows = candidates.withColumn("precedence", precedence())
    one = F.struct((-F.col("precedence")).alias("p"), (-F.col("confidence")).alias("c"), "seq", "value", "source")
    g = rows.groupBy("record_id", "key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    top = F.get("all", 0)
    g = g.withColumn("top", top)
    same = F.filter("all", lambda x: agree(x["value"], F.col("top.value")))
    others = F.filter("all", lambda x: ~agree(x["value"], F.col("top.value")))
    g = g.withColumn("support", F.size(F.array_distinct(F.filter(F.transform(same, lambda x: x["source"]), lambda s: s != F.col("top.source"))))).withColumn("rival", F.get(others, 0)).withColumn("alternatives", F.size(others))
    a, b = F.abs(F.col("rival.value").try_cast("double")), F.abs(F.col("top.value").try_cast("double"))
    big = F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))
    unit = F.lit(False)
    for scale in (10.0, 100.0, 1000.0) if numeric else ():
        unit = unit | (F.abs(big - scale) <= 0.02 * scale)
    lead = F.col("rival.p") - F.col("top.p")
    base = F.least(F.lit(1.0), -F.col("top.c") + F.least(F.lit(15), F.col("support") * 6) / 100.0)
    issue = F.when(F.col("rival").isNull() | (F.col("top.source") == "human"), "").when(lead >= 20, "SOURCE_CONFLICT_KEPT").when(unit, "UNIT_SUSPECT").otherwise("SOURCE_CONFLICT")
    cap = F.when(issue == "SOURCE_CONFLICT_KEPT", 0.85).when(issue == "UNIT_SUSPECT", 0.5).when(issue == "SOURCE_CONFLICT", 0.55).otherwise(1.0)
    return g.select("record_id", "key", F.col("top.value").alias("value"), F.col("top.source").alias("source"), (F.floor(F.least(base, cap) * 1000 + 0.5) / 1000.0).alias("confidence"), "support", "alternatives", issue.alias("issue"))


def facts(numbers: Column, tolerance: float = 0.02) -> Column:
    """How many facts an array of numbers states: going through them in order, a new one begins wherever a number doesn't agree
    with the one before it. Agreement isn't transitive; by this rule numbers belong together when steps that agree lead from
    one to the other."""
    sorted_ = F.array_sort(F.array_compact(numbers))
    steps = F.zip_with(F.slice(sorted_, 1, F.greatest(F.size(sorted_) - 1, F.lit(0))), F.slice(sorted_, 2, F.greatest(F.size(sorted_) - 1, F.lit(0))), lambda a, b: numbers_agree(a, b, tolerance))
    return F.when(F.size(sorted_) == 0, 0).otherwise(1 + F.size(F.filter(steps, lambda x: ~x)))


def resolve_typed(cells: DataFrame) -> DataFrame:
    """One row for each record and key of cells(record_id, key, seq, source, confidence, method, dtype, canonical, number, unit_out,
    issues), as canonical.canonicalise makes them: value, number, unit, method, source, confidence, support, alternatives,
    facts (different ones stated), issue, codes (what making the kept candidate canonical found).

    Candidates are compared with the best one by the spec's type: numbers in the spec's unit within the tolerance, lists as sets
    without case, anything else as text. Lists are united in the order of candidates, 0.06 surer for each further one, 0.15 at
    most. Otherwise as resolve(); only numbers can be UNIT_SUSPECT. Empty candidates take no part. One shuffle.
    """
    rows = cells.filter(F.coalesce(F.trim("canonical"), F.lit("")) != "").withColumn("precedence", precedence())
    kept = ("canonical", "source", "number", "unit_out", "method", "issues", "dtype")
    one = F.struct((-F.col("precedence")).alias("p"), (-F.col("confidence")).alias("c"), "seq", *kept)
    g = rows.groupBy("record_id", "key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    g = g.withColumn("top", F.get("all", 0))
    items = lambda c: F.array_sort(F.array_distinct(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x)))))

    def agrees(x: Column) -> Column:
        top = F.col("top")
        both = x["number"].isNotNull() & top["number"].isNotNull()
        return F.when(both, numbers_agree(x["number"], top["number"])).when(top["dtype"] == "list", items(x["canonical"]) == items(top["canonical"])).otherwise(texts_agree(x["canonical"], top["canonical"]))

    g = g.withColumn("split", F.struct(F.filter("all", agrees).alias("same"), F.filter("all", lambda x: ~agrees(x)).alias("others")))
    is_list = F.coalesce(F.col("top.dtype") == "list", F.lit(False))
    others, rival = F.when(is_list, F.slice("split.others", 1, 0)).otherwise(F.col("split.others")), F.get("split.others", 0)
    sources = F.array_distinct(F.filter(F.transform("split.same", lambda x: x["source"]), lambda s: s != F.col("top.source")))
    stated = F.when(F.col("top.number").isNotNull(), facts(F.transform("all", lambda x: x["number"]))).otherwise(F.size(F.array_distinct(F.transform("all", lambda x: F.lower(F.trim(x["canonical"]))))))
    g = g.select("record_id", "key", "all", "top", is_list.alias("is_list"), F.size(sources).alias("support"), F.size(others).alias("alternatives"), F.when(~is_list, rival).alias("rival"), stated.alias("facts"))
    a, b = F.abs("rival.number"), F.abs("top.number")
    big = F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))
    unit = F.coalesce((F.abs(big - 10) <= 0.2) | (F.abs(big - 100) <= 2) | (F.abs(big - 1000) <= 20), F.lit(False)) & a.isNotNull() & b.isNotNull()
    bonus = F.least(F.lit(15), F.when(F.col("is_list"), F.size("all") - 1).otherwise(F.col("support")) * 6)
    base = F.least(F.lit(1.0), -F.col("top.c") + bonus / 100.0)
    issue = F.when(F.col("rival").isNull() | (F.col("top.source") == "human"), "").when(F.col("rival.p") - F.col("top.p") >= 20, "SOURCE_CONFLICT_KEPT").when(unit, "UNIT_SUSPECT").otherwise("SOURCE_CONFLICT")
    g = g.withColumn("issue", issue)
    cap = F.when(F.col("issue") == "SOURCE_CONFLICT_KEPT", 0.85).when(F.col("issue") == "UNIT_SUSPECT", 0.5).when(F.col("issue") == "SOURCE_CONFLICT", 0.55).otherwise(1.0)
    parts = F.flatten(F.transform("all", lambda x: F.transform(F.split(x["canonical"], ","), lambda y: F.trim(y))))
    start = F.array().cast("array<string>")
    union = F.array_join(F.aggregate(parts, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))), ", ")
    return g.select(
        "record_id", "key", F.when(F.col("is_list"), union).otherwise(F.col("top.canonical")).alias("value"), F.col("top.number").alias("number"), F.col("top.unit_out").alias("unit"), F.col("top.method").alias("method"), F.col("top.source").alias("source"),
        (F.floor(F.least(base, cap) * 1000 + 0.5) / 1000.0).alias("confidence"), "support", "alternatives", "facts", "issue", F.filter(F.split(F.col("top.issues"), ","), lambda x: x != "").alias("codes"),
    )
