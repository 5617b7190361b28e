"""Texts that are alike up to a few edits, by an inverted index of their 2-grams; all in expressions and joins.

The score of two texts is 100 * (1 - edits / length of the longer). With at most d edits, texts of n and m characters share
max(n, m) + 1 - 2 d of their 2-grams (ends padded, repeated ones numbered). So of each text's 2-grams, in one order from the rarest
on, the first 1 + floor(2 (1 - floor / 100) n) are enough: two texts that reach the floor have one of those in common. Pairs that
meet there, and whose lengths allow it, are verified by their edit distance. Equal texts are one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a match of texts with their words in alphabetical order counts beside one of the texts as they are.
SORTED = 0.95


def plain(c: Column) -> Column:
    """Lower case, whatever isn't a letter or digit as a space, one space at a time, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _grams(texts: DataFrame) -> DataFrame:
    """(text, n, gram) of texts(text); a gram that a text has before has a number behind it."""
    chars = F.split(F.concat(F.lit("\x02"), F.col("text"), F.lit("\x03")), "")
    pairs = F.transform(F.sequence(F.lit(0), F.length("text")), lambda i: F.concat(F.get(F.col("chars"), i), F.get(F.col("chars"), i + 1)))
    each = texts.withColumn("chars", chars).select("text", F.length("text").alias("n"), F.posexplode(pairs).alias("i", "gram"))
    nth = F.row_number().over(Window.partitionBy("text", "gram").orderBy("i"))
    return each.select("text", "n", F.concat("gram", nth.cast("string")).alias("gram"))


def similar_texts(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, score) for the different texts a of left(text) and b of right(text) whose score is floor or more, equal ones too.
    floor: over 50. Null and empty texts are like nothing."""
    if not 50 < floor <= 100:
        raise ValueError("the floor of similar texts lies over 50, at 100 at most")
    share = 1 - floor / 100
    tidy = lambda x: x.select("text").filter(F.length("text") > 0).distinct()
    a, b = _grams(tidy(left)), _grams(tidy(right))
    common = a.select("gram").unionByName(b.select("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("text").orderBy("df", "gram")

    def rarest(grams: DataFrame) -> DataFrame:
        return grams.join(common, "gram").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 1 + F.floor(2 * share * F.col("n") + 1e-9)).select("text", "n", "gram")

    x, y = rarest(a).withColumnsRenamed({"text": "a", "n": "an"}), rarest(b).withColumnsRenamed({"text": "b", "n": "bn"})
    longer = F.greatest("an", "bn")
    met = x.join(y, "gram").filter(F.abs(F.col("an") - F.col("bn")) <= share * longer + 1e-9).select("a", "b", longer.alias("longer")).distinct()
    score = F.round(100.0 * (1 - F.levenshtein("a", "b") / F.col("longer")), 4)
    return met.select("a", "b", score.alias("score")).filter(F.col("score") >= floor)


def similar_names(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, score) as similar_texts(), where texts with their words in alphabetical order count too, at SORTED of the score."""
    direct = similar_texts(left, right, floor)
    if floor / SORTED > 100:
        return direct
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    forms = [x.select("text").distinct().select("text", ordered(F.col("text")).alias("form")) for x in (left, right)]
    alike = similar_texts(*(f.select(F.col("form").alias("text")) for f in forms), floor / SORTED).withColumnsRenamed({"a": "fa", "b": "fb"})
    turned = alike.join(forms[0].withColumnsRenamed({"text": "a", "form": "fa"}), "fa").join(forms[1].withColumnsRenamed({"text": "b", "form": "fb"}), "fb")
    turned = turned.select("a", "b", F.round(F.col("score") * SORTED, 4).alias("score")).filter(F.col("score") >= floor)
    return direct.unionByName(turned).groupBy("a", "b").agg(F.max("score").alias("score"))


def resolve_aliases(texts: DataFrame, column: str, aliases: DataFrame, floor: float = 84.0, margin: float = 4.0, k: int = 3) -> DataFrame:
    """column, key, score, closest for each different text of the column: the key of an alias that it equals (score 100), else of
    the most similar one of those that reach the floor, unless one of the k most similar has another key and is within the
    margin of it; then, as without any, key and score are null.

    aliases(alias, key): the smallest key counts where an alias has several. closest: the k most similar aliases as (alias, key,
    score), ties in the alphabet's order. Texts and aliases are compared as plain() makes them. Nulls are left out."""
    known = aliases.select(plain(F.col("alias")).alias("b"), "key").filter(F.length("b") > 0).groupBy("b").agg(F.min("key").alias("key"))
    given = texts.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().withColumn("a", plain(F.col(column)))
    scored = similar_names(given.select(F.col("a").alias("text")), known.select(F.col("b").alias("text")), floor).join(known, "b")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    top = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    closest = F.transform(F.array_sort(F.collect_list(F.struct("r", "b", "key", "score"))), lambda x: F.struct(x["b"].alias("alias"), x["key"].alias("key"), x["score"].alias("score")))
    top = top.groupBy("a").agg(closest.alias("closest"))
    first = F.get("closest", F.lit(0))
    rival = F.exists("closest", lambda x: (x["key"] != first["key"]) & (first["score"] - x["score"] < margin))
    sure = (first["score"] == 100) & (first["alias"] == F.col("a")) | ~rival
    none = F.array().cast(top.schema["closest"].dataType)
    found = given.join(top, "a", "left")
    return found.select(column, F.when(sure, first["key"]).alias("key"), F.when(sure, first["score"]).alias("score"), F.coalesce("closest", none).alias("closest"))
