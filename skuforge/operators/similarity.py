"""TF-IDF similarity and peers by series, as joins on terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuforge.sources.tables import growing, save


def tokens(text):
    """Lower-case words, which may hold . - / within, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_#][a-z0-9_#.\-/]*"), F.lit(0))
    return words


def weights(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, term, weight of 1- and 2-grams: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document at unit length."""
    w = docs.select(id_col, tokens(F.col(text_col)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = w.select(id_col, F.explode(F.concat("w", pairs)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n))
    x = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = raw.select(id_col, "term", x.alias("x"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("x") / F.col("norm")).alias("weight"))


def top_similar(w: DataFrame, id_col: str, group: DataFrame | None = None, k: int = 5, least: float = 0.12, digits: int = 6) -> DataFrame:
    """id_col, other, score, rank: the k most similar documents of the same group (group: id_col, category).

    Products of weights meet on (category, term); sums go through a partial aggregate. Similarities are rounded, ties go to
    the smaller id. A term of a whole category is a skewed key, which adaptive execution splits.
    """
    w = w if group is None else w.join(group, id_col)
    on = ["term"] if group is None else ["term", "category"]
    other = w.select(*on, F.col(id_col).alias("other"), F.col("weight").alias("other_weight"))
    pairs = w.join(other, on).filter(F.col(id_col) != F.col("other")).groupBy(id_col, "other").agg(F.round(F.sum(F.col("weight") * F.col("other_weight")), digits).alias("score"))
    over = Window.partitionBy(id_col).orderBy(F.desc("score"), "other")
    return pairs.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _heads(docs: DataFrame, id_col: str, text_col: str, group: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, text, category), and for each text of a group head, its smallest id, and ids, its k + 1 smallest."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(group).alias("category"))
    heads = rows.withColumn("r", F.row_number().over(Window.partitionBy("category", "text").orderBy("id"))).filter(F.col("r") <= k + 1)
    return rows, heads.groupBy("category", "text").agg(F.min("id").alias("head"), F.array_sort(F.collect_list("id")).alias("ids"))


def _each_copy(pairs: DataFrame, rows: DataFrame, ids: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best of each row, from pairs(id, other, score) of heads, each with itself among them."""
    pairs = pairs.join(ids.select(F.col("head").alias("other"), "ids"), "other").select("id", "score", F.explode("ids").alias("other"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("r") <= k + 1)
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "other", "score"))).alias("best")).withColumnRenamed("id", "head")
    each = rows.join(ids.select("category", "text", "head"), rows["category"].eqNullSafe(ids["category"]) & rows["text"].eqNullSafe(ids["text"])).select("id", "head").join(best, "head")
    rest = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(rest).alias("at", "x")).select(F.col("id").alias(id_col), "x.other", "x.score", (F.col("at") + 1).alias("rank"))


def top_similar_copies(docs: DataFrame, id_col: str, text_col: str, group: str, k: int = 5, least: float = 0.12, digits: int = 6) -> DataFrame:
    """What top_similar() gives for docs(id_col, text_col, group), with equal texts of a group as one: only different texts
    meet, and each stands for its k + 1 smallest ids. Weights are those of all documents."""
    rows, ids = _heads(docs, id_col, text_col, group, k)
    w = weights(rows, "id", "text").join(ids.select(F.col("head").alias("id"), "category"), "id")
    other = w.select("term", "category", F.col("id").alias("other"), F.col("weight").alias("other_weight"))
    pairs = w.join(other, ["term", "category"]).groupBy("id", "other").agg(F.round(F.sum(F.col("weight") * F.col("other_weight")), digits).alias("score")).filter(F.col("score") >= least)
    return _each_copy(pairs, rows, ids, id_col, k)


# ---- top-k by bounds of weights ------------------------------------------------------------------------------------------


def bounded_vectors(w: DataFrame) -> DataFrame:
    """w(category, id, term, weight) without terms of a single document of a category, and for each term n, its documents there,
    rare, its place among the document's terms from the rarest on, and reach, the most that this term and the document's more
    frequent ones can add to any similarity: sums of the weight times the term's largest weight in the category."""
    stats = w.groupBy("category", "term").agg(F.count("*").alias("n"), F.max("weight").alias("top")).filter("n > 1")
    shared = w.join(stats, ["category", "term"])
    frequent = Window.partitionBy("id").orderBy(F.desc("n"), "term")
    reach = F.sum(F.col("weight") * F.col("top")).over(frequent.rowsBetween(Window.unboundedPreceding, 0))
    rare = F.count("*").over(Window.partitionBy("id")) - F.row_number().over(frequent) + 1
    return shared.select("category", "id", "term", "weight", "n", reach.alias("reach"), rare.cast("int").alias("rare"))


def exact_scores(pairs: DataFrame, vectors: DataFrame, digits: int) -> DataFrame:
    """(id, other, score) of pairs(id, other)."""
    mine = pairs.select("id", "other").join(vectors.select("id", "term", "weight"), "id")
    theirs = vectors.select(F.col("id").alias("other"), "term", F.col("weight").alias("other_weight"))
    return mine.join(theirs, ["other", "term"]).groupBy("id", "other").agg(F.round(F.sum(F.col("weight") * F.col("other_weight")), digits).alias("score"))


def first_limits(vectors: DataFrame, k: int, digits: int, probes: int = 4, depth: int = 32) -> DataFrame:
    """(id, limit): a score that k others reach, from the `depth` heaviest documents of each one's `probes` rarest terms. Only a
    start: documents without k such others have no row, and nothing is left out of the search because of it."""
    heaviest = Window.partitionBy("category", "term").orderBy(F.desc("weight"), "id")
    heavy = vectors.withColumn("r", F.row_number().over(heaviest)).filter(F.col("r") <= depth).select("category", "term", F.col("id").alias("other"))
    tried = vectors.filter(F.col("rare") <= probes).join(heavy, ["category", "term"]).filter("id <> other").select("id", "other").distinct()
    best = exact_scores(tried, vectors, digits).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"))))
    return best.filter(F.col("r") <= k).groupBy("id").agg(F.count("*").alias("c"), F.min("score").alias("limit")).filter(F.col("c") == k).select("id", "limit")


def meetings(vectors: DataFrame, limits: DataFrame, least: float, slack: float) -> DataFrame:
    """A row for each term over which two documents meet: id, other, part (product of weights), limit, rest (what terms that
    weren't looked up can add at most).

    A document looks up the terms whose reach comes up to its limit. All its other terms together stay below it, so a pair at the
    limit has a common term among those looked up; the rarest common term is one of them, in the index of the other document
    too, which holds the terms whose reach comes up to `least`."""
    asks = vectors.join(limits, "id", "left").withColumn("limit", F.greatest(F.coalesce("limit", F.lit(least)), F.lit(least)) - slack)
    whole = Window.partitionBy("id")
    asks = asks.withColumn("below", F.coalesce(F.max(F.when(F.col("reach") < F.col("limit"), F.col("reach"))).over(whole), F.lit(0.0))).filter(F.col("reach") >= F.col("limit"))
    index = vectors.withColumn("low", F.coalesce(F.max(F.when(F.col("reach") < least - slack, F.col("reach"))).over(whole), F.lit(0.0))).filter(F.col("reach") >= least - slack)
    index = index.select("category", "term", F.col("id").alias("other"), F.col("weight").alias("other_weight"), "low")
    met = asks.join(index, ["category", "term"]).filter("id <> other")
    return met.select("id", "other", (F.col("weight") * F.col("other_weight")).alias("part"), "limit", (F.col("below") + F.col("low")).alias("rest"))


def top_similar_bounded(docs: DataFrame, id_col: str, text_col: str, group: str, k: int = 5, least: float = 0.12, digits: int = 6) -> DataFrame:
    """What top_similar() gives for docs(id_col, text_col, group), ties by id included, without meeting over every common term.

    Equal texts of a group are one. Terms have one order in a category, by how many of its documents hold them. A first round
    gives each document a score that k others reach; in the second it looks up only terms whose bound comes up to that score,
    and whoever could reach it by what they share there is scored exactly. A term of a whole category is looked up by those
    alone that have no better neighbours."""
    slack = 10.0**-digits
    rows, ids = _heads(docs, id_col, text_col, group, k)
    ids = save(ids, "similar-heads")
    w = save(weights(rows, "id", "text").join(ids.select(F.col("head").alias("id"), "category"), "id"), "similar-weights")
    vectors = save(bounded_vectors(w), "similar-vectors")
    limits = save(first_limits(vectors, k, digits), "similar-limits")
    met = meetings(vectors, limits, least, slack).groupBy("id", "other").agg(F.sum("part").alias("part"), F.first("limit").alias("limit"), F.first("rest").alias("rest"))
    likely = met.filter(F.col("part") + F.col("rest") >= F.col("limit") - slack)
    scored = exact_scores(likely, vectors, digits).filter(F.col("score") >= least)
    itself = w.select("id").distinct().select("id", F.col("id").alias("other"), F.lit(1.0).alias("score"))
    return _each_copy(scored.unionByName(itself), rows, ids, id_col, k)


def shared_keys(pairs: DataFrame, fields: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the sorted keys that both records have."""
    keys = fields.groupBy("record_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    left = pairs.join(growing(keys.withColumnsRenamed({"record_id": a, "keys": "ka"})), a, "left").join(growing(keys.withColumnsRenamed({"record_id": b, "keys": "kb"})), b, "left")
    return left.withColumn("shared", F.array_join(F.array_intersect(F.coalesce("ka", F.array().cast("array<string>")), F.coalesce("kb", F.array().cast("array<string>"))), ",")).drop("ka", "kb")


def consensus_groups(categories: DataFrame, fields: DataFrame) -> DataFrame:
    """record_id, category, level, grp: records of a category by their series, and all its records of a brand by that (level brand) if
    one of them has no series, so that every record with a series or a brand has a group to ask."""
    series = fields.filter((F.col("key") == "series") & (F.col("value") != "")).select("record_id", F.col("value").alias("grp"))
    by_series = categories.select("record_id", "category").join(growing(series), "record_id").select("record_id", "category", F.lit("series").alias("level"), "grp")
    asks = categories.filter("brand <> ''").join(growing(series.select("record_id")), "record_id", "left_anti").select("category", "brand").distinct()
    by_brand = categories.join(asks, ["category", "brand"]).select("record_id", "category", F.lit("brand").alias("level"), F.col("brand").alias("grp"))
    return by_series.unionByName(by_brand)


def group_consensus(members: DataFrame, fields: DataFrame, group: list[str], least: int = 3, share: float = 0.6, of_all: bool = True) -> DataFrame:
    """group, key, value, support, share: the value that `least` members or more of a group have, being `share` or more of
    all members (of_all) or of those with a value. Ties go to the smaller value. Counts only: no member meets another."""
    size = members.groupBy(*group).agg(F.count("*").alias("members"))
    votes = members.join(growing(fields.select("record_id", "key", "value")), "record_id").groupBy(*group, "key", "value").agg(F.count("*").alias("support"))
    best = votes.groupBy(*group, "key").agg(F.max(F.struct("support", F.lit(0).alias("_"))).alias("m"), F.sum("support").alias("valued"))
    top = votes.join(best, [*group, "key"]).filter(F.col("support") == F.col("m.support")).groupBy(*group, "key", "support", "valued").agg(F.min("value").alias("value"))
    whole = F.col("members") if of_all else F.col("valued")
    out = top.join(size, group).withColumn("share", F.round(F.col("support") / whole, 6))
    return out.filter((F.col("support") >= least) & (F.col("share") >= share)).select(*group, "key", "value", "support", "share")
