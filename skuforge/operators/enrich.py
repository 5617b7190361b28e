"""Filling gaps from peers, and checks of generated content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.functions.dictionary import NEVER_INFER
from skuforge.operators import graph, score
from skuforge.sources.tables import growing, has_key, keys_of, save


def missing(categories: DataFrame, fields: DataFrame, specs: DataFrame, never: tuple[str, ...] = NEVER_INFER) -> DataFrame:
    """record_id, key, weight of what specs ask for, isn't filled and may be inferred."""
    known = categories.select("record_id", "category").join(growing(keys_of(fields)), "record_id", "left")
    wanted = known.join(F.broadcast(specs.filter(~F.col("key").isin(*never)).select("category", "key", "weight")), "category")
    return wanted.filter(~has_key("key")).select("record_id", "key", "weight")


def series_consensus(categories: DataFrame, fields: DataFrame, wanted: DataFrame, least: int = 3, share: float = 0.6, confidence: float = 0.6) -> DataFrame:
    """record_id, key, value, support, share for wanted(record_id, key) cells: what `least` peers or more say with confidence, being
    `share` or more of all peers. Peers are the other records of the category with the same series, or, for a record without
    one, with the same brand, both without case. Counts only; a wanted cell has no value of its own. Ties go to the smaller
    value."""
    series = fields.filter("key = 'series'").groupBy("record_id").agg(F.min(F.lower("value")).alias("series"))
    rows = categories.select("record_id", "category", F.lower("brand").alias("brand")).join(growing(series), "record_id", "left")
    by = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    # every record is a peer by its series and by its brand, and asks by one of them
    as_peer = rows.select("record_id", F.explode(F.array_compact(F.array(F.when(by("series"), F.struct("category", F.lit("series").alias("by"), F.col("series").alias("of"))), F.when(by("brand"), F.struct("category", F.lit("brand").alias("by"), F.col("brand").alias("of")))))).alias("g")).select("record_id", "g.*")
    asks = rows.select("record_id", F.when(by("series"), F.struct("category", F.lit("series").alias("by"), F.col("series").alias("of"))).when(by("brand"), F.struct("category", F.lit("brand").alias("by"), F.col("brand").alias("of"))).alias("g")).filter("g is not null").select("record_id", "g.*")
    group = ["category", "by", "of"]
    size = as_peer.groupBy(*group).agg((F.count("*") - 1).alias("peers"))
    votes = as_peer.join(growing(fields.filter(F.col("confidence") >= confidence).select("record_id", "key", "value")), "record_id").groupBy(*group, "key", "value").agg(F.count("*").alias("c"))
    best = votes.groupBy(*group, "key").agg(F.min(F.struct((-F.col("c")).alias("less"), "value")).alias("b")).select(*group, "key", "b.value", (-F.col("b.less")).alias("support"))
    sure = best.join(size, group).withColumn("share", F.round(F.col("support") / F.col("peers"), 6)).filter((F.col("support") >= least) & (F.col("share") >= share))
    # what is asked grows with the records, so it is marked too: groups may be many, but askers are more
    asked = wanted.select("record_id", "key").join(growing(asks), "record_id")
    return growing(asked).join(sure, [*group, "key"]).select("record_id", "key", "value", "support", "share")


def fill_from_peers(categories: DataFrame, fields: DataFrame, specs: DataFrame, consensus: bool = False) -> DataFrame:
    """record_id, key, value, confidence, support: min(0.70, 0.45 + 0.3 share). Peers are as they were before any filling. With
    consensus, cells that peer groups don't answer are asked of the series next."""
    wanted = missing(categories, fields, specs).select("record_id", "key")
    found = graph.infer(graph.peer_groups(categories, fields), fields, wanted)
    if consensus:
        found = save(found, "inferred")
        rest = wanted.join(growing(keys_of(found)), "record_id", "left").filter(~has_key("key")).select("record_id", "key")
        found = found.select("record_id", "key", "value", "support", "share").unionByName(series_consensus(categories, fields, rest))
    return found.select("record_id", "key", "value", F.round(F.least(F.lit(0.70), 0.45 + 0.3 * F.col("share")), 6).alias("confidence"), "support")


def content_length(fields: DataFrame, targets: dict[str, tuple[int, int]]) -> DataFrame:
    """record_id, key, chars, code for texts under 0.8 of their lower or over 1.2 of their upper target length."""
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, v[i])))[F.col("key")]
    n = F.length("value")
    code = F.when(n * 10 < pick(0) * 8, "CONTENT_TOO_SHORT").when(n * 10 > pick(1) * 12, "CONTENT_TOO_LONG")
    return fields.filter(F.col("key").isin(*targets)).select("record_id", "key", n.alias("chars"), code.alias("code")).filter("code is not null")


def verified_block(fields: DataFrame, floor: float = 0.6) -> DataFrame:
    """record_id and its confident cells as `key: value unit` lines, by key."""
    line = F.concat(F.col("key"), F.lit(": "), F.col("value"), F.when(F.col("unit") != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(""))
    g = fields.filter(score.penalised() >= floor).groupBy("record_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("record_id", F.array_join("lines", "\n").alias("block"))
