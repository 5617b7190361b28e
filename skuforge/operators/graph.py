"""The product graph as two tables, and inference from peers by counts that leave the record itself out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuforge.sources.tables import growing, save, stored


def edges(categories: DataFrame, fields: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """product, node, kind: products to their category and to the values of some keys (lower case)."""
    a = categories.select(F.concat(F.lit("product:"), F.col("record_id").cast("string")).alias("product"), F.concat(F.lit("category:"), F.lower("category")).alias("node"), F.lit("category").alias("kind"))
    rows = fields.filter(F.col("key").isin(*keys) & F.col("value").isNotNull())
    b = rows.select(F.concat(F.lit("product:"), F.col("record_id").cast("string")).alias("product"), F.concat("key", F.lit(":"), F.lower(F.trim("value"))).alias("node"), F.col("key").alias("kind"))
    return a.unionByName(b)


def nodes(e: DataFrame) -> DataFrame:
    products = e.select(F.col("product").alias("node"), F.lit("product").alias("kind"))
    return products.unionByName(e.select("node", "kind")).distinct()


def related(e: DataFrame, k: int = 8, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """product, other, shared, rank: the k products with the most nodes in common."""
    e = e if kinds is None else e.filter(F.col("kind").isin(*kinds))
    pairs = e.select("product", "node").join(e.select(F.col("product").alias("other"), "node"), "node").filter("product <> other").groupBy("product", "other").agg(F.count("*").alias("shared"))
    over = Window.partitionBy("product").orderBy(F.desc("shared"), "other")
    return pairs.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def related_sets(e: DataFrame, k: int = 8) -> DataFrame:
    """What related() gives over all edges, each edge counted once, for products of few nodes: no pair of products is made.

    For each set of nodes that some product has, the first k + 1 products (by text) with all of it are kept. A product finds
    its k best among the lists of the subsets of its own nodes: whoever is before another in a list shares as much or more
    and has a smaller name, and the largest set whose list has a product is what is shared with it. Products with the same
    nodes are one. Work grows with 2 to the power of a product's nodes, but in proportion to the products.
    """
    nodes_of = e.groupBy("product").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    first = lambda df, key, name: df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(name))).filter(F.col("_r") <= k + 1).drop("_r")
    grow = lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x))))
    subsets = F.filter(F.aggregate("nodes", F.array(F.array().cast("array<string>")), grow), lambda s: F.size(s) > 0)
    heads = first(nodes_of, "nodes", "product")
    lists = heads.select(F.col("product").alias("other"), F.explode(subsets).alias("subset"))
    lists = first(lists, "subset", "other")
    own = nodes_of.select("nodes").distinct().select("nodes", F.explode(subsets).alias("subset"))
    pairs = own.join(lists, "subset").groupBy("nodes", "other").agg(F.max(F.size("subset")).cast("long").alias("shared"))
    over = Window.partitionBy("nodes").orderBy(F.desc("shared"), "other")
    best = pairs.withColumn("_r", F.row_number().over(over)).filter(F.col("_r") <= k + 1)
    best = best.groupBy("nodes").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("less"), "other"))).alias("best"))
    rest = F.slice(F.filter("best", lambda x: x["other"] != F.col("product")), 1, k)
    out = nodes_of.join(best, "nodes").select("product", F.posexplode(rest).alias("at", "x"))
    return out.select("product", F.col("x.other").alias("other"), (-F.col("x.less")).alias("shared"), (F.col("at") + 1).alias("rank"))


def ego(e: DataFrame, start: str, radius: int) -> DataFrame:
    """Nodes within radius steps of start, with their distance. Each step is a join of the frontier with the edges."""
    both = e.select(F.col("product").alias("a"), F.col("node").alias("b")).unionByName(e.select(F.col("node").alias("a"), F.col("product").alias("b"))).distinct()
    seen = e.sparkSession.createDataFrame([(start, 0)], "node string, distance int")
    for d in range(1, radius + 1):
        step = seen.filter(F.col("distance") == d - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(d).alias("distance")).distinct()
        seen = seen.unionByName(step.join(seen.select("node"), "node", "left_anti"))
    return seen


def alike(both: DataFrame) -> DataFrame:
    """(node, cls) of every node of both(node, next): nodes with the same neighbours have the same class, two 64-bit hashes of them
    all. Unequal neighbours could count as equal only by chance. Sums are taken before the shuffle, so a hub is no task of its own."""
    of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "next")).alias(f"h{seed}")
    return both.groupBy("node").agg(of(1), of(2)).select("node", F.struct("h1", "h2").alias("cls"))


#: Members of a class in a list, and pairs of a start and a node made by a task, both on average.
MEMBERS_A_LIST, PAIRS_A_TASK = 256, 10_000_000


def lists(members: DataFrame, sizes: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """key and name, lists of key's members, of which sizes(key, n_name) tells how many there are. A large class has many lists,
    to which members are dealt by hash, so no class is whole in a row or a task."""
    at = F.pmod(F.xxhash64(member), F.ceil(F.col(f"n_{name}") / MEMBERS_A_LIST))
    return members.join(sizes, key).withColumn("_list", at).groupBy(key, "_list").agg(F.collect_list(member).alias(name)).drop("_list")


def neighbourhoods(e: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """(start, node, distance) of all nodes within radius steps of each start of starts(start), products or other nodes; a start
    that isn't in the graph has no row.

    Nodes with the same neighbours are one class: another node is as far from each of them, and they are two steps from each other,
    or one if they are neighbours. So steps go from class to class, and classes become nodes in the result only. All starts go in
    step: a step joins the last step's classes with the links between classes and keeps those not seen before. Each step's classes
    are a table of their own, and the seen ones are read from those folders, so plans stay as short at any radius. It ends when
    a step finds nothing."""
    spark = e.sparkSession
    both = save(e.select(F.col("product").alias("node"), F.col("node").alias("next")).unionByName(e.select("node", F.col("product").alias("next"))).distinct(), "adjacent")
    classes = save(alike(both), "classes")
    # one node of a class tells its neighbours
    one = both.join(growing(classes.groupBy("cls").agg(F.min("node").alias("node"))), "node")
    links = save(one.select("cls", F.col("next").alias("node")).join(growing(classes.select("node", F.col("cls").alias("next"))), "node").select("cls", "next").distinct(), "links")
    known = save(classes.join(growing(starts.select(F.col("start").alias("node")).distinct()), "node").select(F.col("node").alias("start"), F.col("cls").alias("begin")), "starts")
    first = known.select("begin", F.col("begin").alias("cls"), F.lit(0).alias("distance")).distinct()
    reached = [stored(first, "reached")]
    schema = first.schema
    for d in range(1, radius + 1):
        last, seen = spark.read.schema(schema).parquet(reached[-1]), spark.read.schema(schema).parquet(*reached)
        step = last.join(growing(links), "cls").select("begin", F.col("next").alias("cls")).distinct().join(growing(seen.select("begin", "cls")), ["begin", "cls"], "left_anti")
        reached.append(stored(step.select("begin", "cls", F.lit(d).alias("distance")), "reached"))
        if spark.read.schema(schema).parquet(reached[-1]).isEmpty():
            break
    near = spark.read.schema(schema).parquet(*reached)
    # others of the start's own class
    beside = links.filter(F.col("cls") == F.col("next")).select("cls", F.lit(1).alias("beside"))
    near = near.join(growing(beside), "cls", "left").withColumn("distance", F.when(F.col("distance") == 0, F.coalesce("beside", F.lit(2))).otherwise(F.col("distance"))).filter(F.col("distance") <= radius)
    # lists of starts meet lists of nodes and are dealt by what they make; the last step makes pairs of them and neither sorts nor joins
    n_starts, n_nodes = known.groupBy("begin").agg(F.count("*").alias("n_starts")), classes.groupBy("cls").agg(F.count("*").alias("n_nodes"))
    made = near.join(n_starts, "begin").join(n_nodes, "cls").agg(F.sum(F.col("n_starts") * F.col("n_nodes"))).first()[0] or 0
    met = near.join(growing(lists(known, n_starts, "begin", "start", "starts")), "begin").join(growing(lists(classes, n_nodes, "cls", "node", "nodes")), "cls")
    met = met.select("distance", (F.col("begin") == F.col("cls")).alias("own"), "starts", "nodes").repartition(1 + made // PAIRS_A_TASK, "starts", "nodes")
    # a lambda is outside generated code, so starts come one by one; else all pairs of two lists are kept before the first goes on
    each = F.explode(F.transform("starts", lambda x: x))
    pairs = met.select("distance", "own", "nodes", each.alias("start")).select("start", F.explode("nodes").alias("node"), "distance", "own")
    others = pairs.filter(~F.col("own") | (F.col("start") != F.col("node"))).select("start", "node", "distance")
    return known.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).unionByName(others)


def drawn(e: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Elements for a graph widget, as JSON: (start, part, element) of the nodes and edges among within(start, node), of the whole
    graph (start null) without it. Nodes have id, label and kind, edges source, target and relation."""
    kind = F.max(F.when(F.col("kind").isin("product", "category"), F.col("kind")).otherwise("attribute"))
    every = nodes(e).groupBy("node").agg(kind.alias("kind"))
    name = F.regexp_extract("node", r"(?s)^[^:]*:(.*)$", 1)
    label = F.when(F.col("kind") == "attribute", F.concat(F.regexp_extract("node", "^([^:]*):", 1), F.lit("="), name)).otherwise(name)
    links = e.select("product", "node", F.when(F.col("kind") == "category", "in_category").otherwise("has_attribute").alias("relation")).distinct()
    if within is None:
        every, links = (x.withColumn("start", F.lit(None).cast("string")) for x in (every, links))
    else:
        inside = within.select("start", "node").distinct()
        every = every.join(inside, "node")
        links = links.join(inside, "node").join(inside.withColumnRenamed("node", "product"), ["start", "product"])
    element = lambda *c: F.to_json(F.struct(F.struct(*c).alias("data"))).alias("element")
    points = every.select("start", F.lit("node").alias("part"), element(F.col("node").alias("id"), label.alias("label"), "kind"))
    return points.unionByName(links.select("start", F.lit("edge").alias("part"), element(F.col("product").alias("source"), F.col("node").alias("target"), "relation")))


def peer_groups(categories: DataFrame, fields: DataFrame, least: int = 3) -> DataFrame:
    """record_id, level, grp: the series if it has `least` records or more, else brand and category, else category.
    Group sizes are counted before the shuffle and joined back, so a group of any size is no task of its own; a record without
    a series is counted with none."""
    series = fields.filter("key = 'series'").select("record_id", F.col("value").alias("series"))
    rows = categories.join(growing(series), "record_id", "left")
    in_series = series.join(growing(categories.select("record_id")), "record_id").groupBy(F.col("series").alias("s")).agg(F.count("*").alias("in_series"))
    in_brand = categories.groupBy(F.col("brand").alias("b"), F.col("category").alias("c")).agg(F.count("*").alias("in_brand"))
    rows = rows.join(in_series, F.col("series") == F.col("s"), "left").join(in_brand, F.col("brand").eqNullSafe(F.col("b")) & F.col("category").eqNullSafe(F.col("c")), "left")
    level = F.when(F.col("in_series") >= least, "series").when(F.col("in_brand") >= least, "brand").otherwise("category")
    grp = F.when(level == "series", F.col("series")).when(level == "brand", F.concat_ws("|", "brand", "category")).otherwise(F.col("category"))
    return rows.select("record_id", level.alias("level"), grp.alias("grp"))


def _votes(groups: DataFrame, fields: DataFrame) -> DataFrame:
    return groups.join(growing(fields.select("record_id", "key", "value")), "record_id").groupBy("level", "grp", "key", "value").agg(F.count("*").alias("c"))


def _best_two(votes: DataFrame) -> DataFrame:
    """For each group and key: total, and the two most frequent values, ties by value. Bounded state: top two of an array
    that holds each distinct value once."""
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy("level", "grp", "key").orderBy(F.desc("c"), "value")))
    g = ranked.groupBy("level", "grp", "key").agg(F.sum("c").alias("total"), *(F.max(F.when(F.col("r") == i, F.struct("value", "c"))).alias(f"v{i}") for i in (1, 2)))
    return g


def outliers(groups: DataFrame, fields: DataFrame, least: int = 4, share: float = 0.8) -> DataFrame:
    """record_id, key, value, majority, support, peers: cells that differ from what `share` or more of at least `least` other
    members have."""
    best = _best_two(_votes(groups, fields))
    own = groups.join(growing(fields.select("record_id", "key", "value")), "record_id")
    own = growing(own).join(best, ["level", "grp", "key"])
    peers = F.col("total") - 1
    # the record's own value isn't the majority, so leaving it out can't change the majority's count
    hit = own.filter((F.col("value") != F.col("v1.value")) & (peers >= least) & (F.col("v1.c") >= share * peers))
    return hit.select("record_id", "key", "value", F.col("v1.value").alias("majority"), F.col("v1.c").alias("support"), peers.alias("peers"))


def infer(groups: DataFrame, fields: DataFrame, wanted: DataFrame, brand_keys: tuple[str, ...] = ("brand", "series", "warranty_months"), least: int = 3, share: float = 0.75, confidence: float = 0.6) -> DataFrame:
    """record_id, key, value, support, share for wanted(record_id, key) cells: what peers with confidence say, by count. Keys
    of a brand aren't inferred from a mere category. A wanted cell has no value of its own, so nothing is left out."""
    votes = _votes(groups, fields.filter(F.col("confidence") >= confidence))
    best = _best_two(votes)
    j = wanted.join(growing(groups), "record_id").filter(~((F.col("level") == "category") & F.col("key").isin(*brand_keys)))
    # marked, as its shuffled rows are few bytes: the optimiser would build them in the driver and read the groups past them
    j = growing(j).join(best, ["level", "grp", "key"])
    s = F.col("v1.c") / F.col("total")
    return j.filter((F.col("v1.c") >= least) & (s >= share)).select("record_id", "key", F.col("v1.value").alias("value"), F.col("v1.c").alias("support"), F.round(s, 6).alias("share"))
