"""Prefix trie of conversations by chained cryptographic digests.

A conversation's prefixes get digests, each made from the one before and the next turn; equal (depth, digest) is one node.

* Turns are numbered without gathering a conversation in a task: rows are dealt by ranges of (conversation, turn), numbered
  inside a range, and moved on by what the conversation has in earlier ranges.
* A chain runs inside a block of BLOCK turns. The blocks' last digests are a sequence of their own, chained the same way, and
  so on: a conversation of any length is worked on by many tasks. The digest of a prefix is its place in its block's chain,
  hashed with the digest of all blocks before; of a whole block, the digest of the blocks up to it.
* Every prefix is exploded and grouped by (depth, digest). A node's ancestors are the prefixes of any member.
* For sums over subtrees every node is exploded to its ancestors inside its block; what hangs below a block's last node is
  summed over blocks first, in the same way. So a node makes BLOCK rows at most, however deep it lies.
* A node's ids are joined and hashed in order as a stream of pieces: SHA-256 can't be split, but no list is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuforge.llm import common

BLOCK = 32
#: Characters of joined ids in a piece, about.
PIECE = 1 << 15
_NONE = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def numbered_turns(conversations: DataFrame, work: common.Workspace, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, pos, digest, chars) of every turn, pos from 1 by turn, null first, and (conv, n)). Turns of equal number go by the
    SHA-256 of the role's length, role and text; rows without a conversation are left out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = common.only(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv IS NOT NULL")
    turns = turns.select(F.col("conv").cast("long").alias("conv"), "turn", _sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"))
    # rows that are alike in all else are told apart by where they stand, so that no key is too frequent for a range
    dealt = turns.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("conv", "turn", "digest", "salt")
    dealt = work.save(dealt.withColumn("part", F.spark_partition_id()).drop("salt"), "turns")
    parts = work.save(dealt.groupBy("conv", "part").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "digest"))
    numbered = dealt.withColumn("i", inside).join(offsets, ["conv", "part"]).select("conv", (F.col("before") + F.col("i")).alias("pos"), "digest", "chars")
    return numbered, parts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(numbered: DataFrame, lengths: DataFrame, work: common.Workspace, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, digest, chars, length), (conv, length)): each conversation c with its first h = crc32(c) % heads turns
    replaced by those of conversation c - c % family; where that has fewer, all of them, or none if it isn't there (% keeps the
    sign, as in SQL). At pos 0 stands the start without text."""
    numbered = work.save(numbered, "numbered")
    h = (F.crc32(F.col("conv").cast("string")) % heads).alias("h")
    convs = lengths.select("conv", "n", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = work.save(convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = numbered.join(convs, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars", "length")
    first = numbered.filter((F.col("conv") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv", "base")
    first = first.join(convs, "base").filter("pos <= h").select("conv", "pos", "digest", "chars", "length")
    start = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"), "length")
    return own.unionByName(first).unionByName(start), convs.select("conv", "length")


def chained_blocks(sequence: DataFrame, longest: int, work: common.Workspace) -> list[DataFrame]:
    """For sequence(conv, pos from 0, digest, chars, length): a table of blocks and one for each level above, of (conv, block,
    length, top: digest of all blocks before, digests, chars of the block's places)."""
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))
    rows = sequence.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"), F.max("length").alias("length"))
    link = lambda done, x: F.concat(done, F.array(_sha(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), x["digest"]))))
    chain = F.aggregate("items", F.array().cast("array<binary>"), link)
    rows = rows.select("conv", "block", "length", chain.alias("digests"), F.col("items.chars").alias("chars"))
    if longest < BLOCK:
        return [work.save(rows.withColumn("top", F.lit(None).cast("binary")), "blocks")]
    rows = work.save(rows, "chains")
    tails = rows.filter(F.size("digests") == BLOCK).select("conv", F.col("block").alias("pos"), F.element_at("digests", -1).alias("digest"), F.lit(0).cast("long").alias("chars"), "length")
    above = chained_blocks(tails, longest // BLOCK, work)
    done = above[0].select("conv", "block", F.posexplode("digests").alias("i", "digest")).select("conv", (F.col("block") * BLOCK + F.col("i")).alias("block"), "digest")
    none = F.lit(None).cast("binary")
    upto = done.select("conv", "block", F.col("digest").alias("end"), none.alias("top")).unionByName(done.select("conv", (F.col("block") + 1).alias("block"), none.alias("end"), F.col("digest").alias("top")))
    upto = upto.groupBy("conv", "block").agg(F.max("end").alias("end"), F.max("top").alias("top"))
    placed = F.transform("digests", lambda x, i: F.when(F.col("end").isNotNull() & (i == BLOCK - 1), F.col("end")).when(F.col("top").isNotNull(), _sha(F.concat(F.col("top"), x))).otherwise(x))
    return [work.save(rows.join(upto, ["conv", "block"], "left").withColumn("digests", placed).drop("end"), "blocks"), *above]


def subtree_sums(nodes: DataFrame, levels: list[DataFrame], sums: list[str]) -> DataFrame:
    """(pos, digest, *sums) with the sums of nodes(pos, digest, conv: any member, *sums) over subtrees, the node itself included."""
    place = (F.col("pos") % BLOCK).cast("int")
    placed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(levels[0].select("conv", "block", "top", "digests"), ["conv", "block"])
    if len(levels) > 1:
        hung = placed.filter("block > 0").groupBy((F.col("block") - 1).alias("pos"), F.col("top").alias("digest")).agg(F.min("conv").alias("conv"), *(F.sum(s).alias(s) for s in sums))
        below = subtree_sums(hung, levels[1:], sums).select((F.col("pos") * BLOCK + BLOCK - 1).alias("pos"), "digest", *(F.col(s).alias(f"below_{s}") for s in sums))
        placed = placed.join(below, ["pos", "digest"], "left").withColumns({s: F.col(s) + F.coalesce(f"below_{s}", F.lit(0)) for s in sums})
    up = placed.select("block", *sums, F.posexplode(F.slice("digests", F.lit(1), place + 1)).alias("i", "at"))
    return up.groupBy((F.col("block") * BLOCK + F.col("i")).alias("pos"), F.col("at").alias("digest")).agg(*(F.sum(s).alias(s) for s in sums))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(pos, digest, ends_sha256) of ends(pos, digest, conv): SHA-256 of each node's ids, ascending, with a comma between."""
    key = ["pos", "digest"]
    dealt = ends.select(*key, "conv").repartitionByRange(*key, "conv").withColumn("part", F.spark_partition_id()).sortWithinPartitions(*key, "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, n = None, [], 0, 0
        def made():
            columns = [pa.array([x], t) for x, t in zip((*now, n, ",".join(ids)), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, [*key, "part", "n", "ids"])

        for batch in batches:
            for pos, digest, conv, part in zip(*(batch.column(c).to_pylist() for c in (*key, "conv", "part")), strict=True):
                if ids and ((pos, digest, part) != now or size > PIECE):
                    yield made()
                    n, ids, size = n + 1, [], 0
                now = (pos, digest, part)
                ids.append(x := str(conv))
                size += len(x) + 1
        if ids:
            yield made()

    def digest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, found = None, None, []
        schema = ([pa.int64(), pa.binary(), pa.string()], [*key, "ends_sha256"])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema[0], strict=True)], schema[1])
        for batch in batches:
            for pos, digest, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if (pos, digest) != now:
                    if sha:
                        found.append((*now, sha.hexdigest()))
                    now, sha = (pos, digest), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if found:
                yield made()
                found = []
        if sha:
            found.append((*now, sha.hexdigest()))
            yield made()

    pieces = dealt.transform(common.arrow, join, "pos long, digest binary, part int, n long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "part", "n").transform(common.arrow, digest_of, "pos long, digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", heads: int = 6, family: int = 100, work: common.Workspace | None = None) -> DataFrame:
    """Every node of the trie of rebuilt conversations (see rebuilt()): conv_id (smallest member), depth, parent_conv_id (null
    at the root), n_convs, n_children, n_leaves (nodes without children in the subtree), saved_tokens (sum over the subtree of
    (members - 1) times the code points of the node's last text), ends_sha256 (members that end here), digest.

    Null roles and texts count as empty, null turns come first, turns of equal number go by the SHA-256 of role and text.
    Repeated rows are turns of their own. Rows with a null conversation are left out; an empty table has no node. Other columns
    aren't read.
    """
    work = work or common.Workspace(conversations.sparkSession, "prefix-trie")
    numbered, lengths = numbered_turns(conversations, work, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    sequence, convs = rebuilt(numbered, lengths, work, heads, family)
    longest = convs.agg(F.max("length")).first()[0] or 0
    levels = chained_blocks(sequence, int(longest), work)
    places = levels[0].select("conv", "block", "length", "top", "digests", F.posexplode(F.arrays_zip("digests", "chars")).alias("i", "x"))
    prefixes = places.select("conv", (F.col("block") * BLOCK + F.col("i")).alias("pos"), F.col("x.digests").alias("digest"), F.col("x.chars").alias("chars"), F.coalesce(F.get("digests", F.col("i") - 1), "top").alias("before"), "length")
    nodes = prefixes.groupBy("pos", "digest").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.first("before").alias("before"), F.first("chars").alias("chars"))
    nodes = work.save(nodes, "nodes")
    above = nodes.filter("pos > 0").select((F.col("pos") - 1).alias("pos"), F.col("before").alias("digest"))
    children = above.groupBy("pos", "digest").agg(F.count("*").alias("n_children"))
    nodes = work.save(nodes.join(children, ["pos", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")
    weighed = nodes.select("pos", "digest", "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(weighed, levels, ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("pos") + 1).alias("pos"), F.col("digest").alias("before"), F.col("conv").alias("parent_conv_id"))
    ends = ends_digest(prefixes.filter("pos = length"))
    whole = nodes.join(parents, ["pos", "before"], "left").join(sums, ["pos", "digest"]).join(ends, ["pos", "digest"], "left")
    return whole.select(F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))
