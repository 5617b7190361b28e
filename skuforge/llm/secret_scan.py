r"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Base spans are found by pattern: assignments of a value to a password-like name, access keys and long hexadecimal runs. Each
is a candidate with a hash of its secret value (an assignment's value, else the whole match). Over the corpus, a candidate
hash has a number of distinct repositories and of distinct owners that hold it. A value in `example_owners` owners or more
is a widely copied example, as is one of fewer than `distinct_characters` different characters. The rest belong to few owners,
look live and become added spans of kind `live` on their value. No list of words overrides the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common, spans

KINDS = ("assign", "access", "hex")
_NAME = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_BEFORE_VALUE = _NAME + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = _BEFORE_VALUE + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX), strict=True))


def _value(kind: Column, text: Column) -> Column:
    """The secret within a match."""
    return F.when(kind == "assign", F.regexp_replace(text, "^" + _BEFORE_VALUE, "")).otherwise(text)


def _base(text: Column, hit) -> Column:
    parts = []
    for r, k in enumerate(KINDS):
        found = spans.placed(text, hit(k), PATTERNS[k], k, r)
        parts.append(F.filter(found, _long_enough) if k == "assign" else found)
    return spans.merged(parts)


def _long_enough(s: Column) -> Column:
    return F.length(_value(F.lit("assign"), s["value"])) >= 6


def scan(
    docs: DataFrame, work: common.Workspace, *, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, example_owners: int = 3, distinct_characters: int = 6
) -> DataFrame:
    """Spans of every whole text: id_col, text_key, base, spans (arrays of spans.SPAN), n_live, n_example.

    repository and owner: columns of docs, by default `source` and what precedes its first slash. A null text counts as
    empty; a null repository or owner is one of its own. Rows with the same id, text and source have the same spans, with
    null ids too. One scan of the texts; only candidates are shuffled: counted by hash, repository and owner before the
    shuffle, so that a value found everywhere gathers in no task.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.substring_index(F.col("source"), "/", 1) if owner is None else owner
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    t = F.col("text")
    may = {"assign": t.rlike(_NAME + r"""["']?\x20*[:=]"""), "access": t.contains("AKIA"), "hex": t.rlike(r"[0-9a-f]{24}")}
    df = df.select("id", "repository", "owner", "text", F.xxhash64("text").alias("text_key"), *(F.when(may[k], spans.hits(t, PATTERNS[k])).otherwise(F.array().cast("array<string>")).alias(f"hit_{k}") for k in KINDS))
    first = work.save(df.select("id", "repository", "owner", "text_key", _base(t, lambda k: F.col(f"hit_{k}")).alias("base")), "candidates")
    candidates = first.filter(F.size("base") > 0).select("id", "text_key", "repository", "owner", F.explode("base").alias("s"))
    candidates = candidates.withColumn("value", _value(F.col("s.kind"), F.col("s.value"))).withColumn("hash", F.sha2("value", 256))
    held = candidates.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    owners = held.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repositories = held.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    frequency = owners.join(repositories, "hash")
    plain = F.size(F.array_distinct(F.split("value", ""))) < distinct_characters
    verdict = F.when(plain | (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= 2 * example_owners), "example").otherwise("live")
    end = F.col("s.end")
    live = F.struct((end - F.length("value")).cast("int").alias("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"), F.lit("live").alias("kind"), F.col("value"))
    judged = candidates.join(frequency, "hash").select("id", "text_key", verdict.alias("verdict"), live.alias("span")).distinct()
    judged = judged.groupBy("id", "text_key").agg(F.collect_set(F.when(F.col("verdict") == "live", F.col("span"))).alias("live"), F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"))
    judged = judged.withColumnsRenamed({"id": "judged_id", "text_key": "judged_text"})
    out = first.join(judged, first["id"].eqNullSafe(judged["judged_id"]) & (first["text_key"] == judged["judged_text"]), "left")
    return out.select(F.col("id").alias(id_col), "text_key", "base", F.array_sort(F.concat("base", F.coalesce("live", spans.no_spans()))).alias("spans"), F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def report(docs: DataFrame, **options) -> DataFrame:
    """id, number of base spans of each kind, base_sha256, spans (kind:start:end, comma-joined), n_live, n_example."""
    found = scan(docs, common.Workspace(docs.sparkSession, "secrets"), **options)
    counts = [spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(options.get("id_col", "doc_id")), *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"), "n_live", "n_example")
