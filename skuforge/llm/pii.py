r"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card and telephone numbers, found by pattern (base spans). A term is
a word of three letters or more. Over the whole corpus, with N documents, n(e) with an entity, n(t) with a term and n(t, e)
with both, wherever in the document they are, the term tells of the entity PMI(e; t) = log2(n(t, e) N / (n(t) n(e))) bits out
of IC(e) = log2(N / n(e)), all there is to tell. The share PMI / IC is 1 where every document with the term has the entity.
Terms with a share of at least `threshold`, seen with the entity in `support` different texts or more (in all of its texts,
where the entity has fewer), are disclosing: in documents that hold the entity every occurrence of them outside a base span
becomes a span of kind `term`.

sanitise() replaces base spans by their kind and disclosing terms by a generalisation of them, or removes them.

Java's patterns for possessive and bounded repetition run in linear time and without recursion, and match what the plain
patterns match: a match can only begin at the start of a run of its first class, or where the match before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.llm import common, spans

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
WORD = r"\p{L}{3,}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":  # without leading zeros, three digits at most
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & spans.luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["value"])


def _base(df: DataFrame) -> DataFrame:
    """df(key, text) with base: the spans of the four kinds."""
    t = F.col("text")
    # a cheap test spares most texts the pattern
    may = {"email": t.contains("@"), "phone": t.contains("+"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]")}
    df = df.select("*", *(F.when(may[k], spans.hits(t, PATTERNS[k])).otherwise(F.array().cast("array<string>")).alias(f"hit_{k}") for k in KINDS))
    parts = [F.filter(spans.placed(t, F.col(f"hit_{k}"), PATTERNS[k], k, r), _test(k)) for r, k in enumerate(KINDS)]
    return df.select("key", "text", spans.merged(parts).alias("base"))


def _words(text: Column) -> Column:
    """The different words of a text, as written."""
    return F.array_distinct(spans.hits(text, WORD))


def _terms(text: Column) -> Column:
    """The different words of a text in lower case."""
    return F.array_distinct(F.transform(_words(text), F.lower))


def _entity(s: Column) -> Column:
    return F.xxhash64(s["kind"], F.lower(s["value"]))


def _placed_terms(text: Column, words: Column, terms: Column) -> Column:
    """Spans of the words = hits(text, WORD) that are one of the terms in lower case.

    The terms are dealt to as many buckets as the root of their number, so that a word isn't compared with all of them.
    """
    count = F.ceil(F.sqrt(F.size(terms).cast("double")))
    bucket = lambda x: F.pmod(F.xxhash64(x), count).cast("int")
    buckets = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda b: F.filter(terms, lambda t: bucket(t) == b))
    placed = spans.placed(text, words, WORD, "term", len(KINDS))
    return spans.let(buckets, lambda b: F.filter(placed, lambda s: F.array_contains(F.get(b, bucket(F.lower(s["value"]))), F.lower(s["value"]))))


def analyse(docs: DataFrame, work: common.Workspace, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 2) -> DataFrame:
    """Base and term spans of every whole text: columns id_col, text_key, base and spans (arrays of spans.SPAN).

    A null text counts as empty. Rows with the same id and text have the same spans; rows with a null id too. Extra columns
    aren't read. One scan finds the base spans, one counts n(t); words are counted before the shuffle, so neither a frequent
    word nor a copied text gathers rows in a task. Only words that can reach the threshold meet the entities of their
    document: as n(t, e) is n(e) at most, a share of `threshold` needs n(t) <= N^(1 - threshold) n(e)^threshold, or
    n(t) <= n(e).
    """
    df = common.only(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = df.select(F.struct("id", F.xxhash64("text").alias("text")).alias("key"), "text")
    first = _base(keyed)
    first = work.save(first.select("key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "found")
    seen = first.filter(F.size("base") > 0)
    held = seen.select("key", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = held.groupBy("entity", F.col("key.text").alias("t")).agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts_e"))
    n = work.save(first.agg(F.count("*").alias("n")), "rows")
    # n(t) of all words, each once per document; the inner join below stays above the counting, so that words are counted
    # before the shuffle whatever the size of the other side
    terms = keyed.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t, n_e, rows = F.col("n_t"), F.col("n_e"), F.col("n")
    # a little more than the bound: the share itself is tested below
    may = n_t <= F.greatest(n_e, F.pow(rows, F.lit(1 - threshold)) * F.pow(n_e, F.lit(threshold)) * 1.000001)
    most = entities.agg(F.max("n_e").alias("n_e")).crossJoin(n)
    rare = terms.crossJoin(F.broadcast(most)).filter(may).select("term", "n_t")
    words = seen.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(rare, "term")
    of = held.distinct().join(entities, "entity")
    pairs = words.join(of, "key").crossJoin(F.broadcast(n)).filter(may).select("key", "term", "entity", "n_t", "n_e", "texts_e", "n")
    pairs = work.save(pairs, "pairs")
    same = ("n_t", "n_e", "texts_e", "n")
    told = pairs.groupBy("term", "entity", F.col("key.text").alias("t"), *same).agg(F.count("*").alias("c")).groupBy("term", "entity", *same).agg(F.sum("c").alias("n_te"), F.count("*").alias("texts"))
    share = (F.log2(F.col("n_te") * rows / (n_t * n_e))) / F.nullif(F.log2(rows / n_e), F.lit(0.0))
    # an entity in fewer texts than support can be told of in all of them, no more
    enough = F.col("texts") >= F.least(F.lit(support), F.col("texts_e"))
    telling = told.filter(enough & (share >= threshold)).select("term", "entity")
    told = pairs.select("key", "term", "entity").join(telling, ["term", "entity"]).groupBy("key").agg(F.collect_set("term").alias("terms"))
    k = F.col("key")
    told = told.select(k["id"].alias("told_id"), k["text"].alias("told_text"), "terms")
    out = first.select(k["id"].alias("id"), k["text"].alias("text_key"), "base", "text")
    out = out.join(told, out["id"].eqNullSafe(told["told_id"]) & (out["text_key"] == told["told_text"]), "left")
    # columns of their own, so that nothing is matched or placed twice
    out = out.select("id", "text_key", "base", "text", "terms", F.when(F.col("terms").isNotNull(), spans.hits(F.col("text"), WORD)).alias("words"))
    found = F.when(F.col("terms").isNull(), spans.no_spans()).otherwise(_placed_terms(F.col("text"), F.col("words"), F.col("terms")))
    clear = F.filter(found, lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return out.select(F.col("id").alias(id_col), "text_key", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """id, number of base spans of each kind, base_sha256, spans (kind:start:end, comma-joined) and n_term; a row per document."""
    work = common.Workspace(docs.sparkSession, "pii")
    id_col = options.get("id_col", "doc_id")
    found = analyse(docs, work, **options)
    counts = [spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"), spans.count(F.col("spans"), "term").alias("n_term"))


def generalised(term: Column) -> Column:
    """What stands for a disclosing term: its shape says name or word, nothing more."""
    return F.when(term.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False, **options) -> DataFrame:
    """docs with base spans replaced by [EMAIL], [IP], [CARD], [PHONE] and disclosing terms generalised, or removed.

    Overlapping spans are replaced as one, by the first one's name. Rows, ids and other columns stay; null texts stay null.
    """
    work = common.Workspace(docs.sparkSession, "pii")
    found = analyse(docs, work, id_col=id_col, text_col=text_col, **options)
    fid, ftext, fspans = (common.free_name(docs, f"found_{x}") for x in ("id", "text", "spans"))
    found = found.filter(F.size("spans") > 0).select(F.col(id_col).alias(fid), F.col("text_key").alias(ftext), F.col("spans").alias(fspans)).dropDuplicates([fid, ftext])
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    both = docs.join(found, id_.eqNullSafe(found[fid]) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == found[ftext]), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        name = F.when(s["kind"] == "term", F.lit("") if remove_terms else generalised(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name)
        new = F.struct(s["end"].alias("at"), out.alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(new)

    clean = F.aggregate(found[fspans], start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return both.select(*(F.when(found[fspans].isNull(), text).otherwise(clean).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns))
