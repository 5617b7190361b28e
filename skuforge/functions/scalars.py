"""Scalar column functions: cleaning, coercion and formatting of catalogue cells. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that say nothing (fixed values).
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "unknown", "tbd", "-", "--", "unbranded", "no brand", "not applicable", "generic")
TRUE_TOKENS = ("yes", "y", "true", "1", "included", "on")
FALSE_TOKENS = ("no", "n", "false", "0", "none", "off")
TRUE_HINTS = ("armour", "retardant", "resistant")
VENDOR_CODE = r"\s*\(([A-Z0-9]{3,8})\)\s*$"


def is_placeholder(c: Column) -> Column:
    """Blank, one of the placeholder tokens, or text between double dashes; null counts as blank."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (low == "") | low.isin(*PLACEHOLDERS) | low.rlike("^--.*--$")


def vendor_code(c: Column) -> Column:
    """The distributor's code at the end of an account name, without brackets; empty where there is none."""
    return F.regexp_extract(c, VENDOR_CODE, 1)


def without_vendor_code(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, VENDOR_CODE, ""))


def collapse(c: Column) -> Column:
    """White space runs as one space, ends trimmed of spaces and punctuation."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r'^[" .;,\-]+|[" .;,\-]+$', "")


def to_boolean(c: Column) -> Column:
    """True and false tokens, then hints of truth within the text, else null."""
    low = F.lower(F.trim(c))
    hint = low.rlike("|".join(TRUE_HINTS))
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False).when(hint, True)


def to_list(c: Column) -> Column:
    """Parts between ; , / | and line ends or the word and; trimmed, without blanks, the first spelling of each kept."""
    parts = F.filter(F.transform(F.split(c, r"[;,/|\n]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.array().cast("array<string>")
    return F.aggregate(parts, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def to_enum(c: Column, options: list[str], hints: dict[str, str] | None = None, snap: float | None = None) -> Column:
    """Exact option, hinted option (exact, then as a word), option in another case, option within or around; with snap, the most
    similar option from that score on; else null."""
    low = F.lower(F.trim(c))
    choices = [F.when(F.trim(c) == o, o) for o in options]
    for word, option in (hints or {}).items():
        choices.append(F.when(low == word, option))
    for word, option in (hints or {}).items():
        choices.append(F.when(low.rlike(rf"(^|[^a-z0-9]){word}([^a-z0-9]|$)"), option))
    choices += [F.when(low == o.lower(), o) for o in options]
    choices += [F.when(low.contains(o.lower()) | (F.lit(o.lower()).contains(low) & (F.length(low) > 1)), o) for o in options]
    if snap is not None:
        choices.append(snapped(c, options, snap))
    return F.coalesce(*choices)


def snapped(c: Column, options: list[str], floor: float = 82.0) -> Column:
    """The option most like the text, of those that reach the floor (the first of equal ones); null without one. For a few
    options, which are part of the expression."""
    low = F.lower(F.trim(c))
    score = lambda o: 100.0 * (1 - F.levenshtein(low, F.lit(o.lower())) / F.greatest(F.length(low), F.lit(len(o))))
    scored = F.array(*(F.struct((-score(o)).alias("less"), F.lit(i).alias("i"), F.lit(o).alias("option")) for i, o in enumerate(options)))
    best = F.array_min(F.filter(scored, lambda x: x["less"] <= -floor))
    return F.when(F.length(low) > 0, best["option"])


def number(c: Column) -> Column:
    return c.try_cast("double")


def half_up(c: Column, digits: int) -> Column:
    """Rounding of values from zero on, written so that any engine's doubles give the same result."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


def shown(c: Column) -> Column:
    """A double as text without trailing zeros."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def warranty(months: Column) -> Column:
    """Whole years as `N Year(s) Limited`, else months."""
    years = (months / 12).cast("int").cast("string")
    return F.when(months <= 0, "").when(months % 12 == 0, F.concat(years, F.when(months == 12, " Year Limited").otherwise(" Years Limited"))).otherwise(F.concat(months.cast("string"), F.lit(" Months Limited")))


def grade(score: Column) -> Column:
    """A from 90, B from 75, C from 60, D from 40, else F."""
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def bar(confidence: Column) -> Column:
    """Five blocks, as many full as fifths of the confidence."""
    n = F.floor(confidence * 5 + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), 5 - n))


def truncated(c: Column, limit: int, marker: str = "\n[... truncated ...]\n", head: float = 0.7) -> Column:
    """Text over limit characters as its head, a marker and its tail."""
    first = int(limit * head)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, first), F.lit(marker), F.right(c, F.lit(limit - first)))).otherwise(c)


def fingerprint(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts together; null parts count as empty."""
    return F.substring(F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def located(text: Column, evidence: Column, name: Column) -> Column:
    """name#offset=place of the evidence's first 60 characters (from 0), or name alone where it isn't in the text."""
    at = F.locate(F.substring(evidence, 1, 60), text) if isinstance(evidence, str) else F.expr("0") + F.instr(text, F.substring(evidence, 1, 60))
    return F.when(at > 0, F.concat(name, F.lit("#offset="), (at - 1).cast("string"))).otherwise(name)


def page_of(text: Column, evidence: Column, marker: str) -> Column:
    """Which page holds the evidence: markers before it, 0 where it isn't found."""
    at = F.instr(text, evidence)
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at), marker)) - 1).otherwise(0)


def json_salvage(c: Column) -> Column:
    """The JSON within an answer: a fenced block, else from the first opening brace or bracket to the last closing one."""
    fenced = F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1)
    loose = F.regexp_extract(c, r"([\[{][\s\S]*[\]}])", 1)
    best = F.when(F.trim(fenced) != "", fenced).otherwise(loose)
    return F.when(F.try_parse_json(best).isNotNull(), F.regexp_replace(best, r"^\s+|\s+$", ""))


def retry_hint(message: Column) -> Column:
    """Seconds that a rate-limit message asks to wait, null without any."""
    said = F.coalesce(F.nullif(F.regexp_extract(message, r"(?i)retry in ([0-9.]+)\s*s", 1), F.lit("")), F.nullif(F.regexp_extract(message, r"(?i)retryDelay['\"]?\s*:\s*['\"]?([0-9.]+)s", 1), F.lit("")))
    return said.try_cast("double")


def html_text(c: Column) -> Column:
    """Readable text of a page: script, style, nav, header, footer, noscript and svg elements and comments go, then tags."""
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(c, r"[\x20\t\n\r]+", " "))


def html_table_rows(c: Column) -> Column:
    """Cells of every table row, each row joined by a vertical bar."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr[ >].*?</tr>"), F.lit(0))
    return F.transform(rows, lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), " | "))
