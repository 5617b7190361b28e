"""Spans of pattern matches with DataFrame functions only: start and end in code points, the end exclusive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: where it is, its kind's place among the kinds, its kind and its text.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def hits(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a Java pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def running(x: Column) -> Column:
    """Running sums of an array of integers.

    An array that grows by a value at a time is copied each time, so the sums are made in blocks of the root of its length,
    then the blocks' own: the copies are in proportion to the power 1.5 of the length, not its square.
    """

    def grown(y: Column) -> Column:
        return F.aggregate(y, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def summed(b: Column) -> Column:
        before = F.slice(grown(F.transform(b, lambda y: F.element_at(y, -1))), 1, F.size(b))
        return F.flatten(F.zip_with(b, before, lambda y, o: F.transform(F.slice(y, 2, F.size(y) - 1), lambda v: v + o)))

    def blocks(y: Column) -> Column:
        n = F.greatest(F.size(y), F.lit(1))
        step = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(1), n, step), lambda at: grown(F.slice(y, at, step)))

    return let(x, lambda y: let(blocks(y), summed))


def placed(text: Column, found: Column, pattern: str, kind: str, rank: int) -> Column:
    """Spans of found = hits(text, pattern): what lies between the matches gives their places."""
    gaps = F.split(text, F.lit(pattern), -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
    # the sums are where the matches end
    spans = F.zip_with(found, running(lengths), lambda h, end: F.struct((end - F.length(h)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), h.alias("value")))
    return F.when(F.size(found) == 0, no_spans()).otherwise(spans)


def merged(parts: Sequence[Column]) -> Column:
    """All spans by start, then by the kinds' order."""
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of each, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
