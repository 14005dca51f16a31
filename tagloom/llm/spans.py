"""Spans of regular expressions as JVM-side column expressions, in time that grows with n log n of a text's matches.

Spark's array functions have no running sum, and an array that grows by one is copied each time. Positions come from a prefix
scan by doubling instead: log2(n) passes over an array of n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,end:long,kind:int,value:string>>"
#: Stands around matches while they are cut out of a text, which is freed of it first. No pattern tells it from NUL.
MARK = "\x01"
#: Code points of the blocks that a text is cut from.
BLOCK = 1024


def unmarked(text: Column) -> Column:
    """The text with NUL for MARK: positions stay."""
    return F.when(text.contains(MARK), F.translate(text, MARK, "\0")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _powers(n: Column) -> Column:
    """The powers of two up to n, which is at least 1."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of op over the first, the first two, ... of the values; op is associative."""

    def step(acc: Column, shift: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= shift, op(F.get(acc, i - shift), x)).otherwise(x))

    return let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(_powers(F.size(v) - 1), v, step)).otherwise(v))


def count_below(ordered: Column, x: Column) -> Column:
    """How many of an ordered array are less than x, by halving."""
    step = lambda j, p: F.when(F.get(ordered, j + p - 1) < x, j + p).otherwise(j)
    return F.when(F.size(ordered) > 0, F.aggregate(F.reverse(_powers(F.greatest(F.size(ordered), F.lit(1)))), F.lit(0), step)).otherwise(F.lit(0))


def matches(text: Column, pattern: str, kind: int, when: Column | None = None) -> Column:
    """Array of (start, end, kind, value) of the leftmost non-overlapping matches, in code points.

    The text must be free of MARK. One search puts marks around the matches; what lies between marks is a gap or a match in
    turn, and its lengths add up to positions. The pattern must not match the empty string. when: a cheap test that spares
    texts without a match.
    """
    found = marked_spans(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), kind)
    return found if when is None else F.when(when, found).otherwise(F.array().cast(SPAN))


def marked_spans(marked: Column, kind: int) -> Column:
    """Array of (start, end, kind, value) of what stands between pairs of MARK, in code points of the text without marks."""

    def spans(p: Column, ends: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        return F.transform(at, lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), F.get(p, i).alias("value")))

    def of(p: Column) -> Column:
        ends = scan(F.transform(p, lambda x: F.length(x).cast("long")), lambda a, b: a + b)
        return F.when(F.size(p) > 1, let(ends, lambda e: spans(p, e)).cast(SPAN)).otherwise(F.array().cast(SPAN))

    return let(F.split(marked, MARK, -1), of)


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    order = F.array_sort(F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def kept(o: Column, upto: Column) -> Column:
        starts = F.transform(o, lambda s: s["start"])
        return let(starts, lambda st: F.filter(spans, lambda w: F.coalesce(F.get(upto, count_below(st, w["end"]) - 1), F.lit(0)) <= w["start"]))

    return F.when(F.size(others) == 0, spans).otherwise(let(order, lambda o: let(scan(F.transform(o, lambda s: s["end"]), F.greatest), lambda u: kept(o, u))))


def among(ordered: Column, x: Column) -> Column:
    """Whether an ordered array of distinct values holds x."""
    return F.coalesce(F.get(ordered, count_below(ordered, x)) == x, F.lit(False))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is given in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    part = F.concat_ws("", F.slice(blocks, first + 1, F.greatest(count, F.lit(1))))
    return F.when(end > start, F.substring(part, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def spliced(text: Column, spans: Column, piece: Callable[[Column, Column, Callable], Column]) -> Column:
    """The text with piece(span, place that is copied up to, cut) for each span by start, the longer first, and the rest after them."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["end"].alias("end"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def joined(o: Column, upto: Column, b: Column) -> Column:
        cut = lambda a, z: _cut(b, a, z)
        parts = F.transform(o, lambda s, i: piece(s, F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(upto, i - 1)), cut))
        return F.concat_ws("", parts, F.array(cut(F.element_at(upto, -1), F.length(text).cast("long"))))

    whole = let(order, lambda o: let(scan(F.transform(o, lambda s: s["end"]), F.greatest), lambda u: let(blocks, lambda b: joined(o, u, b))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    key = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(key, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(listed(spans, kinds), 256)
