"""Regular-expression spans as Spark expressions: code-point offsets, no Python on executors.

The pieces between matches (`split`) and the matches (`regexp_extract_all`) come from the same find loop, so their
lengths give each match's place. Higher-order functions are interpreted, so what an expression uses twice is bound once (`let`), and
running totals go by parts of `PART` items: all work here is in proportion to a text's length and its matches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
PART, BLOCK = 64, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """The totals up to and with each of an array of numbers from 0 up, by an operation for which 0 is neutral."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    grow = lambda a, x: F.concat(a, F.array(plus(last(a), x)))
    none = F.array().cast("array<int>")

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(PART)), lambda k: F.aggregate(F.slice(v, k + 1, PART), none, grow))
        bases = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda a, x: grow(a, last(x)))
        return let(parts, lambda p: let(bases(p), lambda b: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: plus(F.get(b, i), y))))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def blocks(text: Column) -> Column:
    """A text in pieces of BLOCK code points, so that cutting anywhere costs a block."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points start to end - 1 of a text in blocks; places before its start or after its end are empty."""
    a, n = F.greatest(start, F.lit(0)), F.lit(BLOCK)
    i, j = F.floor(a / n).cast("int"), F.floor((end - 1) / n).cast("int")
    piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    across = F.concat(F.substr(piece(i), a - i * n + 1), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(piece(j), F.lit(1), end - j * n))
    return F.when(end <= a, F.lit("")).when(i == j, F.substr(piece(i), a - i * n + 1, end - a)).otherwise(across)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of all leftmost non-overlapping matches; the pattern never matches empty text."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["hit"])), lambda x, y: x + y)
        return let(ends, lambda e: F.transform(found, lambda p, i: F.struct((F.get(e, i) - F.length(p["hit"])).alias("start"), F.get(e, i).alias("end"), p["hit"].alias("text"))))

    return let(F.filter(both, lambda p: p["hit"].isNotNull()), placed)


def clusters(found: Column) -> Column:
    """Spans (start, end, ...) in arrays of those that overlap, one after another, in the order of `sort_array`, which starts with
    start: a span that starts where all before it have ended opens a new one."""

    def parted(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        opens = let(reach, lambda r: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(r, i - 1)), i)), lambda i: i.isNotNull()))
        return let(opens, lambda o: F.transform(o, lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(o, k + 1), F.size(s)) - at)))

    return let(F.sort_array(found), parted)


def spans(text: Column, pattern: str, keep=None, hint: str | None = None) -> Column:
    """Matches that pass `keep`. `hint`: a cheap pattern that every matching text holds; others cost one look."""
    got = matches(text, pattern)
    if keep is not None:
        got = F.filter(got, keep)
    return F.when(text.rlike(hint or pattern), got).otherwise(F.array().cast(SPAN))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Of a string of digits, from the right: every second one doubled, nines cast out."""
    back = F.reverse(x)
    at = F.sequence(F.lit(0), F.length(x) - 1)
    each = F.transform(at, lambda i: F.substr(back, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return (F.length(x) > 0) & (total % 10 == 0)


def named(kind: str, rank: int, got: Column) -> Column:
    """(rank, start, end, kind) of each span, for sorting."""
    return F.transform(got, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def quoted(text: str) -> str:
    return re.escape(text)
