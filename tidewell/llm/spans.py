"""Matches of a pattern with their places, in SQL functions alone.

``regexp_extract_all`` gives the matched texts from left to right, ``split`` gives the texts
between them; the lengths of both, added up, are the places. Both take one pass over a text. Lengths are
added up in blocks of ``BLOCK`` matches, whose beginnings come from the sums of earlier blocks: arrays that grow
element by element stay that short, so the cost is in proportion to the matches (200,000 in one text take
seconds). A pattern must not match the empty text. Repeated groups must be possessive: the regular expression
engine recurses once a repetition of any other group, and a long run ends its stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points, from 0, end exclusive.
SPAN = "array<struct<start:int,end:int,match:string>>"
#: Matches whose places are added up by growing one array.
BLOCK = 256


def located(text: Column, pattern: str, where: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as SPAN; ``where`` is a cheap test that a text with matches passes."""
    none = F.array().cast("array<string>")

    def tested(x: Column) -> Column:
        return F.coalesce(x if where is None else F.when(where, x).otherwise(none), none)

    found = tested(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = tested(F.split(text, pattern, -1))
    # the text after the last match pairs with no match
    pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("match"), F.length(b).alias("before"), F.coalesce(F.length(m), F.lit(0)).alias("long")))
    return _let(pairs, _placed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _placed(pairs: Column) -> Column:
    blocks = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(blocks, lambda k: F.aggregate(block(k), F.lit(0), lambda n, p: n + p["before"] + p["long"]))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("done"))
    starts = F.aggregate(sums, none, lambda held, n: F.struct((held["at"] + n).alias("at"), F.concat(held["done"], F.array(held["at"])).alias("done")), lambda held: held["done"])

    def step(held: Column, pair: Column) -> Column:
        begin = held["at"] + pair["before"]
        end = begin + pair["long"]
        one = F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.when(pair["match"].isNull(), held).otherwise(F.struct(end.alias("at"), F.concat(held["done"], F.array(one)).alias("done")))

    def walked(k: Column, at: Column) -> Column:
        return F.aggregate(block(k), F.struct(at.alias("at"), F.array().cast(SPAN).alias("done")), step, lambda held: held["done"])

    return F.flatten(F.zip_with(blocks, starts, walked))


def labelled(kind: str, order: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
