"""Spans of regular expressions by DataFrame functions alone.

Splitting a text by a pattern and extracting the pattern's matches see the same leftmost, non-overlapping matches, so the
lengths of the pieces, added up, place each match. Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1024  # code points
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def none() -> Column:
    return F.array().cast(SPAN)


def span(kind: str, start: Column, end: Column, score: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), score.cast("double").alias("score"))


#: Items that a fold gathers in one array before it starts the next, as appending copies the array.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gathered(items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], item: str) -> Column:
    """What step(state, x) = (next state, y) makes of items in turn: the array of all y, of the type item. Linear in items."""
    empty = F.array().cast(f"array<{item}>")

    def add(acc: Column, x: Column) -> Column:
        state, y = step(acc["state"], x)
        return F.struct(state.alias("state"), F.array_append(acc["found"], y).alias("found"))

    def whole(acc: Column, block: Column) -> Column:
        inner = F.struct(acc["state"].alias("state"), empty.alias("found"))
        return F.aggregate(block, inner, add, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["found"], r["found"]).alias("found")))

    def fold(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(begin.alias("state"), F.array().cast(f"array<array<{item}>>").alias("found"))
        return F.flatten(F.aggregate(blocks, start, whole, lambda acc: acc["found"]))

    return F.when(F.size(items) > 0, let(items, fold)).otherwise(empty)


def find(df: DataFrame, text: str, out: str, kind: str, pattern: str, maybe: Callable[[Column], Column],
         base: Callable[[Column], Column], bonus: Callable[[Column], Column], context: int, least: float) -> DataFrame:
    """Adds column out: the spans of pattern's matches whose base(match) + bonus(the context characters before) is at least
    least; a null base drops.

    maybe(text) is false only for texts without a match; it saves the work on most. pattern must not match empty text, and
    repeated groups in it should be possessive, as a greedy one takes stack for every turn.
    """
    there = maybe(F.col(text))
    empty = F.array().cast("array<string>")
    df = df.withColumn("_match", F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("_gap", F.when(F.size("_match") > 0, F.split(text, pattern, -1)).otherwise(empty))
    long = lambda c: F.length(c).cast("long")
    end = lambda c: F.right(c, F.lit(context))

    def part(m: Column, i: Column) -> Column:
        gap = F.get(F.col("_gap"), i)
        return F.struct(long(gap).alias("gap"), long(m).alias("size"), end(gap).alias("before"), end(m).alias("tail"), base(m).alias("base"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start, before = state["at"] + x["gap"], end(F.concat(state["tail"], x["before"]))
        state = F.struct((start + x["size"]).alias("at"), end(F.concat(before, x["tail"])).alias("tail"))
        return state, span(kind, start, start + x["size"], x["base"] + bonus(before))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"))
    found = gathered(F.transform("_match", part), begin, step, SPAN[6:-1])
    return df.withColumn(out, F.when(F.size("_match") > 0, F.filter(found, lambda s: s["score"] >= F.lit(least))).otherwise(none())).drop("_match", "_gap")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span, spans that overlap taken as one, replaced by its kind in square brackets."""
    in_order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int")))
    # The text in pieces of CHUNK code points, so that a part is cut out without a walk from its beginning.
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    begin = F.struct(F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        piece = F.struct(state["at"].alias("from"), F.when(s["start"] >= state["at"], s["start"]).alias("to"), s["kind"].alias("kind"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at")), piece

    pieces = F.filter(gathered(in_order, begin, step, "struct<from:long,to:long,kind:string>"), lambda p: p["to"].isNotNull())

    def cut(chunks: Column, p: Column) -> Column:
        first, last = F.floor(p["from"] / CHUNK).cast("int"), F.floor(p["to"] / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.concat(F.substring(near, (p["from"] % CHUNK + 1).cast("int"), (p["to"] - p["from"]).cast("int")), F.lit("["), F.upper(p["kind"]), F.lit("]"))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    parts = let(chunks, lambda all_: F.transform(pieces, lambda p: cut(all_, p)))
    whole = F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
