"""Places of pattern matches in whole texts, by built-in functions alone.

A span is struct(s, o, e, k): start and end in code points (end exclusive), the order of its kind, the kind.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.llm.common import let

SPANS = "array<struct<s:int,o:int,e:int,k:string>>"
#: A match with the characters before and after it.
FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
CONTEXT = 40


#: Elements that a fold appends to one array before the next array begins; appending copies what is there.
CHUNK = 256


def chunks(items: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK))
    return F.transform(starts, lambda i: F.slice(items, i, CHUNK))


def scanned(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Walks items from left to right; step(state, item) gives the next state and an array of what the item yields, of type `kind`.

    Gives all yields in order. What is found is gathered in chunks, so the cost grows with the number of items and not with its square.
    """

    def one(acc: Column, x: Column) -> Column:
        after, made = step(acc.state, x)
        more = let(made, lambda m: F.when(F.size(m) > 0, F.concat(acc.out, m)).otherwise(acc.out))
        return F.struct(after.alias("state"), more.alias("out"))

    def many(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc.state.alias("state"), F.array().cast(kind).alias("out")), one)
        return let(inner, lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, F.array(r.out)).alias("out")))

    return F.flatten(F.aggregate(chunks(items), F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), many, lambda acc: acc.out))


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """FOUND for the leftmost non-overlapping matches of which keep(match) holds.

    The text is split at the matches; the lengths of pieces and matches are summed from left to right. Texts without a match skip all this.
    """
    none = F.array().cast(FOUND)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.struct(a.alias("gap"), b.alias("m")))

    def walked(parts: Column) -> Column:
        def step(state: Column, x: Column) -> tuple[Column, Column]:
            at = state.at + F.length(x.gap)
            end = at + F.length(x.m)
            before = F.right(x.gap, F.lit(CONTEXT))
            after = F.left(F.get(parts, state.i + 1).gap, F.lit(CONTEXT))
            item = F.struct(at.alias("s"), end.alias("e"), x.m.alias("m"), before.alias("before"), after.alias("after"))
            ok = x.m.isNotNull() & (keep(x.m) if keep else F.lit(True))
            return F.struct(F.coalesce(end, at).alias("at"), (state.i + 1).alias("i")), F.when(ok, F.array(item)).otherwise(none)

        return scanned(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("i")), FOUND, step)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, walked)).otherwise(none)


def as_spans(found: Column, kind: str, order: int) -> Column:
    make = lambda x: F.struct(x.s.alias("s"), F.lit(order).alias("o"), x.e.alias("e"), F.lit(kind).alias("k"))
    return F.transform(found, make).cast(SPANS)


def apart(found: Column, spans: Column, kind: str, inside: bool = False) -> Column:
    """The elements (s, e and more, an array of type kind) that overlap none of spans, or, with inside, that lie in none of them; by their ends.

    One walk over the starts of spans and the ends of elements, in order of place: an element's end sees how far the spans that began
    before it reach, or, with inside, how far those reach that began at its start or before.
    """
    field = "s" if inside else "e"

    def step(far: Column, event: Column) -> tuple[Column, Column]:
        free = event.x.isNotNull() & ((far < event.x.e) if inside else (far <= event.x.s))
        return F.greatest(far, event.reach), F.when(free, F.array(event.x)).otherwise(F.array().cast(kind))

    def walk(found: Column, spans: Column) -> Column:
        # Equal places: a span that begins where an element ends doesn't overlap it; one that begins where it starts may hold it.
        none = F.lit(None).cast(kind.removeprefix("array<")[:-1])
        begins = F.transform(spans, lambda y: F.struct(y.s.alias("at"), F.lit(0 if inside else 1).alias("t"), y.e.alias("reach"), none.alias("x")))
        asks = F.transform(found, lambda x: F.struct(x[field].alias("at"), F.lit(1 if inside else 0).alias("t"), F.lit(None).cast("int").alias("reach"), x.alias("x")))
        return let(F.sort_array(F.concat(begins, asks)), lambda events: scanned(events, F.lit(0), kind, step))

    return let(found, lambda f: F.when(F.size(f) > 0, let(spans, lambda s: F.when(F.size(s) > 0, walk(f, s)).otherwise(f))).otherwise(f))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then order of kind, joined by commas."""
    line = lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), line), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the kind of its first in angle brackets."""

    def many(acc: Column, part: Column) -> Column:
        """A chunk of spans cuts its own piece of the text, so no step reads the text from its start."""
        far = F.greatest(acc.at, F.array_max(F.transform(part, lambda x: x.e)))

        def cut(piece: Column) -> Column:
            def one(inner: Column, x: Column) -> Column:
                new = F.concat(piece.substr(inner.at - acc.at + 1, x.s - inner.at), F.lit("<"), x.k, F.lit(">"))
                return F.struct(F.greatest(inner.at, x.e).alias("at"), F.when(x.s >= inner.at, F.concat(inner.out, F.array(new))).otherwise(inner.out).alias("out"))

            return F.aggregate(part, F.struct(acc.at.alias("at"), F.array().cast("array<string>").alias("out")), one)

        return let(let(text.substr(acc.at + 1, far - acc.at), cut), lambda r: F.struct(r.at.alias("at"), F.concat(acc.out, F.array(F.array_join(r.out, ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    finish = lambda acc: F.concat(F.array_join(acc.out, ""), text.substr(acc.at + 1, F.length(text)))
    return F.when(F.size(spans) > 0, let(F.sort_array(spans), lambda x: F.aggregate(chunks(x), start, many, finish))).otherwise(text)
