"""Character spans with DataFrame functions alone: where a pattern matches, as code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose spans are listed together.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: Column | str, kind: int, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` passes ``keep``, with that group as value.

    The text between matches (split) and the matches themselves have lengths that add up to the places; texts
    without a match take neither path.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.arrays_zip(
        F.split(text, pat, -1).alias("gap"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("value"),
    )

    def add(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")
        )
        more = F.when(
            x["match"].isNotNull() & keep(x["value"]), F.concat(seen["out"], F.array(span))
        ).otherwise(seen["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    # lists grow by copying, so matches are taken in chunks: each begins where the lengths of those before it end
    size = F.size(zipped)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda c: F.slice(zipped, c * CHUNK + 1, CHUNK))
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))
    reach = lambda chunk: F.aggregate(chunk, F.lit(0), lambda t, x: t + length(x))

    def spans_of(all_chunks: Column) -> Column:
        begins = F.aggregate(
            all_chunks,
            F.array(F.lit(0)),
            lambda seen, chunk: F.array_append(seen, F.element_at(seen, -1) + reach(chunk)),
        )

        def within(starts: Column) -> Column:
            def one(chunk: Column, i: Column) -> Column:
                zero = F.struct(F.get(starts, i).alias("at"), none().alias("out"))
                return F.aggregate(chunk, zero, add, lambda x: x["out"])

            return F.flatten(F.transform(all_chunks, one))

        return F.transform(F.array(begins), within)[0]

    return F.when(F.regexp_like(text, pat), F.transform(F.array(chunks), spans_of)[0]).otherwise(none())


def joined(spans: Column, kinds: tuple[str, ...], by: tuple[str, str]) -> Column:
    """kind:start:end, comma-joined, in the order of the two fields ``by`` (start, kind)."""
    other = "end"
    ranked = F.array_sort(
        F.transform(spans, lambda s: F.struct(s[by[0]].alias("a"), s[by[1]].alias("b"), s[other].alias("c")))
    )
    names = F.array(*[F.lit(k) for k in kinds])
    start, kind = ("a", "b") if by[0] == "start" else ("b", "a")
    return F.array_join(
        F.transform(
            ranked, lambda s: F.concat_ws(":", F.element_at(names, s[kind] + 1), s[start].cast("string"), s["c"].cast("string"))
        ),
        ",",
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, tags: tuple[str, ...]) -> Column:
    """The text with each span replaced by its kind's tag; where spans overlap, the earlier one is replaced and
    what the later one has beyond it is dropped with it."""
    names = F.array(*[F.lit(t) for t in tags])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(seen: Column, s: Column) -> Column:
        gap = F.substr(text, seen["at"] + 1, F.greatest(s["start"] - seen["at"], F.lit(0)))
        tag = F.when(s["start"] >= seen["at"], F.element_at(names, s["kind"] + 1)).otherwise(F.lit(""))
        return F.struct(
            F.greatest(seen["at"], s["end"]).alias("at"), F.concat(seen["out"], gap, tag).alias("out")
        )

    done = F.aggregate(F.array_sort(spans), zero, add, lambda x: F.concat(x["out"], F.substr(text, x["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
