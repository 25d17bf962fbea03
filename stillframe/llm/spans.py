"""Regular-expression matches with positions, in SQL functions only.

Spark gives matches but not where they stand.  Here a mark is put around every match,
the text is split at the marks, and lengths of the parts are summed up.  Positions
count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks; a text's own ones are replaced by a third character, of which no pattern
#: here speaks, so matches and positions stay the same.
MARK, OTHER = "\x01", "\x03"
#: Parts that are summed up in one go; more are summed by blocks, so the work per text
#: grows far slower than the square of its matches.
BLOCK = 256


def clean(text: Column) -> Column:
    """``text`` (null: empty) without marks, of the same length."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit(MARK)), F.translate(t, MARK, OTHER)).otherwise(t)


def around(text: Column, pattern: str) -> Column:
    """Parts of a clean text: what lies before, in, between and behind the matches."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def between(text: Column, edges: str) -> Column:
    """As ``around``, for a zero-width pattern that matches where a span starts or ends."""
    return F.split(F.regexp_replace(text, edges, MARK), MARK, -1)


def _starts(lengths: Column, first: Column) -> Column:
    step = F.aggregate(
        lengths,
        F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
    )
    return step["out"]


def starts(parts: Column) -> Column:
    """Where each part starts."""
    lengths = F.transform(parts, lambda p: F.length(p))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.zip_with(blocks, _starts(sums, F.lit(0)), lambda b, first: _starts(b, first)))


def marked(parts: Column) -> Column:
    """array<struct<start, end, value>> of the matches among ``parts`` (every second one)."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    both = F.arrays_zip(parts.alias("value"), starts(parts).alias("start"))
    odd = F.filter(both, lambda x, i: i % 2 == 1)
    found = F.transform(
        odd,
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")
        ),
    )
    return F.when(F.size(parts) < 3, empty).otherwise(found)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind, in the form that ``joined`` takes."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["value"].alias("value"),
        ),
    )


def in_order(*spans: Column) -> Column:
    """All spans by start, then by the order of their kinds."""
    return F.array_sort(F.concat(*spans))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def labelled_again(spans: Column) -> Column:
    """Spans with further fields, cut down to those of ``labelled``."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )


def merged(spans: Column) -> Column:
    """Ordered spans as disjoint (start, end, kind): overlapping ones become one, of the
    first one's kind."""
    first = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        size = F.size(out)
        return (
            F.when(size == 0, F.array(own))
            .when(s["start"] < F.get(out, size - 1)["end"], F.concat(F.slice(out, 1, F.greatest(size - 1, F.lit(0))), F.array(wide)))
            .otherwise(F.concat(out, F.array(own)))
        )

    return F.aggregate(spans, first, add)


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the disjoint, ordered spans replaced by its kind in brackets."""
    n = F.size(spans)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.concat(
            F.when(i > 0, F.concat(F.lit("["), F.upper(F.get(spans, i - 1)["kind"]), F.lit("]"))).otherwise(F.lit("")),
            F.substring(
                text,
                F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)) + 1,
                F.when(i < n, F.get(spans, i)["start"]).otherwise(F.length(text)) - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)),
            ),
        ),
    )
    return F.array_join(pieces, "")
