"""Spans of code points in texts: a scanner as a column, digests of what it found."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
)
Span = tuple[str, int, int, float, bool]


def spans_of(scan: Callable[[str], list[Span]], kinds: tuple[str, ...], text: Column) -> Column:
    """The spans scan finds in text, by start, then by the kind's place in kinds, then by end."""
    order = {k: i for i, k in enumerate(kinds)}
    names = ("kind", "start", "end", "score", "base")

    @F.arrow_udf(SPAN)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            x = t.as_py()
            rows.append([dict(zip(names, s)) for s in sorted(scan(x), key=lambda s: (s[1], order[s[0]], s[2]))] if x else [])
        return pa.array(rows, _ARROW)

    return found(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])).cast("long")
