"""Filters with the semantics of document stores: missing values are neither equal nor lost."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def differs(c: Column, value) -> Column:
    """Not equal to value; null differs."""
    return ~c.eqNullSafe(F.lit(value))


def visible_to(viewer, owner: Column, public: Column, privacy: Column) -> Column:
    """Own rows, and public ones that aren't private; without a viewer public ones alone."""
    shown = F.coalesce(public, F.lit(False)) & differs(privacy, "private")
    return shown if viewer is None else F.coalesce(owner == F.lit(viewer), F.lit(False)) | shown


def level_or_label(level: Column, wanted, label: Column, old: list[str]) -> Column:
    """The wanted level or, where a row has none, one of the labels used before."""
    return F.coalesce(level == F.lit(wanted), F.lit(False)) | (level.isNull() & F.coalesce(label.isin(old), F.lit(False)))


def phrase(c: Column, query: str) -> Column:
    """Whether c holds the query's words in turn, in any case, with any white space between them."""
    return c.rlike("(?i)" + r"\s+".join(re.escape(w) for w in query.split()))


def any_column_like(columns: list[Column], query: str) -> Column:
    """Whether one of the columns holds the query as it is written, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(query))), F.lit(False)) for c in columns])


def holds_all(array: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, F.coalesce(array, F.array().cast("array<string>")))) == 0


def holds_none(array: Column, value) -> Column:
    """Not in the array; a null array holds nothing."""
    return ~F.coalesce(F.array_contains(array, value), F.lit(False))


def kept(deleted: Column) -> Column:
    """Rows not marked as deleted."""
    return ~deleted.eqNullSafe(F.lit(True))


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(otherwise)
