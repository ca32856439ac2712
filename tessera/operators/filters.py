"""Predicates: optional filters, keyword search, metadata filters, scopes, upload policies."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(c: Column, value) -> Column:
    """Equality if a value is given, else true."""
    return F.lit(True) if value is None else c == F.lit(value)


def keyword(query: str | None, *fields: Column, allowed: Mapping[str, Column] | None = None, chosen: Iterable[str] = ()) -> Column:
    """Whether any field contains the query in any case; ``%`` and ``_`` in the query are wildcards, a blank query
    holds for every row. With ``allowed`` only the chosen ones of its fields are searched, all if none is."""
    text = (query or "").strip().lower()
    if not text:
        return F.lit(True)
    if allowed is not None:
        fields = tuple(allowed[k] for k in chosen if k in allowed) or tuple(allowed.values())
    return reduce(Column.__or__, [F.lower(F.coalesce(f, F.lit(""))).like(f"%{text}%") for f in fields])


def in_list(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is listed; nothing for an empty list."""
    values = list(values)
    return df.where(F.col(column).isin(values)) if values else df.limit(0)


@dataclass
class Conditions:
    """Conditions that are added as they are given; together they hold if all do."""

    parts: list[Column] = field(default_factory=list)

    def equals(self, c: Column, value) -> Conditions:
        return self if value is None else Conditions([*self.parts, c == F.lit(value)])

    def like(self, c: Column, value: str | None) -> Conditions:
        return self if not value else Conditions([*self.parts, F.lower(c).like(f"%{value.lower()}%")])

    def between(self, c: Column, start: datetime.datetime | None, end: datetime.datetime | None) -> Conditions:
        """The half-open interval from start to end."""
        parts = ([c >= F.lit(start)] if start is not None else []) + ([c < F.lit(end)] if end is not None else [])
        return Conditions([*self.parts, *parts])

    def all(self) -> Column:
        return reduce(Column.__and__, self.parts, F.lit(True))


@dataclass(frozen=True)
class Range:
    """Bounds of a value, each in or out; at least one is needed, and they must not cross. With bounds that are numbers a
    value that is none is out."""

    low: float | str | None = None
    high: float | str | None = None
    with_low: bool = True
    with_high: bool = True

    def __post_init__(self):
        if self.low is None and self.high is None:
            raise ValueError("a range needs a bound")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError("a range's bounds must not cross")

    def holds(self, c: Column) -> Column:
        typed = c.try_cast("double") if isinstance(self.low if self.low is not None else self.high, int | float) else c
        parts = []
        if self.low is not None:
            parts.append(typed >= self.low if self.with_low else typed > self.low)
        if self.high is not None:
            parts.append(typed <= self.high if self.with_high else typed < self.high)
        return reduce(Column.__and__, parts)


@dataclass(frozen=True)
class MetadataFilter:
    """Criteria on a string map, and an object scope on columns of its own. Values compare as strings; ranges, which
    compare by type, only count with ``use_ranges``."""

    equals: Mapping[str, object] = field(default_factory=dict)
    among: Mapping[str, Iterable] = field(default_factory=dict)
    ranges: Mapping[str, Range] = field(default_factory=dict)
    object_type: str | None = None
    object_id: str | None = None
    use_ranges: bool = False

    def cleaned(self) -> MetadataFilter:
        """Keys trimmed, blank keys and values dropped, lists without repeats; scope keys become the scope."""

        def text(v) -> str | None:
            s = None if v is None else str(v).strip() if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
            return s or None

        same = {k.strip(): text(v) for k, v in self.equals.items() if k and k.strip() and text(v)}
        lists = {k.strip(): list(dict.fromkeys(filter(None, map(text, vs)))) for k, vs in self.among.items() if k and k.strip()}
        return MetadataFilter(
            {k: v for k, v in same.items() if k not in ("objectType", "objectId")},
            {k: v for k, v in lists.items() if v and k not in ("objectType", "objectId")},
            dict(self.ranges), text(self.object_type) or same.get("objectType"), text(self.object_id) or same.get("objectId"), self.use_ranges,
        )

    def predicate(self, metadata: Column, type_col: Column, id_col: Column, any_case: bool = False) -> Column:
        """The condition on rows, to be applied before any ranking. ``any_case``: types compare in any case."""
        f = self.cleaned()
        parts = [metadata[k] == v for k, v in f.equals.items()] + [metadata[k].isin(*v) for k, v in f.among.items()]
        if f.use_ranges:
            parts += [r.holds(metadata[k]) for k, r in f.ranges.items()]
        if f.object_type:
            parts.append(F.lower(type_col) == f.object_type.lower() if any_case else type_col == f.object_type)
        if f.object_id:
            parts.append(id_col == f.object_id)
        return reduce(Column.__and__, parts, F.lit(True))


def upload_violation(size: Column, extension: Column, mime: Column, status: Column, max_mb: Column, extensions: Column, mimes: Column) -> Column:
    """The first rule an upload breaks, null if none: status, size, allowed extensions, allowed types (``type/*``
    allows a family). Empty or null lists allow everything."""
    listed = F.transform(F.split(F.lower(F.coalesce(extensions, F.lit(""))), ","), lambda x: F.trim(x))
    kinds = F.transform(F.split(F.lower(F.coalesce(mimes, F.lit(""))), ","), lambda x: F.trim(x))
    given = lambda a: F.exists(a, lambda x: x != "")
    family = F.concat(F.split_part(F.lower(mime), F.lit("/"), F.lit(1)), F.lit("/*"))
    return (
        F.when(F.upper(status).isin("DISABLED", "DEPRECATED"), F.lit("STATUS"))
        .when(size > max_mb * F.lit(1 << 20), F.lit("SIZE"))
        .when(given(listed) & ~F.coalesce(F.array_contains(listed, F.lower(extension)), F.lit(False)), F.lit("EXTENSION"))
        .when(given(kinds) & ~F.coalesce(F.array_contains(kinds, F.lower(mime)) | F.array_contains(kinds, family), F.lit(False)), F.lit("MIME"))
    )
