"""Immutable description of what a report is asked for: filters, sort order, page."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date, timedelta

Day = date | str | None


def as_day(value: Day) -> date | None:
    """Dates pass through; of a text only the leading ISO day counts."""
    if value is None or value == "":
        return None
    return date.fromisoformat(value[:10]) if isinstance(value, str) else value


@dataclass(frozen=True)
class FilterSpec:
    """One filter state shared by all reports. Empty parts do not filter."""

    mediums: tuple[str, ...] = ()
    event_names: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    keyword: str | None = None
    start: Day = None
    end: Day = None

    def __post_init__(self):
        for name in ("mediums", "event_names", "countries", "categories"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))
        object.__setattr__(self, "keyword", (self.keyword or "").strip() or None)
        object.__setattr__(self, "start", as_day(self.start))
        object.__setattr__(self, "end", as_day(self.end))

    def without_events(self) -> FilterSpec:
        return replace(self, event_names=())

    def between(self, start: Day, end: Day) -> FilterSpec:
        return replace(self, start=start, end=end)

    def previous(self) -> FilterSpec | None:
        """The adjoining earlier range of equal length; None unless both bounds are set."""
        if self.start is None or self.end is None:
            return None
        days = (self.end - self.start).days
        last = self.start - timedelta(days=1)
        return self.between(last - timedelta(days=days), last)

    @property
    def narrows_events(self) -> bool:
        """True if a condition is set that only the event row can answer."""
        return bool(self.mediums or self.countries or self.keyword)


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = False


def sort_keys(requested: Iterable[Mapping[str, str]] | None,
              allowed: Iterable[str]) -> list[SortKey]:
    """Keep the requested keys that are allowed; any direction but 'asc' is descending."""
    allowed = set(allowed)
    return [
        SortKey(key["column_id"], key.get("direction") == "asc")
        for key in requested or ()
        if key.get("column_id") in allowed
    ]
