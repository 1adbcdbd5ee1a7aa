"""Run parameters: the calendar horizon and the dashboard filters."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Horizon:
    """Calendar bounds of the date spine and the month open-ended subscriptions run to.

    ``start``/``end`` bound the day calendar (``dim_date``); ``open_end`` is the last
    revenue month of a subscription without an end date. ``accounts`` is about how many accounts
    run through these months (0: not known); it sizes tasks and is no part of the calendar.
    """

    start: _dt.date
    end: _dt.date
    open_end: _dt.date
    accounts: int = field(default=0, compare=False)

    @property
    def first_month(self) -> _dt.date:
        """First first-of-month on or after ``start`` (the calendar's first month row)."""
        if self.start.day == 1:
            return self.start
        y, m = (self.start.year + 1, 1) if self.start.month == 12 else (self.start.year, self.start.month + 1)
        return _dt.date(y, m, 1)

    @property
    def months(self) -> int:
        """Calendar months from ``start`` to ``end``, both included."""
        return max(1, (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1)


# Horizon of the modelled product (18 months of generated history).
PRODUCT_HORIZON = Horizon(_dt.date(2024, 7, 1), _dt.date(2025, 12, 31), _dt.date(2025, 12, 1))

# Calendar of the TPC-H-like test tables at sf0.1; registered queries take theirs from the
# tables they read (``TestdataRaw.horizon``).
TESTDATA_HORIZON = Horizon(_dt.date(1995, 1, 1), _dt.date(2001, 12, 31), _dt.date(2001, 8, 1))


@dataclass(frozen=True)
class Filters:
    """Global dashboard filters; ``None`` (or ``"All"``) means no condition."""

    segment: str | None = None
    region: str | None = None
    channel: str | None = None

    def normalized(self) -> "Filters":
        def norm(v):
            return None if v in (None, "", "All") else v

        return Filters(norm(self.segment), norm(self.region), norm(self.channel))

    @property
    def is_empty(self) -> bool:
        f = self.normalized()
        return f.segment is None and f.region is None and f.channel is None


NO_FILTERS = Filters()
