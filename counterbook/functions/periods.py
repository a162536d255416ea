"""Report periods and their default windows (plain Python date arithmetic on
the driver; only the resulting literals reach the plan)."""

from __future__ import annotations

import datetime as dt
import re

VALID_PERIODS = ("daily", "weekly", "monthly", "yearly", "custom")
# DATE_TRUNC unit per period
TRUNC_UNIT = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year", "custom": "day"}

_DATE_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


class ReportArgumentError(ValueError):
    pass


def _as_date(value: str | dt.date | dt.datetime | None) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if not _DATE_RE.match(str(value)):
        raise ReportArgumentError(f"date must be in YYYY-MM-DD format: {value!r}")
    return dt.date.fromisoformat(str(value))


def check_date_range(start, end) -> tuple[dt.date | None, dt.date | None]:
    s, e = _as_date(start), _as_date(end)
    if s is not None and e is not None and s > e:
        raise ReportArgumentError("`from` must not be after `to`")
    return s, e


def report_window(period: str, as_of: str | dt.date | dt.datetime) -> tuple[str, dt.date, dt.date]:
    """(trunc unit, default from, default to) for a period, relative to
    ``as_of``: 30 days, 12 weeks (84 days), 12 months from the first of the
    month 11 months back, 5 calendar years; custom is just the day."""
    period = (period or "daily").lower()
    if period not in VALID_PERIODS:
        raise ReportArgumentError(f"Invalid period. Must be one of: {', '.join(VALID_PERIODS)}")
    today = _as_date(as_of)
    if period == "daily":
        start = today - dt.timedelta(days=29)
    elif period == "weekly":
        start = today - dt.timedelta(days=83)
    elif period == "monthly":
        months = today.year * 12 + (today.month - 1) - 11
        start = dt.date(months // 12, months % 12 + 1, 1)
    elif period == "yearly":
        start = dt.date(today.year - 4, 1, 1)
    else:
        start = today
    return TRUNC_UNIT[period], start, today


def resolve_report_dates(period: str, start, end, as_of) -> tuple[str, dt.date, dt.date]:
    """Validation and defaults of the sales summary: known period, custom
    needs both dates, ``from`` not after ``to``; missing dates come from the
    period's default window."""
    period = (period or "daily").lower()
    if period not in VALID_PERIODS:
        raise ReportArgumentError(f"Invalid period. Must be one of: {', '.join(VALID_PERIODS)}")
    if period == "custom" and (not start or not end):
        raise ReportArgumentError('`from` and `to` are required when period is "custom"')
    s, e = check_date_range(start, end)
    unit, d_from, d_to = report_window(period, as_of)
    return unit, s or d_from, e or d_to
