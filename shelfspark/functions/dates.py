"""Dates as long text, parsed to DATE; every rule takes the day it is judged on (as_of)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import text
from shelfspark.schemas import DATE_FORMAT

Day = dt.date | str | Column | None


def day(as_of: Day) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def parse(c: Column | str) -> Column:
    """A long date or yyyy-MM-dd; whatever is no such date is null."""
    t = text(c)
    return F.coalesce(F.try_to_date(t, DATE_FORMAT), F.try_to_date(t, "yyyy-MM-dd"))


def show(c: Column) -> Column:
    return F.date_format(c, DATE_FORMAT)


def overdue(due: Column | str, as_of: Day = None) -> Column:
    """Before the day; what is due on it, or is no date, is not overdue."""
    return F.coalesce(parse(due) < day(as_of), F.lit(False))


def not_yet_due(due: Column | str, as_of: Day = None) -> Column:
    return F.coalesce(parse(due) >= day(as_of), F.lit(False))


def membership(expiry: Column | str, as_of: Day = None) -> Column:
    """'active' if the membership ends after the day, else 'expired': also without a date."""
    return F.when(F.coalesce(parse(expiry) > day(as_of), F.lit(False)), "active").otherwise("expired")


def later(due: Column | str, days: int | Column = 21) -> Column:
    """A date's text, so many days later."""
    return show(F.date_add(parse(due), days))


def iso(c: Column | str) -> Column:
    """A timestamp in UTC as ISO text with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
