"""Classification browsing. The options are a fixed list, so they compile to one disjunction instead of a theta join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import text, trim
from shelfspark.schemas import EXACT_CLASSIFICATIONS, NO_CLASSIFICATION, PREFIX_CLASSIFICATIONS, UNCLASSIFIED


def _item(c: Column | str) -> Column:
    return F.lower(trim(text(c)))


def matches(c: Column | str, selected: str) -> Column:
    """Whether a classification is the selected one, or starts with it where that option takes prefixes. Blank takes all."""
    sel = selected.strip().lower()
    if not sel:
        return F.lit(True)
    return _item(c).startswith(sel) if sel in {p.lower() for p in PREFIX_CLASSIFICATIONS} else _item(c) == sel


def matches_any(c: Column | str) -> Column:
    item = _item(c)
    return reduce(lambda a, p: a | item.startswith(p.lower()), PREFIX_CLASSIFICATIONS, item.isin([v.lower() for v in EXACT_CLASSIFICATIONS]))


def blank(c: Column | str) -> Column:
    return trim(text(c)) == ""


def selected(c: Column | str, value: str) -> Column:
    """The browse filter: an option, none at all, or anything that is no option."""
    if value == NO_CLASSIFICATION:
        return blank(c)
    if value == UNCLASSIFIED:
        return ~blank(c) & ~matches_any(c)
    return matches(c, value)
