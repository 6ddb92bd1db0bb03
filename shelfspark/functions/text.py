"""Text predicates and scalar functions over columns, all inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as spreadsheet text has it, with no-break space and byte-order mark.
SPACE = r"[\s ﻿]"


def text(c: Column | str) -> Column:
    """A cell as text; blank for null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    """All white space at both ends goes, tabs and no-break spaces included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def contains(c: Column | str, query: str) -> Column:
    """Case-insensitive substring test; every text contains the empty query."""
    return F.lower(text(c)).contains(query.lower())


def any_contains(columns: list[str | Column], query: str) -> Column:
    return reduce(lambda a, b: a | b, (contains(c, query) for c in columns))


def falsy(c: Column | str, other: Column) -> Column:
    """c, or other where c is null or blank."""
    return F.coalesce(F.nullif(text(c), F.lit("")), other)


def cut(c: Column | str, most: int = 500) -> Column:
    return F.left(text(c), F.lit(most))


def sparse(columns: list[str]) -> list[Column]:
    """Blank fields as null, so that JSON leaves them out."""
    return [F.nullif(text(c), F.lit("")).alias(c) for c in columns]


def json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sparse(columns)), {"ignoreNullFields": "true"})


def same_id(c: Column | str, value: str | int) -> Column:
    """Ids are compared as text: cells may hold numbers."""
    return text(c) == F.lit(str(value))


def new_id(prefix: str) -> Column:
    """A random id: prefix, five digits, a capital letter, four digits; a UUID without prefix. Not checked for collisions."""
    if not prefix:
        return F.expr("uuid()")
    digits = lambda n: F.lpad(F.floor(F.rand() * 10**n).cast("string"), n, "0")
    letter = F.char((F.lit(65) + F.floor(F.rand() * 26)).cast("int"))
    return F.concat(F.lit(prefix), digits(5), letter, digits(4))
