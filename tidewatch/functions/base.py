"""Small expression helpers shared by the function modules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    """Null-safe string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def any_of(terms, prefix: str = "", suffix: str = "") -> str:
    """Regular expression matching any of the literal `terms`."""
    return prefix + "(?:" + "|".join(re.escape(t) for t in terms) + ")" + suffix


def contains_any(c, terms) -> Column:
    """Whether any literal term occurs.

    One pattern rather than one test per term: as fast when measured, and the
    plan stays small where the optimizer copies the expression.
    """
    return col(c).rlike(any_of(terms)) if terms else F.lit(False)


def starts_with_any(c, terms) -> Column:
    return col(c).rlike(any_of(terms, prefix="^")) if terms else F.lit(False)


def choose(c, mapping: dict, default=None) -> Column:
    """Lookup in a literal map.

    One reference to `c`, so the optimizer cannot multiply a long expression
    behind it the way a CASE per key would.
    """
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), col(c))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def micros(c) -> Column:
    """Timestamp as microseconds since the epoch (session zone is UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c) -> Column:
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def ntz(value: str) -> Column:
    """Literal timestamp without zone."""
    return F.lit(value).cast("timestamp_ntz")


def fmt_ts(c, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(c).cast("timestamp"), pattern)


def int_div(a, b) -> Column:
    """Exact integer quotient."""
    return F.call_function("div", col(a), F.lit(b))
