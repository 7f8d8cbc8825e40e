"""Small column helpers shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# White space as Python and Java's Unicode mode see it, as trim characters and as a pattern.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst may inline a projected column into the lambda of a higher-order
    function, where it would be evaluated once per element. Binding through a
    one-element array prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(BLANKS))


def collapse(col: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return strip(F.regexp_replace(col, BLANK + "+", " "))


def has_text(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(has_text(col), col)


def words(col: Column) -> Column:
    """White-space separated words; empty text gives an empty array."""
    return let(
        strip(col),
        lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, BLANK + "+")),
    )


def alnum_key(col: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def long(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
