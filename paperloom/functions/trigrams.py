"""Title trigrams: lower case, each word padded as ``"  word "``, distinct 3-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def trigrams(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def pieces(padded: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    grams = F.transform(F.array_distinct(found), lambda w: let(F.concat(F.lit("  "), w, F.lit(" ")), pieces))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared))
