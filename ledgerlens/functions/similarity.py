"""Similarity of names, 0 to 1, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; for texts over 200 characters the difference in length."""
    far = (F.length(a) > 200) | (F.length(b) > 200)
    return F.when(far, F.abs(F.length(a) - F.length(b))).otherwise(F.levenshtein(a, b))


def token_jaccard(a: Column, b: Column) -> Column:
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    """The best of: edit similarity, its blend with shared words, and 0.9 if all words of a stand in b."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(ta, tb))
    near = 1 - edit_distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    contained = F.when((F.size(ta) > 1) & (shared == F.size(ta)), 0.9).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(token_jaccard(a, b) * 0.6 + near * 0.4, near, contained))
