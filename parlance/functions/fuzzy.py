"""One-typo similarity of two short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_adjacent_swap(a: Column, b: Column) -> Column:
    """Equal lengths and exactly one pair of neighbours exchanged."""
    first = F.array_min(F.filter(
        F.sequence(F.lit(1), F.length(a)),
        lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)),
    ))
    swapped = F.concat(
        F.left(a, first - 1), F.substr(a, first + 1, F.lit(1)), F.substr(a, first, F.lit(1)), F.substr(a, first + 2),
    )
    return swapped == b


def similar(a: Column, b: Column, min_fuzzy_len: int = 4) -> Column:
    """Equal, or one substitution, insertion, deletion or adjacent swap apart when both are at
    least `min_fuzzy_len` long. Empty strings match nothing."""
    la, lb = F.length(a), F.length(b)
    long_enough = (F.least(la, lb) >= min_fuzzy_len) & (F.abs(la - lb) <= 1)
    near = F.levenshtein(a, b, 2)
    typo = F.when(near == 1, True).when((near == 2) & (la == lb), _one_adjacent_swap(a, b)).otherwise(False)
    return F.when((la == 0) | (lb == 0), False).when(a == b, True).when(long_enough, typo).otherwise(False)
