"""Array, map and row functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_at(a: Column, i: Column) -> Column:
    """a[i], 1-based; NULL at or below zero and beyond the end."""
    return F.get(a, i.cast("int") - 1)


def map_value(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def cardinality(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def element(a: Column) -> Column:
    """The only element; NULL for an empty array; several raise."""
    single = F.when(F.size(a) > 1, F.raise_error(F.lit("array has more than one element")).cast("boolean")).otherwise(F.lit(True))
    return F.when(single, F.get(a, F.lit(0)))


def contains(a: Column, needle: Column) -> Column:
    """ARRAY_CONTAINS; a NULL needle finds a NULL element, a NULL array gives NULL."""
    return F.when(a.isNotNull(), F.exists(a, lambda x: x.eqNullSafe(needle)))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def append(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def prepend(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def position(a: Column, x: Column) -> Column:
    return F.array_position(a, x)


def remove(a: Column, needle: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(needle))


def join(a: Column, delimiter: str, missing: str | None = None) -> Column:
    return F.array_join(a, delimiter, missing)


def sort(a: Column, ascending: bool = True, nulls_first: bool | None = None) -> Column:
    """ARRAY_SORT; NULLs first ascending and last descending, unless said."""
    if nulls_first is None or nulls_first == ascending:
        return F.sort_array(a, ascending)
    some, none = F.sort_array(F.array_compact(a), ascending), F.filter(a, lambda x: x.isNull())
    return F.concat(none, some) if nulls_first else F.concat(some, none)


def slice_of(a: Column, start: Column, end: Column | None = None) -> Column:
    """ARRAY_SLICE with 1-based inclusive bounds; negatives count from the end, 0 as start means 1, 0 as end nothing."""
    n = F.size(a)
    s = F.when(start < 0, F.greatest(n + start + 1, F.lit(1))).otherwise(F.greatest(start, F.lit(1)))
    e = n if end is None else F.when(end < 0, n + end + 1).otherwise(F.least(end, n))
    return F.when(a.isNotNull() & start.isNotNull() & (F.lit(True) if end is None else end.isNotNull()), F.when(e >= s, F.slice(a, s, F.greatest(e - s + 1, F.lit(0)))).otherwise(F.slice(a, 1, 0)))


def distinct(a: Column) -> Column:
    return F.array_distinct(a)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def entries_key(m: Column) -> Column:
    """A map as a sorted array of entries, to group or join by."""
    return F.array_sort(F.map_entries(m))
