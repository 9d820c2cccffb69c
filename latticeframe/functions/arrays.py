"""Small helpers for expressions over arrays inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(array) -> Column:
    """The array itself, as an expression, for use inside ``explode``.

    For an explode of a plain column Spark infers a filter on its size and pushes it below
    the projection that computes the column, which would then be computed twice.
    """
    c = F.col(array) if isinstance(array, str) else array
    return F.slice(c, F.lit(1), F.size(c))


def last_value_map(pairs: Column, name: str, value: str) -> Column:
    """Map from an array of structs; a repeated name keeps its last value."""

    def build(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, lambda x: x[name]))
        last = lambda n: F.element_at(F.filter(p, lambda x: x[name] == n), -1)[value]
        return F.map_from_arrays(names, F.transform(names, last))

    return let(pairs, build)
