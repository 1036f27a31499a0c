"""Growable arrays as Column functions. Positions count from 0; arrays do not change in place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _none(a) -> Column:
    """The empty array of a's type."""
    return F.slice(_c(a), 1, 0)


def push(a, value: Column) -> Column:
    return F.array_append(_c(a), value)


def pop(a) -> Column:
    """Without the last value; an empty array stays."""
    return F.slice(_c(a), F.lit(1), F.greatest(F.size(_c(a)) - 1, F.lit(0)))


def at(a, i: Column | int) -> Column:
    """The value at i, null outside."""
    return F.get(_c(a), F.lit(i) if isinstance(i, int) else i)


def front(a) -> Column:
    return at(a, 0)


def back(a) -> Column:
    return F.try_element_at(_c(a), F.lit(-1))


def append(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def equals(a, b) -> Column:
    return _c(a).eqNullSafe(_c(b))


def fill(a, value: Column) -> Column:
    """Every value replaced."""
    return F.transform(_c(a), lambda _: value)


def resized(a, n: int, value: Column) -> Column:
    """The first n values, filled up with value."""
    more = F.array_repeat(value, F.greatest(F.lit(n) - F.size(_c(a)), F.lit(0)))
    return F.concat(F.slice(_c(a), F.lit(1), F.least(F.size(_c(a)), F.lit(n))), more)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def inserted(a, i: int, b) -> Column:
    """The values of b put in before position i."""
    return F.concat(F.slice(_c(a), F.lit(1), F.least(F.lit(i), F.size(_c(a)))), _c(b), rest(a, i))


def rest(a, i: int) -> Column:
    """The values from position i on."""
    n = F.size(_c(a)) - i
    return F.when(n > 0, F.slice(_c(a), F.lit(i + 1), F.greatest(n, F.lit(0)))).otherwise(_none(a))


def erased(a, i: int, n: int = 1) -> Column:
    """Without n values from position i on."""
    return F.concat(F.slice(_c(a), F.lit(1), F.least(F.lit(i), F.size(_c(a)))), rest(a, i + n))
