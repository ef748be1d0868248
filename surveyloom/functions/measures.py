"""Measures: a column, or one column for each imputation, NULL where a respondent has no value.

A measure is a list of columns. One column is a plain variable; M columns are the M
imputations of a score. Shares are 100 or 0, so that their mean is a percentage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Measure = Sequence[Column]
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
}


def family(pattern: str, n: int) -> Measure:
    """Columns of an imputation family: ``family("pv{pv}a", 10)``; one column when ``{pv}`` is absent."""
    return [F.col(pattern.replace("{pv}", str(i))) for i in range(1, n + 1)] if "{pv}" in pattern else [F.col(pattern)]


def condition(column: str, op: str, value: object = None) -> Column:
    """One filter; several are joined by AND with ``all_of``."""
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    return COMPARE[op](F.col(column), value)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def share(test: Column, known: Column) -> Column:
    """100 where ``test`` holds, 0 where it does not, NULL where nothing is known."""
    return F.when(known, F.when(test, 100.0).otherwise(0.0))


def score(measure: Measure, divide_by: float = 1.0) -> Measure:
    return [c / F.lit(float(divide_by)) for c in measure]


def level_share(measure: Measure, op: str, cut: float) -> Measure:
    """Share of scores below / at or above / above / at or below a cut; each imputation guards itself."""
    return [share(COMPARE[op](c, cut), c.isNotNull()) for c in measure]


def joint_level_share(measures: Sequence[Measure], op: str, cut: float, every: bool) -> Measure:
    """Share that meets the cut in all (or any) domains; NULL only where all domains are NULL."""
    out = []
    for cols in zip(*measures, strict=True):
        tests = [F.coalesce(COMPARE[op](c, cut), F.lit(False)) for c in cols]
        out.append(share(reduce(and_ if every else or_, tests), F.coalesce(*cols).isNotNull()))
    return out


def code_share(column: Column, codes: Sequence, others: Sequence | None = None) -> Column:
    """Share of ``codes`` among all known values, or among ``codes`` and ``others``."""
    hit = column.isin(*codes)
    return share(hit, column.isNotNull() if others is None else hit | column.isin(*others))


def count_share(columns: Sequence[Column], code: object, n: int, exactly: bool = False) -> Column:
    """Share with (at least) ``n`` items that take ``code``; NULL only where all items are NULL."""
    hits = reduce(add, [F.coalesce((c == code).cast("int"), F.lit(0)) for c in columns])
    return share(hits == n if exactly else hits >= n, F.coalesce(*columns).isNotNull())


def sides(column: Column, a: Sequence, b: Sequence) -> Column:
    """Two code sets as 1 and 0; other values are NULL."""
    return F.when(column.isin(*a), 1).when(column.isin(*b), 0)


def dummies(column: Column, codes: Sequence, reference: Sequence) -> dict[object, Column]:
    """0/1 predictors, one a code; the other codes and the reference count as 0, further values are NULL."""
    known = column.isin(*codes, *reference)
    return {c: F.when(column == c, 1.0).when(known, 0.0) for c in codes}
