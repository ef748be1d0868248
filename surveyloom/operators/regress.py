"""Weighted least squares on the replicate kernel: cross products in Spark, tiny solves in batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign
from ..sources.work import materialized
from .replicate import STATS, analysis_frame, combine, known_number, null_safe_join, stored, weighted_sums
from .stats import _quartered

INTERCEPT = "(intercept)"


def _frame(df: DataFrame, design: SurveyDesign, y: Sequence[Column], predictors: dict[str, Column], by: Sequence[str], where: Column | None) -> DataFrame:
    """Measures are NULL where a predictor is, so that each imputation deletes listwise. Two scans read it."""
    return _listwise(stored(df, design, _columns(y, predictors), by, where), design, len(y), len(predictors), by)


def _columns(y: Sequence[Column], predictors: dict[str, Column]) -> dict[str, Column]:
    if not 1 <= len(predictors) <= 6:
        raise ValueError("a regression takes 1 to 6 predictors")
    return {f"_y{i}": m for i, m in enumerate(y, 1)} | {f"_p{j}": p for j, p in enumerate(predictors.values(), 1)}


def _listwise(rows: DataFrame, design: SurveyDesign, n_y: int, k: int, by: Sequence[str]) -> DataFrame:
    """The frame of rows that have ``_columns``."""
    y, predictors = [F.col(f"_y{i}") for i in range(1, n_y + 1)], [F.col(f"_p{j}") for j in range(1, k + 1)]
    known = reduce(and_, [p.isNotNull() for p in predictors])
    xs = {f"x_{j}": p.cast("double") for j, p in enumerate(predictors, 1)}
    return analysis_frame(rows, design, [F.when(known, m.cast("double")) for m in y], by, None, xs | {"_known": known})


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k + 1) for b in range(a, k + 1)]


#: A predictor whose part that the others leave open is this share of its variance, or less, depends on them.
OPEN = 1e-10


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(coefficients with the intercept first, dependent predictor or 0, the single predictor that it repeats or 0).

    ``a`` and ``b`` are the cross products of the intercept and the predictors with each other and with the
    outcome. They are centred and scaled, so that correlations are left whatever the units, and decomposed
    predictor by predictor: of one that those before it determine the step leaves nothing. Such a system,
    and one without weight, has no coefficients (NaN).
    """
    k, none = len(a) - 1, np.full(len(a), np.nan)
    if not a[0, 0] > 0:
        return none, 1, 0
    mean, y = a[0, 1:] / a[0, 0], b[0] / a[0, 0]
    cov = a[1:, 1:] / a[0, 0] - np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = np.flatnonzero(size**2 <= OPEN * np.diag(a)[1:] / a[0, 0])
    if len(flat):
        return none, int(flat[0]) + 1, 0
    corr, low = cov / np.outer(size, size), np.zeros((k, k))
    for j in range(k):
        low[j, :j] = np.linalg.solve(low[:j, :j], corr[:j, j])
        rest = corr[j, j] - low[j, :j] @ low[j, :j]
        if rest <= OPEN:
            same = np.flatnonzero(corr[:j, j] ** 2 >= 1 - OPEN)
            return none, j + 1, int(same[0]) + 1 if len(same) else 0
        low[j, j] = np.sqrt(rest)
    right = (b[1:] / a[0, 0] - mean * y) / size
    slope = np.linalg.solve(low.T, np.linalg.solve(low, right)) / size
    return np.array([y - slope @ mean, *slope]), 0, 0


def _solved(frame: DataFrame, by: Sequence[str], n_y: int, names: Sequence[str], outcome: bool = True) -> tuple[DataFrame, DataFrame]:
    """(groups with a reason why they have no regression, ``[*by, rep, pv, STATS, beta, reason]`` of the others).

    A first scan without the weights counts values and takes each predictor's mean and range; in the second
    one predictors are shifted and scaled by these, so that cross products keep their digits. Whether a system
    has a solution is seen from its left side: without ``outcome`` there are no sums with it, and no counts.
    """
    k, counts = len(names), STATS if outcome else ()
    spans = materialized(_spans(frame, by, n_y, names), "spans")
    fit = null_safe_join(frame, spans.where("reason IS NULL").drop("reason"), by)
    terms: dict[str, Column] = {f"x_{j}": (F.col(f"x_{j}") - F.col("_shift")[j - 1]) / F.col("_range")[j - 1] for j in range(1, k + 1)}
    products: dict[str, tuple[str, ...]] = {}
    for i in range(1, n_y + 1):
        x = lambda *js: [f"x_{j}" for j in js if j]
        terms[f"known_{i}"] = F.col(f"m_{i}").isNotNull()
        products |= {f"a_{i}_{a}_{b}": (f"known_{i}", *x(a, b)) for a, b in _pairs(k)}
        if outcome:
            terms[f"m_{i}"] = F.col(f"m_{i}")
            products |= {f"c_{i}_{a}": (f"known_{i}", f"m_{i}", *x(a)) for a in range(k + 1)}
    sums = weighted_sums(fit, by, terms, [F.col("m_1").isNotNull()] if outcome else [], products).withColumnsRenamed({f"{c}_0": c for c in counts})
    right = lambda i: [f"c_{i}_{a}" for a in range(k + 1)] if outcome else [F.lit(0.0)] * (k + 1)
    cell = lambda i: F.struct(F.lit(i).alias("pv"), F.array(*[f"a_{i}_{a}_{b}" for a, b in _pairs(k)], *right(i)).alias("s"))
    long = sums.select(*by, "rep", F.explode(F.array(*[cell(i) for i in range(1, n_y + 1)])).alias("c"), *counts).select(*by, "rep", "c.pv", *counts, "c.s")
    long = null_safe_join(long, spans.select(*by, "_shift", "_range"), by)
    upper, n_keys = np.array(_pairs(k)), len(by) + 2 + len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            betas, reasons = [], []
            for s, shift, size in zip(*(batch.column(n_keys + c).to_pylist() for c in range(3)), strict=True):
                s, a = np.array(s), np.zeros((k + 1, k + 1))
                a[upper[:, 0], upper[:, 1]] = a[upper[:, 1], upper[:, 0]] = s[: len(upper)]
                beta, depends, on = solve(a, s[len(upper) :])
                beta[1:] = beta[1:] / size
                beta[0] -= beta[1:] @ np.array(shift)
                betas.append(None if depends else beta.tolist())
                reasons.append(f"{names[depends - 1]} depends on {names[on - 1] if on else 'the predictors before it'}" if depends else None)
            cols = [*(batch.column(c) for c in range(n_keys)), pa.array(betas, pa.list_(pa.float64())), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*by, "rep", "pv", *counts, "beta", "reason"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.select(*by, "rep", "pv", *counts).schema)
    return spans.where("reason IS NOT NULL").select(*by, "reason"), long.mapInArrow(run, f"{kinds}, beta array<double>, reason string")


def regression(df: DataFrame, design: SurveyDesign, y: Sequence[Column], predictors: dict[str, Column], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Coefficients with standard errors: ``[*by, term, ...]``; groups of ``regression_skipped`` are left out."""
    return _estimates(_frame(df, design, y, predictors, by, where), design, len(y), predictors, by)


def _estimates(frame: DataFrame, design: SurveyDesign, n_y: int, predictors: dict[str, Column], by: Sequence[str]) -> DataFrame:
    _, solved = _solved(frame, by, n_y, list(predictors))
    whole = solved.withColumn("_bad", F.max("reason").over(Window.partitionBy(*by))).where("_bad IS NULL")
    names = F.array(*[F.lit(x) for x in (INTERCEPT, *predictors)])
    cells = F.explode(F.arrays_zip(names.alias("term"), F.col("beta").alias("value"))).alias("_c")
    values = whole.select(*by, "rep", "pv", *STATS, cells).select(*by, "rep", "pv", *STATS, "_c.term", "_c.value")
    return combine(values, [*by, "term"], design)


def regression_by_quarter(df: DataFrame, design: SurveyDesign, y: Sequence[Column], predictors: dict[str, Column], over: Column, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    rows = _quartered(df, design, over, by, where, _columns(y, predictors))
    return _estimates(_listwise(rows, design, len(y), len(predictors), ["quarter", *by]), design, len(y), predictors, ["quarter", *by])


def _spans(frame: DataFrame, by: Sequence[str], n_y: int, names: Sequence[str]) -> DataFrame:
    """``[*by, reason, _shift, _range]``: what keeps a group out at once, and where its predictors lie."""
    k = len(names)
    full = reduce(and_, [F.col(f"m_{i}").isNotNull() for i in range(1, n_y + 1)])
    x = [F.when(full, F.col(f"x_{j}")) for j in range(1, k + 1)]
    counts = [F.count(f"m_{i}").alias(f"y{i}") for i in range(1, n_y + 1)] + [F.count(f"x_{j}").alias(f"n{j}") for j in range(1, k + 1)]
    places = [f(c).alias(f"{name}{j}") for j, c in enumerate(x, 1) for name, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    g = frame.groupBy(*by).agg(*counts, *places, F.count(F.when(full, 1)).alias("complete"))
    # the outcome counts only where all predictors are known, so they are named first
    reason = F.when(F.col("n1") == 0, f"{names[0]} has no values")
    for j, name in enumerate(names[1:], 2):
        reason = reason.when(F.col(f"n{j}") == 0, f"{name} has no values")
    reason = reason.when(F.least(*[F.col(f"y{i}") for i in range(1, n_y + 1)], F.lit(1 << 60)) == 0, "outcome has no values")
    reason = reason.when(F.col("complete") < k + 2, "too few complete rows")
    for j, name in enumerate(names, 1):
        reason = reason.when(F.col(f"low{j}") == F.col(f"high{j}"), f"{name} has a single value")
    ranges = F.array(*[F.col(f"high{j}") - F.col(f"low{j}") for j in range(1, k + 1)])
    return g.select(*by, reason.alias("reason"), F.array(*[f"mean{j}" for j in range(1, k + 1)]).alias("_shift"), ranges.alias("_range"))


def regression_skipped(df: DataFrame, design: SurveyDesign, y: Sequence[Column], predictors: dict[str, Column], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """(group, reason) of groups without a regression; a predictor that others determine is named.

    The reasons come from the very systems that ``regression`` solves, so every group is in one of the two. Of an
    outcome it only matters where there is one, and schools are not counted.
    """
    there = [F.when(known_number(m).isNotNull(), 1.0) for m in y]
    early, solved = _solved(_frame(df, replace(design, school=None), there, predictors, by, where), by, len(y), list(predictors), outcome=False)
    late = solved.where("reason IS NOT NULL").groupBy(*by).agg(F.min_by("reason", F.struct("pv", "rep")).alias("reason"))
    return early.unionByName(late.where("reason IS NOT NULL"))
