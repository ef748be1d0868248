"""Replicate estimates and their combination: the kernel of all statistics.

A *replicate frame* has ``[*by, pv, rep, value, n, n_schools, wcov]``: an estimate for each
group, imputation and weight (rep 0 is the full sample). Every statistic is built from sums
of weight times a row's term. Catalyst computes the terms, each Arrow batch multiplies its
weight matrix with them, and Spark adds the batches' sums: groups x reps rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign
from ..sources.work import materialized

STATS = ("n", "n_schools", "wcov")

#: Bytes of sums that a task holds.
HELD = 64 << 20


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that match NULL with NULL; keys come once, from the side that has them.

    Without keys both sides are one group each, and so one row each of result frames.
    """
    if not keys:
        return a.crossJoin(b)
    renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    out = a.join(renamed, on, how)
    key = (lambda k: F.coalesce(a[k], F.col(f"_r_{k}"))) if how in ("full", "right", "outer") else (lambda k: a[k])
    rest = [c for c in a.columns if c not in keys] + [c for c in renamed.columns if not c.startswith("_r_")]
    return out.select(*[key(k).alias(k) for k in keys], *rest)


def known_number(c: Column) -> Column:
    """A column as double in which NaN is NULL, as a missing answer is."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def stored(df: DataFrame, design: SurveyDesign, columns: dict[str, Column], keep: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """The rows with further columns, for operators that read them several times.

    Where the design can make the weights from few columns, these, ``keep`` and the new columns are written once,
    so that whatever joins the rows come from run once; the weights are made again at every reading.
    """
    rows = df if where is None else df.where(where)
    if not design.make:
        return rows.withColumns(columns)
    school = [design.school] if design.school and design.school in df.columns else []
    names = dict.fromkeys([*keep, design.weight, *school, *design.made_from])
    return design.make(materialized(rows.select(*[F.col(c) for c in names if c not in columns], *[c.alias(k) for k, c in columns.items()]), "rows"))


def analysis_frame(df: DataFrame, design: SurveyDesign, measures: Sequence[Column], by: Sequence[str] = (), where: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Groups, measures ``m_1..`` (NaN is NULL), named extras, the weights as one array, the full-sample weight, and the school.

    A filter comes before everything else. A row without a full-sample weight weighs nothing.
    """
    rows = df if where is None else df.where(where)
    school = F.col(design.school) if design.school and design.school in df.columns else F.lit(None).cast("long")
    return rows.select(
        *[F.col(b) for b in by],
        *[known_number(m).alias(f"m_{i}") for i, m in enumerate(measures, 1)],
        *[c.alias(k) for k, c in (extra or {}).items()],
        design.weights.alias("_weights"),
        F.coalesce(F.col(design.weight).cast("double"), F.lit(0.0)).alias("_w0"),
        school.alias("_school"),
    )


def group_stats(frame: DataFrame, by: Sequence[str], seen: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """Rows and schools with a value of the first measure, and the weighted share of such rows.

    ``n_schools`` is -1 where no row of the group has a school. ``more`` are further aggregates of the same scan.
    """
    seen = F.col("m_1").isNotNull() if seen is None else seen
    schools = F.count_distinct(F.when(seen, F.col("_school")))
    return frame.groupBy(*by).agg(
        F.count(F.when(seen, 1)).alias("n"),
        F.when(F.count("_school") > 0, schools).otherwise(F.lit(-1)).alias("n_schools"),
        F.try_divide(F.sum(F.when(seen, F.col("_w0"))), F.sum("_w0")).alias("wcov"),
        *more,
    )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """An array column as a matrix; missing and not-a-number weights weigh nothing."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return (np.nan_to_num(flat) if np.isnan(flat).any() else flat).reshape(rows, -1)


def _codes(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """One number per row that tells its values of these columns apart; NULL is a value."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in columns:
        own = batch.column(k).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    return code


def weighted_sums(frame: DataFrame, by: Sequence[str], terms: dict[str, Column], seen: Sequence[Column] = (), products: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``[*by, rep, *terms]``: sum of weight x term of every group and weight; a NULL term adds nothing.

    For every condition in ``seen`` there are also ``n_k``, ``n_schools_k`` and ``wcov_k`` (k from 0), as in
    ``group_stats``, from the same scan: batches send their groups' schools beside the sums, marked by
    rep -1. With ``products``, these are summed instead: each is the product of the named terms, and nothing
    where the first of them is 0. Batches make them, so that only the factors leave Spark. A task adds up to
    ``HELD`` bytes of sums before it sends any, and sends them in rows as narrow as those of the schools, which are many.
    """
    flat = F.array(*[F.coalesce(t.cast("double"), F.lit(0.0)) for t in terms.values()])
    # empty where nothing is asked: of a list column that is always NULL Arrow writes all offsets again at every row
    seen_flat = F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in seen]).cast("array<double>")
    school = F.col("_school") if seen else F.lit(None).cast("long")
    rows = frame.select(*by, flat.alias("_x"), "_weights", seen_flat.alias("_seen"), school.alias("_school"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    sums_of = list(products or terms)
    at = {t: k for k, t in enumerate(terms)}
    factors = [[at[f] for f in fs] for fs in (products or {}).values()]
    n_by, n_factors, n_terms, n_seen = len(by), len(terms), len(sums_of), len(seen)
    width = 1 + 2 * n_seen if seen else n_terms
    parts, most = -(-n_terms // width), HELD // 8
    names = [*by, "_rep", "_part", "_school", *[f"_v{k}" for k in range(width)]]
    fields = [f"`{x}` {kinds[x]}" for x in by] + ["_rep int", "_part int", f"_school {kinds['_school']}"] + [f"_v{k} double" for k in range(width)]

    def out(keys: list[pa.Array], rep: np.ndarray, part: np.ndarray, school: pa.Array, values: Iterable[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, pa.array(rep.astype(np.int32)), pa.array(part.astype(np.int32)), school, *[pa.array(v) for v in values]], names=names)

    def told(firsts: list[list[pa.Array]], sums: np.ndarray, school: pa.DataType) -> pa.RecordBatch:
        """The sums (groups, reps, terms) as rows of ``width`` terms."""
        groups, reps, _ = sums.shape
        cells = np.zeros((groups, reps, parts * width))
        cells[:, :, :n_terms] = sums
        cells = cells.reshape(-1, width)
        where = pa.array(np.repeat(np.arange(groups), reps * parts))
        keys = [pa.concat_arrays([f[k] for f in firsts]).take(where) for k in range(n_by)]
        rep, part = np.tile(np.repeat(np.arange(reps), parts), groups), np.tile(np.arange(parts), groups * reps)
        return out(keys, rep, part, pa.nulls(len(cells), school), np.ascontiguousarray(cells.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[pa.Array], np.ndarray]] = {}
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(n_by + 3).type
            x = batch.column(n_by).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_factors)
            if factors:
                f = np.ascontiguousarray(x.T)
                x = np.column_stack([np.where(f[fs[0]] != 0, reduce(np.multiply, [f[k] for k in fs]), 0.0) for fs in factors])
            w = _matrix(batch.column(n_by + 1), batch.num_rows)
            code = _codes(batch, range(n_by))
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            w_in, x_in, ends = w[order], x[order], [*cuts[1:], len(order)]
            for a, b in zip(cuts, ends, strict=True):
                sums = w_in[a:b].T @ x_in[a:b]
                first = [batch.column(k).slice(int(order[a]), 1) for k in range(n_by)]
                key = tuple(c[0] for c in first)
                if key in held:
                    np.add(held[key][1], sums, out=held[key][1])
                    continue
                if (len(held) + 1) * sums.size > most and held:
                    yield told([f for f, _ in held.values()], np.stack([v for _, v in held.values()]), kind)
                    held.clear()
                held[key] = first, sums
            if n_seen:
                met = batch.column(n_by + 2).flatten().to_numpy().reshape(batch.num_rows, n_seen)
                pair = _codes(batch, [*range(n_by), n_by + 3])
                _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
                total = lambda v: np.bincount(inverse, v)  # noqa: E731, B023
                values = [total(w[:, 0])] + [v for j in range(n_seen) for v in (total(met[:, j]), total(met[:, j] * w[:, 0]))]
                one = pa.array(first)
                yield out([batch.column(k).take(one) for k in range(n_by)], np.full(len(first), -1), np.zeros(len(first)), batch.column(n_by + 3).take(one), values)
        if held:
            yield told([f for f, _ in held.values()], np.stack([v for _, v in held.values()]), kind)

    sent = rows.mapInArrow(run, ", ".join(fields)).groupBy(*by, "_rep", "_part", "_school").agg(*[F.sum(f"_v{k}").alias(f"_v{k}") for k in range(width)])
    apart = F.col("_rep") < 0
    has = apart & F.col("_school").isNotNull()
    stats = []
    for k in range(n_seen):
        many, weight = F.col(f"_v{1 + 2 * k}"), F.col(f"_v{2 + 2 * k}")
        stats += [
            F.sum(F.when(apart, many)).cast("long").alias(f"n_{k}"),
            F.when(F.count_if(has) > 0, F.count_if(has & (many > 0))).otherwise(F.lit(-1)).alias(f"n_schools_{k}"),
            F.try_divide(F.sum(F.when(apart & (many > 0), weight)), F.sum(F.when(apart, F.col("_v0")))).alias(f"wcov_{k}"),
        ]
    counts = [f"{c}_{k}" for k in range(n_seen) for c in STATS]
    # a group's cells come together with its counts, so that the rows are read once; every group has all parts of all weights
    cell = F.struct("_rep", "_part", F.array(*[f"_v{k}" for k in range(width)]).alias("v"))
    one = sent.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(~apart, cell))).alias("_cells"), *stats)
    row = lambda r: F.struct(r.alias("rep"), F.flatten(F.transform(F.slice("_cells", r * parts + 1, F.lit(parts)), lambda c: c["v"])).alias("v"))
    reps = F.when(F.size("_cells") > 0, F.sequence(F.lit(0), (F.size("_cells") / parts).cast("int") - 1))
    long = one.select(*by, F.explode(F.transform(reps, row)).alias("_c"), *counts)
    return long.select(*by, "_c.rep", *[F.get("_c.v", F.lit(k)).alias(t) for k, t in enumerate(sums_of)], *counts)


def stack(wide: DataFrame, keys: Sequence[str], values: dict[int, Column]) -> DataFrame:
    """One row per imputation from one column each."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pv"), v.alias("value")) for i, v in values.items()]))
    return wide.select(*keys, cells.alias("_c")).select(*[k for k in keys if k not in STATS], "_c.pv", "_c.value", *[k for k in keys if k in STATS])


def with_stats(values: DataFrame, frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts from a scan of their own, for statistics whose rows are not those of one frame."""
    return null_safe_join(values, group_stats(frame, by), by)


def replicate_frame(frame: DataFrame, by: Sequence[str], n_measures: int, terms: Callable[[int], dict[str, Column]], value: Callable[[int], Column]) -> DataFrame:
    """Any statistic of weighted sums: ``terms(i)`` are summed for measure i, ``value(i)`` combines the sums. One scan."""
    all_terms = {k: c for i in range(1, n_measures + 1) for k, c in terms(i).items()}
    sums = weighted_sums(frame, by, all_terms, [F.col("m_1").isNotNull()]).withColumnsRenamed({f"{c}_0": c for c in STATS})
    return stack(sums, [*by, "rep", *STATS], {i: value(i) for i in range(1, n_measures + 1)})


def replicate_means(df: DataFrame, design: SurveyDesign, measure: Sequence[Column], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Weighted mean of every group, imputation and weight."""
    frame = analysis_frame(df, design, measure, by, where)
    terms = lambda i: {f"num_{i}": F.col(f"m_{i}"), f"den_{i}": F.col(f"m_{i}").isNotNull()}
    return replicate_frame(frame, by, len(measure), terms, lambda i: F.try_divide(F.col(f"num_{i}"), F.col(f"den_{i}")))


def combine(replicates: DataFrame, by: Sequence[str], design: SurveyDesign) -> DataFrame:
    """Estimates with standard errors: ``[*by, estimate, se, n_pv, n, n_schools, wcov]``.

    Sampling variance per imputation from the squared replicate deviations, averaged, plus
    (1 + 1/M) times the variance of the estimates between imputations. No estimate, no error.
    """
    full = F.max(F.when(F.col("rep") == 0, F.col("value"))).over(Window.partitionBy(*by, "pv"))
    per_pv = (
        replicates.withColumn("t0", full)
        .groupBy(*by, "pv")
        .agg(
            F.max("t0").alias("t0"),
            (F.sum(F.when(F.col("rep") > 0, F.pow(F.col("value") - F.col("t0"), 2))) * design.scale).alias("u"),
            *[F.min(c).alias(c) for c in STATS],
        )
    )
    between = (1 + 1 / F.count("*")) * F.coalesce(F.var_samp("t0"), F.lit(0.0))
    out = per_pv.groupBy(*by).agg(F.avg("t0").alias("estimate"), F.sqrt(F.avg("u") + between).alias("se"), F.count("*").alias("n_pv"), *[F.min(c).alias(c) for c in STATS])
    return out.withColumn("se", F.when(F.col("estimate").isNotNull(), F.col("se")))


def contrast(replicates: DataFrame, by: Sequence[str], column: str, a: object, b: object) -> DataFrame:
    """Replicate frame of side ``a`` minus side ``b`` of a group column; a missing side gives NULL."""
    side = lambda s, c: F.max(F.when(F.col(column) == F.lit(s), F.col(c)))
    sides = replicates.where(F.col(column).isin(a, b)).groupBy(*by, "pv", "rep")
    return sides.agg((side(a, "value") - side(b, "value")).alias("value"), *[F.min(c).alias(c) for c in STATS])
