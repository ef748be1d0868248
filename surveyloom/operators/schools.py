"""School-level derivations: weighted shares of a school's students, and their spread."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign
from .replicate import _codes, _matrix, null_safe_join


def _share(design: SurveyDesign, column: Column, codes: Sequence) -> Column:
    """Weighted share of students with ``codes`` among those with a value: 0, not NULL, where nobody has one of them."""
    w = F.col(design.weight).cast("double")
    return F.try_divide(F.sum(F.when(column.isin(*codes), w).otherwise(0.0)), F.sum(F.when(column.isNotNull(), w)))


def _schools(df: DataFrame, design: SurveyDesign, column: Column, codes: Sequence, out: str) -> DataFrame:
    """(economy, school, share, n) of every school with a known share; students without a school are in none."""
    known = df.where(F.col(design.school).isNotNull())
    shares = known.groupBy(design.economy, design.school).agg(_share(design, column, codes).alias(out), F.count("*").alias("n"))
    return shares.where(F.col(out).isNotNull())


def school_share(df: DataFrame, design: SurveyDesign, column: Column, codes: Sequence, out: str) -> DataFrame:
    """Add each student's school's weighted share of students with ``codes``; NULL without a school or a known share."""
    keys = [design.economy, design.school]
    return null_safe_join(df, _schools(df, design, column, codes, out).drop("n"), keys, "left")


def school_split(df: DataFrame, design: SurveyDesign, column: Column, codes: Sequence, cut: float) -> DataFrame:
    """Per economy: schools, schools at or above the cut, percentiles of the share, median students a school.

    Schools without a known share and students without a school count nowhere.
    """
    schools = _schools(df, design, column, codes, "share")
    points = {f"p{int(100 * p)}": F.percentile("share", p) for p in (0.1, 0.5, 0.9)}
    return schools.groupBy(design.economy).agg(
        F.count("*").alias("n_schools"), F.count_if(F.col("share") >= cut).alias("n_at_cut"), *[c.alias(k) for k, c in points.items()], F.percentile("n", 0.5).alias("median_students")
    )


def school_mean(column: str, school: str) -> Column:
    """The unweighted mean of a variable over each student's school, as a measure or predictor."""
    return F.avg(column).over(Window.partitionBy(school))


#: A school with so many rows in an Arrow batch sends that batch's sums instead of its rows.
MANY = 64


def school_sums(frame: DataFrame, by: Sequence[str], n_measures: int) -> DataFrame:
    """``[*by, rep, w_i, s_i, q_i, b_i]``: sums of weight, weight x value, weight x square, and over schools of s^2 / w.

    Rows are dealt out once by (by, school), so a school's sums are made where its rows meet and only
    groups x reps rows go on. A school that fills batches sends sums, so its size does not matter.
    """
    m = F.array(*[f"m_{i}" for i in range(1, n_measures + 1)])
    rows = frame.select(*by, "_school", m.alias("_m"), "_weights")
    n_by, n = len(by), n_measures
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, "_school").schema]

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(n_by + 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n)
        return x, _matrix(batch.column(n_by + 2), batch.num_rows)

    def sums(x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(group, rep, 3 n) of rows in groups that begin at ``starts``."""
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        terms = np.concatenate([known.astype(float), x, x * x], 1)
        return np.stack([np.add.reduceat(w * terms[:, t : t + 1], starts, axis=0) for t in range(3 * n)], 2)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as they are, and one row of sums for each school with many rows in the batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch, range(n_by + 1))
            count = np.bincount(code)
            big = count[code] >= MANY
            few = batch.filter(pa.array(~big))
            yield few.append_column("_sums", pa.nulls(few.num_rows, pa.list_(pa.float64())))
            if big.any():
                x, w = numbers(batch)
                order = np.flatnonzero(big)[np.argsort(code[big], kind="stable")]
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                got = sums(x[order], w[order], starts)
                some = batch.take(pa.array(order[starts]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * got[0].size, pa.int32()), pa.array(got.ravel()))
                yield some.append_column("_sums", lists)

    dealt = rows.mapInArrow(shrink, ", ".join([*kinds, "_m array<double>", "_weights array<double>", "_sums array<double>"]))
    dealt = dealt.repartition(*by, "_school").sortWithinPartitions(*by, "_school")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the partition's schools; the last school of a batch waits for the next one."""
        held: dict[tuple, np.ndarray] = {}
        last: tuple[tuple, np.ndarray] | None = None

        def close(key: tuple, own: np.ndarray) -> None:
            w, s, q = own[:, :n], own[:, n : 2 * n], own[:, 2 * n :]
            b = np.divide(s * s, w, out=np.zeros_like(s), where=w > 0)
            held[key[:-1]] = held.get(key[:-1], 0) + np.concatenate([w, s, q, b], 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = numbers(batch)
            ready = batch.column(n_by + 3)
            is_sum = ready.is_valid().to_numpy(zero_copy_only=False)
            w = np.where(is_sum[:, None], 0.0, w)
            code = _codes(batch, range(n_by + 1))
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            got = sums(x, w, starts)
            group = np.searchsorted(starts, np.arange(batch.num_rows), side="right") - 1
            np.add.at(got, group[is_sum], ready.drop_null().flatten().to_numpy().reshape(-1, *got.shape[1:]))
            keys = list(zip(*(batch.column(k).take(pa.array(starts)).to_pylist() for k in range(n_by + 1)), strict=True))
            for key, own in zip(keys, got, strict=True):
                if last and last[0] == key:
                    own = own + last[1]
                elif last:
                    close(*last)
                last = (key, own)
        if last:
            close(*last)
        for key, own in held.items():
            reps = len(own)
            cols = [pa.array([k] * reps, batch.schema.field(j).type) for j, k in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(reps, dtype=np.int32)), *[pa.array(own[:, t]) for t in range(4 * n)]], names=names)

    cells = [f"{k}_{i}" for k in ("w", "s", "q", "b") for i in range(1, n + 1)]
    names = [*by, "rep", *cells]
    found = dealt.mapInArrow(finish, ", ".join([*kinds[:n_by], "rep int", *[f"{c} double" for c in cells]]))
    return found.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in cells])
