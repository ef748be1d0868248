"""Weighted quarters and percentiles in bounded pieces.

Both need running sums of weights in value order. For quarters a group is cut at approximate
quantiles into buckets, more of them the larger it is; sums per bucket give every bucket its
start, and only rows of one bucket are ever sorted together. Percentiles are selected by
narrowing brackets, from sums per bin. So a group may hold any share of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign
from ..sources.work import materialized
from .replicate import STATS, _codes, _matrix, analysis_frame, group_stats, null_safe_join, stored

#: Rows that a bucket aims at, and the most buckets of a group.
PIECE, MOST = 50_000, 1024
#: Bins that a percentile's bracket is cut into, and bytes of their sums that a task holds.
BINS, HELD = 256, 64 << 20
QUARTERS = (0.25, 0.5, 0.75)


def _cut(fine: Column, n: Column, piece: int, least: int = 1) -> Column:
    """Every so many of a group's fine quantiles, so that ``n`` rows fall into pieces of about ``piece`` rows (``least`` pieces)."""
    step = F.least(F.lit(MOST // least), F.greatest(F.lit(1), F.floor(F.lit(MOST * piece) / n))).cast("int")
    return F.array_distinct(F.filter(fine, lambda x, i: (i + 1) % step == 0))


def _fine(value: str) -> Column:
    return F.percentile_approx(value, [i / MOST for i in range(1, MOST)], 4 * MOST)


def _below(cuts: str, value: Column) -> Column:
    """How many of the sorted cuts, fewer than ``MOST``, lie below a value: found in halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((MOST - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def edges(df: DataFrame, keys: Sequence[str], value: str, piece: int = PIECE) -> DataFrame:
    """(keys, _cuts, _ties): where to cut each group, and values that alone fill two pieces."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(_fine(value).alias("_fine"), F.count("*").alias("_n"))
    many = F.ceil(F.lit(2.0 * MOST * piece) / F.col("_n"))
    ties = F.array_distinct(F.filter("_fine", lambda x, i: F.get("_fine", (i + many).cast("int")) == x))
    return g.select(*keys, _cut(F.col("_fine"), F.col("_n"), piece).alias("_cuts"), ties.alias("_ties"))


def weighted_quarters(df: DataFrame, design: SurveyDesign, value: Column, within: Sequence[str], out: str = "quarter", piece: int = PIECE, written: bool = False) -> DataFrame:
    """Rows with a value, and their weighted quarter 1-4 by the midpoint rule.

    A row's place is (weights up to it - half its own) / all weights of the group; ties are split by
    ``design.order``, whose first column must be a number: a value that fills pieces alone is cut again
    at quantiles of that column. A place that equals a cut belongs to the lower quarter. Only the first
    row past each cut is looked for, in narrow rows, which are written once unless ``df`` is read from rows
    that are ``written``; the rows themselves are read once more, to be compared with it. The cuts, a row a group,
    are made at once.
    """
    rows = df.withColumn("_v", value).where("_v IS NOT NULL")
    narrow = narrow_rows(rows, design, within)
    # edges, ties, sums and bounds are all made from these few columns
    bounds = quarter_bounds(narrow if written else materialized(narrow, "narrow"), within, piece)
    placed = null_safe_join(rows.withColumn("_at", F.struct("_v", *design.order)), bounds, within)
    above = sum(F.coalesce((F.col("_at") >= F.col(f"_q{i}")).cast("int"), F.lit(0)) for i in range(len(QUARTERS)))
    return placed.withColumn(out, 1 + above).drop("_v", "_at", *[f"_q{i}" for i in range(len(QUARTERS))])


def narrow_rows(rows: DataFrame, design: SurveyDesign, within: Sequence[str]) -> DataFrame:
    """(within, value, first order column, place, weight) of rows with a value ``_v``: all that cuts are found from."""
    w0 = F.coalesce(F.col(design.weight).cast("double"), F.lit(0.0))
    return rows.select(*within, "_v", F.col(design.order[0]).cast("double").alias("_o"), F.struct("_v", *design.order).alias("_at"), w0.alias("_w"))


def quarter_bounds(narrow: DataFrame, within: Sequence[str], piece: int = PIECE, shares: Sequence[float] = QUARTERS) -> DataFrame:
    """``[*within, _q0, ..]``: place of the first row past each share of a group's weight, looked for in the pieces where the share lies."""
    cuts = materialized(edges(narrow, within, "_v", piece), "edges")
    narrow = null_safe_join(narrow, cuts, within).withColumn("_bucket", _below("_cuts", F.col("_v"))).drop("_cuts")
    keys = [*within, "_bucket", "_sub"]
    if cuts.where("size(_ties) > 0").isEmpty():
        narrow = narrow.withColumn("_sub", F.lit(0))
    else:
        tied = narrow.withColumn("_tie", F.when(F.array_contains("_ties", F.col("_v")), F.col("_v")))
        more = materialized(edges(tied.where("_tie IS NOT NULL"), [*within, "_tie"], "_o", piece).drop("_ties"), "edges")
        narrow = null_safe_join(tied, more, [*within, "_tie"], "left")
        # the tied value's own rows follow the bucket's smaller ones
        sub = F.when(F.col("_tie").isNull(), 0).otherwise(1 + F.coalesce(_below("_cuts", F.col("_o")), F.lit(0)))
        narrow = narrow.withColumn("_sub", sub)
    narrow = narrow.select(*keys, "_at", "_w")
    sums = narrow.groupBy(*keys).agg(F.sum("_w").alias("_in"))
    up_to = Window.partitionBy(*within).orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.select(*keys, F.sum("_in").over(up_to).alias("_end"), "_in", F.sum("_in").over(Window.partitionBy(*within)).alias("_total"))
    ends = ends.select("*", F.explode(F.array(*[F.lit(c) for c in shares])).alias("_cut")).where("_end > _cut * _total")
    # half a weight may move the first row past a cut into the next piece
    first = Window.partitionBy(*within, "_cut").orderBy("_bucket", "_sub")
    hits = ends.withColumn("_k", F.row_number().over(first)).where("_k <= 2").groupBy(*keys).agg(F.min(F.col("_end") - F.col("_in")).alias("_start"), F.min("_total").alias("_total"))
    run = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    near = null_safe_join(narrow, materialized(hits, "hits"), keys).withColumn("_place", (F.col("_start") + F.sum("_w").over(run) - F.col("_w") / 2) / F.col("_total"))
    bounds = near.groupBy(*within).agg(*[F.min(F.when(F.col("_place") > c, F.col("_at"))).alias(f"_q{i}") for i, c in enumerate(shares)])
    return materialized(bounds, "bounds")


def _bin(v: Column, low: Column, high: Column) -> Column:
    """Which of ``BINS`` parts of equal width of [low, high] holds a value; the ends never share one unless they are equal."""
    part = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS)
    return F.when(v.isNull(), None).when(low == high, 0).when(v >= high, BINS - 1).when(v <= low, 0).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(BINS - 1))).cast("int")


_HIT = "struct<rep:int,percentile:double,need:double>"
_FOUND = "rep int, percentile double, value double, low double, high double, many long, need double, bin int"


def _reach(wanted: list[dict], bins: list[dict]) -> Iterator[dict]:
    """For each wanted (rep, percentile, need): the first bin, in value order, up to which the weights reach what is needed."""
    bins = sorted(bins, key=lambda b: b["low"])
    up_to = np.cumsum(np.array([b["w"] for b in bins]), 0)
    for h in wanted:
        run = up_to[:, h["rep"]]
        # rounding may put a target above the total; it is the last bin's
        k = min(int(np.searchsorted(run, h["need"])), len(bins) - 1)
        b = bins[k]
        yield {
            "rep": h["rep"], "percentile": h["percentile"], "value": b["low"] if b["low"] == b["high"] else None,
            "low": b["low"], "high": b["high"], "many": b["many"], "need": h["need"] - (run[k - 1] if k else 0.0), "bin": b["bin"],
        }


def percentiles(df: DataFrame, design: SurveyDesign, measure: Sequence[Column], by: Sequence[str], points: Sequence[float], where: Column | None = None, small: int = 1024) -> DataFrame:
    """``[*by, pv, rep, percentile, value, n, n_schools, wcov]``: smallest value whose cumulative weight reaches the share.

    Exact selection by narrowing brackets. The first scan takes each group's range and counts, without the
    weights. The second adds up the weights of every bin of the range, a vector of all weights a bin; where
    the target of some weight falls into a bin of one value, that is the answer. The third writes the few
    rows of the other bins that are hit. Such a bracket of at most ``small`` rows is finished at once; a
    larger one is cut into bins again, until none is left. Only sums, and brackets of bounded size, are
    shuffled, and a group's size decides nothing but the number of rounds. The three scans read rows that are
    written once where the design makes its weights.
    """
    n, reps, keys = len(measure), design.groups + 1, [*by, "pv"]
    rows = stored(df, design, {f"_y{i}": m for i, m in enumerate(measure, 1)}, by, where)
    frame = analysis_frame(rows, design, [F.col(f"_y{i}") for i in range(1, n + 1)], by)
    span = [f(f"m_{i}").alias(f"_{k}{i}") for i in range(1, n + 1) for k, f in (("low", F.min), ("high", F.max))]
    spans = materialized(group_stats(frame, by, more=span), "spans")
    ends = spans.select(*by, *[f"_{k}{i}" for i in range(1, n + 1) for k in ("low", "high")])
    one = lambda i: F.coalesce(_bin(F.col(f"m_{i}"), F.col(f"_low{i}"), F.col(f"_high{i}")), F.lit(-1))
    flat = F.array(*[f"m_{i}" for i in range(1, n + 1)]).alias("_m")
    binned = null_safe_join(frame, ends, by).select(*by, flat, F.array(*[one(i) for i in range(1, n + 1)]).alias("_b"), "_weights")
    sums = _bin_sums(binned, by, n, reps)
    total = F.expr(f"transform(sequence(0, {reps - 1}), r -> aggregate(_bins, 0D, (s, b) -> s + b.w[r]))")
    marks = F.array(*[F.lit(float(p)) for p in points])
    need = F.flatten(F.transform("_total", lambda t, r: F.transform(marks, lambda p: F.struct(r.alias("rep"), p.alias("percentile"), (t * p / 100).alias("need"))))).cast(f"array<{_HIT}>")
    found = materialized(_searched(sums.withColumn("_total", total).select(*keys, need.alias("_wanted"), "_bins"), keys), "found")
    out = [found.where("value IS NOT NULL").select(*keys, "rep", "percentile", "value")]
    spot = [*keys, "_at"]  # a bracket is told by its lower end
    left = found.where("value IS NULL").withColumn("_at", F.lit(0.0))
    rows = None
    while not left.isEmpty():
        hits = F.collect_list(F.struct("rep", "percentile", "need")).cast(f"array<{_HIT}>")
        brackets = left.groupBy(*spot, "bin", "low", "high").agg(F.first("many").alias("_many"), hits.alias("_wanted"))
        brackets = materialized(brackets, "brackets")
        if rows is None:
            rows = _hit_rows(binned, brackets, by, n).withColumn("_at", F.lit(0.0))
        rows = null_safe_join(rows, brackets.select(*spot, "bin", "low", "high", "_many"), [*spot, "bin"])
        inner = _bin(F.col("value"), F.col("low"), F.col("high")).alias("bin")
        rows = materialized(rows.select(*keys, F.col("low").alias("_at"), "value", "_w", inner, "_many"), "bracket_rows")
        cell = F.struct("bin", F.col("value").alias("low"), F.col("value").alias("high"), F.lit(1).cast("long").alias("many"), F.col("_w").alias("w"))
        few = rows.where(F.col("_many") <= small).groupBy(*spot).agg(F.collect_list(cell).alias("_bins"))
        wide = rows.where(F.col("_many") > small).select(*spot, F.array("value").alias("_m"), F.array("bin").alias("_b"), F.col("_w").alias("_weights"))
        wide = _bin_sums(wide, spot, 1, reps, None)
        wanted = brackets.select(*keys, F.col("low").alias("_at"), "_wanted")
        found = null_safe_join(few.unionByName(wide), wanted, spot).select(*spot, "_wanted", "_bins")
        found = materialized(_searched(found, spot), "found")
        out.append(found.where("value IS NOT NULL").select(*keys, "rep", "percentile", "value"))
        left = found.where("value IS NULL")
        rows = null_safe_join(rows.drop("_many"), left.select(*spot, "bin").distinct(), [*spot, "bin"])
    values = reduce(DataFrame.unionByName, out)
    return null_safe_join(values, spans.select(*by, *STATS), by)


class _Bins:
    """Range, rows and weights of one group's bins."""

    def __init__(self, key: list[pa.Array], n: int, reps: int):
        self.key = key
        self.low, self.high = np.full((n, BINS), np.inf), np.full((n, BINS), -np.inf)
        self.many, self.total = np.zeros((n, BINS), np.int64), np.zeros((n, BINS, reps))

    def add(self, x: np.ndarray, bins: np.ndarray, w: np.ndarray) -> None:
        for i in range(x.shape[1]):
            some = np.flatnonzero(bins[:, i] >= 0)
            order = some[np.argsort(bins[some, i], kind="stable")]
            if len(order):
                starts = np.flatnonzero(np.diff(bins[order, i], prepend=-1))
                b, v = bins[order[starts], i], x[order, i]
                self.low[i, b] = np.minimum(self.low[i, b], np.minimum.reduceat(v, starts))
                self.high[i, b] = np.maximum(self.high[i, b], np.maximum.reduceat(v, starts))
                self.many[i, b] += np.diff(np.append(starts, len(order)))
                self.total[i, b] += np.add.reduceat(w[order], starts, axis=0)


def _bin_sums(binned: DataFrame, by: Sequence[str], n: int, reps: int, pv: str | None = "pv") -> DataFrame:
    """``[*by, pv, _bins]``: of every bin its range, rows and summed weights, as one array; rows are added up where they are read."""
    n_by = len(by)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in binned.select(*by).schema]
    keys, widths = [*by, *([pv] if pv else [])], [f"s{r}" for r in range(reps)]
    names = [*keys, "bin", "low", "high", "many", *widths]

    def out(groups: list[pa.Array], rows: np.ndarray, i: np.ndarray, bins: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        cols = [c.take(pa.array(rows)) for c in groups] + ([pa.array((i + 1).astype(np.int32))] if pv else [])
        cols += [pa.array(bins.astype(np.int32)), pa.array(low), pa.array(high), pa.array(many.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(total[:, r])) for r in range(reps)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of up to ``HELD`` bytes stay over the batches of a task; what is over goes on at once."""
        held: dict[tuple, _Bins] = {}
        most = max(1, HELD // (8 * n * BINS * (reps + 3)))

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                groups = [pa.concat_arrays([h.key[k] for h in held.values()]) for k in range(n_by)]
                for at, h in enumerate(held.values()):
                    i, b = np.nonzero(h.many)
                    yield out(groups, np.full(len(i), at), i, b, h.low[i, b], h.high[i, b], h.many[i, b], h.total[i, b])
                held.clear()

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = batch.column(n_by).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size, n)
            bins, w = batch.column(n_by + 1).flatten().to_numpy().reshape(size, n), _matrix(batch.column(n_by + 2), size)
            code = _codes(batch, range(n_by))
            _, firsts = np.unique(code, return_index=True)
            if len(firsts) > most:
                for i in range(n):
                    some = np.flatnonzero(bins[:, i] >= 0)
                    order = some[np.lexsort([bins[some, i], code[some]])]
                    if len(order):
                        starts = np.flatnonzero(np.diff(code[order] * BINS + bins[order, i], prepend=-1))
                        at, v = order[starts], x[order, i]
                        count = np.diff(np.append(starts, len(order)))
                        edges = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
                        yield out(batch.columns[:n_by], at, np.full(len(at), i), bins[at, i], *edges, count, np.add.reduceat(w[order], starts, axis=0))
                continue
            if len(held) + len(firsts) > 2 * most:
                yield from told()
            keys_of = [tuple(batch.column(k)[int(f)].as_py() for k in range(n_by)) for f in firsts]
            for f, key in zip(firsts, keys_of, strict=True):
                if key not in held:
                    held[key] = _Bins([batch.column(k).slice(int(f), 1) for k in range(n_by)], n, reps)
                rows = np.flatnonzero(code == code[f])
                held[key].add(x[rows], bins[rows], w[rows])
        yield from told()

    sent = binned.mapInArrow(run, ", ".join([*kinds, *([f"{pv} int"] if pv else []), "bin int, low double, high double, many long", *[f"{s} double" for s in widths]]))
    per = sent.groupBy(*keys, "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("many").alias("many"), *[F.sum(s).alias(s) for s in widths])
    return per.groupBy(*keys).agg(F.collect_list(F.struct("bin", "low", "high", "many", F.array(*widths).alias("w"))).alias("_bins"))  # BINS at most


def _hit_rows(binned: DataFrame, brackets: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by, pv, bin, value, _w): a row for each imputation of a row that lies in a bin that is hit."""
    wanted = brackets.groupBy(*by).agg(F.collect_set(F.col("pv") * BINS + F.col("bin")).alias("_hits"))
    met = lambda i: F.array_contains("_hits", F.lit(i * BINS) + F.get("_b", F.lit(i - 1))) & (F.get("_b", F.lit(i - 1)) >= 0)
    cells = F.array_compact(F.array(*[F.when(met(i), F.struct(F.lit(i).alias("pv"), F.get("_b", F.lit(i - 1)).alias("bin"), F.get("_m", F.lit(i - 1)).alias("value"))) for i in range(1, n + 1)]))
    rows = null_safe_join(binned, wanted, by).select(*by, cells.alias("_cells"), "_weights").where("size(_cells) > 0")
    return rows.select(*by, F.explode("_cells").alias("_c"), F.col("_weights").alias("_w")).select(*by, "_c.*", "_w")


def _searched(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_FOUND``): every wanted target looked up in the bins of its row."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(_reach(batch.column(n)[k].as_py(), batch.column(n + 1)[k].as_py()))
                at = pa.array(np.full(len(got), k))
                cols = [pa.array([g[c] for g in got], t) for c, t in zip(names, found_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(n)), *cols], names=[*keys, *names])

    found_types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in _FOUND.split(", ")]
    return rows.mapInArrow(run, ", ".join([*kinds, _FOUND]))
