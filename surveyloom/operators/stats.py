"""Statistics with standard errors, all on the replicate kernel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import code_share, share
from ..plans.design import SurveyDesign
from ..sources.work import materialized
from .quantile import percentiles as percentile_values
from .quantile import narrow_rows, quarter_bounds, weighted_quarters
from .replicate import STATS, analysis_frame, combine, contrast, null_safe_join, replicate_frame, replicate_means, stack, stored, weighted_sums, with_stats
from .schools import school_share, school_sums

By = Sequence[str]
Measure = Sequence[Column]


def weighted_mean(df: DataFrame, design: SurveyDesign, measure: Measure, by: By = (), where: Column | None = None) -> DataFrame:
    return combine(replicate_means(df, design, measure, by, where), by, design)


def weighted_means_multi(df: DataFrame, design: SurveyDesign, measures: dict[str, Measure], by: By = (), where: Column | None = None) -> DataFrame:
    """Several measures in one scan: ``measure`` is a further key; counts are each measure's own."""
    flat = [(name, i, m) for name, cols in measures.items() for i, m in enumerate(cols, 1)]
    frame = analysis_frame(df, design, [m for *_, m in flat], by, where)
    terms = {}
    for k in range(1, len(flat) + 1):
        terms |= {f"num_{k}": F.col(f"m_{k}"), f"den_{k}": F.col(f"m_{k}").isNotNull()}
    firsts = {name: next(k for k, (x, *_) in enumerate(flat, 1) if x == name) for name in measures}
    wide = weighted_sums(frame, by, terms, [F.col(f"m_{k}").isNotNull() for k in firsts.values()])
    place = {name: j for j, name in enumerate(firsts)}

    def cell(k: int, name: str, i: int) -> Column:
        own = [F.col(f"{c}_{place[name]}").alias(c) for c in STATS]
        return F.struct(F.lit(name).alias("measure"), F.lit(i).alias("pv"), F.try_divide(F.col(f"num_{k}"), F.col(f"den_{k}")).alias("value"), *own)

    values = wide.select(*by, "rep", F.explode(F.array(*[cell(k, name, i) for k, (name, i, _) in enumerate(flat, 1)])).alias("c")).select(*by, "rep", "c.*")
    return combine(values, [*by, "measure"], design)


def weighted_proportion(df: DataFrame, design: SurveyDesign, column: Column, codes: Sequence, by: By = (), where: Column | None = None, others: Sequence | None = None, category: str | None = None) -> DataFrame:
    """Per cent of known values (or of ``codes`` and ``others``) that are in ``codes``."""
    out = weighted_mean(df, design, [code_share(column, codes, others)], by, where)
    return out.withColumn("category", F.lit(category)) if category else out


def gap(df: DataFrame, design: SurveyDesign, measure: Measure, group: Column, a: object, b: object, by: By = (), where: Column | None = None, label: str | None = None) -> DataFrame:
    """Mean of group ``a`` minus group ``b``, the difference taken in every replicate."""
    rows = (df if where is None else df.where(where)).withColumn("_group", group)
    reps = replicate_means(rows, design, measure, [*by, "_group"], F.col("_group").isin(a, b))
    return combine(contrast(reps, by, "_group", a, b), by, design).select(F.lit(label or f"{a} minus {b}").alias("contrast"), "*")


def gap_levels(df: DataFrame, design: SurveyDesign, measure: Measure, group: Column, a: object, b: object, by: By = (), where: Column | None = None) -> DataFrame:
    """Each side's own mean beside a gap; the column ``side`` holds the group's code."""
    rows = (df if where is None else df.where(where)).withColumn("side", group)
    return weighted_mean(rows, design, measure, [*by, "side"], F.col("side").isin(a, b))


def school_share_gap(
    df: DataFrame, design: SurveyDesign, measure: Measure, column: Column, codes: Sequence, cut: float, by: By = (), students: Sequence | None = None, label: str | None = None
) -> DataFrame:
    """Students in schools where at least ``cut`` of the students have ``codes``, minus students in schools below it.

    ``students`` restricts the compared students to codes of the same column; it leaves the schools' shares as
    they are, which count every student. Students without a school, and of schools without a known share, are
    on neither side.
    """
    rows = school_share(df, design, column, codes, "_share")
    who = F.lit(True) if students is None else column.isin(*students)
    side = F.when(who & (F.col("_share") >= cut), 1).when(who & (F.col("_share") < cut), 0)
    return gap(rows, design, measure, side, 1, 0, by, label=label or "high minus low")


def _ranked(df: DataFrame, design: SurveyDesign, over: Column, by: By, where: Column | None, columns: dict[str, Column]) -> DataFrame:
    """The rows with ``columns`` and the index, ``_over``; the filter comes first."""
    return stored(df, design, columns | {"_over": over}, [*by, *design.order], where)


def _quartered(df: DataFrame, design: SurveyDesign, over: Column, by: By, where: Column | None, columns: dict[str, Column]) -> DataFrame:
    """Rows with ``columns`` and their quarter, cut within the economy, or in all rows when it is not a group."""
    return _cut(_ranked(df, design, over, by, where, columns), design, by)


def _cut(ranked: DataFrame, design: SurveyDesign, by: By) -> DataFrame:
    return weighted_quarters(ranked, design, F.col("_over"), [design.economy] if design.economy in by else [], written=bool(design.make))


def _named(measure: Measure, name: str = "_y") -> dict[str, Column]:
    return {f"{name}{i}": m for i, m in enumerate(measure, 1)}


def quartile_replicates(df: DataFrame, design: SurveyDesign, measure: Measure, over: Column, by: By = (), where: Column | None = None) -> DataFrame:
    """Means per weighted quarter; ``wcov`` is the weighted share of rows whose quarter is known."""
    columns = _named(measure)
    rows = _ranked(df, design, over, by, where, columns)
    w = F.col(design.weight).cast("double")
    known = rows.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("_over").isNotNull(), w)), F.sum(w)).alias("wcov"))
    reps = replicate_means(_cut(rows, design, by), design, [F.col(c) for c in columns], [*by, "quarter"])
    return null_safe_join(reps.drop("wcov"), known, by)


def quartile_means(df: DataFrame, design: SurveyDesign, measure: Measure, over: Column, by: By = (), where: Column | None = None, quarters: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    return combine(quartile_replicates(df, design, measure, over, by, where), [*by, "quarter"], design).where(F.col("quarter").isin(*quarters))


def quartile_gap(df: DataFrame, design: SurveyDesign, measure: Measure, over: Column, by: By = (), where: Column | None = None) -> DataFrame:
    """Top minus bottom quarter."""
    reps = quartile_replicates(df, design, measure, over, by, where)
    return combine(contrast(reps, by, "quarter", 4, 1), by, design).select(F.lit("top minus bottom quarter").alias("contrast"), "*")


def _paired(x: Measure, y: Measure) -> list[tuple[Column, Column]]:
    """Imputation i of one with i of the other; a single series is repeated."""
    if 1 not in (len(x), len(y)) and len(x) != len(y):
        raise ValueError("two families of imputations must have the same length")
    n = max(len(x), len(y))
    return list(zip(list(x) * (n if len(x) == 1 else 1), list(y) * (n if len(y) == 1 else 1), strict=True))


def correlation(df: DataFrame, design: SurveyDesign, x: Measure, y: Measure, by: By = (), where: Column | None = None) -> DataFrame:
    """Weighted Pearson correlation over rows where both are known."""
    pairs = _paired(x, y)
    both = [a.isNotNull() & b.isNotNull() for a, b in pairs]
    xs = {f"x_{i}": F.when(ok, a.cast("double")) for i, ((a, _), ok) in enumerate(zip(pairs, both, strict=True), 1)}
    frame = analysis_frame(df, design, [F.when(ok, b.cast("double")) for (_, b), ok in zip(pairs, both, strict=True)], by, where, xs)

    def sums(i: int) -> dict[str, Column]:
        a, b = F.col(f"x_{i}"), F.col(f"m_{i}")
        got = {"w": b.isNotNull(), "x": a, "y": b, "xy": a * b, "xx": a * a, "yy": b * b}
        return {f"{k}_{i}": c for k, c in got.items()}

    def value(i: int) -> Column:
        s = {k: F.col(f"{k}_{i}") for k in ("w", "x", "y", "xy", "xx", "yy")}
        mean = lambda k: F.try_divide(s[k], s["w"])
        spread = lambda k: F.greatest(mean(k * 2) - F.pow(mean(k), 2), F.lit(0.0))
        return F.try_divide(mean("xy") - mean("x") * mean("y"), F.sqrt(spread("x") * spread("y")))

    return combine(replicate_frame(frame, by, len(pairs), sums, value), by, design)


def correlation_by_quarter(df: DataFrame, design: SurveyDesign, x: Measure, y: Measure, over: Column, by: By = (), where: Column | None = None) -> DataFrame:
    xs, ys = _named(x, "_x"), _named(y)
    return correlation(_quartered(df, design, over, by, where, xs | ys), design, [F.col(c) for c in xs], [F.col(c) for c in ys], ["quarter", *by])


def weighted_sd(df: DataFrame, design: SurveyDesign, measure: Measure, by: By = (), where: Column | None = None) -> DataFrame:
    frame = analysis_frame(df, design, [m.cast("double") for m in measure], by, where)

    def sums(i: int) -> dict[str, Column]:
        m = F.col(f"m_{i}")
        return {f"w_{i}": m.isNotNull(), f"s_{i}": m, f"q_{i}": m * m}

    def value(i: int) -> Column:
        mean = F.try_divide(F.col(f"s_{i}"), F.col(f"w_{i}"))
        return F.sqrt(F.greatest(F.try_divide(F.col(f"q_{i}"), F.col(f"w_{i}")) - mean * mean, F.lit(0.0)))

    return combine(replicate_frame(frame, by, len(measure), sums, value), by, design)


def percentiles(df: DataFrame, design: SurveyDesign, measure: Measure, by: By = (), points: Sequence[float] = (10, 25, 50, 75, 90), where: Column | None = None) -> DataFrame:
    return combine(percentile_values(df, design, measure, by, points, where), [*by, "percentile"], design)


def percentile_spread(df: DataFrame, design: SurveyDesign, measure: Measure, by: By = (), lower: float = 10, upper: float = 90, where: Column | None = None) -> DataFrame:
    reps = percentile_values(df, design, measure, by, (lower, upper), where)
    diff = contrast(reps, by, "percentile", float(upper), float(lower))
    return combine(diff, by, design).select(F.lit(f"P{upper:g} minus P{lower:g}").alias("contrast"), "*")


def crosstab(df: DataFrame, design: SurveyDesign, row: str, col: str, by: By = (), where: Column | None = None, categories: Sequence | None = None, most: int = 12) -> DataFrame:
    """Row per cent of ``col`` within ``row``; more than ``most`` categories raise."""
    rows = (df if where is None else df.where(where)).where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if categories is None:
        categories = [r[0] for r in rows.select(col).distinct().limit(most + 1).collect()]
    if len(categories) > most:
        raise ValueError(f"{col} has more than {most} categories")
    measures = {str(c): [share(F.col(col) == c, F.col(col).isNotNull())] for c in sorted(categories)}
    out = weighted_means_multi(rows, design, measures, [*by, row])
    return out.withColumnsRenamed({row: "row", "measure": "col"})


def resilient_share(df: DataFrame, design: SurveyDesign, measure: Measure, over: Column, by: By = (), cut: float | None = None, where: Column | None = None) -> DataFrame:
    """Of the bottom quarter of an index: per cent in the top quarter of each imputation (or at or above ``cut``).

    Scores are long only while the cuts are looked for. A cut is a row a group and imputation, so each row is
    compared with all of its own where it stands, and its weights are met once for all imputations.
    """
    names = [f"_y{i}" for i in range(1, len(measure) + 1)]
    columns = dict(zip(names, [m.cast("double") for m in measure], strict=True))
    if cut is not None:
        rows = _quartered(df, design, over, by, where, columns)
        return weighted_mean(rows, design, [share(F.col(c) >= cut, F.col(c).isNotNull()) for c in names], by, F.col("quarter") == 1)
    # the top quarter is cut among all rows with the index
    rows = _ranked(df, design, over, by, where, columns).where("_over IS NOT NULL")
    within = [design.economy] if design.economy in by else []
    kept = (lambda narrow: narrow) if design.make else (lambda narrow: materialized(narrow, "narrow"))
    low = quarter_bounds(kept(narrow_rows(rows.withColumn("_v", F.col("_over")), design, within)), within, shares=(0.25,))
    score = F.explode(F.array(*[F.struct(F.lit(i).alias("pv"), F.col(c).alias("_v")) for i, c in enumerate(names, 1)]))
    keep = list(dict.fromkeys([*within, *design.order, design.weight]))
    long = rows.select(*keep, score.alias("_c")).select(*keep, "_c.*").where("_v IS NOT NULL")
    top = quarter_bounds(kept(narrow_rows(long, design, [*within, "pv"])), [*within, "pv"], shares=(0.75,))
    top = top.groupBy(*within).agg(*[F.min(F.when(F.col("pv") == i, F.col("_q0"))).alias(f"_top{i}") for i in range(1, len(names) + 1)])
    placed = null_safe_join(null_safe_join(rows, low.withColumnRenamed("_q0", "_low"), within), top, within, "left")
    past = lambda c, bound: F.coalesce(F.struct(F.col(c).alias("_v"), *design.order) >= F.col(bound), F.lit(False))
    met = [share(past(c, f"_top{i}"), F.col(c).isNotNull()) for i, c in enumerate(names, 1)]
    return weighted_mean(placed, design, met, by, ~past("_over", "_low"))


def between_school_share(df: DataFrame, design: SurveyDesign, measure: Measure, by: By = (), where: Column | None = None) -> DataFrame:
    """100 x weighted variance of school means / total variance.

    Students without a school and schools without a value take no part, in the counts as well.
    """
    frame = analysis_frame(df, design, measure, by, where).where("_school IS NOT NULL")
    n = len(measure)
    sums = school_sums(frame, by, n)

    def value(i: int) -> Column:
        w, s, q, b = (F.col(f"{k}_{i}") for k in ("w", "s", "q", "b"))
        mean = F.try_divide(s, w)
        return 100 * F.try_divide(F.try_divide(b, w) - mean * mean, F.try_divide(q, w) - mean * mean)

    values = stack(sums, [*by, "rep"], {i: value(i) for i in range(1, n + 1)})
    return combine(with_stats(values, frame, by), by, design)
