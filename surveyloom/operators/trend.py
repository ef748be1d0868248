"""Estimates across cycles, benchmarks and membership rules, on result frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import level_share
from ..plans.design import SurveyDesign
from .replicate import combine, null_safe_join, replicate_means
from .stats import weighted_means_multi

By = Sequence[str]


def trend(results: DataFrame, by: By, cycles: Sequence[str], link_error: float | Column = 0.0, cycle_col: str = "cycle") -> DataFrame:
    """Cycles side by side from one long result frame, the last minus the first, and its error.

    A group that a cycle lacks keeps its row with NULLs; pivoting needs no join, so NULL keys meet.
    """
    one = lambda v, c: F.max(F.when(F.col(cycle_col) == c, F.col(v))).alias(f"{v}_{c}")
    wide = results.groupBy(*by).agg(*[one(v, c) for c in cycles for v in ("estimate", "se")])
    first, last = cycles[0], cycles[-1]
    link = F.coalesce(link_error if isinstance(link_error, Column) else F.lit(float(link_error)), F.lit(0.0))
    change = F.col(f"estimate_{last}") - F.col(f"estimate_{first}")
    error = F.sqrt(F.pow(F.col(f"se_{first}"), 2) + F.pow(F.col(f"se_{last}"), 2) + F.pow(link, 2))
    return wide.withColumns({"change": change, "se_change": F.when(change.isNotNull(), error)})


def trend_with_link_errors(results: DataFrame, by: By, cycles: Sequence[str], links: DataFrame, keys: By) -> DataFrame:
    """Trend whose link error comes from a table (``keys``, link_error); keys it lacks have none."""
    wide = null_safe_join(trend(results, by, cycles), links, keys, "left")
    error = F.sqrt(F.pow("se_change", 2) + F.pow(F.coalesce("link_error", F.lit(0.0)), 2))
    return wide.withColumn("se_change", error).drop("link_error")


#: Statistics whose change carries the domain's link error, and those in which it cancels.
LEVELS, APPROXIMATE = ("mean", "quartile_means", "percentiles"), ("percentiles",)
CANCELS = ("gap", "quartile_gap", "percentile_spread", "correlation", "regression", "sd")


def link_error_rules(plans: DataFrame, table: DataFrame) -> DataFrame:
    """Link error of (template, domain, first, last): the domain's constant for levels, 0 where it cancels, else none."""
    found = plans.join(table, ["domain", "first", "last"], "left")
    rule = F.when(F.col("template").isin(*APPROXIMATE), "approximate").when(F.col("template").isin(*LEVELS), "constant").when(F.col("template").isin(*CANCELS), "cancels").otherwise("none")
    error = F.when(rule.isin("constant", "approximate"), F.col("link_error")).when(rule == "cancels", 0.0)
    return found.select(*plans.columns, rule.alias("rule"), error.alias("link_error"))


def share_link_error(df: DataFrame, design: SurveyDesign, measure: Sequence[Column], op: str, cut: float, error: float, by: By = (), where: Column | None = None) -> DataFrame:
    """Half the distance between the shares with every score shifted up and down by the link error, in one scan."""
    shifted = {name: level_share([m + F.lit(float(s)) for m in measure], op, cut) for name, s in (("up", error), ("down", -error))}
    both = weighted_means_multi(df, design, shifted, by, where).groupBy(*by)
    side = lambda s: F.max(F.when(F.col("measure") == s, F.col("estimate")))
    return both.agg((F.abs(side("up") - side("down")) / 2).alias("link_error"))


def group_average(results: DataFrame, key: str, label: str, by: By = ()) -> DataFrame:
    """Unweighted mean of the members' estimates as one row (per ``by``) named "<label> avg"."""
    known = results.where(F.col(key).isNotNull() & F.col("estimate").isNotNull())
    n = F.count("*")
    return known.groupBy(*by).agg(F.avg("estimate").alias("estimate"), (F.sqrt(F.sum(F.pow("se", 2))) / n).alias("se"), n.alias("n_members")).select(F.lit(f"{label} avg").alias(key), "*")


def constant_members(results: DataFrame, key: str, cycles: int, cycle_col: str = "cycle") -> DataFrame:
    """Members with an estimate in every cycle."""
    return results.where("estimate IS NOT NULL").groupBy(key).agg(F.count_distinct(cycle_col).alias("_n")).where(F.col("_n") == cycles).select(key)


def average_constant_membership(results: DataFrame, key: str, label: str, cycles: Sequence[str]) -> DataFrame:
    """Group averages per cycle over members present in all cycles; the others are counted and named.

    The one row about the others is joined to a row a cycle.
    """
    kept = constant_members(results, key, len(cycles))
    gone = results.where(F.col(key).isNotNull()).select(key).distinct().join(kept, key, "left_anti")
    dropped = gone.agg(F.count("*").alias("n_dropped"), F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), " ").alias("dropped"))
    return group_average(results.join(kept, key, "left_semi"), key, label, ["cycle"]).crossJoin(F.broadcast(dropped))


def benchmark_groups(results: DataFrame, members: DataFrame, key: str, by: By = ("cycle",), excluded: DataFrame | None = None) -> DataFrame:
    """Averages of every labelled group (label, ``key``), over all its members whatever rows are shown.

    ``excluded`` names members that a group leaves out in some cycle or domain: label, ``key`` and any of
    ``by``; a NULL label leaves the member out of every group.
    """
    named = results.join(members, key).where("estimate IS NOT NULL")
    if excluded is not None:
        keys = [c for c in excluded.columns if c != "label"]
        out = excluded.select(*[F.col(c).alias(f"_x_{c}") for c in excluded.columns])
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_x_{c}") for c in keys])
        named = named.join(out, same & (F.col("_x_label").isNull() | (F.col("_x_label") == F.col("label"))), "left_anti")
    n = F.count("*")
    out = named.groupBy("label", *by).agg(F.avg("estimate").alias("estimate"), (F.sqrt(F.sum(F.pow("se", 2))) / n).alias("se"), n.alias("n_members"))
    return out.withColumn("label", F.concat("label", F.lit(" avg")))


def stratum_rows(df: DataFrame, design: SurveyDesign, measure: Sequence[Column], economy: object, column: str, strata: Sequence, label: str, exclude: bool = False) -> DataFrame:
    """The economy's own row and one of its part in (or not in) a set of strata; exclusion also drops NULL strata."""
    inside = F.col(column).isin(*strata)
    part = ~inside & F.col(column).isNotNull() if exclude else inside
    here = df.where(F.col(design.economy) == economy)
    own = combine(replicate_means(here, design, measure, [design.economy]), [design.economy], design)
    some = combine(replicate_means(here, design, measure, [design.economy], part), [design.economy], design)
    return own.unionByName(some.withColumn(design.economy, F.lit(label)))


def index_group_mean(df: DataFrame, design: SurveyDesign, column: str, flag: Column, by: By = (), least: int = 5) -> DataFrame:
    """Unweighted mean over flagged economies of their weighted means; NULL with fewer than ``least``."""
    w, v = F.col(design.weight), F.col(column)
    own = df.where(flag).groupBy(*by, design.economy).agg(F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))).alias("_m")).where("_m IS NOT NULL")
    return own.groupBy(*by).agg(F.when(F.count("*") >= least, F.avg("_m")).alias("group_mean"), F.count("*").alias("n_economies"))


def trend_scaled(means: DataFrame, first: str, listed: bool = False, limit: float = 0.05) -> DataFrame:
    """Whether an index is scaled for trends: a later cycle's group mean lies away from 0, or it is listed."""
    far = F.max(F.when(F.col("cycle") > first, F.abs("group_mean")))
    return means.agg(far.alias("largest"), (F.coalesce(far >= limit, F.lit(False)) | F.lit(listed)).alias("trend_scaled"))


def stack(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Result frames under one another, named by a further column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in frames.items()])
