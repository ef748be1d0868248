"""Rules that make result frames publishable, and comparisons between their rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def verdict(estimate: Column, se: Column) -> Column:
    """Whether an estimate differs from 0; NULL without a positive error."""
    return F.when(se > 0, F.abs(estimate) > Z * se)


def ci95(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Bounds of estimate +- 1.96 errors, to two decimals, for every (estimate, error) column pair."""
    return df.withColumns({f"{e}_{k}": F.round(F.col(e) + s * Z * F.col(se), 2) for e, se in pairs.items() for k, s in (("low", -1), ("high", 1))})


def small_cell(n: Column, n_schools: Column, least: int = 30, least_schools: int = 5) -> Column:
    """Why a cell is too small to publish: students, schools, or NULL; -1 schools means none are known."""
    return F.when(n < least, "students").when((n_schools >= 0) & (n_schools < least_schools), "schools")


def suppress_small_cells(df: DataFrame, least: int = 30, least_schools: int = 5) -> DataFrame:
    """Blank estimates of small cells, say why, and drop the counts."""
    out = df.withColumn("suppressed", small_cell(F.col("n"), F.col("n_schools"), least, least_schools))
    blank = {c: F.when(F.col("suppressed").isNull(), F.col(c)) for c in ("estimate", "se")}
    return out.withColumns(blank).drop("n", "n_schools", "wcov")


def suppressed_counts(df: DataFrame, by: Sequence[str] = (), least: int = 30, least_schools: int = 5) -> DataFrame:
    """How many estimates each reason blanks, before ``suppress_small_cells``."""
    why = df.where("estimate IS NOT NULL").withColumn("suppressed", small_cell(F.col("n"), F.col("n_schools"), least, least_schools))
    return why.where("suppressed IS NOT NULL").groupBy(*by, "suppressed").agg(F.count("*").alias("n_cells"))


def low_coverage(df: DataFrame, least: float = 0.85) -> DataFrame:
    """Published rows whose measure is known for too few: per cent without a value."""
    return df.where(small_cell(F.col("n"), F.col("n_schools")).isNull() & (F.col("wcov") < least)).withColumn("missing_percent", F.round(100 * (1 - F.col("wcov"))))


def drop_null_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known; ``n_dropped`` counts the others."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dropped = df.agg(F.count_if(~known).alias("n_dropped"))
    return df.where(known).crossJoin(F.broadcast(dropped))


def comparability_reasons(measures: DataFrame) -> DataFrame:
    """(measure, reason) of the measures whose change says nothing.

    ``measures`` has a row a measure: ``measure``, ``domain`` (of a test score, whose scales are linked;
    else NULL), ``label``, ``index`` (standardised within the cycle), ``trend_scaled``, and
    ``renamed``, ``differs`` and ``same_wording`` for measures under other codes in some cycle: a renamed
    index and items of the same wording compare, other different variables do not.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    other = yes("differs") & ~yes("renamed")
    reason = F.when(F.col("domain").isNotNull() | (other & yes("same_wording")), None)
    reason = reason.when(other, "different variables are used in different cycles")
    reason = reason.when(yes("index") & ~yes("trend_scaled"), F.concat("label", F.lit(" is standardised within each cycle")))
    return measures.select("measure", reason.alias("reason")).where("reason IS NOT NULL")


def blank_non_comparable(trend: DataFrame, reasons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blank change and error where a (keys, reason) row says that cycles do not compare."""
    out = trend.join(reasons, list(keys), "left")
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("change", "se_change")})


def missing_reason(cells: DataFrame, presence: DataFrame, successors: DataFrame, administered: DataFrame) -> DataFrame:
    """Why a blank (key, cycle) cell is blank: suppressed, absent, succeeded by a code, or not administered."""
    out = cells.where("estimate IS NULL")
    out = out.join(presence.withColumn("_here", F.lit(True)), ["key", "cycle"], "left").join(successors, ["key", "cycle"], "left")
    out = out.join(administered.withColumn("_asked", F.lit(True)), ["key", "cycle"], "left")
    reason = F.when(F.col("suppressed").isNotNull(), F.concat(F.lit("suppressed: "), "suppressed"))
    reason = reason.when(F.col("successor").isNotNull(), F.concat(F.lit("now "), "successor")).when(F.col("_here").isNull(), "absent from cycle")
    return out.select("key", "cycle", reason.when(F.col("_asked").isNull(), "not administered").otherwise("not released").alias("reason"))


def empty_cycles(results: DataFrame, cycles: DataFrame) -> DataFrame:
    """(cycle, n_rows, empty) of every wanted cycle."""
    counts = results.groupBy("cycle").agg(F.count("*").alias("n"))
    return cycles.join(counts, "cycle", "left").select("cycle", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNull().alias("empty"))


def contrast_label(contrasts: DataFrame, labels: DataFrame) -> DataFrame:
    """"A minus B" from the value labels (variable, code, label) of both sides; codes stand in for missing labels."""
    one = lambda side: labels.select("variable", F.col("code").alias(f"code_{side}"), F.col("label").alias(f"label_{side}"))
    out = contrasts.join(one("a"), ["variable", "code_a"], "left").join(one("b"), ["variable", "code_b"], "left")
    name = lambda s: F.coalesce(f"label_{s}", F.col(f"code_{s}").cast("string"))
    return out.withColumn("contrast", F.concat(name("a"), F.lit(" minus "), name("b"))).drop("label_a", "label_b")


def ranked(df: DataFrame, value: str = "estimate", average: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rank 1 is the highest, ties share the least; averages and NULLs have none."""
    counts = F.col(value).isNotNull() & ~(average if average is not None else F.lit(False))
    order = Window.partitionBy(*by, counts).orderBy(F.col(value).desc())
    return df.select(F.when(counts, F.rank().over(order)).alias("rank"), "*")


def sort_results(df: DataFrame, by: str = "estimate", descending: bool = True) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last())


def top_n_keep_averages(df: DataFrame, n: int, average: Column, value: str = "estimate") -> DataFrame:
    """The ``n`` highest rows, and all averages."""
    top = df.where(~average & F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(n)
    return top.unionByName(df.where(average))


def extremes_per_group(df: DataFrame, group: str, key: str, value: str = "estimate", n: int = 3, named: Sequence = ()) -> DataFrame:
    """First and last ``n`` rows of every group and the named rows, with the group's extremes."""
    up = Window.partitionBy(group).orderBy(F.col(value).desc(), key)
    down = Window.partitionBy(group).orderBy(F.col(value).asc(), key)
    known = df.where(F.col(value).isNotNull())
    every = Window.partitionBy(group)
    out = known.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down), "highest": F.max(value).over(every), "lowest": F.min(value).over(every)})
    return out.where((F.col("_up") <= n) | (F.col("_down") <= n) | F.col(key).isin(*named)).drop("_up", "_down")


def pairwise_differences(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Every pair a < b of a group: difference, error, verdict. Result frames have a row per economy, so pairs are few."""
    one = lambda s: df.where("estimate IS NOT NULL").select(*by, *[F.col(c).alias(f"{c}_{s}") for c in (key, "estimate", "se")])
    a, b = one("a"), one("b")
    pairs = a.join(b, list(by)) if by else a.join(F.broadcast(b), F.col(f"{key}_a") < F.col(f"{key}_b"))
    out = pairs.where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    diff, se = F.col("estimate_a") - F.col("estimate_b"), F.sqrt(F.pow("se_a", 2) + F.pow("se_b", 2))
    return out.select(*by, f"{key}_a", f"{key}_b", diff.alias("difference"), se.alias("se"), verdict(diff, se).alias("significant"))


def tied_with(df: DataFrame, key: str, named: Sequence) -> DataFrame:
    """For named rows: how many rows lie clearly above and below, the tied ones, and the range of ranks."""
    rows = df.where("estimate IS NOT NULL").select(key, "estimate", "se")
    own = F.broadcast(rows.where(F.col(key).isin(*named)).select(F.col(key).alias("name"), F.col("estimate").alias("_e"), F.col("se").alias("_s")))
    diff, se = F.col("estimate") - F.col("_e"), F.sqrt(F.pow("se", 2) + F.pow("_s", 2))
    tie = F.abs(diff) <= Z * se
    out = rows.join(own, F.col(key) != F.col("name")).groupBy("name").agg(
        F.count_if(~tie & (diff > 0)).alias("n_above"), F.count_if(~tie & (diff < 0)).alias("n_below"), F.sort_array(F.collect_list(F.when(tie, F.col(key)))).alias("_tied")
    )
    low = F.col("n_above") + 1
    return out.select("name", "n_above", "n_below", F.array_join("_tied", " ").alias("tied"), low.alias("rank_from"), (low + F.size("_tied")).alias("rank_to"))


def diff_from_average(df: DataFrame, key: str, average: DataFrame, members: DataFrame) -> DataFrame:
    """Row minus the group's average (estimate, se, n_members); a member's own share in it enters the error."""
    avg = F.broadcast(average.select(F.col("estimate").alias("_a"), F.col("se").alias("_as"), F.col("n_members").alias("_n")))
    out = df.where("estimate IS NOT NULL").crossJoin(avg).join(members.select(key).withColumn("_member", F.lit(True)), key, "left")
    member = F.coalesce("_member", F.lit(False))
    var = F.pow("se", 2) * F.when(member, 1 - 2 / F.col("_n")).otherwise(1.0) + F.pow("_as", 2)
    diff, se = F.col("estimate") - F.col("_a"), F.sqrt(F.greatest(var, F.lit(0.0)))
    return out.select(key, member.alias("member"), diff.alias("difference"), se.alias("se_difference"), verdict(diff, se).alias("significant"))


def change_of_difference(pairs: DataFrame, first: str, last: str, keys: Sequence[str]) -> DataFrame:
    """(a - b) in the last cycle minus that in the first; link errors cancel."""
    one = lambda c: pairs.where(F.col("cycle") == c).select(*keys, F.col("difference").alias(f"d_{c}"), F.col("se").alias(f"s_{c}"))
    out = one(first).join(one(last), list(keys))
    diff, se = F.col(f"d_{last}") - F.col(f"d_{first}"), F.sqrt(F.pow(f"s_{first}", 2) + F.pow(f"s_{last}", 2))
    return out.select(*keys, diff.alias("change"), se.alias("se_change"), verdict(diff, se).alias("significant"))


def trend_shape(trend: DataFrame, key: str = "cnt", most: int = 5) -> DataFrame:
    """How many changes are clear rises, clear falls, or flat, and the ``most`` largest clear ones by name."""
    clear = F.coalesce(verdict(F.col("change"), F.col("se_change")), F.lit(False))
    shape = F.when(clear & (F.col("change") > 0), "rise").when(clear, "fall").otherwise("flat")
    rows = trend.where("change IS NOT NULL").withColumn("shape", shape)
    place = F.row_number().over(Window.partitionBy("shape").orderBy(F.abs("change").desc(), key))
    named = F.when((F.col("shape") != "flat") & (F.col("_k") <= most), F.struct("_k", F.col(key).alias("name")))
    largest = F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["name"]), " ")
    g = rows.withColumn("_k", place).groupBy("shape")
    return g.agg(F.count("*").alias("n"), F.max("change").alias("highest"), F.min("change").alias("lowest"), largest.alias("largest"))


def fact_rows(df: DataFrame, key: str, average: Column, least: float = 0.85, change: str | None = None, term: str | None = None) -> DataFrame:
    """One tidy row per result row: level, error, rank among how many, verdict, low coverage.

    ``average`` marks benchmark rows, which have no rank; with ``change`` (and ``se_change``) the verdict
    is that of the change, which is a column more; of regression terms (``term``) the intercept has
    neither rank nor verdict.
    """
    blank = small_cell(F.col("n"), F.col("n_schools")).isNotNull()
    aside = average if term is None else average | (F.col(term) == "(intercept)")
    shown = df.withColumns({"level": F.when(~blank, F.col("estimate")), "error": F.when(~blank, F.col("se"))})
    by = [term] if term else []
    out = ranked(shown, "level", aside, by)
    counted = F.sum(F.when(F.col("rank").isNotNull(), 1)).over(Window.partitionBy(*by))
    low = F.when(~blank & (F.col("wcov") < least), F.round(100 * (1 - F.col("wcov"))))
    judged = verdict(F.col(change), F.col("se_change")) if change else verdict(F.col("level"), F.col("error"))
    if term:
        judged = F.when(F.col(term) != "(intercept)", judged)
    more = [F.when(~blank, F.col(change)).alias("change")] if change else []
    return out.select(
        key, *by, "level", "error", *more, "rank", F.when(F.col("rank").isNotNull(), counted).alias("ranked"),
        judged.alias("significant"), low.alias("missing_percent"),
    )
