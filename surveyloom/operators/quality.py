"""Reconciliation with published figures, and drift between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUMBER


def reconcile_means(published: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Status of every published mean: ok, fail, or missing from the computed ones."""
    out = published.join(computed, list(keys), "left")
    diff = F.abs(F.col("published") - F.col("estimate"))
    return out.select(*keys, "published", "estimate", diff.alias("difference"), F.when(F.col("estimate").isNull(), "missing").when(diff <= tolerance, "ok").otherwise("fail").alias("status"))


def reconcile_se(published: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n within 1, population within 0.5 %, error within 0.02; a row without published error is noted."""
    out = published.join(computed, list(keys), "left")
    ok = (F.abs(F.col("p_n") - F.col("n")) <= 1) & (F.abs(F.col("p_pop") - F.col("pop")) <= 0.005 * F.col("p_pop")) & (F.abs(F.col("p_se") - F.col("se")) <= 0.02)
    return out.select(*keys, F.when(F.col("n").isNull(), "missing").when(F.col("p_se").isNull(), "noted").when(ok, "ok").otherwise("fail").alias("status"))


def result_drift(golden: DataFrame, current: DataFrame, keys: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """Golden cells against current ones; new, gone, blank and moved cells are told apart."""
    a = golden.select(*keys, F.col("estimate").alias("golden"), F.lit(True).alias("_g"))
    b = current.select(*keys, F.col("estimate").alias("current"), F.lit(True).alias("_c"))
    out = a.join(b, list(keys), "full_outer")
    status = F.when(F.col("_g").isNull(), "new").when(F.col("_c").isNull(), "gone")
    same = (F.abs(F.col("golden") - F.col("current")) <= tolerance) | (F.col("golden").isNull() & F.col("current").isNull())
    return out.select(*keys, "golden", "current", status.when(same, "same").otherwise("moved").alias("status"))


def answer_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest recorded and the newest new run of every question: route, template, variables, numbers.

    Both need question, ts, event_id, route, template, variables (array), answer, error. A number counts
    as lost if the old answer has it, with decimals or from 100 on, and the new one does not, to one
    decimal.
    """
    seen = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))
    counts = F.filter(seen, lambda x: F.contains(x, F.lit(".")) | (x.cast("double") >= 100))
    numbers = F.array_distinct(F.transform(counts, lambda x: F.round(x.cast("double"), 1)))
    fields = ["route", "template", "variables", "numbers", "error"]

    def newest(df: DataFrame, s: str) -> DataFrame:
        rows = df.withColumns({"question": F.trim("question"), "numbers": numbers}).where("question <> ''")
        one = rows.groupBy("question").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("x"))
        return one.select("question", *[F.col(f"x.{f}").alias(f"{f}_{s}") for f in fields])

    both = newest(old, "old").join(newest(new, "new"), "question")
    none = F.array().cast("array<string>")
    text = lambda c: F.array_join(F.array_sort(c), " ")
    a, b = F.coalesce("variables_old", none), F.coalesce("variables_new", none)
    known = (F.size(a) > 0) & (F.size(b) > 0)
    lost = F.array_except("numbers_old", "numbers_new")
    return both.select(
        "question", F.col("route_old").eqNullSafe(F.col("route_new")).alias("same_route"), (F.col("template_old").isNull() | F.col("template_old").eqNullSafe(F.col("template_new"))).alias("same_template"),
        F.when(known, text(F.array_except(a, b))).otherwise("").alias("variables_gone"), F.when(known, text(F.array_except(b, a))).otherwise("").alias("variables_new"),
        F.size(lost).alias("n_numbers_lost"), F.when(F.col("error_new").isNotNull(), "fails now").when(F.col("error_old").isNotNull(), "fixed").alias("error"),
    )
