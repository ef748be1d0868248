"""Usage analytics on an append-only event log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], since: Column | None = None, limit: int = 5000) -> DataFrame:
    """Merge the lines of an id in order: each field's last value wins; an id starts at a line that passes ``since``."""
    seq = F.struct(*order)
    rows = events.where(F.col(key).isNotNull())
    if since is not None:
        starts = rows.where(since).groupBy(key).agg(F.min(seq).alias("_from"))
        rows = rows.join(starts, key).where(seq >= F.col("_from"))
    state = rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields], F.max(seq).alias("_last"))
    return state.orderBy(F.col("_last").desc(), key).limit(limit).drop("_last")


def usage_kpis(events: DataFrame) -> DataFrame:
    """The figures of a log's head: asks, sessions, institutions, shares in per cent, votes, rate limits.

    Needs kind, session, institution, route, error, chart (NULL: nothing rendered), vote, mobile.
    """
    ask = F.col("kind") == "ask"
    n = F.count_if(ask)
    drawn = ask & F.col("chart").isNotNull()
    percent = lambda test, of: F.round(100 * F.try_divide(F.count_if(test), of))
    return events.agg(
        n.alias("asks"), F.count_distinct(F.when(ask, F.col("session"))).alias("sessions"), F.count_distinct(F.when(ask, F.col("institution"))).alias("institutions"),
        percent(ask & (F.col("route") == "data"), n).alias("data_percent"), percent(ask & ((F.col("route") == "error") | F.col("error").isNotNull()), n).alias("error_percent"),
        percent(drawn & (F.col("chart") != "none"), F.count_if(drawn)).alias("charted_percent"),
        F.count_if(ask & (F.col("vote") == "up")).alias("votes_up"), F.count_if(ask & (F.col("vote") == "down")).alias("votes_down"),
        percent(drawn & F.col("mobile"), F.count_if(drawn)).alias("mobile_percent"), F.count_if(F.col("kind") == "rate_limited").alias("rate_limited"),
    )


def usage_latency(events: DataFrame, by: Sequence[str], value: str = "total_ms", calls: str = "calls") -> DataFrame:
    """Latency at the median and the 95th place, and the median number of calls."""
    time = nearest_rank(events, by, value, (0.5, 0.95))
    many = nearest_rank(events, by, calls, (0.5,)).withColumnRenamed("p50", "median_calls")
    return time.join(many, list(by), "left") if by else time.crossJoin(many)


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """The value at place floor(q n) of the ascending values, counted by distinct value instead of sorting rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_end": F.sum("_c").over(run), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_end") > F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1), F.col(value))).alias(f"p{int(q * 100)}") for q in points])


def usage_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("asks")).orderBy("day")


def top_counts(df: DataFrame, column: Column, n: int = 20, array: bool = False) -> DataFrame:
    """Most frequent values (elements of arrays), ties by value."""
    return df.select((F.explode(column) if array else column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(n)


#: The breakdowns of a log: name, column, whether it is a list, whether only asks with data count, how many are shown.
BREAKDOWNS = (
    ("institution", "institution", False, False, 1000), ("template", "template", False, True, 1000), ("cycles", "cycles", False, True, 1000), ("chart", "chart", False, False, 1000),
    ("country", "countries", True, True, 15), ("variable", "variables", True, True, 15), ("guard", "guards", True, False, 20), ("mode", "summary_mode", False, True, 1000), ("build", "build", False, True, 1000),
)


def usage_breakdowns(events: DataFrame) -> DataFrame:
    """Counts of a log by institution, template, cycles, chart, country, variable, guard, mode and build.

    One pass counts the values of all of them; only counts are ranked.
    """
    asks = events.where("kind = 'ask'")

    def cells_of(name: str, column: str, is_list: bool, data: bool) -> Column:
        value = F.col(column) if is_list else F.array(F.col(column).cast("string"))
        counted = F.when(F.col("route") == "data", value) if data else value
        return F.transform(F.coalesce(counted, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("breakdown"), v.alias("value")))

    cells = [cells_of(*b[:4]) for b in BREAKDOWNS]
    n = asks.select(F.explode(F.concat(*cells)).alias("c")).select("c.*").where("value IS NOT NULL AND value <> ''").groupBy("breakdown", "value").agg(F.count("*").alias("n"))
    most = F.create_map(*[F.lit(x) for name, *_, k in BREAKDOWNS for x in (name, k)])
    place = F.row_number().over(Window.partitionBy("breakdown").orderBy(F.col("n").desc(), "value"))
    return n.withColumn("_k", place).where(F.col("_k") <= most[F.col("breakdown")]).drop("_k")


def guard_downvotes(events: DataFrame, guards: Column, down: Column) -> DataFrame:
    """Per guard: how often it fired, and how many of those asks were voted down."""
    each = events.select(F.explode(guards).alias("guard"), down.alias("_down"))
    return each.groupBy("guard").agg(F.count("*").alias("n"), F.count_if("_down").alias("n_down"))


def review_queues(events: DataFrame, n: int = 200) -> DataFrame:
    """(queue, event_id, ts): rejected drafts, answers voted down, errors, clarifications, and the newest ``n`` asks."""
    asks = events.where("kind = 'ask'")
    tests = {
        "rejected": (F.col("route") == "data") & (F.size(F.coalesce("prose_issues", F.array().cast("array<string>"))) > 0), "down": F.col("vote") == "down",
        "error": (F.col("route") == "error") | F.col("error").isNotNull(), "clarify": F.col("route") == "clarify",
    }
    named = F.filter(F.array(*[F.when(t, k) for k, t in tests.items()]), lambda q: q.isNotNull())
    queued = asks.select(F.explode(named).alias("queue"), "event_id", "ts")
    newest = asks.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).select(F.lit("recent").alias("queue"), "event_id", "ts")
    return queued.unionByName(newest)


def event_facts(asks: DataFrame) -> DataFrame:
    """Loggable columns of answered plans: countries named in the filter, whether all count, number of rows, flags.

    Needs event_id, template, filter (text), groups, rows, substitution, limitation, benchmarks.
    """
    countries = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("filter", F.lit("")), F.lit("'([A-Z]{3})'"), F.lit(1))))
    return asks.select(
        "event_id", "template", F.array_join(countries, " ").alias("countries"), (F.array_contains(F.coalesce("groups", F.array().cast("array<string>")), "CNT") & (F.size(countries) == 0)).alias("all_countries"),
        F.coalesce("rows", F.lit(0)).alias("rows"), (F.col("template") == "raw_sql").alias("raw_sql"), F.coalesce(F.col("substitution") != "", F.lit(False)).alias("substitution"),
        F.coalesce(F.col("limitation") != "", F.lit(False)).alias("limitation"), (F.size(F.coalesce("benchmarks", F.array().cast("array<string>"))) > 0).alias("has_benchmarks"),
    )
