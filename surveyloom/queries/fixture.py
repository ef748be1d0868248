"""The driver's tables as a survey, in SQL that Spark and DuckDB both run, and the SQL of the kernel.

A respondent is a line of an order, a school a customer, an economy the customer's nation,
a cycle the ship year modulo 3. Replicate weights follow Walsh signs of the school.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign

G, M = 80, 3
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_W = ",\n  ".join(f"l_quantity * (CASE WHEN bit_count((o_custkey % 128) & {r}) % 2 = 0 THEN 1.5 ELSE 0.5 END) AS w{r}" for r in range(1, G + 1))
_PV = ",\n  ".join(
    f"CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE {base} + ((l_partkey * {i}) % 11 - 5) * 4 + ((l_suppkey * {i}) % 7 - 3) * 3 END AS pv{i}{d}"
    for d, base in (("a", "l_extendedprice / 200"), ("b", "o_totalprice / 1000"))
    for i in range(1, M + 1)
)
_FROM = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_YEAR = "year(l_shipdate) % 3"
FRAME = f"""SELECT
  CASE {_YEAR} WHEN 0 THEN 'c1' WHEN 1 THEN 'c2' ELSE 'c3' END AS cycle,
  n_name AS cnt, o_custkey AS sch, c_mktsegment AS stratum,
  CASE WHEN n_regionkey IN (0, 1, 2) THEN 1 ELSE 0 END AS oecd, n_regionkey AS region,
  CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 END AS gender,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS immig,
  CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS item,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS adm,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE (o_totalprice - 250000) / 100000 + (l_extendedprice - 50000) / 70000 END AS escs,
  l_discount AS x2, c_acctbal AS sch_x,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5,
  l_quantity AS w0,
  {_W},
  {_PV}
{_FROM}
WHERE NOT (n_name = 'NATION_24' AND {_YEAR} = 0)"""


#: For Spark the weights are one array, looked up by the school's pattern of Walsh signs and the row's weight.
PATTERNS, WEIGHTS = 128, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The respondents of all cycles.

    Orders meet their customers before the lines do, so that lines are shuffled once however many customers
    there are, and of a line's date only the cycle's number is.
    """
    lines, orders, customers, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    orders = orders.join(customers, F.expr("o_custkey = c_custkey"))
    sql = FRAME.replace(_W, f"o_custkey % {PATTERNS} AS pattern").replace(_YEAR, "l_cycle")
    sql = sql.replace(_FROM, "FROM {lines} JOIN {orders} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey")
    return with_weights(spark.sql(sql, lines=lines.withColumn("l_cycle", F.expr(_YEAR)), orders=orders, nation=nation))


def with_weights(rows: DataFrame) -> DataFrame:
    """Rows with their array of weights, from the school's pattern and the full-sample weight."""
    arrays = "transform(sequence(0, {G}), r -> w0 * CASE WHEN r = 0 THEN 1.0D WHEN bit_count(pattern & r) % 2 = 0 THEN 1.5D ELSE 0.5D END)".replace("{G}", str(G))
    keys = rows.sparkSession.range(PATTERNS * WEIGHTS).select((F.col("id") % PATTERNS).alias("_p"), (F.floor(F.col("id") / PATTERNS) + 1).cast("double").alias("_w"))
    held = keys.select("_p", "_w", F.expr(arrays.replace("w0", "_w").replace("pattern", "_p")).alias("_wts"))
    # a weight outside the usual range has its array made in place
    out = rows.join(F.broadcast(held), (F.col("pattern") == F.col("_p")) & (F.col("w0") == F.col("_w")), "left")
    return out.withColumn("wts", F.coalesce("_wts", F.expr(arrays))).drop("_p", "_w", "_wts")


DESIGN = SurveyDesign(array="wts", reps=G, made_from=("pattern", "w0"), make=with_weights)


def query(name: str, sql: str | None) -> Callable:
    """Register a query over (spark, sf_dir) and the SQL it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as sums depend on their order."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def pv(d: str = "a") -> list[str]:
    return [f"pv{i}{d}" for i in range(1, M + 1)]


# -- SQL of the kernel ---------------------------------------------------------------------------

_WS = ", ".join(f"w{r}" for r in range(G + 1))
STATS = "n, n_schools, wcov"


def _b(by: Sequence[str]) -> str:
    return "".join(f"{x}, " for x in by)


def _g(by: Sequence[str], *more: str) -> str:
    keys = [*by, *more]
    return f"GROUP BY {', '.join(keys)}" if keys else ""


def sql_f(where: str = "") -> str:
    """CTE ``f``: the respondents."""
    return f"f AS (SELECT * FROM ({FRAME}){' WHERE ' + where if where else ''})"


def sql_stats(by: Sequence[str], first: str, src: str = "f", school: str = "sch") -> str:
    return (
        f"SELECT {_b(by)} count(CASE WHEN {first} IS NOT NULL THEN 1 END) AS n, "
        f"CASE WHEN count({school}) > 0 THEN count(DISTINCT CASE WHEN {first} IS NOT NULL THEN {school} END) ELSE -1 END AS n_schools, "
        f"sum(CASE WHEN {first} IS NOT NULL THEN w0 END) / sum(w0) AS wcov FROM {src} {_g(by)}"
    )


def sql_join(by: Sequence[str], a: str, b: str, how: str = "JOIN") -> str:
    on = " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in by) or "TRUE"
    return f"{a} {how} {b} ON {on}"


def sql_values(by: Sequence[str], measures: Sequence[str], value: str, p: str = "", src: str = "f", extra: dict[str, str] | None = None) -> str:
    """CTEs ``{p}l`` (a row per row and weight) and ``{p}v`` (by, pv, rep, value); ``value`` uses ``m`` and ``w``."""
    cols = "".join(f"{m} AS m{i}, " for i, m in enumerate(measures, 1)) + "".join(f"{e} AS {k}, " for k, e in (extra or {}).items())
    one = " UNION ALL ".join(
        f"SELECT {_b(by)} {i} AS pv, rep, {value.replace('{m}', f'm{i}')} AS value FROM {p}l {_g(by, 'rep')}" for i in range(1, len(measures) + 1)
    )
    return f"{p}l AS (SELECT {_b(by)} {cols} unnest(range({G + 1})) AS rep, unnest([{_WS}]) AS w FROM {src}), {p}v AS ({one})"


MEAN = "sum(w * {m}) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN w END), 0)"


def sql_rep(by: Sequence[str], measures: Sequence[str], value: str = MEAN, p: str = "", src: str = "f", school: str = "sch", extra: dict[str, str] | None = None, first: str | None = None) -> str:
    """CTE ``{p}r``: the replicate frame."""
    return (
        sql_values(by, measures, value, p, src, extra)
        + f", {p}s AS ({sql_stats(by, first or measures[0], src, school)}), {p}r AS (SELECT {''.join(f'{p}v.{x}, ' for x in by)} pv, rep, value, {STATS} FROM {sql_join(by, p + 'v', p + 's')})"
    )


def sql_comb(by: Sequence[str], p: str = "", src: str | None = None, out: str | None = None) -> str:
    """CTE ``{p}c``: estimates and standard errors of the replicate frame."""
    src, out = src or f"{p}r", out or f"{p}c"
    return f"""{out}0 AS (SELECT *, max(CASE WHEN rep = 0 THEN value END) OVER (PARTITION BY {_b(by)} pv) AS t0 FROM {src}),
{out}1 AS (SELECT {_b(by)} pv, max(t0) AS t0, sum(CASE WHEN rep > 0 THEN pow(value - t0, 2) END) / 20 AS u, min(n) AS n, min(n_schools) AS n_schools, min(wcov) AS wcov FROM {out}0 {_g(by, 'pv')}),
{out} AS (SELECT {_b(by)} avg(t0) AS estimate, CASE WHEN avg(t0) IS NOT NULL THEN sqrt(avg(u) + (1 + 1.0 / count(*)) * coalesce(var_samp(t0), 0)) END AS se,
  count(*) AS n_pv, min(n) AS n, min(n_schools) AS n_schools, min(wcov) AS wcov FROM {out}1 {_g(by)})"""


def sql_diff(by: Sequence[str], column: str, a: str, b: str, p: str = "", out: str = "d") -> str:
    """CTE ``out``: replicate frame of side a minus side b."""
    side = lambda s: f"max(CASE WHEN {column} = {s} THEN value END)"
    return f"{out} AS (SELECT {_b(by)} pv, rep, {side(a)} - {side(b)} AS value, min(n) AS n, min(n_schools) AS n_schools, min(wcov) AS wcov FROM {p}r WHERE {column} IN ({a}, {b}) {_g(by, 'pv', 'rep')})"


EST = "round(estimate, 6) AS estimate, round(se, 6) AS se"
ALL = f"{EST}, n_pv, n, n_schools, round(wcov, 6) AS wcov"


def sql_mean(by: Sequence[str], measures: Sequence[str], where: str = "", select: str | None = None) -> str:
    """A whole query: weighted means by group."""
    return f"WITH {sql_f(where)}, {sql_rep(by, measures)}, {sql_comb(by)} SELECT {select or _b(by) + ALL} FROM c"
