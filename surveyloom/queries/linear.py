"""Queries: measures, means, gaps, quarters, correlations, percentiles, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as ms
from ..operators import stats
from ..operators.quantile import weighted_quarters as quarters
from ..operators.replicate import analysis_frame as frame_of
from ..operators.replicate import combine as combined
from ..operators.replicate import replicate_means as rep_means
from .fixture import ALL, DESIGN, M, MEAN, pv, query, rounded, sql_comb, sql_diff, sql_f, sql_join, sql_mean, sql_rep, sql_stats, survey

CNT = ["cnt"]


def pva():
    """The imputations of the first domain; columns need a running session, so they are made on call."""
    return ms.family("pv{pv}a", M)


def pvb():
    return ms.family("pv{pv}b", M)


def _mean(name, measure, sql_measures, by=("cnt",), where=None, sql_where=""):
    by = list(by)

    def run(spark, d):
        return rounded(stats.weighted_mean(survey(spark, d), DESIGN, measure(), by, where() if where else None))

    query(name, sql_mean(by, sql_measures, sql_where))(run)


_share = lambda test, known: f"CASE WHEN {known} THEN CASE WHEN {test} THEN 100.0 ELSE 0.0 END END"
_lvl = lambda p, op, cut: _share(f"{p} {op} {cut}", f"{p} IS NOT NULL")

_mean("weighted_mean", pva, pv())
_mean("measure_score", lambda: ms.score(pva(), 100), [f"{p} / 100.0" for p in pv()])
_mean("measure_level_share", lambda: ms.level_share(pva(), ">=", 200), [_lvl(p, ">=", 200) for p in pv()])
_mean(
    "measure_joint_level_share",
    lambda: ms.joint_level_share([pva(), pvb()], "<", 250, True),
    [_share(f"coalesce({a} < 250, FALSE) AND coalesce({b} < 250, FALSE)", f"coalesce({a}, {b}) IS NOT NULL") for a, b in zip(pv(), pv("b"), strict=True)],
)
_mean("measure_code_share", lambda: [ms.code_share(F.col("item"), [1, 2], [3, 4])], [_share("item IN (1, 2)", "item IN (1, 2, 3, 4)")])
_mean("measure_threshold_share", lambda: [ms.share(F.col("escs") > 0, F.col("escs").isNotNull())], [_share("escs > 0", "escs IS NOT NULL")])
_mean(
    "measure_count_share",
    lambda: [ms.count_share([F.col("item"), F.col("immig"), F.col("gender")], 1, 2)],
    [_share("coalesce(CAST(item = 1 AS INT), 0) + coalesce(CAST(immig = 1 AS INT), 0) + coalesce(CAST(gender = 1 AS INT), 0) >= 2", "coalesce(item, immig, gender) IS NOT NULL")],
)
_mean(
    "filter_ops", pva, pv(), where=lambda: ms.all_of([ms.condition("item", "in", [1, 2, 3]), ms.condition("escs", ">", -1), ms.condition("gender", "not_null"), ms.condition("immig", "!=", 3), ms.condition("x2", "<=", 0.08)]),
    sql_where="item IN (1, 2, 3) AND escs > -1 AND gender IS NOT NULL AND immig <> 3 AND x2 <= 0.08",
)


@query("weighted_proportion", f"WITH {sql_f()}, {sql_rep(CNT, [_share('immig IN (1)', 'immig IS NOT NULL')])}, {sql_comb(CNT)} SELECT cnt, {ALL}, 'first' AS category FROM c")
def weighted_proportion(spark, d):
    return rounded(stats.weighted_proportion(survey(spark, d), DESIGN, F.col("immig"), [1], CNT, category="first"))


@query("replicate_means", f"WITH {sql_f()}, {sql_rep(CNT, pv())} SELECT cnt, pv, rep, round(value, 6) AS value, n, n_schools, round(wcov, 6) AS wcov FROM r")
def replicate_means(spark, d):
    return rounded(rep_means(survey(spark, d), DESIGN, pva(), CNT))


@query("combine", f"WITH {sql_f()}, {sql_rep(['cycle', 'cnt'], pv('b'))}, {sql_comb(['cycle', 'cnt'])} SELECT cycle, cnt, {ALL} FROM c")
def combine(spark, d):
    return rounded(combined(rep_means(survey(spark, d), DESIGN, pvb(), ["cycle", "cnt"]), ["cycle", "cnt"], DESIGN))


@query("analysis_frame", f"WITH {sql_f(chr(34) + 'cycle' + chr(34) + ' = ' + chr(39) + 'c3' + chr(39))} SELECT cnt, gender, round(pv1a, 6) AS m_1, round(pv2a, 6) AS m_2, round(escs, 6) AS escs, w0, w1, w80, sch AS school FROM f")
def analysis_frame(spark, d):
    f = frame_of(survey(spark, d), DESIGN, pva()[:2], ["cnt", "gender"], F.col("cycle") == "c3", {"escs": F.col("escs")})
    w = F.col("_weights")
    return rounded(f.select("cnt", "gender", "m_1", "m_2", "escs", w[0].alias("w0"), w[1].alias("w1"), w[80].alias("w80"), F.col("_school").alias("school")))


_multi = lambda by, sets: ", ".join(f"{sql_rep(by, m, p=k)}, {sql_comb(by, p=k)}" for k, m in sets.items())


@query("weighted_means_multi", f"WITH {sql_f()}, {_multi(CNT, {'ma': pv(), 'mb': pv('b'), 'me': ['escs']})} " + " UNION ALL ".join(f"SELECT cnt, '{n}' AS measure, {ALL} FROM {k}c" for k, n in (("ma", "math"), ("mb", "read"), ("me", "escs"))))
def weighted_means_multi(spark, d):
    return rounded(stats.weighted_means_multi(survey(spark, d), DESIGN, {"math": pva(), "read": pvb(), "escs": [F.col("escs")]}, CNT))


def _gap_sql(by, measures, column, a, b, label, where=""):
    w = f"{column} IN ({a}, {b})" + (f" AND {where}" if where else "")
    return f"WITH {sql_f(w)}, {sql_rep([*by, column], measures)}, {sql_diff(by, column, a, b)}, {sql_comb(by, src='d')} SELECT '{label}' AS contrast, {''.join(x + ', ' for x in by)} {ALL} FROM c"


@query("gap", _gap_sql(CNT, pv(), "gender", "2", "1", "2 minus 1"))
def gap(spark, d):
    return rounded(stats.gap(survey(spark, d), DESIGN, pva(), F.col("gender"), 2, 1, CNT))


@query("gap_levels", sql_mean(["cnt", "gender"], pv(), "gender IN (1, 2)", f"cnt, gender AS side, {ALL}"))
def gap_levels(spark, d):
    return rounded(stats.gap_levels(survey(spark, d), DESIGN, pva(), F.col("gender"), 2, 1, CNT))


_SIDES = "CASE WHEN item IN (1, 2) THEN 1 WHEN item IN (4, 5) THEN 0 END"


@query("contrast_sets", _gap_sql(CNT, pv(), "g", "1", "0", "low minus high").replace(f"f AS (SELECT * FROM (", f"f AS (SELECT * FROM (SELECT *, {_SIDES} AS g FROM (", 1).replace(") WHERE g IN", ")) WHERE g IN", 1))
def contrast_sets(spark, d):
    return rounded(stats.gap(survey(spark, d), DESIGN, pva(), ms.sides(F.col("item"), [1, 2], [4, 5]), 1, 0, CNT, label="low minus high"))


_ORDER = "k1, k2, k3, k4, k5, w0"


def sql_quarters(value, out="quarter", src="f", within="cnt", dest="q"):
    run = f"sum(w0) OVER (PARTITION BY {within} ORDER BY {value}, {_ORDER} ROWS UNBOUNDED PRECEDING) - w0 / 2"
    p = f"({run}) / sum(w0) OVER (PARTITION BY {within})"
    return f"{dest} AS (SELECT * EXCLUDE (_p), 1 + CAST(_p > 0.25 AS INT) + CAST(_p > 0.5 AS INT) + CAST(_p > 0.75 AS INT) AS {out} FROM (SELECT *, {p} AS _p FROM {src} WHERE {value} IS NOT NULL))"


@query("weighted_quarters", f"WITH {sql_f()}, {sql_quarters('escs')} SELECT cnt, {_ORDER}, quarter FROM q")
def weighted_quarters(spark, d):
    q = quarters(survey(spark, d), DESIGN, F.col("escs"), CNT)
    return rounded(q.select("cnt", *DESIGN.order, "quarter"))


_KNOWN = "y AS (SELECT cnt, sum(CASE WHEN escs IS NOT NULL THEN w0 END) / sum(w0) AS wcov FROM f GROUP BY cnt)"
_QREP = f"WITH {sql_f()}, {sql_quarters('escs')}, {sql_rep(['cnt', 'quarter'], pv(), src='q', p='z')}, {_KNOWN}, r AS (SELECT zr.* REPLACE (y.wcov AS wcov) FROM {sql_join(CNT, 'zr', 'y')})"
_QMEANS = f"{_QREP}, {sql_comb(['cnt', 'quarter'])} SELECT cnt, quarter, {ALL} FROM c"


@query("quartile_means", _QMEANS)
def quartile_means(spark, d):
    return rounded(stats.quartile_means(survey(spark, d), DESIGN, pva(), F.col("escs"), CNT))


@query("quarter_filter", _QMEANS + " WHERE quarter IN (1, 4)")
def quarter_filter(spark, d):
    return rounded(stats.quartile_means(survey(spark, d), DESIGN, pva(), F.col("escs"), CNT, quarters=(1, 4)))


@query("quartile_gap", f"{_QREP}, {sql_diff(CNT, 'quarter', '4', '1')}, {sql_comb(CNT, src='d')} SELECT 'top minus bottom quarter' AS contrast, cnt, {ALL} FROM c")
def quartile_gap(spark, d):
    return rounded(stats.quartile_gap(survey(spark, d), DESIGN, pva(), F.col("escs"), CNT))


def _corr_sql(by, src="f", pre=""):
    ok = [f"CASE WHEN {p} IS NOT NULL AND escs IS NOT NULL THEN {p} END" for p in pv()]
    xs = {f"x{i}": f"CASE WHEN {p} IS NOT NULL THEN escs END" for i, p in enumerate(pv(), 1)}
    # x{i} follows m{i}
    mean = lambda e: f"(sum(w * {e}) / sum(CASE WHEN {{m}} IS NOT NULL THEN w END))"
    x = "x_OF_{m}"
    value = f"({mean(f'{x} * {{m}}')} - {mean(x)} * {mean('{m}')}) / sqrt(greatest({mean(f'{x} * {x}')} - pow({mean(x)}, 2), 0) * greatest({mean('{m} * {m}')} - pow({mean('{m}')}, 2), 0))"
    sql = sql_rep(by, ok, value, src=src, extra=xs)
    for i in range(1, M + 1):
        sql = sql.replace(f"x_OF_m{i}", f"x{i}")
    return f"WITH {sql_f()}, {pre}{sql}, {sql_comb(by)} SELECT {', '.join(by)}, {ALL} FROM c"


@query("correlation", _corr_sql(CNT))
def correlation(spark, d):
    return rounded(stats.correlation(survey(spark, d), DESIGN, [F.col("escs")], pva(), CNT))


@query("correlation_by_quarter", _corr_sql(["quarter", "cnt"], "q", sql_quarters("sch_x") + ", "))
def correlation_by_quarter(spark, d):
    return rounded(stats.correlation_by_quarter(survey(spark, d), DESIGN, [F.col("escs")], pva(), F.col("sch_x"), CNT))


_SD = f"sqrt(greatest(sum(w * {{m}} * {{m}}) / sum(CASE WHEN {{m}} IS NOT NULL THEN w END) - pow({MEAN}, 2), 0))"


@query("weighted_sd", f"WITH {sql_f()}, {sql_rep(CNT, pv(), _SD)}, {sql_comb(CNT)} SELECT cnt, {ALL} FROM c")
def weighted_sd(spark, d):
    return rounded(stats.weighted_sd(survey(spark, d), DESIGN, pva(), CNT))


def _pct_sql(points):
    cells = " UNION ALL ".join(f"SELECT cnt, {i} AS pv, {p} AS value, unnest(range(81)) AS rep, unnest([{', '.join(f'w{r}' for r in range(81))}]) AS w FROM f WHERE {p} IS NOT NULL" for i, p in enumerate(pv(), 1))
    run = "sum(w) OVER (PARTITION BY cnt, pv, rep ORDER BY value RANGE UNBOUNDED PRECEDING)"
    return (
        f"WITH {sql_f()}, t AS ({cells}), u AS (SELECT cnt, pv, rep, value, {run} AS cum, sum(w) OVER (PARTITION BY cnt, pv, rep) AS total FROM t), "
        f"v AS (SELECT cnt, pv, rep, percentile, min(value) AS value FROM u, (SELECT unnest([{', '.join(f'{float(p)}' for p in points)}]) AS percentile) WHERE cum >= total * percentile / 100 GROUP BY cnt, pv, rep, percentile), "
        f"s AS ({sql_stats(CNT, 'pv1a')}), r AS (SELECT v.cnt, percentile, pv, rep, value, n, n_schools, wcov FROM {sql_join(CNT, 'v', 's')})"
    )


@query("percentiles", f"{_pct_sql((10, 50, 90))}, {sql_comb(['cnt', 'percentile'])} SELECT cnt, percentile, {ALL} FROM c")
def percentiles(spark, d):
    return rounded(stats.percentiles(survey(spark, d), DESIGN, pva(), CNT, (10, 50, 90)))


@query("percentile_spread", f"{_pct_sql((10, 90))}, {sql_diff(CNT, 'percentile', '90.0', '10.0')}, {sql_comb(CNT, src='d')} SELECT 'P90 minus P10' AS contrast, cnt, {ALL} FROM c")
def percentile_spread(spark, d):
    return rounded(stats.percentile_spread(survey(spark, d), DESIGN, pva(), CNT))


_TAB = [f"{k}" for k in (1, 2, 3, 4, 5)]


@query(
    "crosstab",
    f"WITH {sql_f('immig IS NOT NULL AND item IS NOT NULL')}, "
    + ", ".join(f"{sql_rep(['cnt', 'immig'], [_share(f'item = {k}', 'item IS NOT NULL')], p=f'i{k}')}, {sql_comb(['cnt', 'immig'], p=f'i{k}')}" for k in _TAB)
    + " " + " UNION ALL ".join(f"SELECT cnt, immig AS \"row\", '{k}' AS col, {ALL} FROM i{k}c" for k in _TAB),
)
def crosstab(spark, d):
    return rounded(stats.crosstab(survey(spark, d), DESIGN, "immig", "item", CNT))


_TOP = [_share(f"q{i} = 4", f"q{i} IS NOT NULL") for i in range(1, M + 1)]
@query(
    "resilient_share",
    f"WITH {sql_f()}, {sql_quarters('escs', 'low')}, "
    + ", ".join(f"{sql_quarters(f'pv{i}a', f'q{i}', 'q', dest=f'z{i}')}" for i in range(1, M + 1))
    + ", y AS (SELECT q.*, " + ", ".join(f"z{i}.q{i}" for i in range(1, M + 1)) + " FROM q "
    + " ".join(f"LEFT JOIN z{i} ON " + " AND ".join(f"q.{k} = z{i}.{k}" for k in ("cnt", *DESIGN.order)) for i in range(1, M + 1))
    + f" WHERE q.low = 1), {sql_rep(CNT, _TOP, src='y')}, {sql_comb(CNT)} SELECT cnt, {ALL} FROM c",
)
def resilient_share(spark, d):
    return rounded(stats.resilient_share(survey(spark, d), DESIGN, pva(), F.col("escs"), CNT))


_BETWEEN = " UNION ALL ".join(
    f"SELECT cnt, {i} AS pv, rep, 100 * (sum(s * s / nullif(w, 0)) / sum(w) - pow(sum(s) / sum(w), 2)) / (sum(q) / sum(w) - pow(sum(s) / sum(w), 2)) AS value "
    f"FROM (SELECT cnt, sch, rep, sum(CASE WHEN m{i} IS NOT NULL THEN w END) AS w, sum(w * m{i}) AS s, sum(w * m{i} * m{i}) AS q FROM l GROUP BY cnt, sch, rep) GROUP BY cnt, rep"
    for i in range(1, M + 1)
)


@query(
    "between_school_share",
    f"WITH {sql_f()}, l AS (SELECT cnt, sch, pv1a AS m1, pv2a AS m2, pv3a AS m3, unnest(range(81)) AS rep, unnest([{', '.join(f'w{r}' for r in range(81))}]) AS w FROM f), v AS ({_BETWEEN}), "
    f"s AS ({sql_stats(CNT, 'pv1a')}), r AS (SELECT v.*, n, n_schools, wcov FROM {sql_join(CNT, 'v', 's')}), {sql_comb(CNT)} SELECT cnt, {ALL} FROM c",
)
def between_school_share(spark, d):
    return rounded(stats.between_school_share(survey(spark, d), DESIGN, pva(), CNT))


