"""Queries: regression, trends, benchmarks, rules and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as ms
from ..operators import cycles, regress, rules, stats, trend
from ..operators.schools import school_mean
from .fixture import ALL, DESIGN, EST, pv, query, rounded, sql_comb, sql_diff, sql_f, sql_join, sql_mean, sql_rep, sql_stats, survey, table
from .linear import CNT, pva, pvb, sql_quarters

CYC = ["c1", "c2", "c3"]


def _means(spark, d, by=("cycle", "cnt"), measure=None):
    """A result frame, the input of the rules."""
    return stats.weighted_mean(survey(spark, d), DESIGN, measure or pva(), list(by))


def _cte(by=("cycle", "cnt"), measures=None, where="", name="res"):
    by = list(by)
    return f"{sql_f(where)}, {sql_rep(by, measures or pv())}, {sql_comb(by)}, {name} AS (SELECT * FROM c)"


def _beta_sql(by, src="f", pre=""):
    """Closed form of one predictor."""
    parts = []
    for i, p in enumerate(pv(), 1):
        ok = f"({p} IS NOT NULL AND escs IS NOT NULL)"
        s = f"SELECT {', '.join(by)}, rep, sum(CASE WHEN {ok} THEN w END) AS w, sum(CASE WHEN {ok} THEN w * escs END) AS x, sum(CASE WHEN {ok} THEN w * {p} END) AS y, sum(CASE WHEN {ok} THEN w * escs * escs END) AS xx, sum(CASE WHEN {ok} THEN w * escs * {p} END) AS xy FROM l GROUP BY {', '.join(by)}, rep"
        slope = "(xy / w - (x / w) * (y / w)) / (xx / w - (x / w) * (x / w))"
        parts.append(f"SELECT {', '.join(by)}, 'escs' AS term, {i} AS pv, rep, {slope} AS value FROM ({s}) UNION ALL SELECT {', '.join(by)}, '(intercept)', {i}, rep, y / w - {slope} * x / w FROM ({s})")
    ws = ", ".join(f"w{r}" for r in range(81))
    return (
        f"WITH {sql_f()}, {pre}l AS (SELECT {', '.join(by)}, escs, {', '.join(pv())}, unnest(range(81)) AS rep, unnest([{ws}]) AS w FROM {src}), v AS ({' UNION ALL '.join(parts)}), "
        f"s AS ({sql_stats(by, 'CASE WHEN escs IS NOT NULL THEN pv1a END', src)}), r AS (SELECT v.*, n, n_schools, wcov FROM {sql_join(by, 'v', 's')}), {sql_comb([*by, 'term'])} SELECT {', '.join(by)}, term, {ALL} FROM c"
    )


@query("regression", _beta_sql(CNT))
def regression(spark, d):
    return rounded(regress.regression(survey(spark, d), DESIGN, pva(), {"escs": F.col("escs")}, CNT))


def _two_sql(by):
    """Closed form of two predictors from sums about the means."""
    parts = []
    for i, p in enumerate(pv(), 1):
        ok = f"({p} IS NOT NULL AND escs IS NOT NULL AND x2 IS NOT NULL)"
        total = lambda e, ok=ok: f"sum(CASE WHEN {ok} THEN w * {e} END) / sum(CASE WHEN {ok} THEN w END)"
        pairs = {"a": "escs", "b": "x2", "y": p, "aa": "escs * escs", "bb": "x2 * x2", "ab": "escs * x2", "ay": f"escs * {p}", "yb": f"x2 * {p}"}
        s = f"SELECT {', '.join(by)}, rep, {', '.join(f'{total(e)} AS {k}' for k, e in pairs.items())} FROM l GROUP BY {', '.join(by)}, rep"
        det = "((aa - a * a) * (bb - b * b) - (ab - a * b) * (ab - a * b))"
        one = f"(((ay - a * y) * (bb - b * b) - (yb - y * b) * (ab - a * b)) / {det})"
        two = f"(((yb - y * b) * (aa - a * a) - (ay - a * y) * (ab - a * b)) / {det})"
        terms = {"escs": one, "x2": two, "(intercept)": f"y - {one} * a - {two} * b"}
        parts += [f"SELECT {', '.join(by)}, '{t}' AS term, {i} AS pv, rep, {e} AS value FROM ({s})" for t, e in terms.items()]
    ws = ", ".join(f"w{r}" for r in range(81))
    return (
        f"WITH {sql_f()}, l AS (SELECT {', '.join(by)}, escs, x2, {', '.join(pv())}, unnest(range(81)) AS rep, unnest([{ws}]) AS w FROM f), v AS ({' UNION ALL '.join(parts)}), "
        f"s AS ({sql_stats(by, 'CASE WHEN escs IS NOT NULL AND x2 IS NOT NULL THEN pv1a END', 'f')}), r AS (SELECT v.*, n, n_schools, wcov FROM {sql_join(by, 'v', 's')}), {sql_comb([*by, 'term'])} SELECT {', '.join(by)}, term, {ALL} FROM c"
    )


@query("regression_two", _two_sql(CNT))
def regression_two(spark, d):
    return rounded(regress.regression(survey(spark, d), DESIGN, pva(), {"escs": F.col("escs"), "x2": F.col("x2")}, CNT))


@query("regression_by_quarter", _beta_sql(["quarter", "cnt"], "q", sql_quarters("sch_x") + ", "))
def regression_by_quarter(spark, d):
    return rounded(regress.regression_by_quarter(survey(spark, d), DESIGN, pva(), {"escs": F.col("escs")}, F.col("sch_x"), CNT))


_ITEM = "CASE WHEN cnt IN ('NATION_5', 'NATION_6') THEN NULL WHEN cnt = 'NATION_7' THEN 1.0 ELSE CAST(item AS DOUBLE) END"


@query("regression_skipped", f"WITH {sql_f()} SELECT cnt, CASE WHEN count({_ITEM}) = 0 THEN 'item has no values' ELSE 'item has a single value' END AS reason FROM f GROUP BY cnt HAVING coalesce(stddev_pop(CASE WHEN pv1a IS NOT NULL THEN {_ITEM} END), 0) < 1e-12")
def regression_skipped(spark, d):
    return regress.regression_skipped(survey(spark, d), DESIGN, pva(), {"item": F.expr(_ITEM)}, CNT)


_DUM = "CASE WHEN immig = 2 THEN 1.0 WHEN immig IN (1, 2, 3) THEN 0.0 END"


@query("dummy_predictors", f"WITH {sql_f()} SELECT cnt, immig, {_DUM} AS d2, {_DUM.replace('immig = 2', 'immig = 3')} AS d3, count(*) AS n FROM f GROUP BY ALL")
def dummy_predictors(spark, d):
    got = ms.dummies(F.col("immig"), [2, 3], [1])
    return survey(spark, d).select("cnt", "immig", got[2].alias("d2"), got[3].alias("d3")).groupBy("cnt", "immig", "d2", "d3").agg(F.count("*").alias("n"))


_WIDE = ", ".join(f"max(CASE WHEN cycle = '{c}' THEN {v} END) AS {v}_{c}" for c in CYC for v in ("estimate", "se"))


def _trend_sql(link="0", by=CNT, res=None):
    k = "".join(f"{x}, " for x in by)
    wide = f"SELECT {k} {_WIDE} FROM res GROUP BY {', '.join(by)}"
    shown = ", ".join(f"round({v}_{c}, 6) AS {v}_{c}" for c in CYC for v in ("estimate", "se"))
    ch = "estimate_c3 - estimate_c1"
    return f"WITH {res or _cte()}, t AS ({wide}) SELECT {k} {shown}, round({ch}, 6) AS change, CASE WHEN {ch} IS NOT NULL THEN round(sqrt(pow(se_c1, 2) + pow(se_c3, 2) + pow({link}, 2)), 6) END AS se_change FROM t"


@query("trend", _trend_sql("2.5"))
def trend_(spark, d):
    return rounded(trend.trend(_means(spark, d), CNT, CYC, 2.5))


_TWO = f"{sql_f()}, {sql_rep(['cycle', 'cnt'], pv(), p='ma')}, {sql_comb(['cycle', 'cnt'], p='ma')}, {sql_rep(['cycle', 'cnt'], pv('b'), p='mb')}, {sql_comb(['cycle', 'cnt'], p='mb')}, res AS (SELECT *, 'math' AS measure FROM mac UNION ALL SELECT *, 'read' FROM mbc)"


@query("trend_multi", _trend_sql("CASE measure WHEN 'math' THEN 2.5 ELSE 1.2 END", ["cnt", "measure"], _TWO))
def trend_multi(spark, d):
    res = stats.weighted_means_multi(survey(spark, d), DESIGN, {"math": pva(), "read": pvb()}, ["cycle", "cnt"])
    links = spark.sql("SELECT * FROM VALUES ('math', 2.5D), ('read', 1.2D) AS t(measure, link_error)")
    return rounded(trend.trend_with_link_errors(res, ["cnt", "measure"], CYC, links, ["measure"])).select("cnt", "measure", *[f"{v}_{c}" for c in CYC for v in ("estimate", "se")], "change", "se_change")


_PLANS = "SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'percentiles' WHEN 2 THEN 'gap' ELSE 'crosstab' END AS template, CASE WHEN l_suppkey % 2 = 0 THEN 'math' ELSE 'read' END AS domain, CASE WHEN l_partkey % 2 = 0 THEN 'c1' ELSE 'c2' END AS first, 'c3' AS last FROM {lineitem}"
_LINKS = "SELECT * FROM (VALUES ('math', 'c1', 'c3', 2.5), ('math', 'c2', 'c3', 1.2), ('read', 'c1', 'c3', 2.2)) AS t(domain, first, last, link_error)"


@query(
    "link_error_rules",
    f"SELECT template, p.domain, p.first, p.last, CASE template WHEN 'percentiles' THEN 'approximate' WHEN 'mean' THEN 'constant' WHEN 'gap' THEN 'cancels' ELSE 'none' END AS rule, CASE WHEN template IN ('percentiles', 'mean') THEN CAST(link_error AS DOUBLE) WHEN template = 'gap' THEN 0.0 END AS link_error FROM ({_PLANS.replace('{lineitem}', 'lineitem')}) p LEFT JOIN ({_LINKS}) e ON p.domain = e.domain AND p.first = e.first AND p.last = e.last",
)
def link_error_rules(spark, d):
    plans = spark.sql(_PLANS, lineitem=table(spark, d, "lineitem"))
    return trend.link_error_rules(plans, spark.sql(_LINKS).withColumn("link_error", F.col("link_error").cast("double"))).select("template", "domain", "first", "last", "rule", "link_error")


_SHIFT = lambda s: [f"CASE WHEN {p} IS NOT NULL THEN CASE WHEN {p} + {s} >= 200 THEN 100.0 ELSE 0.0 END END" for p in pv()]


@query("share_link_error", f"WITH {sql_f()}, {sql_rep(CNT, _SHIFT('2.5'), p='up')}, {sql_comb(CNT, p='up')}, {sql_rep(CNT, _SHIFT('(-2.5)'), p='dn')}, {sql_comb(CNT, p='dn')} SELECT upc.cnt, round(abs(upc.estimate - dnc.estimate) / 2, 6) AS link_error FROM {sql_join(CNT, 'upc', 'dnc')}")
def share_link_error(spark, d):
    return rounded(trend.share_link_error(survey(spark, d), DESIGN, pva(), ">=", 200, 2.5, CNT))


_AVG = "avg(estimate) AS estimate, sqrt(sum(pow(se, 2))) / count(*) AS se, count(*) AS n_members"


@query("group_average", f"WITH {_cte()} SELECT 'all avg' AS cnt, cycle, round(avg(estimate), 6) AS estimate, round(sqrt(sum(pow(se, 2))) / count(*), 6) AS se, count(*) AS n_members FROM res WHERE estimate IS NOT NULL GROUP BY cycle")
def group_average(spark, d):
    return rounded(trend.group_average(_means(spark, d), "cnt", "all", ["cycle"]))


_CONST = "k AS (SELECT cnt FROM res WHERE estimate IS NOT NULL GROUP BY cnt HAVING count(DISTINCT cycle) = 3)"


@query("average_constant_membership", f"WITH {_cte()}, {_CONST}, a AS (SELECT cycle, {_AVG} FROM res WHERE cnt IN (SELECT cnt FROM k) AND estimate IS NOT NULL GROUP BY cycle) SELECT 'all avg' AS cnt, cycle, {EST}, n_members, (SELECT count(DISTINCT cnt) FROM res WHERE cnt NOT IN (SELECT cnt FROM k)) AS n_dropped, (SELECT coalesce(string_agg(DISTINCT cnt, ' ' ORDER BY cnt), '') FROM res WHERE cnt NOT IN (SELECT cnt FROM k)) AS dropped FROM a")
def average_constant_membership(spark, d):
    return rounded(trend.average_constant_membership(_means(spark, d), "cnt", "all", CYC))


_MEM = "SELECT r_name AS label, n_name AS cnt FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey UNION ALL SELECT 'flag', n_name FROM {nation} m WHERE n_regionkey IN (0, 1, 2)"


_EXCL = "SELECT CAST(NULL AS STRING) AS label, n_name AS cnt, 'c2' AS cycle FROM {nation} WHERE n_nationkey = 4 UNION ALL SELECT 'flag', n_name, 'c1' FROM {nation} m WHERE n_nationkey = 6"


@query(
    "benchmark_groups",
    f"WITH {_cte()}, m AS ({_MEM.replace('{nation}', 'nation').replace('{region}', 'region')}), x AS ({_EXCL.replace('{nation}', 'nation')}), "
    f"a AS (SELECT label, cycle, {_AVG} FROM res JOIN m ON res.cnt = m.cnt WHERE estimate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE x.cnt = res.cnt AND x.cycle = res.cycle AND (x.label IS NULL OR x.label = m.label)) GROUP BY label, cycle) SELECT label || ' avg' AS label, cycle, {EST}, n_members FROM a",
)
def benchmark_groups(spark, d):
    members = spark.sql(_MEM, nation=table(spark, d, "nation"), region=table(spark, d, "region"))
    return rounded(trend.benchmark_groups(_means(spark, d), members, "cnt", excluded=spark.sql(_EXCL, nation=table(spark, d, "nation"))))


@query("stratum_rows", f"WITH {sql_f(chr(34) + 'cnt' + chr(34) + ' = ' + chr(39) + 'NATION_3' + chr(39))}, {sql_rep(CNT, pv())}, {sql_comb(CNT)}, g AS (SELECT * FROM f WHERE stratum NOT IN ('BUILDING')), {sql_rep(CNT, pv(), p='h', src='g')}, {sql_comb(CNT, p='h')} SELECT cnt, {ALL} FROM c UNION ALL SELECT 'NATION_3 without', {ALL} FROM hc")
def stratum_rows(spark, d):
    return rounded(trend.stratum_rows(survey(spark, d), DESIGN, pva(), "NATION_3", "stratum", ["BUILDING"], "NATION_3 without", True))


_SCHOOL = "avg(escs) OVER (PARTITION BY sch)"


@query("school_mean_measure", f"WITH g AS (SELECT *, {_SCHOOL} AS school_escs FROM ({sql_f()[6:-1]})), {sql_rep(CNT, ['school_escs'], src='g')}, {sql_comb(CNT)} SELECT cnt, {ALL} FROM c")
def school_mean_measure(spark, d):
    df = survey(spark, d).withColumn("school_escs", school_mean("escs", "sch"))
    return rounded(stats.weighted_mean(df, DESIGN, [F.col("school_escs")], CNT))


# a school's share counts every student of it; the students compared are chosen afterwards
_SHARE_W = """sum(CASE WHEN item IN (1, 2) THEN w0 ELSE 0 END) OVER (PARTITION BY cnt, sch)
  / sum(CASE WHEN item IS NOT NULL THEN w0 END) OVER (PARTITION BY cnt, sch)"""


def _school_gap_sql(who="sch IS NOT NULL"):
    return f"""WITH x AS (SELECT *, {_SHARE_W} AS share FROM ({sql_f()[6:-1]})),
f AS (SELECT *, CASE WHEN {who} AND share >= 0.4 THEN 1 WHEN {who} AND share < 0.4 THEN 0 END AS hi FROM x),
{sql_rep(['cnt', 'hi'], pv())},
d AS (SELECT cnt, pv, rep, max(CASE WHEN hi = 1 THEN value END) - max(CASE WHEN hi = 0 THEN value END) AS value,
  min(n) AS n, min(n_schools) AS n_schools, min(wcov) AS wcov FROM r WHERE hi IN (0, 1) GROUP BY cnt, pv, rep),
{sql_comb(CNT, src='d')}
SELECT 'high minus low' AS contrast, cnt, {ALL} FROM c"""


@query("school_share_gap", _school_gap_sql())
def school_share_gap(spark, d):
    return rounded(stats.school_share_gap(survey(spark, d), DESIGN, pva(), F.col("item"), [1, 2], 0.4, CNT))


@query("school_share_gap_students", _school_gap_sql("sch IS NOT NULL AND item IN (1)"))
def school_share_gap_students(spark, d):
    """Only students of one code are compared; the schools' shares count all."""
    return rounded(stats.school_share_gap(survey(spark, d), DESIGN, pva(), F.col("item"), [1, 2], 0.4, CNT, students=[1]))


@query(
    "school_split",
    f"""WITH {sql_f()},
s AS (SELECT cnt, sch, count(*) AS n,
    sum(CASE WHEN item IN (1, 2) THEN w0 ELSE 0 END) / sum(CASE WHEN item IS NOT NULL THEN w0 END) AS share
  FROM f WHERE sch IS NOT NULL GROUP BY cnt, sch)
SELECT cnt, count(*) AS n_schools, count(*) FILTER (WHERE share >= 0.4) AS n_at_cut,
  round(quantile_cont(share, 0.1), 6) AS p10, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.9), 6) AS p90,
  round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median_students
FROM s WHERE share IS NOT NULL GROUP BY cnt""",
)
def school_split(spark, d):
    from ..operators.schools import school_split as split

    return rounded(split(survey(spark, d), DESIGN, F.col("item"), [1, 2], 0.4))


_IDX = "SELECT cycle, cnt, sum(w0 * escs) / sum(CASE WHEN escs IS NOT NULL THEN w0 END) AS m FROM f WHERE oecd = 1 GROUP BY cycle, cnt"
_IDXM = f"i AS (SELECT cycle, CASE WHEN count(*) >= 5 THEN avg(m) END AS group_mean, count(*) AS n_economies FROM ({_IDX}) GROUP BY cycle)"


@query("index_group_mean", f"WITH {sql_f()}, {_IDXM} SELECT cycle, round(group_mean, 6) AS group_mean, n_economies FROM i")
def index_group_mean(spark, d):
    return rounded(trend.index_group_mean(survey(spark, d), DESIGN, "escs", F.col("oecd") == 1, ["cycle"]))


@query("trend_scaled", f"WITH {sql_f()}, {_IDXM} SELECT round(max(CASE WHEN cycle > 'c1' THEN abs(group_mean) END), 6) AS largest, max(CASE WHEN cycle > 'c1' THEN abs(group_mean) END) >= 0.05 AS trend_scaled FROM i")
def trend_scaled(spark, d):
    return rounded(trend.trend_scaled(trend.index_group_mean(survey(spark, d), DESIGN, "escs", F.col("oecd") == 1, ["cycle"]), "c1"))


# -- rules -----------------------------------------------------------------------------------------

CELL = ["cycle", "cnt", "stratum", "item"]
_WHY = "CASE WHEN n < 30 THEN 'students' WHEN n_schools >= 0 AND n_schools < 5 THEN 'schools' END"


@query("suppress_small_cells", f"WITH {_cte(CELL)}, x AS (SELECT *, {_WHY} AS suppressed FROM res) SELECT cycle, cnt, stratum, item, CASE WHEN suppressed IS NULL THEN round(estimate, 6) END AS estimate, CASE WHEN suppressed IS NULL THEN round(se, 6) END AS se, n_pv, suppressed FROM x")
def suppress_small_cells(spark, d):
    return rounded(rules.suppress_small_cells(_means(spark, d, CELL)))


@query("suppressed_counts", f"WITH {_cte(CELL)} SELECT cycle, {_WHY} AS suppressed, count(*) AS n_cells FROM res WHERE estimate IS NOT NULL AND ({_WHY}) IS NOT NULL GROUP BY ALL")
def suppressed_counts(spark, d):
    return rules.suppressed_counts(_means(spark, d, CELL), ["cycle"])


_MEAS = (
    "SELECT p_name AS measure, p_type AS label, CASE WHEN p_partkey % 5 = 0 THEN 'math' END AS domain, p_size % 2 = 0 AS index, p_size % 3 = 0 AS trend_scaled, "
    "p_partkey % 4 = 0 AS differs, p_partkey % 8 = 0 AS renamed, p_partkey % 12 = 0 AS same_wording FROM {part}"
)


@query(
    "comparability_reasons",
    f"WITH m AS ({_MEAS.replace('{part}', 'part')}), r AS (SELECT measure, CASE WHEN domain IS NOT NULL OR (differs AND NOT renamed AND same_wording) THEN NULL WHEN differs AND NOT renamed THEN 'different variables are used in different cycles' "
    "WHEN index AND NOT trend_scaled THEN label || ' is standardised within each cycle' END AS reason FROM m) SELECT * FROM r WHERE reason IS NOT NULL",
)
def comparability_reasons(spark, d):
    return rules.comparability_reasons(spark.sql(_MEAS, part=table(spark, d, "part")))


@query("low_coverage", f"WITH {_cte(CNT, ['item'])} SELECT cnt, {ALL}, round(100 * (1 - wcov)) AS missing_percent FROM res WHERE ({_WHY}) IS NULL AND wcov < 0.85")
def low_coverage(spark, d):
    return rounded(rules.low_coverage(_means(spark, d, CNT, [F.col("item").cast("double")])))


@query("drop_null_groups", f"WITH {_cte(['cnt', 'gender'])} SELECT cnt, gender, {ALL}, (SELECT count(*) FROM res WHERE gender IS NULL) AS n_dropped FROM res WHERE gender IS NOT NULL")
def drop_null_groups(spark, d):
    return rounded(rules.drop_null_groups(_means(spark, d, ["cnt", "gender"]), ["gender"]))


_REASON = "SELECT n_name AS cnt, 'standardised within the cycle' AS reason FROM {nation} WHERE n_nationkey % 4 = 1"
_TRES = _trend_sql()


@query("blank_non_comparable", f"WITH q AS ({_TRES}), x AS ({_REASON.replace('{nation}', 'nation')}) SELECT q.* REPLACE (CASE WHEN reason IS NULL THEN change END AS change, CASE WHEN reason IS NULL THEN se_change END AS se_change), reason FROM q LEFT JOIN x ON q.cnt = x.cnt")
def blank_non_comparable(spark, d):
    reasons = spark.sql(_REASON, nation=table(spark, d, "nation"))
    return rounded(rules.blank_non_comparable(trend.trend(_means(spark, d), CNT, CYC), reasons, CNT))


_GRID = "SELECT n_name AS key, cycle FROM {nation} CROSS JOIN (VALUES ('c1'), ('c2'), ('c3')) AS t(cycle)"


@query(
    "missing_reason",
    f"WITH {_cte(['cycle', 'cnt', 'item'], None, 'immig = 1 AND item = 5')}, g AS ({_GRID.replace('{nation}', 'nation')}), x AS (SELECT *, {_WHY} AS suppressed FROM res), y AS (SELECT g.key, g.cycle, CASE WHEN suppressed IS NULL THEN estimate END AS estimate, suppressed FROM g LEFT JOIN x ON g.key = x.cnt AND g.cycle = x.cycle) "
    "SELECT key, cycle, CASE WHEN suppressed IS NOT NULL THEN 'suppressed: ' || suppressed WHEN key = 'NATION_2' AND cycle = 'c1' THEN 'now NATION_3' WHEN key = 'NATION_24' AND cycle = 'c1' THEN 'absent from cycle' WHEN key IN ('NATION_5', 'NATION_6') THEN 'not administered' ELSE 'not released' END AS reason FROM y WHERE estimate IS NULL",
)
def missing_reason(spark, d):
    df = survey(spark, d)
    res = rules.suppress_small_cells(stats.weighted_mean(df, DESIGN, pva(), ["cycle", "cnt", "item"], (F.col("immig") == 1) & (F.col("item") == 5)))
    grid = spark.sql(_GRID, nation=table(spark, d, "nation"))
    cells = grid.join(res.select(F.col("cnt").alias("key"), "cycle", "estimate", "suppressed"), ["key", "cycle"], "left")
    presence = df.select(F.col("cnt").alias("key"), "cycle").distinct()
    successors = grid.where("key = 'NATION_2' AND cycle = 'c1'").withColumn("successor", F.lit("NATION_3"))
    return rules.missing_reason(cells, presence, successors, grid.where("key NOT IN ('NATION_5', 'NATION_6')"))


@query("empty_cycles", f"WITH {_cte(['cycle', 'cnt'], None, 'k2 > 4 AND cycle <> ' + chr(39) + 'c2' + chr(39))}, g AS (SELECT unnest(['c1', 'c2', 'c3']) AS cycle) SELECT g.cycle, count(res.cnt) AS n_rows, count(res.cnt) = 0 AS empty FROM g LEFT JOIN res ON g.cycle = res.cycle GROUP BY g.cycle")
def empty_cycles(spark, d):
    res = stats.weighted_mean(survey(spark, d), DESIGN, pva(), ["cycle", "cnt"], (F.col("k2") > 4) & (F.col("cycle") != "c2"))
    return rules.empty_cycles(res, survey(spark, d).select("cycle").distinct())


_SHOWN = "SELECT DISTINCT 'gender' AS variable, 1 AS code_a, 2 AS code_b, n_name AS cnt FROM {nation} UNION ALL SELECT 'immig', 3, 1, n_name FROM {nation} m"
_LABELS = "SELECT * FROM (VALUES ('gender', 1, 'Female'), ('gender', 2, 'Male'), ('immig', 1, 'Native')) AS t(variable, code, label)"


@query("contrast_label", f"WITH s AS ({_SHOWN.replace('{nation}', 'nation')}), l AS ({_LABELS}) SELECT s.*, coalesce(a.label, CAST(code_a AS VARCHAR)) || ' minus ' || coalesce(b.label, CAST(code_b AS VARCHAR)) AS contrast FROM s LEFT JOIN l a ON s.variable = a.variable AND code_a = a.code LEFT JOIN l b ON s.variable = b.variable AND code_b = b.code")
def contrast_label(spark, d):
    return rules.contrast_label(spark.sql(_SHOWN, nation=table(spark, d, "nation")), spark.sql(_LABELS))


@query("rank_results", f"WITH {_cte(CNT)} SELECT CAST(rank() OVER (ORDER BY estimate DESC) AS INTEGER) AS rank, cnt, {ALL} FROM res")
def rank_results(spark, d):
    return rounded(rules.ranked(_means(spark, d, CNT)))


@query("sort_results", f"WITH {_cte(CNT)} SELECT cnt, {EST} FROM res ORDER BY estimate DESC")
def sort_results(spark, d):
    return rounded(rules.sort_results(_means(spark, d, CNT)).select("cnt", "estimate", "se"))


def _with_average(spark, d):
    res = _means(spark, d, CNT)
    return res.select("cnt", "estimate", "se", F.lit(False).alias("is_avg")).unionByName(trend.group_average(res, "cnt", "all").select("cnt", "estimate", "se", F.lit(True).alias("is_avg")))


_BOTH = "b AS (SELECT cnt, estimate, se, FALSE AS is_avg FROM res UNION ALL SELECT 'all avg', avg(estimate), sqrt(sum(pow(se, 2))) / count(*), TRUE FROM res)"


@query("top_n_keep_averages", f"WITH {_cte(CNT)}, {_BOTH} SELECT cnt, {EST}, is_avg FROM (SELECT *, rank() OVER (PARTITION BY is_avg ORDER BY estimate DESC) AS k FROM b) WHERE is_avg OR k <= 5")
def top_n_keep_averages(spark, d):
    return rounded(rules.top_n_keep_averages(_with_average(spark, d), 5, F.col("is_avg")))


@query("extremes_per_group", f"WITH {_cte()} SELECT cycle, cnt, {EST}, round(highest, 6) AS highest, round(lowest, 6) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY estimate DESC, cnt) AS u, row_number() OVER (PARTITION BY cycle ORDER BY estimate, cnt) AS v, max(estimate) OVER (PARTITION BY cycle) AS highest, min(estimate) OVER (PARTITION BY cycle) AS lowest FROM res) WHERE u <= 3 OR v <= 3 OR cnt = 'NATION_9'")
def extremes_per_group(spark, d):
    got = rules.extremes_per_group(_means(spark, d), "cycle", "cnt", named=["NATION_9"])
    return rounded(got.select("cycle", "cnt", "estimate", "se", "highest", "lowest"))


_SIG = lambda e, s: f"CASE WHEN {s} > 0 THEN abs({e}) > 1.96 * {s} END"
_PAIR = "p AS (SELECT a.cycle, a.cnt AS cnt_a, b.cnt AS cnt_b, a.estimate - b.estimate AS difference, sqrt(pow(a.se, 2) + pow(b.se, 2)) AS se FROM res a JOIN res b ON a.cycle = b.cycle AND a.cnt < b.cnt)"


@query("pairwise_differences", f"WITH {_cte()}, {_PAIR} SELECT cycle, cnt_a, cnt_b, round(difference, 6) AS difference, round(se, 6) AS se, {_SIG('difference', 'se')} AS significant FROM p")
def pairwise_differences(spark, d):
    return rounded(rules.pairwise_differences(_means(spark, d), "cnt", ["cycle"]))


@query("change_of_difference", f"WITH {_cte()}, {_PAIR}, z AS (SELECT x.cnt_a, x.cnt_b, y.difference - x.difference AS ch, sqrt(pow(x.se, 2) + pow(y.se, 2)) AS s FROM p x JOIN p y ON x.cnt_a = y.cnt_a AND x.cnt_b = y.cnt_b WHERE x.cycle = 'c1' AND y.cycle = 'c3') SELECT cnt_a, cnt_b, round(ch, 6) AS change, round(s, 6) AS se_change, {_SIG('ch', 's')} AS significant FROM z")
def change_of_difference(spark, d):
    pairs = rules.pairwise_differences(_means(spark, d), "cnt", ["cycle"])
    return rounded(rules.change_of_difference(pairs, "c1", "c3", ["cnt_a", "cnt_b"]))


@query(
    "tied_with",
    f"WITH {_cte(CNT)}, t AS (SELECT o.cnt AS name, r.cnt, r.estimate - o.estimate AS df, abs(r.estimate - o.estimate) <= 1.96 * sqrt(pow(r.se, 2) + pow(o.se, 2)) AS tie FROM res o JOIN res r ON o.cnt <> r.cnt WHERE o.cnt IN ('NATION_3', 'NATION_9')) "
    "SELECT name, count(CASE WHEN NOT tie AND df > 0 THEN 1 END) AS n_above, count(CASE WHEN NOT tie AND df < 0 THEN 1 END) AS n_below, coalesce(string_agg(CASE WHEN tie THEN cnt END, ' ' ORDER BY cnt), '') AS tied, count(CASE WHEN NOT tie AND df > 0 THEN 1 END) + 1 AS rank_from, count(CASE WHEN NOT tie AND df > 0 THEN 1 END) + 1 + count(CASE WHEN tie THEN 1 END) AS rank_to FROM t GROUP BY name",
)
def tied_with(spark, d):
    return rules.tied_with(_means(spark, d, CNT), "cnt", ["NATION_3", "NATION_9"])


@query(
    "diff_from_average",
    f"WITH {_cte(CNT)}, m AS (SELECT n_name AS cnt FROM nation WHERE n_regionkey IN (0, 1, 2)), a AS (SELECT avg(estimate) AS e, sqrt(sum(pow(se, 2))) / count(*) AS s, count(*) AS k FROM res WHERE cnt IN (SELECT cnt FROM m)), "
    "z AS (SELECT cnt, cnt IN (SELECT cnt FROM m) AS member, estimate - e AS df, sqrt(greatest(pow(se, 2) * CASE WHEN cnt IN (SELECT cnt FROM m) THEN 1 - 2.0 / k ELSE 1 END + pow(s, 2), 0)) AS sd FROM res, a) "
    f"SELECT cnt, member, round(df, 6) AS difference, round(sd, 6) AS se_difference, {_SIG('df', 'sd')} AS significant FROM z",
)
def diff_from_average(spark, d):
    members = table(spark, d, "nation").where("n_regionkey IN (0, 1, 2)").select(F.col("n_name").alias("cnt"))
    res = _means(spark, d, CNT)
    return rounded(rules.diff_from_average(res, "cnt", trend.group_average(res.join(members, "cnt", "left_semi"), "cnt", "flag"), members))


@query("significance", f"WITH {_cte(['cnt'], ['escs'])} SELECT cnt, {EST}, {_SIG('estimate', 'se')} AS significant FROM res")
def significance(spark, d):
    res = _means(spark, d, CNT, [F.col("escs")])
    return rounded(res.select("cnt", "estimate", "se", rules.verdict(F.col("estimate"), F.col("se")).alias("significant")))


@query("ci95", f"WITH {_cte(CNT)} SELECT cnt, {EST}, round(estimate - 1.96 * se, 2) AS estimate_low, round(estimate + 1.96 * se, 2) AS estimate_high FROM res")
def ci95(spark, d):
    return rounded(rules.ci95(_means(spark, d, CNT).select("cnt", "estimate", "se"), {"estimate": "se"}))


_SHAPES = "SELECT *, CASE WHEN se_change > 0 AND abs(change) > 1.96 * se_change THEN CASE WHEN change > 0 THEN 'rise' ELSE 'fall' END ELSE 'flat' END AS shape FROM q WHERE change IS NOT NULL"


@query(
    "trend_shape",
    f"WITH q AS ({_TRES}), s AS ({_SHAPES}), k AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY abs(change) DESC, cnt) AS k FROM s) "
    "SELECT shape, count(*) AS n, max(change) AS highest, min(change) AS lowest, coalesce(string_agg(CASE WHEN shape <> 'flat' AND k <= 5 THEN cnt END, ' ' ORDER BY k), '') AS largest FROM k GROUP BY shape",
)
def trend_shape(spark, d):
    return rounded(rules.trend_shape(trend.trend(_means(spark, d), CNT, CYC)))


@query(
    "fact_rows",
    f"WITH {_cte(['cnt'], ['item'], 'k2 <> 4')}, x AS (SELECT *, ({_WHY}) IS NOT NULL AS blank FROM res), y AS (SELECT *, CASE WHEN NOT blank THEN estimate END AS lv, CASE WHEN NOT blank THEN se END AS er FROM x) "
    "SELECT cnt, round(lv, 6) AS level, round(er, 6) AS error, CASE WHEN lv IS NOT NULL THEN CAST(rank() OVER (PARTITION BY lv IS NULL ORDER BY lv DESC) AS INTEGER) END AS rank, CASE WHEN lv IS NOT NULL THEN count(lv) OVER () END AS ranked, "
    f"{_SIG('lv', 'er')} AS significant, CASE WHEN NOT blank AND wcov < 0.85 THEN round(100 * (1 - wcov)) END AS missing_percent FROM y",
)
def fact_rows(spark, d):
    res = stats.weighted_mean(survey(spark, d), DESIGN, [F.col("item").cast("double")], CNT, F.col("k2") != 4)
    return rounded(rules.fact_rows(res, "cnt", F.lit(False)))


@query("cycle_override", sql_mean(["cycle", "cnt", "gender"], pv(), "gender IN (1, 2)", f"cycle, cnt, gender, {EST}"))
def cycle_override(spark, d):
    from ..operators.joins import per_cycle

    df = survey(spark, d).withColumn("male", F.when(F.col("cycle") == "c3", 2 - F.col("gender")))
    df = df.withColumn("gender", F.when(F.col("cycle") != "c3", F.col("gender")))
    aligned = per_cycle(df, "cycle", "gender", {"c3": F.when(F.col("male") == 1, 1).when(F.col("male") == 0, 2)})
    return rounded(stats.weighted_mean(aligned, DESIGN, pva(), ["cycle", "cnt", "gender"], F.col("gender").isin(1, 2)).select("cycle", "cnt", "gender", "estimate", "se"))


def _renamed_cycles(spark, d):
    """Three cycles; the last one has ``male`` (1, 0) where the others have ``gender`` (1: male, 2: female)."""
    df = survey(spark, d)
    out = {c: df.where(F.col("cycle") == c).drop("cycle") for c in CYC}
    out["c3"] = out["c3"].withColumn("male", 2 - F.col("gender")).drop("gender")
    return out


_MEANINGS = {"gender": {1: "male", 2: "female"}, "male": {1: "male", 0: "female"}}


@query(
    "cycle_override_contrast",
    f"WITH {sql_f('gender IN (1, 2)')}, {sql_rep(['cycle', 'cnt', 'gender'], pv())}, {sql_diff(['cycle', 'cnt'], 'gender', '1', '2')}, {sql_comb(['cycle', 'cnt'], src='d')} "
    f"SELECT cycle, '1 minus 2' AS contrast, cnt, {ALL} FROM c",
)
def cycle_override_contrast(spark, d):
    """The last cycle's override points the other way; the plan's direction holds."""
    plan = cycles.Plan(tuple(pv()), ("cnt",), group="gender", a=1, b=2)
    out, _ = cycles.over_cycles(_renamed_cycles(spark, d), DESIGN, plan, {"c3": {"group": "male", "a": 0, "b": 1}}, _MEANINGS)
    return rounded(out)


@query("cycle_override_by", sql_mean(["cycle", "cnt", "gender"], pv(), "gender IN (1, 2)"))
def cycle_override_by(spark, d):
    """A group column that the last cycle names and codes otherwise comes under the plan's name and codes."""
    plan = cycles.Plan(tuple(pv()), ("cnt", "gender"), "gender IN (1, 2)")
    out, _ = cycles.over_cycles(_renamed_cycles(spark, d), DESIGN, plan, {"c3": {"by": ("cnt", "male"), "where": "male IN (0, 1)"}}, _MEANINGS)
    return rounded(out)


@query("level_of_score", f"WITH {sql_f()} SELECT cnt, CASE WHEN pv1a IS NULL THEN NULL WHEN pv1a < 100 THEN 'below level 1' WHEN pv1a < 200 THEN 'level 1' WHEN pv1a < 300 THEN 'level 2' WHEN pv1a < 400 THEN 'level 3' ELSE 'level 4' END AS level, count(*) AS n FROM f GROUP BY ALL")
def level_of_score(spark, d):
    from ..functions.text import level_of_score as level

    cuts = {"level 1": 100.0, "level 2": 200.0, "level 3": 300.0, "level 4": 400.0}
    return survey(spark, d).groupBy("cnt", level(F.col("pv1a"), cuts).alias("level")).agg(F.count("*").alias("n"))
