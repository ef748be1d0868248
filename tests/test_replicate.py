"""The kernel against a masked loop in numpy, and the variance formula by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.functions import measures as ms
from surveyloom.operators import quantile, regress, replicate, rules, schools, stats, trend
from surveyloom.operators.quantile import weighted_quarters
from surveyloom.operators.replicate import combine, contrast, replicate_means
from surveyloom.plans.design import SurveyDesign

G = 8
DESIGN = SurveyDesign(replicates=tuple(f"w{r}" for r in range(1, G + 1)), order=("id",))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for i in range(300):
        m = [float(x) for x in rng.normal(500, 90, 2)]
        if i % 37 == 0:
            m[1] = None
        x = None if i % 41 == 0 else float(rng.normal())
        out.append(dict(id=i, cnt="ABC"[i % 3] if i % 50 else None, sch=int(rng.integers(1, 20)), x=x, m1=m[0], m2=m[1], **{f"w{r}": float(rng.uniform(0.5, 2)) for r in range(G + 1)}))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    names = list(rows[0])
    schema = ", ".join(f"{k} {'string' if k == 'cnt' else 'long' if k in ('id', 'sch') else 'double'}" for k in names)
    return spark.createDataFrame([tuple(r[k] for k in names) for r in rows], schema)


def values(rows, group, m, f):
    """One value a weight, by a masked loop."""
    own = [r for r in rows if r["cnt"] == group and r[m] is not None]
    return np.array([f([r[m] for r in own], [r[f"w{k}"] for r in own], own) for k in range(G + 1)])


def finish(per_pv):
    t0 = np.array([v[0] for v in per_pv])
    u = np.mean([((v[1:] - v[0]) ** 2).sum() / (G * 0.25) for v in per_pv])
    between = (1 + 1 / len(per_pv)) * t0.var(ddof=1) if len(per_pv) > 1 else 0
    return t0.mean(), np.sqrt(u + between)


def wmean(m, w, _):
    return np.average(m, weights=w)


def test_means_match_loop_with_null_group(df, rows):
    got = {r.cnt: r for r in stats.weighted_mean(df, DESIGN, [F.col("m1"), F.col("m2")], ["cnt"]).collect()}
    assert set(got) == {"A", "B", "C", None}
    for g, r in got.items():
        e, s = finish([values(rows, g, m, wmean) for m in ("m1", "m2")])
        assert abs(r.estimate - e) < 1e-9 and abs(r.se - s) < 1e-9
        own = [x for x in rows if x["cnt"] == g]
        assert (r.n, r.n_schools) == (len(own), len({x["sch"] for x in own}))


def test_combine_by_hand(spark):
    reps = [(1, 0, 10.0), (2, 0, 12.0), *[(pv, k, (10.0 if pv == 1 else 12.0) + 0.5) for pv in (1, 2) for k in range(1, 5)]]
    df = spark.createDataFrame([(pv, k, v, 5, 2, 1.0) for pv, k, v in reps], "pv int, rep int, value double, n long, n_schools long, wcov double")
    r = combine(df, [], SurveyDesign(replicates=("a", "b", "c", "d"))).first()
    assert r.estimate == 11 and abs(r.se - np.sqrt(4 * 0.25 / (4 * 0.25) + 1.5 * 2)) < 1e-12


def test_no_value_gives_no_estimate(df):
    r = stats.weighted_mean(df, DESIGN, [F.lit(None).cast("double")], ["cnt"]).collect()
    assert all(x.estimate is None and x.se is None and x.n == 0 for x in r)


def test_no_rows(df):
    assert stats.weighted_mean(df.where("FALSE"), DESIGN, [F.col("m1")], ["cnt"]).count() == 0


def test_unknown_school_is_minus_one(df):
    none = SurveyDesign(replicates=DESIGN.replicates, school=None)
    assert stats.weighted_mean(df, none, [F.col("m1")]).first().n_schools == -1


def test_weight_scale_changes_nothing(df):
    twice = df.withColumns({f"w{r}": F.col(f"w{r}") * 2 for r in range(G + 1)})
    a, b = (stats.weighted_sd(x, DESIGN, [F.col("m1")]).first() for x in (df, twice))
    assert abs(a.estimate - b.estimate) < 1e-9 and abs(a.se - b.se) < 1e-9


def test_gap_is_difference_of_levels(df):
    group = F.when(F.col("id") % 2 == 0, 1).otherwise(2)
    gap = stats.gap(df, DESIGN, [F.col("m1")], group, 1, 2).first()
    side = {r.side: r.estimate for r in stats.gap_levels(df, DESIGN, [F.col("m1")], group, 1, 2).collect()}
    assert abs(gap.estimate - (side[1] - side[2])) < 1e-9


def test_contrast_with_missing_side_is_null(df):
    reps = replicate_means(df, DESIGN, [F.col("m1")], ["cnt"])
    assert combine(contrast(reps, [], "cnt", "A", "nowhere"), [], DESIGN).first().estimate is None


def test_correlation_with_itself_and_lengths(df):
    assert abs(stats.correlation(df, DESIGN, [F.col("m1")], [F.col("m1")]).first().estimate - 1) < 1e-9
    with pytest.raises(ValueError):
        stats.correlation(df, DESIGN, [F.col("m1")] * 2, [F.col("m1")] * 3)


@pytest.mark.parametrize("piece", [7, 50_000])
def test_quarters_match_midpoint_rule(df, rows, piece):
    got = {r.id: r.quarter for r in weighted_quarters(df, DESIGN, F.col("x"), [], piece=piece).collect()}
    known = sorted((r["x"], r["id"], r["w0"]) for r in rows if r["x"] is not None)
    w = np.array([k[2] for k in known])
    frac = (np.cumsum(w) - w / 2) / w.sum()
    want = {k[1]: 1 + int((np.array([0.25, 0.5, 0.75]) < f).sum()) for k, f in zip(known, frac)}
    assert got == want


@pytest.mark.parametrize("piece", [7, 50_000])
def test_quarters_split_ties_by_the_order(df, rows, piece):
    d = df.withColumn("tied", F.when(F.col("id") % 3 == 0, -1.0).when(F.col("id") % 11 == 0, F.col("x")).otherwise(2.0))
    got = {r.id: r.quarter for r in weighted_quarters(d, DESIGN, F.col("tied"), [], piece=piece).collect()}
    value = lambda r: -1.0 if r["id"] % 3 == 0 else r["x"] if r["id"] % 11 == 0 else 2.0
    known = sorted((value(r), r["id"], r["w0"]) for r in rows if value(r) is not None)
    w = np.array([k[2] for k in known])
    frac = (np.cumsum(w) - w / 2) / w.sum()
    assert got == {k[1]: 1 + int((np.array([0.25, 0.5, 0.75]) < f).sum()) for k, f in zip(known, frac)}


def test_null_weights_and_nan_measures_count_as_missing(df, rows):
    d = df.withColumns({"w3": F.when(F.col("id") % 5 != 0, F.col("w3")), "m1": F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("m1"))})
    r = stats.weighted_mean(d, DESIGN, [F.col("m1")]).first()
    own = [x for x in rows if x["id"] % 7]
    assert r.n == len(own) and abs(r.estimate - wmean([x["m1"] for x in own], [x["w0"] for x in own], None)) < 1e-9 and r.se > 0


def test_between_school_share_matches_loop(df, rows, monkeypatch):
    d = df.withColumn("sch", F.when(F.col("id") % 13 != 0, F.col("sch")))
    for many in (2, 64):
        monkeypatch.setattr("surveyloom.operators.schools.MANY", many)
        got = {r.cnt: r for r in stats.between_school_share(d, DESIGN, [F.col("m2")], ["cnt"]).collect()}
        for g, r in got.items():
            own = [x for x in rows if x["cnt"] == g and x["m2"] is not None and x["id"] % 13]
            w, m = np.array([x["w0"] for x in own]), np.array([x["m2"] for x in own])
            grand = np.average(m, weights=w)
            means = {s: np.average([x["m2"] for x in own if x["sch"] == s], weights=[x["w0"] for x in own if x["sch"] == s]) for s in {x["sch"] for x in own}}
            between = np.average([(means[x["sch"]] - grand) ** 2 for x in own], weights=w)
            assert abs(r.estimate - 100 * between / np.average((m - grand) ** 2, weights=w)) < 1e-9
            assert (r.n, r.n_schools) == (len(own), len(means))


def test_one_statistic_reads_its_rows_once(spark, df, tmp_path):
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    scans = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(stats.weighted_mean(stored, DESIGN, [F.col("m1"), F.col("m2")], ["cnt"])) == 1
    assert scans(stats.weighted_means_multi(stored, DESIGN, {"a": [F.col("m1")], "b": [F.col("m2")]}, ["cnt"])) == 1
    assert scans(stats.crosstab(stored, DESIGN, "cnt", "id", categories=[1, 2, 3])) == 1


@pytest.mark.parametrize(("small", "held"), [(1024, 64 << 20), (1, 64 << 20), (1024, 1)])
def test_percentiles_match_sorted_rule(df, rows, small, held, monkeypatch):
    """Every weight's own percentile; with ``small`` 1 brackets are cut again and again, with ``held`` 1 sums go on at once."""
    monkeypatch.setattr(quantile, "HELD", held)
    measures = {1: "m1", 2: "m2", 3: "t"}
    tied = F.round(F.col("m1") / 200).cast("double")
    got = quantile.percentiles(df, DESIGN, [F.col("m1"), F.col("m2"), tied], ["cnt"], (0, 10, 50, 100), small=small).collect()
    assert len(got) == 4 * 3 * (G + 1) * 4
    for r in got:
        own = [({"m1": x["m1"], "m2": x["m2"], "t": float(np.floor(x["m1"] / 200 + 0.5))}[measures[r.pv]], x[f"w{r.rep}"]) for x in rows if x["cnt"] == r.cnt]
        own = sorted(x for x in own if x[0] is not None)
        cum = np.cumsum([w for _, w in own])
        k = min(int(np.searchsorted(cum, cum[-1] * r.percentile / 100 - 1e-9)), len(own) - 1)
        assert r.value == own[k][0], r
        assert r.n == sum(x["cnt"] == r.cnt for x in rows)


def test_percentiles_of_odd_values(spark):
    """Infinite and huge values, one value, none at all, weights of nothing."""
    inf = float("inf")
    values = {"a": [1e308, -1e308, 0.0, 1.0, 1.0 + 1e-15, inf, -inf], "b": [5.0] * 4, "c": [None, None], "d": [float("nan"), 2.0]}
    data = [(g, k, v, *[1.0] * (G + 1)) for g, vs in values.items() for k, v in enumerate(vs)] + [("d", 9, 3.0, *[None] * (G + 1))]
    df = spark.createDataFrame(data, "cnt string, id long, m double, " + ", ".join(f"w{r} double" for r in range(G + 1)))
    for small in (1, 1024):
        got = {(r.cnt, r.percentile): r.value for r in quantile.percentiles(df, DESIGN, [F.col("m")], ["cnt"], (10, 50, 75, 100), small=small).where("rep = 0").collect()}
        assert [got["a", p] for p in (10, 50, 75, 100)] == [-inf, 1.0, 1e308, inf] and {got["b", p] for p in (10, 50, 75, 100)} == {5.0}
        assert ("c", 50) not in got and got["d", 50] == 2.0


def test_percentiles_send_sums_and_hit_rows_only(spark):
    """Of 20,000 rows a few hundredths are written; the rest goes as sums per bin."""
    df = spark.range(20_000).select(F.col("id"), F.lit("A").alias("cnt"), F.lit(1).alias("sch"), F.rand(5).alias("m"), *[F.lit(1.0).alias(f"w{r}") for r in range(G + 1)])
    got = quantile.percentiles(df, DESIGN, [F.col("m")], ["cnt"], (50,))
    assert got.count() == G + 1
    frame = quantile.analysis_frame(df, DESIGN, [F.col("m")], ["cnt"])
    spans = frame.groupBy("cnt").agg(F.min("m_1").alias("_low1"), F.max("m_1").alias("_high1"))
    binned = quantile.null_safe_join(frame, spans, ["cnt"]).select("cnt", F.array("m_1").alias("_m"), F.array(quantile._bin(F.col("m_1"), F.col("_low1"), F.col("_high1"))).alias("_b"), "_weights")
    sums = quantile._bin_sums(binned, ["cnt"], 1, G + 1).first()
    assert len(sums["_bins"]) == quantile.BINS and sum(b.many for b in sums["_bins"]) == 20_000
    brackets = spark.createDataFrame([("A", 1, 127)], "cnt string, pv int, bin int")
    assert 0 < quantile._hit_rows(binned, brackets, ["cnt"], 1).count() < 200


def test_regression_matches_least_squares(df, rows):
    got = {(r.term): r.estimate for r in regress.regression(df, DESIGN, [F.col("m1")], {"x": F.col("x"), "sch": F.col("sch")}, where=F.col("cnt") == "A").collect()}
    own = [r for r in rows if r["cnt"] == "A" and r["x"] is not None]
    X = np.array([[1, r["x"], r["sch"]] for r in own])
    w = np.array([r["w0"] for r in own])
    beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * [r["m1"] for r in own]))
    assert np.allclose([got["(intercept)"], got["x"], got["sch"]], beta)


def test_regression_skips_and_says_why(df):
    flat = F.when(F.col("cnt") == "A", 1.0).otherwise(F.col("x"))
    why = {r.cnt: r.reason for r in regress.regression_skipped(df, DESIGN, [F.col("m1")], {"flat": flat}, ["cnt"]).collect()}
    assert why == {"A": "flat has a single value"}
    assert "A" not in {r.cnt for r in regress.regression(df, DESIGN, [F.col("m1")], {"flat": flat}, ["cnt"]).collect()}
    both = regress.regression_skipped(df, DESIGN, [F.col("m1")], {"x": F.col("x"), "y": 2 * F.col("x")}).first()
    assert both.reason == "y depends on x"
    three = {"x": F.col("x"), "sch": F.col("sch"), "z": F.col("x") + F.col("sch")}
    why = regress.regression_skipped(df, DESIGN, [F.col("m1")], three, ["cnt"]).collect()
    assert len(why) == 4 and {r.reason for r in why} == {"z depends on the predictors before it"}
    assert regress.regression(df, DESIGN, [F.col("m1")], three, ["cnt"]).count() == 0


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_regression_of_predictors_in_any_units(spark, shift):
    """Incomes and a rare 0-1 dummy: coefficients as least squares on the rows, nothing missing without a reason."""
    rng = np.random.default_rng(3)
    big, small = rng.normal(size=400) * 1e6 + shift, (rng.random(400) < 0.1) * 0.1
    y = 3 + 2e-6 * big + 40 * small + rng.normal(size=400)
    w = rng.uniform(0.5, 2, (400, G + 1))
    rows = [("A", k, float(a), float(b), float(a) * 2 + 1, float(v), *map(float, ws)) for k, (a, b, v, ws) in enumerate(zip(big, small, y, w))]
    rows += [("B", k, 1.0, float(k), 2.0 * k, 0.5 * k, *[1.0] * (G + 1)) for k in range(30)] + [("C", k, float(k), float(k % 3), float(k), None, *[1.0] * (G + 1)) for k in range(30)]
    df = spark.createDataFrame(rows, "cnt string, id long, a double, b double, c double, y double, " + ", ".join(f"w{r} double" for r in range(G + 1)))
    got = {(r.cnt, r.term): r.estimate for r in regress.regression(df, DESIGN, [F.col("y")], {"a": F.col("a"), "b": F.col("b")}, ["cnt"]).collect()}
    X = np.stack([np.ones(400), big - shift, small], 1)
    root = np.sqrt(w[:, 0])
    want = np.linalg.lstsq(X * root[:, None], y * root, rcond=None)[0]
    assert set(got) == {("A", t) for t in ("(intercept)", "a", "b")}
    assert np.allclose([got["A", "a"], got["A", "b"]], want[1:], rtol=1e-8) and abs(got["A", "(intercept)"] - (want[0] - want[1] * shift)) < 1e-6
    skipped = lambda xs: {r.cnt: r.reason for r in regress.regression_skipped(df, DESIGN, [F.col("y")], {x: F.col(x) for x in xs}, ["cnt"]).collect()}
    assert skipped("ab") == {"B": "a has a single value", "C": "outcome has no values"}
    assert skipped("ac") == {"A": "c depends on a", "B": "a has a single value", "C": "outcome has no values"}
    assert regress.regression(df, DESIGN, [F.col("y")], {x: F.col(x) for x in "ac"}, ["cnt"]).count() == 0


def school_rows():
    rng = np.random.default_rng(9)
    out = []
    for i in range(400):
        sch = None if i % 29 == 0 else int(rng.integers(1, 25))
        # schools 1-4 have none of the codes, school 5 has no known value
        item = None if sch == 5 or i % 31 == 0 else int(rng.integers(2, 4)) if sch and sch <= 4 else int(rng.integers(0, 4))
        out.append(dict(id=i, cnt="AB"[i % 2], sch=sch, item=item, m=float(rng.normal(500, 50)), **{f"w{r}": float(rng.uniform(0.5, 2)) for r in range(G + 1)}))
    return out


@pytest.mark.parametrize("students", [None, [1]])
def test_school_shares_match_loop(spark, students):
    """A school without any of the codes has a share of 0; no school or no known share is on neither side."""
    rows, cut = school_rows(), 0.3
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, cnt string, sch long, item long, m double, " + ", ".join(f"w{r} double" for r in range(G + 1)))
    shares, sizes = {}, {}
    for r in rows:
        if r["sch"] is not None:
            own = [x for x in rows if (x["cnt"], x["sch"]) == (r["cnt"], r["sch"])]
            known = sum(x["w0"] for x in own if x["item"] is not None)
            sizes[r["cnt"], r["sch"]] = len(own)
            shares[r["cnt"], r["sch"]] = sum(x["w0"] for x in own if x["item"] in (0, 1)) / known if known else None
    for g, r in {r.cnt: r for r in schools.school_split(df, DESIGN, F.col("item"), [0, 1], cut).collect()}.items():
        own = {k: v for k, v in shares.items() if k[0] == g and v is not None}
        assert (r.n_schools, r.n_at_cut, r.median_students) == (len(own), sum(v >= cut for v in own.values()), np.median([sizes[k] for k in own]))
        assert np.allclose([r.p10, r.p50, r.p90], np.quantile(list(own.values()), [0.1, 0.5, 0.9])) and min(own.values()) == 0
    for g, r in {r.cnt: r for r in stats.school_share_gap(df, DESIGN, [F.col("m")], F.col("item"), [0, 1], cut, ["cnt"], students).collect()}.items():
        mine = [x for x in rows if x["cnt"] == g and shares.get((g, x["sch"])) is not None and (students is None or x["item"] in students)]
        sides = [[x for x in mine if (shares[g, x["sch"]] >= cut) == high] for high in (True, False)]
        mean = lambda own, k: np.average([x["m"] for x in own], weights=[x[f"w{k}"] for x in own])
        e, s = finish([np.array([mean(sides[0], k) - mean(sides[1], k) for k in range(G + 1)])])
        assert abs(r.estimate - e) < 1e-9 and abs(r.se - s) < 1e-9


def test_crosstab_rows_sum_to_100_and_limit(df):
    d = df.withColumns({"r": F.col("id") % 2, "c": F.col("sch") % 3})
    sums = stats.crosstab(d, DESIGN, "r", "c").groupBy("row").agg(F.sum("estimate").alias("s")).collect()
    assert all(abs(x.s - 100) < 1e-9 for x in sums)
    with pytest.raises(ValueError):
        stats.crosstab(df, DESIGN, "id", "id")


def test_shares_keep_null(df):
    level = stats.weighted_mean(df, DESIGN, ms.level_share([F.col("m2")], ">=", 500)).first()
    assert level.n == df.where("m2 IS NOT NULL").count()
    with pytest.raises(ValueError):
        ms.condition("x", "like", 1)


def test_trend_keeps_missing_cycles(spark):
    res = spark.createDataFrame([("A", "c1", 500.0, 2.3), ("A", "c2", 460.0, 2.0), ("B", "c1", 1.0, 1.0), (None, "c2", 3.0, 1.0)], "cnt string, cycle string, estimate double, se double")
    got = {r.cnt: r for r in trend.trend(res, ["cnt"], ["c1", "c2"], 1.0).collect()}
    assert got["A"].change == -40 and abs(got["A"].se_change - np.sqrt(2.3**2 + 2**2 + 1)) < 1e-12
    assert got["B"].change is None and got["B"].se_change is None and got[None].estimate_c2 == 3


def test_group_average(spark):
    res = spark.createDataFrame([("A", 480.0, 3.0), ("B", 490.0, 2.0), ("C", None, None)], "cnt string, estimate double, se double")
    r = trend.group_average(res, "cnt", "all").first()
    assert (r.cnt, r.estimate, r.n_members) == ("all avg", 485.0, 2) and abs(r.se - np.sqrt(13) / 2) < 1e-12


def test_suppression(spark):
    res = spark.createDataFrame([("A", 1.0, 1.0, 1, 500, 40, 1.0), ("B", 1.0, 1.0, 1, 12, 3, 1.0), ("C", 1.0, 1.0, 1, 65, 2, 0.57), ("D", 1.0, 1.0, 1, 65, -1, 0.57)], "cnt string, estimate double, se double, n_pv int, n int, n_schools int, wcov double")
    got = {r.cnt: (r.estimate, r.suppressed) for r in rules.suppress_small_cells(res).collect()}
    assert got == {"A": (1.0, None), "B": (None, "students"), "C": (None, "schools"), "D": (1.0, None)}
    assert [(r.cnt, r.missing_percent) for r in rules.low_coverage(res).collect()] == [("D", 43.0)]


def test_ranks_share_ties_and_skip_averages(spark):
    res = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("avg", 2.0), ("d", None)], "k string, estimate double")
    got = {r.k: r["rank"] for r in rules.ranked(res, average=F.col("k") == "avg").collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "avg": None, "d": None}


READ_OFTEN = {
    "percentiles": lambda d, s: stats.percentiles(d, s, [F.col("m1"), F.col("m2")], ["cnt"], (10, 90)),
    "percentile_spread": lambda d, s: stats.percentile_spread(d, s, [F.col("m1"), F.col("m2")], ["cnt"]),
    "regression": lambda d, s: regress.regression(d, s, [F.col("m1")], {"x": F.col("x")}, ["cnt"]),
    "regression_two": lambda d, s: regress.regression(d, s, [F.col("m1"), F.col("m2")], {"x": F.col("x"), "sch": F.col("sch")}, ["cnt"]),
    "regression_skipped": lambda d, s: regress.regression_skipped(d, s, [F.col("m1")], {"x": F.lit(1.0)}, ["cnt"]),
    "regression_by_quarter": lambda d, s: regress.regression_by_quarter(d, s, [F.col("m1")], {"x": F.col("m2")}, F.col("x"), ["cnt"]),
    "resilient_share": lambda d, s: stats.resilient_share(d, s, [F.col("m1"), F.col("m2")], F.col("x"), ["cnt"]),
    "quartile_gap": lambda d, s: stats.quartile_gap(d, s, [F.col("m1")], F.col("x"), ["cnt"]),
    "correlation_by_quarter": lambda d, s: stats.correlation_by_quarter(d, s, [F.col("m1")], [F.col("m2")], F.col("x"), ["cnt"]),
}


@pytest.mark.parametrize("name", READ_OFTEN)
def test_rows_are_made_once_where_the_design_makes_its_weights(spark, df, name):
    """The rows may come from joins, which must not run again at every reading; results are those of given weights."""
    signs = F.array(F.col("w0"), *[F.col("w0") * F.when((F.col("sch") + r) % 2 == 0, 1.5).otherwise(0.5) for r in range(4)])
    make = lambda d: d.withColumn("wts", signs)
    given = SurveyDesign(array="wts", reps=4, order=("id",))
    small = SurveyDesign(array="wts", reps=4, order=("id",), made_from=("sch", "w0"), make=make)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = df.select("id", "cnt", "sch", "w0", "x", "m1", "m2")
    once = make(rows.mapInArrow(counted, rows.schema))
    key = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)
    got = key(READ_OFTEN[name](once, small))
    assert read.value == rows.count()
    assert got == key(READ_OFTEN[name](make(rows), given)) and got


def _python_rows(df):
    """Rows that each Arrow function of an executed plan has given back."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        n = nodes.pop()
        name = n.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(n.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(n.plan())
        elif name == "MapInArrowExec":
            out.append(n.metrics().apply("pythonNumRowsReceived").value())
        children = n.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_a_task_sends_its_sums_once_in_rows_as_narrow_as_the_schools(spark, df, monkeypatch, held):
    """Sums are held over the batches of a task, up to a limit; schools' rows carry no columns for the terms of the sums."""
    monkeypatch.setattr(replicate, "HELD", held)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        frame = replicate.analysis_frame(df.coalesce(1), DESIGN, [F.col("m1"), F.col("m2")], ["cnt"])
        terms = {f"t{k}": F.col("m_1") * k for k in range(5)} | {"one": F.lit(1.0), "m": F.col("m_2")}
        for seen in ([], [F.col("m_1").isNotNull()]):
            got = replicate.weighted_sums(frame, ["cnt"], terms, seen)
            rows = {(r.cnt, r.rep): r for r in got.collect()}
            local = df.collect()
            groups = {r.cnt for r in local}
            assert set(rows) == {(g, k) for g in groups for k in range(G + 1)}
            for (g, k), r in rows.items():
                own = [(x[f"w{k}"] or 0.0, x.m1, x.m2) for x in local if x.cnt == g]
                assert abs(r.t3 - sum(w * 3 * (m or 0) for w, m, _ in own)) < 1e-6 and abs(r.one - sum(w for w, *_ in own)) < 1e-9 and abs(r.m - sum(w * (m or 0) for w, _, m in own)) < 1e-6
            if seen:
                assert "_v3" not in got._jdf.queryExecution().executedPlan().toString()
            elif held > 1:
                assert _python_rows(got) == [len(groups) * (G + 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cuts_are_searched_by_halving(spark):
    rng = np.random.default_rng(3)
    cuts = [[], [1.0], [1.0, 2.0, float("nan")], sorted(rng.normal(0, 1, 33).tolist()), sorted(rng.normal(0, 1, 1023).tolist())]
    data = [(c, float(v)) for c in cuts for v in [*c[:40], *c[-40:], *rng.normal(0, 1, 50), float("inf"), float("nan")]]
    below = lambda c, v: sum(x < v or (np.isnan(v) and not np.isnan(x)) for x in c)
    d = spark.createDataFrame([*data, (None, 1.0)], "c array<double>, v double").withColumn("n", quantile._below("c", F.col("v")))
    assert [r.n for r in d.collect()] == [*[below(c, v) for c, v in data], 0]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(" not in plan


def test_skipped_groups_are_found_without_outcomes_and_schools(spark, df, monkeypatch):
    """A reason needs no sums with the outcome and no schools, so rows and sums are written without them."""
    xs = {"x": F.col("x"), "twice": 2 * F.col("x")}
    got = regress.regression_skipped(df.coalesce(1), DESIGN, [F.col("m1"), F.col("m2")], xs, ["cnt"])
    assert "null AS _seen" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.cnt: r.reason for r in got.collect()}
    assert rows == dict.fromkeys(["A", "B", "C", None], "twice depends on x")
    assert sorted(_python_rows(got)) == [4 * (G + 1), 4 * (G + 1) * 2]
    written, write = [], replicate.materialized
    monkeypatch.setattr(replicate, "materialized", lambda d, name: written.append(d) or write(d, name))
    small = SurveyDesign(array="wts", reps=4, order=("id",), made_from=("w0",), make=lambda d: d.withColumn("wts", F.array_repeat("w0", 5)))
    flat = {"x": F.when(F.col("cnt") == "A", 1.0).otherwise(F.col("x"))}
    kept = small.make(df.where("id % 50 > 0").withColumn("m1", F.when(F.col("cnt") == "B", float("nan")).otherwise(F.col("m1"))))
    assert {r.cnt: r.reason for r in regress.regression_skipped(kept, small, [F.col("m1")], flat, ["cnt"]).collect()} == {"A": "x has a single value", "B": "outcome has no values"}
    assert written[0].columns == ["cnt", "w0", "_y1", "_p1"] and {r._y1 for r in written[0].collect()} == {1.0, None}
