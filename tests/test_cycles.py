"""A plan over cycles that name and code their columns differently."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import cycles, stats
from surveyloom.plans.design import SurveyDesign

DESIGN = SurveyDesign(replicates=("w1", "w2"), order=("id",))
MEANINGS = {"gender": {1: "male", 2: "female"}, "male": {1: "male", 0: "female"}}
PLAN = cycles.Plan(("m",), ("cnt",), group="gender", a=1, b=2)


@pytest.fixture(scope="module")
def files(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "AB"[k % 2], 7, int(rng.integers(1, 3)), float(rng.normal(500, 50)), 1.0, 1.5, 0.5) for k in range(60)]
    one = spark.createDataFrame(rows, "id long, cnt string, sch long, gender long, m double, w0 double, w1 double, w2 double")
    two = one.withColumn("male", 2 - F.col("gender")).drop("gender").withColumnRenamed("cnt", "country")
    return {"2018": one, "2022": two, "2025": one.drop("gender")}


def test_resolving_a_plan():
    same = cycles.resolve(PLAN, {}, ["cnt", "gender", "m"], MEANINGS)
    assert same.plan == PLAN and not same.rename and not same.notes
    turned = cycles.resolve(PLAN, {"group": "male", "a": 0, "b": 1}, ["CNT", "male"], MEANINGS)
    assert (turned.plan.a, turned.plan.b) == (1, 0) and "turned into 1 minus 0" in turned.notes[0]
    right = cycles.resolve(PLAN, {"group": "male", "a": 1, "b": 0}, ["cnt", "male"], MEANINGS)
    assert (right.plan.a, right.plan.b) == (1, 0) and not right.notes
    assert cycles.resolve(PLAN, {"group": "male"}, ["cnt", "gender"], MEANINGS) == "it has no male"
    assert "sides apart" in cycles.resolve(PLAN, {"group": "x", "a": 1, "b": 2}, ["cnt", "x"], MEANINGS)
    assert "not as many" in cycles.resolve(PLAN, {"by": ("a", "b")}, ["a", "b"], MEANINGS)
    by = cycles.resolve(cycles.Plan(("m",), ("cnt", "gender")), {"by": ("country", "male")}, ["country", "male"], MEANINGS)
    assert by.rename == (("country", "cnt"), ("male", "gender")) and by.recode == {"gender": {1: 1, 0: 2}}


def test_a_flipped_contrast_and_renamed_groups_give_the_same_numbers(files):
    got, notes = cycles.over_cycles(files, DESIGN, PLAN, {"2022": {"by": ("country",), "group": "male", "a": 0, "b": 1}}, MEANINGS)
    want = {r.cnt: r.estimate for r in stats.gap(files["2018"], DESIGN, [F.col("m")], F.col("gender"), 1, 2, ["cnt"]).collect()}
    rows = got.collect()
    assert {(r.cycle, r.cnt): r.estimate for r in rows} == {(c, k): v for c in ("2018", "2022") for k, v in want.items()}
    assert {r.contrast for r in rows} == {"1 minus 2"} and notes["2025"] == ("left out: it has no gender",) and notes["2022"] and not notes["2018"]


def test_recoded_groups(files):
    plan = cycles.Plan(("m",), ("cnt", "gender"))
    got, _ = cycles.over_cycles({k: files[k] for k in ("2018", "2022")}, DESIGN, plan, {"2022": {"by": ("country", "male")}}, MEANINGS)
    rows = {(r.cycle, r.cnt, r.gender): r.estimate for r in got.collect()}
    assert len(rows) == 8 and all(rows["2018", c, g] == rows["2022", c, g] for c in "AB" for g in (1, 2))
    with pytest.raises(ValueError, match="it has no gender"):
        cycles.over_cycles({"2025": files["2025"]}, DESIGN, plan)
