"""Sources, guards, search, text and rules on small made-up tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from surveyloom.functions import text
from surveyloom.functions.phrases import Phrases
from surveyloom.operators import catalog, events, joins, rules, trend
from surveyloom.plans.design import SurveyDesign
from surveyloom.sources import ingest, work


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i)) for i in range(30)], "stuid int, grp string, score double")
    df.createOrReplaceTempView("people")
    return df


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT stuid AS x, count(*) FROM people GROUP BY stuid", "SELECT * FROM people, (SELECT count(*) AS n FROM people)", "SELECT p.*, n FROM people p CROSS JOIN (SELECT count(*) AS n FROM people)",
        "SELECT grp AS Aggregate FROM people", "SELECT grp, score FROM people CROSS JOIN (SELECT count(*) AS n FROM people)", "SELECT 1; SELECT 2", "DELETE FROM people", "WITH a AS (SELECT grp FROM people) SELECT grp FROM a",
        "SELECT grp, count(*) AS n FROM people WHERE STUID > 3 GROUP BY grp", "SELECT grp FROM people -- count(*)", "SELECT DISTINCT score FROM people", "SELECT score FROM people UNION ALL SELECT avg(score) FROM people",
    ],
)
def test_safe_sql_refuses_rows_and_identifiers(spark, people, sql):
    with pytest.raises(ValueError):
        ingest.safe_sql(spark, sql, ["stuid"])


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT grp, avg(score) AS m FROM people GROUP BY grp", "WITH a AS (SELECT grp, count(*) AS n FROM people GROUP BY grp) SELECT max(n) AS m FROM a", "WITH a AS (SELECT grp, count(*) AS n FROM people GROUP BY grp) SELECT grp, n FROM a WHERE n > 2 ORDER BY n;",
        "SELECT grp, count(*) AS n FROM people WHERE grp <> 'stuid' GROUP BY grp HAVING count(*) > 1", "SELECT count(*) AS n FROM people UNION ALL SELECT max(score) FROM people",
    ],
)
def test_safe_sql_lets_aggregates_pass(spark, people, sql):
    assert 1 <= ingest.safe_sql(spark, sql, ["stuid"]).count() <= 3


def test_plan_checks(spark, people):
    other = people.withColumnRenamed("score", "escs")
    with pytest.raises(ValueError, match="escs is not in a but in b; zzz is not in a nor"):
        catalog.check_columns({"a": people, "b": other}, ["GRP", "escs", "zzz"], "a")
    catalog.check_columns({"a": people}, ["SCORE"], "a")
    have, left = catalog.cycles_with({"c1": people, "c2": other}, {"m": ["score"], "e": ["escs"], "g": ["grp"]})
    assert have == {"m": ["c1"], "e": ["c2"], "g": ["c1", "c2"]} and left == [("m", "c2"), ("e", "c1")]
    with pytest.raises(ValueError):
        catalog.cycles_with({"c1": people}, {"e": ["escs"]})
    assert catalog.benchmark_keys(["gender"], "cnt", ["A", "B"], []) == ["cnt", "gender"]
    assert catalog.benchmark_keys([], "cnt", ["A"], ["all"]) == ["cnt"] and catalog.benchmark_keys(["gender"], "cnt", ["A"], []) == ["gender"]


def test_registry_skips_what_exists(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    source = [ingest.Source(n, "stu", c, str(tmp_path / "in"), str(tmp_path / n)) for n, c in (("a", "2018"), ("b", "2022"))]
    assert ingest.convert(spark, source, ["2018"]) == {"a": "published"}
    assert ingest.convert(spark, source) == {"a": "skipped", "b": "published"}
    assert ingest.convert(spark, source, ["b"], force=True) == {"b": "published"} and spark.read.parquet(str(tmp_path / "b")).count() == 30
    with pytest.raises(ValueError):
        ingest.select_sources(source, ["c"])
    assert catalog.optional_table(spark, str(tmp_path / "none")) is None and catalog.optional_table(spark, str(tmp_path / "a")).count() == 30


def test_search_meets_phrases_stems_and_odd_words(spark):
    rows = [("WB01", "Student well-being at school"), ("ST2", "Well, how is your (home) today"), ("BULLIED", "Being hit"), ("PV1MATH", "Plausible Value 1 in Mathematics"), ("X", None)]
    cat = spark.createDataFrame([(v, "t", "c1", label) for v, label in rows], "variable string, table_name string, cycle string, label string")
    score = lambda q: {r.variable: r.score for r in catalog.search(cat, q).collect()}
    assert score("wellbeing") == {"WB01": 29, "ST2": 4} and score("well-being") == {"WB01": 25} and score("well being") == {"WB01": 25}
    assert score("bullying") == {"BULLIED": 30} and score("(home") == {"ST2": 11} and score("the of") == {}
    assert score("score math")["PV1MATH"] == 11 + 30 + 3


def test_entities_by_capitals_phrases_and_negatives(spark):
    docs = ["Korea did well", "North Korea did not", "north korea and the Republic of Korea", "KOR leads", "we are here", "ARE rose", "in the united arab emirates", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    names = spark.createDataFrame([("KOR", "korea"), ("KOR", "republic of korea"), ("ARE", "united arab emirates")], "code string, alias string")
    wrong = spark.createDataFrame([("KOR", "north korea")], "code string, alias string")
    got = {(r.id, r.code) for r in text.tag_entities(df, "id", "text", names, wrong).collect()}
    assert got == {(0, "KOR"), (2, "KOR"), (3, "KOR"), (5, "ARE"), (6, "ARE")}
    assert text.tag_entities(df, "id", "text", names).where("code = 'KOR'").count() == 4


def test_numbers_not_in_the_pool(spark):
    said = "In 2018 there were 6,622 of 4785380592391139 at 3.141 and 3.142, v1.2.3 says 12, 13 or -49.5 (SE 2.99, x)"
    pool = spark.createDataFrame([(6622.0,), (3.1414,), (49.46,), (13.4,)], "value double")
    got = {r.number for r in text.ungrounded_numbers(spark.createDataFrame([(1, said), (2, None)], "id int, text string"), "id", "text", pool).collect()}
    assert got == {"4785380592391139", "3.142", "2.99"}


def test_number_text(spark):
    rows = spark.createDataFrame([(12.345,), (-9.999,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in rows.select(text.number_text(F.col("v"))).collect()] == ["12.3", "-10.00", "no estimate", "no estimate"]
    assert rows.select(text.number_text(F.col("v"), 0)).first()[0] == "12"


def test_facts_of_changes_and_terms(spark):
    rows = [("A", 10.0, 1.0, 5.0, 1.0, 50, 9, 1.0), ("B", 12.0, 1.0, 0.5, 1.0, 50, 9, 0.5), ("avg", 11.0, 1.0, None, None, 99, -1, 1.0)]
    df = spark.createDataFrame(rows, "k string, estimate double, se double, change double, se_change double, n int, n_schools int, wcov double")
    got = {r.k: r for r in rules.fact_rows(df, "k", F.col("k") == "avg", change="change").collect()}
    assert (got["A"].change, got["A"].significant, got["A"]["rank"]) == (5.0, True, 2) and got["B"].significant is False and got["B"].missing_percent == 50
    assert got["avg"]["rank"] is None and got["avg"].significant is None
    terms = df.limit(2).withColumn("term", F.when(F.col("k") == "A", "(intercept)").otherwise("x"))
    said = {r.term: r for r in rules.fact_rows(terms, "k", F.lit(False), term="term").collect()}
    assert said["(intercept)"].significant is None and said["(intercept)"]["rank"] is None and said["x"].significant and said["x"]["rank"] == 1


def test_benchmarks_leave_out_named_members(spark):
    res = spark.createDataFrame([(c, y, e, 1.0) for y in ("1", "2") for c, e in (("A", 1.0), ("B", 3.0), ("C", 8.0))], "cnt string, cycle string, estimate double, se double")
    members = spark.createDataFrame([("all", c) for c in "ABC"] + [("two", "A"), ("two", "B")], "label string, cnt string")
    out = spark.createDataFrame([(None, "C", "1"), ("two", "B", "2")], "label string, cnt string, cycle string")
    got = {(r.label, r.cycle): (r.estimate, r.n_members) for r in trend.benchmark_groups(res, members, "cnt", excluded=out).collect()}
    assert got == {("all avg", "1"): (2.0, 2), ("all avg", "2"): (4.0, 3), ("two avg", "1"): (2.0, 2), ("two avg", "2"): (1.0, 1)}


def test_filters_and_counts(spark, people):
    df = people.withColumns({"sch": F.col("stuid") % 4, "w0": F.lit(1.5)})
    keep = joins.economy_filter(F.col("grp"), ["G0", "g1"], ["g1"], {"G0": "g0"})
    assert {r.grp for r in df.where(keep).collect()} == {"g0"}
    assert df.where(joins.stratum_filter(F.col("grp"), ["g0"], True)).count() == 20
    design = SurveyDesign(replicates=(), economy="grp")
    assert tuple(catalog.sample_counts(df, design).first()) == (30, 4, 3, 45.0)
    ties = spark.createDataFrame([("c1", "A", 1), ("c1", "A", 2)], "cycle string, cnt string, mode int")
    assert catalog.mode_by_economy(ties, "cnt", "mode", {1: "paper", 2: "computer"}, 0.5).first()["mode"] == "paper"


def test_log_window(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-09",)], "ts string").select(F.to_timestamp("ts").alias("ts"))
    assert rows.where(F.col("ts") >= ingest.since_days(7, F.lit("2024-01-10").cast("timestamp"))).count() == 1
    asks = spark.createDataFrame([("ask", "s", "i", "data", None, None, "up", True)], "kind string, session string, institution string, route string, error string, chart string, vote string, mobile boolean")
    r = events.usage_kpis(asks).first()
    assert (r.asks, r.data_percent, r.charted_percent, r.votes_up) == (1, 100, None, 1)


def test_item_similarity_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    rows = [(f"A{i}", "t", "c1", x, "{}") for i, x in enumerate(base)]
    for i, x in enumerate(base):
        for k in range(4):
            y = list(x)
            for _ in range(k):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.choice([0, 1])] = rng.choice([[], ["z"]])
            rows.append((f"B{i}_{k}", "t", "c3", "".join(y), "{}"))
    cat = spark.createDataFrame(rows, "variable string, table_name string, cycle string, label string, value_labels string")
    got = {(r[1], r[2], r[3]) for r in joins.item_similarity(cat, "c1", "c3").collect()}
    one = lambda c: cat.where(f"cycle = '{c}'").select(F.col("variable").alias(f"v{c}"), joins.normal_label(F.col("label")).alias(f"w{c}"))
    sim = F.round(1 - F.try_divide(F.levenshtein("wc1", "wc3"), F.greatest(F.length("wc1"), F.length("wc3"))), 6)
    want = {(r[0], r[1], r[2]) for r in one("c1").join(one("c3")).select("vc1", "vc3", sim.alias("s")).where("s >= 0.85").collect()}
    assert got == want and len(want) > 25


def test_safe_sql_follows_identifiers_through_names(spark):
    people = spark.createDataFrame([(k, "AB"[k % 2], float(k)) for k in range(20)], "c_custkey long, grp string, x double")
    people.createOrReplaceTempView("people")
    people.selectExpr("c_custkey AS k", "grp", "x").createOrReplaceTempView("renamed")
    people.groupBy("grp").agg(F.count("c_custkey").alias("n")).createOrReplaceTempView("counted")
    run = lambda sql: ingest.safe_sql(spark, sql, ["c_custkey"]).collect()
    for sql in (
        "SELECT k, count(*) AS n FROM renamed GROUP BY k", "SELECT c_custkey, count(*) AS n FROM people GROUP BY c_custkey", "SELECT grp, max(k) AS top FROM renamed GROUP BY grp",
        "SELECT id, sum(n) AS n FROM (SELECT k + 1 AS id, count(*) AS n FROM renamed GROUP BY k + 1) GROUP BY id", "SELECT count(*) AS n FROM people WHERE C_CUSTKEY = 3",
        "WITH t AS (SELECT k AS z, x FROM renamed) SELECT z, avg(x) AS m FROM t GROUP BY z", "SELECT avg(x) AS m FROM people WHERE x > (SELECT max(k) FROM renamed)",
        "SELECT z, count(*) AS n FROM (SELECT grp AS z FROM people UNION ALL SELECT CAST(k AS STRING) FROM renamed) GROUP BY z",
    ):
        with pytest.raises(ValueError, match="identifiers"):
            run(sql)
    assert {r.grp: r.n for r in run("SELECT grp, count(*) AS n FROM renamed WHERE grp <> 'c_custkey' GROUP BY grp")} == {"A": 10, "B": 10}
    assert run("SELECT sum(n) AS total FROM counted")[0].total == 20 and run("SELECT count(*) AS c_custkey FROM people")[0][0] == 20


def test_publishing_counts_while_it_writes(spark, tmp_path):
    df = spark.range(30).where("id >= 0")
    assert ingest.publish_parquet(df, str(tmp_path / "a"), 30).count() == 30
    with pytest.raises(ValueError, match="30 rows, 31 expected"):
        ingest.publish_parquet(df, str(tmp_path / "b"), 31)
    assert [x for x in os.listdir(tmp_path)] == ["a"]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    ingest.publish_parquet(spark.range(50).mapInArrow(counted, "id long"), str(tmp_path / "c"), 50)
    assert reads.value == 50


def test_phrase_automaton_finds_what_plain_search_finds():
    rng = random.Random(4)
    words = "a b c d".split()
    for _ in range(200):
        phrases = [[rng.choice(words) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 9))]
        text = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        want = {k for k, p in enumerate(phrases) if any(text[i : i + len(p)] == p for i in range(len(text)))}
        assert Phrases(phrases).found(text) == want


def test_entities_by_automaton_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "In Korea and north-korea KOR"), (2, "north korea only"), (3, None), (4, "the republic of korea, kor"), (5, "new  zealand\nwins"), (5, "NZL"), (None, "korea"), (7, "Zealand newcomers")], "id long, text string"
    )
    aliases = spark.createDataFrame([("KOR", "korea"), ("KOR", "Republic of Korea"), ("NZL", "new zealand")], "code string, alias string")
    wrong = spark.createDataFrame([("KOR", "north korea")], "code string, alias string")
    want = [(None, "KOR"), (1, "KOR"), (4, "KOR"), (5, "NZL")]
    for most in (200_000, 1):
        monkeypatch.setattr("surveyloom.functions.text.DICTIONARY", most)
        got = text.tag_entities(docs, "id", "text", aliases, wrong)
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r)) == want
        assert ("Generate" in got._jdf.queryExecution().analyzed().toString()) == (most == 1)
    assert text.tag_entities(docs.limit(0), "id", "text", aliases).count() == 0


def test_regions_meet_by_runs_of_characters(spark):
    names = spark.createDataFrame([("Latin America & Caribbean",), ("EU",), ("the eu zone",), ("nowhere",), (None,), ("Asia",), ("SE Asia",)], "name string")
    aliases = spark.createDataFrame([("eu", "E"), ("latin america", "L"), ("america", "N"), ("asia", "A"), ("south-east asia", "S")], "alias string, region string")
    got = text.region_lookup(names, aliases)
    assert {r.name: r.region for r in got.collect()} == {"Latin America & Caribbean": "L", "EU": "E", "the eu zone": "E", "nowhere": None, None: None, "Asia": "A", "SE Asia": "A"}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_coverage_takes_one_scan_whatever_the_columns(spark, tmp_path):
    columns = [f"v{k}" for k in range(200)]
    rows = [("AB"[r % 2], *[None if (k % 7 == 0 and r % 2) or k == 63 else 1 for k in range(200)]) for r in range(10)]
    spark.createDataFrame(rows, "cnt string, " + ", ".join(f"{c} int" for c in columns)).write.parquet(str(tmp_path / "t"))
    got = catalog.coverage_table(spark.read.parquet(str(tmp_path / "t")), "cnt", columns)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    for r in got.collect():
        k = int(r.variable[1:])
        want = "" if k == 63 else "A" if k % 7 == 0 else "A B"
        assert (r.with_data, r.n_with, r.n_economies) == (want, len(want.split()), 2) and r.missing.split() == [x for x in "AB" if x not in want]
    assert got.count() == 200


def test_search_looks_keys_up_in_the_index(spark):
    rows = [("ST001", "Grade in school"), ("ST004D01T", "Student gender"), ("PV1MATH", "Plausible value 1 in mathematics"), ("W_FSTUWT", "Final weight"), ("MATHEFF", "Mathematics self-efficacy"), ("X", None)]
    cat = spark.createDataFrame(rows, "variable string, label string")
    index = catalog.search_index(cat)
    points = {r.variable: r.score for r in catalog.scores(index, ["mathematics"]).collect()}
    # phrase 25, word 8, in the label 3, stem in the label 4; the name's start 30
    assert points == {"PV1MATH": 40, "MATHEFF": 70}
    assert {r.variable: r.score for r in catalog.scores(index, ["st"]).collect()} == {"ST001": 30, "ST004D01T": 33, "W_FSTUWT": 30}
    assert {r.variable for r in catalog.search(cat, "plausible", index=index).collect()} == {"PV1MATH"}
    plan = catalog.retrieve(cat, ["mathematics", "gender", "weight"], index=index)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.split("Generate")[0]


def test_work_tables_lie_in_one_folder_and_can_be_cleared(spark):
    df = work.materialized(spark.range(5), "some")
    assert df.count() == 5 and spark.sparkContext.applicationId in work.session_dir(spark)
    folder = work.session_dir(spark).removeprefix("file:")
    assert any(x.startswith("some-") for x in os.listdir(folder))
    work.clear_work(spark)
    assert not os.path.exists(folder)
    assert work.materialized(spark.range(3), "some").count() == 3


def _copies(spark, path, n):
    """A catalog in a file, in which many items share few wordings."""
    rows = [(f"V{k}", "t", f"c{1 + 2 * (k % 2)}", f"Student item {'ab'[k % 4 // 2]}", "{}") for k in range(n)]
    spark.createDataFrame(rows, "variable string, table_name string, cycle string, label string, value_labels string").write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_item_similarity_broadcasts_no_pieces(spark, tmp_path):
    got = joins.item_similarity(_copies(spark, tmp_path / "c", 200), "c1", "c3")
    # pieces of labels are many times the file, whose size is all that Spark's estimate knows
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 10_000 and got.where("similarity = 1").count() == 5_000


def test_match_items_lists_no_pairs(spark, tmp_path):
    many = _copies(spark, tmp_path / "c", 400)
    one = spark.createDataFrame([("X", "t", "c1", "Only here", None), ("Y", "t", "c3", "only HERE", None), ("X", "t", "c3", "only here", None), (None, "t", "c3", "only here", None), ("Z", "t", "c1", None, None)], many.schema)
    got = joins.match_items(many.unionByName(one), "c1", "c3")
    assert [tuple(r) for r in got.collect()] == [("X", "Y")]
    joined = got._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in joined.toString()
    # counts meet counts: both sides of the join are grouped before
    assert joined.toString().split("Join", 1)[1].count("Aggregate") > 2
    twice = one.unionByName(one.where("variable = 'Y'"))
    assert joins.match_items(twice, "c1", "c3").count() == 0
