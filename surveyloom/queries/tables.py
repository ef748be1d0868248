"""Queries: sources, filters, joins, catalog, search, text, events, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog as cat
from ..operators import events as ev
from ..operators import joins, quality, stats
from ..sources import ingest
from ..sources.work import work_path
from .fixture import DESIGN, EST, pv, query, rounded, sql_comb, sql_f, sql_mean, sql_rep, survey, table
from .linear import CNT, pva

_V = lambda sql, *ts: _fill(sql, {t: t for t in ts})  # noqa: E731  the SQL for DuckDB


def _fill(sql: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _sql(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, d, t) for t in names})


# -- sources ---------------------------------------------------------------------------------------


@query("scan_instrument", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_returnflag")
def scan_instrument(spark, d):
    ingest.scan_instrument(spark, f"{d}/lineitem.parquet", "line", "2018")
    return rounded(spark.sql("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM line_2018 GROUP BY l_returnflag"))


@query("scan_csv_trend", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def scan_csv_trend(spark, d):
    path = work_path(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    return rounded(spark.read.option("header", True).schema("c_custkey bigint, c_mktsegment string, c_acctbal double").csv(path))


@query("export_csv", "SELECT n_nationkey, 'say \"' || n_name || '\", ok' AS note, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def export_csv(spark, d):
    path = work_path(spark, "export")
    df = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("n"))
    ingest.export_csv(df.select("n_nationkey", F.concat(F.lit('say "'), "n_name", F.lit('", ok')).alias("note"), "n"), path)
    return spark.read.option("header", True).option("escape", '"').schema("n_nationkey int, note string, n bigint").csv(path)


@query("union_by_name", "SELECT o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL, round(o_totalprice, 6) FROM orders WHERE o_orderkey % 3 <> 0")
def union_by_name(spark, d):
    o = table(spark, d, "orders")
    return rounded(ingest.union_by_name([o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey"), o.where("o_orderkey % 3 <> 0").select("o_totalprice", "o_orderkey")]))


@query("cast_schema", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderdate FROM orders")
def cast_schema(spark, d):
    return ingest.cast_schema(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate"), ["o_orderstatus"], ["o_orderdate"])


@query("validate_source", "SELECT 'rows' AS \"check\", TRUE AS ok, CAST(count(*) AS VARCHAR) AS detail FROM customer UNION ALL SELECT 'economies', count(DISTINCT c_nationkey) = 25, CAST(count(DISTINCT c_nationkey) AS VARCHAR) FROM customer UNION ALL SELECT 'keys', FALSE, 'w_fstuwt'")
def validate_source(spark, d):
    df = table(spark, d, "customer")
    return ingest.validate_source(df, df.count(), ["c_custkey", "w_fstuwt"], "c_nationkey", 25)


@query("publish_parquet", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def publish_parquet(spark, d):
    df = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return rounded(ingest.publish_parquet(df, work_path(spark, "published"), df.count()))


@query("scan_events", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events WHERE event_id % 7 <> 0")
def scan_events(spark, d):
    path = work_path(spark, "events")
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "user_id", "event_type", "value"))).alias("value"))
    lines.write.text(path)
    return rounded(spark.read.schema("event_id bigint, user_id bigint, event_type string, value double").option("mode", "DROPMALFORMED").json(path).where("event_id IS NOT NULL"))


_META = "SELECT c_mktsegment AS source, to_json(map_from_entries(collect_list(struct(cast(c_custkey AS STRING), c_name)))) AS labels FROM {customer} GROUP BY c_mktsegment"


@query("scan_metadata_json", "SELECT c_mktsegment AS source, CAST(c_custkey AS VARCHAR) AS variable, c_name AS label FROM customer")
def scan_metadata_json(spark, d):
    path = work_path(spark, "meta")
    _sql(spark, d, _META, "customer").select(F.to_json(F.struct("source", F.from_json("labels", "map<string,string>").alias("labels")))).write.text(path)
    return spark.read.schema("source string, labels map<string,string>").json(path).select("source", F.explode("labels").alias("variable", "label"))


@query("scan_published", "SELECT 'Q' || CAST(n_nationkey AS VARCHAR) AS code, round(max(c_acctbal), 2) AS published FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY n_nationkey")
def scan_published(spark, d):
    raw = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.max("c_acctbal"), 2).cast("string").alias("value")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    letters = lambda c: F.concat(F.lit("Land "), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
    raw = raw.select(F.concat(letters(F.col("n_nationkey")), F.lit(" 2)")).alias("name"), "value")
    codes = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(letters(F.col("n_nationkey")).alias("name"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("code"))
    return ingest.scan_published(raw, F.col("name"), "value", codes)


@query("safe_sql", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def safe_sql(spark, d):
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    return rounded(ingest.safe_sql(spark, "SELECT n_name, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", ["c_custkey"]))


# -- filters ---------------------------------------------------------------------------------------


@query("filter_economy", sql_mean(CNT, pv(), "cnt IN ('NATION_3', 'NATION_4') AND cnt NOT IN ('NATION_4')", f"cnt, {EST}"))
def filter_economy(spark, d):
    keep = joins.economy_filter(F.col("cnt"), ["N3", "NATION_4"], ["N4"], {"N3": "NATION_3", "N4": "NATION_4"})
    return rounded(stats.weighted_mean(survey(spark, d), DESIGN, pva(), CNT, keep).select("cnt", "estimate", "se"))


@query("filter_stratum", sql_mean(["cnt", "stratum"], pv(), "stratum NOT IN ('BUILDING', 'MACHINERY')", f"cnt, stratum, {EST}"))
def filter_stratum(spark, d):
    return rounded(stats.weighted_mean(survey(spark, d), DESIGN, pva(), ["cnt", "stratum"], joins.stratum_filter(F.col("stratum"), ["BUILDING", "MACHINERY"], True)).select("cnt", "stratum", "estimate", "se"))


@query("filter_region", f"WITH {sql_f()}, c AS (SELECT DISTINCT cycle FROM f), p AS (SELECT DISTINCT cycle, cnt FROM f) SELECT r_name AS region, n_name AS code, c.cycle, p.cnt IS NOT NULL AS present FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN c LEFT JOIN p ON p.cycle = c.cycle AND p.cnt = n_name")
def filter_region(spark, d):
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("code"))
    return joins.region_members(regions, survey(spark, d).select("cycle", F.col("cnt").alias("code")).distinct())


_ITEMS = "SELECT CAST(r_regionkey + 1 AS STRING) AS code, CASE WHEN r_regionkey = 3 THEN 'No Response' ELSE r_name END AS label FROM {region}"


@query("codes_left_out", f"WITH {sql_f()}, l AS ({_V(_ITEMS, 'region')}) SELECT DISTINCT CAST(item AS VARCHAR) AS code, label FROM f JOIN l ON CAST(item AS VARCHAR) = code WHERE item NOT IN (1) AND label <> 'No Response'")
def codes_left_out(spark, d):
    return joins.codes_left_out(survey(spark, d), "item", [1], _sql(spark, d, _ITEMS, "region"))


# -- joins -----------------------------------------------------------------------------------------


@query("join_school", f"WITH {sql_f()} SELECT cnt, c_name IS NULL AS unmatched, count(*) AS n, round(sum(c_acctbal), 6) AS balance FROM f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 <> 0) ON sch = c_custkey GROUP BY ALL")
def join_school(spark, d):
    schools = table(spark, d, "customer").where("c_custkey % 50 <> 0").withColumnsRenamed({"c_custkey": "sch", "c_mktsegment": "stratum"})
    df = joins.join_missing_columns(survey(spark, d), schools, ["sch"])
    return rounded(df.groupBy("cnt", F.col("c_name").isNull().alias("unmatched")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")))


@query("join_domain_file", "SELECT o_orderpriority, count(*) AS n, count(t) AS n_matched, round(sum(t), 6) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT o_orderkey AS k, o_totalprice AS t FROM orders WHERE o_orderkey % 4 <> 0) ON k = l_orderkey GROUP BY o_orderpriority")
def join_domain_file(spark, d):
    o = table(spark, d, "orders")
    df = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = joins.join_missing_columns(df, o.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return rounded(got.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("n_matched"), F.sum("o_totalprice").alias("total")))


@query("patch_join", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(-o_totalprice, 6) ELSE round(o_totalprice, 6) END AS o_totalprice FROM orders")
def patch_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    values = o.where("o_orderstatus = 'F'").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return rounded(joins.patch(held, values, ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice"))


_CAT = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'PV' || CAST(p_partkey % 10 + 1 AS STRING) || 'MATH' WHEN 1 THEN 'W_FSTURWT' || CAST(p_partkey % 80 + 1 AS STRING)
  ELSE 'ST' || CAST(p_partkey AS STRING) || 'Q01' END AS variable,
 p_brand AS table_name, 'c' || CAST(p_partkey % 3 + 1 AS STRING) AS cycle, 'Student ' || p_name || ' ' || lower(p_type) AS label,
 CASE WHEN p_size % 2 = 0 THEN 'double' ELSE 'string' END AS var_type,
 CASE WHEN p_size % 5 = 0 THEN '{"1":"Yes","2":"No"}' WHEN p_size % 5 = 1 THEN '{"1":"' || p_type || '"}' END AS value_labels FROM {part}"""
_CATD = _V(_CAT, "part")


def _catalog(spark, d):
    return spark.sql(_CAT.replace('{"1":"Yes","2":"No"}', '{{"1":"Yes","2":"No"}}').replace("'{\"1\":\"' || p_type || '\"}'", "'{{\"1\":\"' || p_type || '\"}}'"), part=table(spark, d, "part"))


@query("label_codes", f"WITH {sql_f()} SELECT cnt, item, label, count(*) AS n FROM f LEFT JOIN (SELECT * FROM (VALUES ('1', 'Never'), ('2', 'Often')) AS t(code, label)) ON CAST(item AS VARCHAR) = code GROUP BY ALL")
def label_codes(spark, d):
    c = spark.sql("""SELECT 'ITEM' AS variable, '{"1":"Never","2":"Often"}' AS value_labels""")
    df = survey(spark, d).withColumn("item", F.col("item").cast("double"))
    return joins.label_codes(df, "item", c, "ITEM", "label").groupBy("cnt", F.col("item").cast("int").alias("item"), "label").agg(F.count("*").alias("n"))


@query("participation", f"WITH {sql_f()}, p AS (SELECT DISTINCT cnt AS code, cycle FROM f) SELECT code, string_agg(cycle, ' ' ORDER BY cycle) AS cycles, min(cycle) = 'c3' AS is_new, max(cycle) <> 'c3' AS is_gone FROM p GROUP BY code")
def participation(spark, d):
    return joins.participation(survey(spark, d).select(F.col("cnt").alias("code"), "cycle"), "c1", "c3")


_ONE = lambda c: f"SELECT variable AS variable_{c}, regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g') AS w_{c}, coalesce(value_labels, '') AS codes, table_name FROM k WHERE cycle = '{c}'"


@query("match_items", f"WITH k AS ({_CATD}), m AS (SELECT variable_c1, variable_c3 FROM ({_ONE('c1')}) a JOIN ({_ONE('c3')}) b ON w_c1 = w_c3 AND a.codes = b.codes WHERE variable_c1 <> variable_c3) SELECT variable_c1, min(variable_c3) AS variable_c3 FROM m GROUP BY variable_c1 HAVING count(*) = 1")
def match_items(spark, d):
    return joins.match_items(_catalog(spark, d), "c1", "c3")


@query("item_similarity", f"WITH k AS ({_CATD}), m AS (SELECT a.table_name, variable_c1, variable_c3, round(1 - levenshtein(w_c1, w_c3) / CAST(greatest(length(w_c1), length(w_c3)) AS DOUBLE), 6) AS similarity FROM ({_ONE('c1')}) a JOIN ({_ONE('c3')}) b ON a.codes = b.codes AND a.table_name = b.table_name) SELECT DISTINCT * FROM m WHERE similarity >= 0.85")
def item_similarity(spark, d):
    return joins.item_similarity(_catalog(spark, d), "c1", "c3")


# -- counts, coverage, catalog ---------------------------------------------------------------------


@query("sample_counts", f"WITH {sql_f()} SELECT cycle, count(*) AS students, count(DISTINCT sch) AS schools, count(DISTINCT cnt) AS economies, round(sum(w0), 6) AS population FROM f GROUP BY cycle")
def sample_counts(spark, d):
    return rounded(cat.sample_counts(survey(spark, d), DESIGN, ["cycle"]))


@query("flag_members", f"WITH {sql_f()} SELECT DISTINCT cnt FROM f WHERE oecd = 1")
def flag_members(spark, d):
    return cat.flag_members(survey(spark, d), "cnt", F.col("oecd") == 1)


@query("unknown_codes", "SELECT DISTINCT 'NATION_' || CAST(c_custkey % 40 AS VARCHAR) AS code FROM customer WHERE c_custkey % 40 >= 25")
def unknown_codes(spark, d):
    asked = table(spark, d, "customer").select(F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string")).alias("code"))
    return joins.unknown_codes(asked, table(spark, d, "nation").select(F.col("n_name").alias("code")))


@query("region_rows", f"WITH {sql_f()} SELECT cnt, count(*) AS n FROM f WHERE cnt IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY cnt")
def region_rows(spark, d):
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("code"))
    return joins.region_rows(survey(spark, d), regions, "ASIA", "cnt").groupBy("cnt").agg(F.count("*").alias("n"))


_COVSRC = "SELECT *, CASE WHEN cnt IN ('NATION_5', 'NATION_6') THEN NULL ELSE item END AS item2, CASE WHEN substr(cnt, 8, 1) = '1' THEN NULL ELSE escs END AS escs2 FROM f"
_COV = f"WITH {sql_f()}, g AS ({_COVSRC}), u AS (" + " UNION ALL ".join(f"SELECT cnt, '{v}' AS variable, count({v}) AS n FROM g GROUP BY cnt" for v in ("item2", "escs2", "gender", "pv1a")) + "), cov AS (SELECT variable, count(CASE WHEN n > 0 THEN 1 END) AS n_with, count(*) AS n_economies, coalesce(string_agg(CASE WHEN n > 0 THEN cnt END, ' ' ORDER BY cnt), '') AS with_data, coalesce(string_agg(CASE WHEN n = 0 THEN cnt END, ' ' ORDER BY cnt), '') AS missing FROM u GROUP BY variable)"


def _coverage(spark, d):
    df = survey(spark, d).withColumn("item2", F.when(~F.col("cnt").isin("NATION_5", "NATION_6"), F.col("item"))).withColumn("escs2", F.when(F.substring("cnt", 8, 1) != "1", F.col("escs")))
    return cat.coverage_table(df, "cnt", ["item2", "escs2", "gender", "pv1a"])


@query("coverage_table", f"{_COV} SELECT * FROM cov")
def coverage_table(spark, d):
    return _coverage(spark, d)


@query("coverage_check", f"{_COV} SELECT variable, n_economies - n_with > 8 AS partial, CASE WHEN list_contains(string_split(missing, ' '), 'NATION_5') THEN 'NATION_5' ELSE '' END AS named_missing, list_contains(string_split(missing, ' '), 'NATION_5') AS blocked FROM cov")
def coverage_check(spark, d):
    c = _coverage(spark, d)
    return cat.coverage_check(c.select("variable"), c, ["NATION_5"])


@query("no_school_link", f"WITH {sql_f()} SELECT DISTINCT cnt FROM f WHERE cnt = 'NATION_3'")
def no_school_link(spark, d):
    return cat.no_school_link(survey(spark, d).withColumn("sch", F.when(F.col("cnt") != "NATION_3", F.col("sch"))), "cnt", "sch")


_MODES = (
    f"{sql_f()}, k AS (SELECT cycle, cnt, CASE WHEN cnt = 'NATION_3' OR (cnt = 'NATION_4' AND cycle = 'c1') THEN 1 WHEN cnt = 'NATION_4' THEN 2 ELSE adm END AS adm, count(*) AS n FROM f GROUP BY ALL), "
    "c AS (SELECT cycle, cnt, CASE WHEN CAST(max(n) AS DOUBLE) / sum(n) >= 0.9 THEN CASE arg_max(adm, n * 10 - adm) WHEN 1 THEN 'paper' ELSE 'computer' END ELSE 'mixed' END AS mode FROM k GROUP BY cycle, cnt)"
)


def _modes(spark, d):
    four = F.col("cnt") == "NATION_4"
    paper = (F.col("cnt") == "NATION_3") | (four & (F.col("cycle") == "c1"))
    df = survey(spark, d).withColumn("adm", F.when(paper, 1).when(four, 2).otherwise(F.col("adm")))
    return cat.mode_by_economy(df, "cnt", "adm", {1: "paper", 2: "computer"})


@query("mode_by_economy", f"WITH {_MODES} SELECT * FROM c")
def mode_by_economy(spark, d):
    return _modes(spark, d)


@query(
    "mode_labels_by_cycle",
    f"WITH {_MODES} SELECT cycle, cnt, CASE WHEN cycle = 'c1' AND mode = 'paper' THEN 'computer' WHEN cycle = 'c1' AND mode = 'computer' THEN 'paper' ELSE mode END AS mode FROM c",
)
def mode_labels_by_cycle(spark, d):
    """In the first cycle the codes mean the other way round."""
    four = F.col("cnt") == "NATION_4"
    paper = (F.col("cnt") == "NATION_3") | (four & (F.col("cycle") == "c1"))
    df = survey(spark, d).withColumn("adm", F.when(paper, 1).when(four, 2).otherwise(F.col("adm")))
    usual = {1: "paper", 2: "computer"}
    return cat.mode_by_economy(df, "cnt", "adm", {"c1": {2: "paper", 1: "computer"}, "c2": usual, "c3": usual})


@query("mode_changes", f"WITH {_MODES} SELECT a.cnt, a.mode AS mode_first, b.mode AS mode_last FROM c a JOIN c b ON a.cnt = b.cnt WHERE a.cycle = 'c1' AND b.cycle = 'c3' AND a.mode <> b.mode")
def mode_changes(spark, d):
    return cat.mode_changes(_modes(spark, d), "cnt", "c1", "c3")


@query("catalog_variables", f"WITH k AS ({_CATD}) SELECT DISTINCT table_name, cycle, variable, first_value(var_type) OVER w AS var_type, first_value(label) OVER w AS label FROM k WINDOW w AS (PARTITION BY table_name, cycle, variable ORDER BY label, var_type)")
def catalog_variables(spark, d):
    k = _catalog(spark, d)
    one = k.groupBy("table_name", "cycle", "variable").agg(F.min(F.struct("label", "var_type", "value_labels")).alias("x"))
    maps = lambda c: F.map_from_entries(F.collect_list(F.struct("variable", c))).alias
    tables = one.groupBy("table_name", "cycle").agg(maps("x.var_type")("types"), maps("x.label")("labels"), maps("x.value_labels")("value_labels"))
    return cat.catalog_variables(tables).select("table_name", "cycle", "variable", "var_type", "label")


@query("comparability", f"WITH k AS ({_CATD}) SELECT table_name, variable, bool_or(cycle = 'c1') AS in_c1, bool_or(cycle = 'c2') AS in_c2, bool_or(cycle = 'c3') AS in_c3, count(DISTINCT cycle) AS n_cycles, count(DISTINCT lower(trim(label))) > 1 AS label_changed FROM k WHERE table_name IN (SELECT table_name FROM k GROUP BY table_name HAVING count(DISTINCT cycle) > 1) GROUP BY table_name, variable")
def comparability(spark, d):
    return cat.comparability(_catalog(spark, d), ["c1", "c2", "c3"])


@query("describe_variable", f"WITH k AS ({_CATD}) SELECT * FROM k WHERE variable = 'PV5MATH' AND cycle = 'c2'")
def describe_variable(spark, d):
    return cat.describe_variable(_catalog(spark, d), "pv5math", "c2")


@query("collapse_family", f"WITH k AS ({_CATD}) SELECT CASE WHEN variable LIKE 'PV%' THEN 'PV1-10MATH' WHEN variable LIKE 'W_%' AND variable NOT LIKE 'ST%' THEN 'W_FSTURWT1-80' ELSE variable END AS family, count(*) AS n FROM k GROUP BY 1")
def collapse_family(spark, d):
    return _catalog(spark, d).groupBy(text.collapse_family(F.col("variable")).alias("family")).agg(F.count("*").alias("n"))


def _score_sql(words):
    name = "lower(variable)"
    label = "(lower(label) || CASE WHEN regexp_matches(variable, '^PV[0-9]+') THEN ' score plausible value pv' WHEN variable LIKE 'W\\_FST%' ESCAPE '\\' THEN ' weight' ELSE '' END)"
    phrase = "".join(words.lower().split()).replace("-", "")
    parts = [f"CASE WHEN contains(regexp_replace({label}, '[^a-z0-9]', '', 'g'), '{phrase}') THEN 25 ELSE 0 END"]
    for t in words.lower().split():
        tests = [(f"{name} = '{t}'", 100), (f"contains({name}, '{t}')", 30), (f"regexp_matches({label}, '\\b{t}\\b')", 8), (f"contains({label}, '{t}')", 3)]
        if len(t) >= 6:
            tests += [(f"regexp_matches({label}, '\\b{t[:4]}')", 4), (f"starts_with({name}, '{t[:4]}')", 30)]
        parts += [f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in tests]
    return " + ".join(parts)


@query("catalog_search", f"WITH k AS ({_CATD}), b AS (SELECT variable, CAST(max({_score_sql('widget st1')}) AS INTEGER) AS score FROM k GROUP BY variable ORDER BY score DESC, variable LIMIT 20) SELECT k.*, score FROM k JOIN b ON k.variable = b.variable WHERE score > 0")
def catalog_search(spark, d):
    return cat.search(_catalog(spark, d), "widget st1")


_TERMS = ["widget", "blue ring", "economy"]
_RET = " UNION ALL ".join(f"SELECT variable, {w} * ({_score_sql(t)}) AS s, '{t}' AS term FROM k" for t, w in zip(_TERMS, ("1.0", "0.5", "0.3"), strict=True))
_RETQ = f"SELECT variable, count(DISTINCT term) AS terms_hit, round(CAST(max(s) AS DOUBLE) * (1 + 0.1 * (count(DISTINCT term) - 1)), 6) AS score FROM ({_RET}) WHERE s > 0 GROUP BY variable"


@query("catalog_retrieve", f"WITH k AS ({_CATD}) SELECT variable, terms_hit, CAST(score AS DOUBLE) AS score FROM ({_RETQ}) ORDER BY score DESC, variable LIMIT 40")
def catalog_retrieve(spark, d):
    return cat.retrieve(_catalog(spark, d), _TERMS)


_FAM = "CASE WHEN variable LIKE 'PV%' THEN 'PV1-10MATH' WHEN variable LIKE 'W_FST%' THEN 'W_FSTURWT1-80' ELSE variable END"


@query(
    "catalog_explore",
    f"WITH k AS ({_CATD}), t AS ({_RETQ} ORDER BY score DESC, variable LIMIT 400), b AS (SELECT DISTINCT variable, TRUE AS verified, NULL::DOUBLE AS score FROM k WHERE regexp_matches(variable, '^PV') UNION ALL SELECT variable, FALSE, CAST(score AS DOUBLE) FROM t WHERE score >= 4.5 AND NOT regexp_matches(variable, '^PV')) "
    f"SELECT {_FAM} AS family, bool_or(verified) AS verified, max(score) AS score, count(*) AS n_variables FROM b GROUP BY 1 ORDER BY verified DESC, score DESC NULLS LAST, family LIMIT 40",
)
def catalog_explore(spark, d):
    return cat.explore(_catalog(spark, d), spark.sql("SELECT 'scores' AS topic, '^PV' AS pattern"), "scores", _TERMS)


_CCOV = "SELECT variable, count(DISTINCT table_name) AS n, string_agg(DISTINCT table_name, ' ' ORDER BY table_name) AS with_data FROM k GROUP BY variable"


@query("coverage_alternatives", f"WITH k AS ({_CATD}), r AS ({_RETQ} ORDER BY score DESC, variable LIMIT 40), o AS (SELECT r.variable, r.score FROM r WHERE EXISTS (SELECT 1 FROM k WHERE k.variable = r.variable AND table_name = 'Brand#7')) SELECT CAST(row_number() OVER (ORDER BY score DESC, variable) AS INTEGER) AS rank, variable, CAST(score AS DOUBLE) AS score FROM o")
def coverage_alternatives(spark, d):
    k = _catalog(spark, d)
    cov = k.groupBy("variable").agg(F.array_join(F.sort_array(F.collect_set("table_name")), " ").alias("with_data"))
    return cat.alternatives(cat.retrieve(k, _TERMS), cov, ["Brand#7"])


# -- text ------------------------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(r_name) || ' ' || c_mktsegment ELSE 'the ' || r_name || ' area' END AS name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"


@query("region_lookup", f"WITH n AS ({_V(_NAMES, 'customer', 'nation', 'region')}) SELECT name, r_name AS region FROM n LEFT JOIN region ON contains(lower(replace(name, ' ', '')), lower(replace(r_name, ' ', '')))")
def region_lookup(spark, d):
    aliases = table(spark, d, "region").select(F.col("r_name").alias("alias"), F.col("r_name").alias("region"))
    return text.region_lookup(_sql(spark, d, _NAMES, "customer", "nation", "region"), aliases)


_ALIASES = "SELECT * FROM (VALUES ('EN', 'the and'), ('EN', 'of the'), ('DE', 'der'), ('DIE', 'und die'), ('LA', 'y la'), ('FR', 'les'), ('FR', 'et les')) AS t(code, alias)"
_NOTS = "SELECT * FROM (VALUES ('FR', 'de les'), ('DE', 'in der'), ('EN', 'and of the')) AS t(code, alias)"


@query(
    "tag_entities",
    f"WITH al AS ({_ALIASES}), ng AS ({_NOTS}), d AS (SELECT doc_id AS id, ' ' || regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' +', ' ', 'g') || ' ' AS low, ' ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', ' ', 'g') || ' ' AS caps FROM documents), "
    "c AS (SELECT DISTINCT code FROM al), h AS (SELECT id, al.code, bool_or(contains(low, ' ' || alias || ' ') AND NOT EXISTS (SELECT 1 FROM ng WHERE ng.code = al.code AND contains(ng.alias, al.alias))) AS name, "
    "bool_or(contains(low, ' ' || alias || ' ')) AS any_name, bool_or(contains(caps, ' ' || al.code || ' ')) AS code_hit FROM d, al GROUP BY id, al.code), "
    "n AS (SELECT id, ng.code, bool_or(contains(low, ' ' || alias || ' ')) AS wrong FROM d, ng GROUP BY id, ng.code) "
    "SELECT h.id, h.code FROM h LEFT JOIN n ON h.id = n.id AND h.code = n.code WHERE code_hit OR name OR (any_name AND NOT coalesce(wrong, FALSE))",
)
def tag_entities(spark, d):
    return text.tag_entities(table(spark, d, "documents"), "doc_id", "text", spark.sql(_ALIASES), spark.sql(_NOTS))


_TOKEN = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_.,]+')"


@query(
    "ungrounded_numbers",
    f"WITH t AS (SELECT doc_id AS id, unnest({_TOKEN}) AS token FROM documents), m AS (SELECT DISTINCT id, regexp_extract(token, '^([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?)(?:$|[.,]$|[.,][^0-9]|,[0-9]{{1,2}}(?:$|[^0-9]))', 1) AS number, token FROM t), "
    "n AS (SELECT DISTINCT id, number FROM m WHERE number <> ''), "
    "v AS (SELECT id, number, CAST(replace(number, ',', '') AS DOUBLE) AS value, least(CASE WHEN contains(number, '.') THEN length(split_part(number, '.', 2)) ELSE 0 END, 12) AS digits FROM n) "
    "SELECT id, number FROM v WHERE NOT (regexp_full_match(number, '(19|20)[0-9][0-9]') OR (digits = 0 AND value <= 12)) AND NOT EXISTS (SELECT 1 FROM documents d WHERE abs(d.n_chars - value) <= 0.5 * pow(10, -digits) + 1e-9)",
)
def ungrounded_numbers(spark, d):
    docs = table(spark, d, "documents")
    return text.ungrounded_numbers(docs, "doc_id", "text", docs.select(F.col("n_chars").alias("value")))


@query("number_format", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no estimate' WHEN o_orderkey % 2 = 0 THEN printf('%.1f', CAST(o_custkey + 10 AS DOUBLE)) ELSE printf('%.2f', CAST(o_custkey % 8 AS DOUBLE) / 4) END AS shown FROM orders")
def number_format(spark, d):
    value = F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 10.0).otherwise((F.col("o_custkey") % 8) / 4))
    return table(spark, d, "orders").select("o_orderkey", text.number_text(value).alias("shown"))


# -- events ----------------------------------------------------------------------------------------


#: The log of a question service, derived from the events; lists are comma-joined here.
_LOG = """SELECT event_id, ts, user_id AS session, CASE WHEN event_id % 13 = 0 THEN 'rate_limited' ELSE 'ask' END AS kind,
 'inst' || CAST(user_id % 7 AS STRING) AS institution, event_type, value AS total_ms, event_id % 6 AS calls, 'q' || CAST(user_id AS STRING) AS question,
 CASE event_id % 9 WHEN 0 THEN 'clarify' WHEN 1 THEN 'error' WHEN 2 THEN 'conversational' ELSE 'data' END AS route,
 CASE WHEN event_id % 31 = 0 THEN 'timeout' END AS error,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'bar' ELSE 'line' END AS chart,
 CASE event_id % 11 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS vote, event_id % 3 = 0 AS mobile,
 CASE event_id % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'gap' WHEN 2 THEN 'raw_sql' ELSE 'trend' END AS template,
 CASE WHEN event_id % 2 = 0 THEN 'c1' ELSE 'c1 + c3' END AS cycles,
 'N' || CAST(event_id % 25 AS STRING) || ',N' || CAST(user_id % 10 AS STRING) AS countries,
 'V' || CAST(event_id % 40 AS STRING) || ',W' || CAST(user_id % 30 AS STRING) AS variables,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE 'g' || CAST(event_id % 4 AS STRING) || ',h' || CAST(event_id % 5 AS STRING) END AS guards,
 CASE WHEN event_id % 8 = 0 THEN 'app' ELSE 'llm' END AS summary_mode, 'b' || CAST(event_id % 3 AS STRING) AS build,
 CASE WHEN event_id % 17 = 0 THEN 'wrong number' ELSE '' END AS prose_issues,
 CASE event_id % 3 WHEN 0 THEN translate('CNT IN (~DEU~, ~FRA~)', '~', chr(39)) WHEN 1 THEN translate('ESCS > 0 AND CNT = ~FIN~', '~', chr(39)) END AS filter,
 CASE WHEN event_id % 2 = 0 THEN 'CNT,GENDER' ELSE 'GENDER' END AS groups, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 50 AS INT) END AS rows,
 CASE WHEN event_id % 6 = 0 THEN 'other' ELSE '' END AS substitution, CASE WHEN event_id % 8 = 0 THEN 'few' END AS limitation,
 CASE WHEN event_id % 4 = 0 THEN 'OECD' ELSE '' END AS benchmarks,
 'mean ' || CAST(100 + event_id % 7 AS STRING) || '.5 of ' || CAST(event_id % 3 * 60 AS STRING) || ' in 2022' AS answer FROM {events}"""
_LISTS = ("countries", "variables", "guards", "prose_issues", "groups", "benchmarks")


def _log(spark, d):
    rows = _sql(spark, d, _LOG, "events")
    return rows.withColumns({c: F.array_remove(F.split(c, ","), "") for c in _LISTS})


_LOGD = f"l AS ({_V(_LOG, 'events')}), a AS (SELECT * FROM l WHERE kind = 'ask')"


@query("latest_state", "WITH s AS (SELECT user_id, min((ts, event_id)) AS start FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY user_id), e AS (SELECT e.*, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events e JOIN s ON e.user_id = s.user_id WHERE (ts, event_id) >= start) SELECT user_id, arg_max(kind, (ts, event_id)) FILTER (WHERE kind IS NOT NULL) AS kind, round(arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL), 6) AS value FROM e GROUP BY user_id ORDER BY max((ts, event_id)) DESC LIMIT 5000")
def latest_state(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return rounded(ev.latest_state(e, "user_id", ["ts", "event_id"], ["kind", "value"], F.col("ts") >= F.lit("2024-01-03").cast("timestamp")))


@query("top_counts", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 20")
def top_counts(spark, d):
    return ev.top_counts(table(spark, d, "documents"), F.split("text", " "), array=True)


_PC = "round(100.0 * count(CASE WHEN {t} THEN 1 END) / nullif(count(CASE WHEN {o} THEN 1 END), 0))"
_DRAWN = "kind = 'ask' AND chart IS NOT NULL"


def _pc(test: str, of: str = "kind = 'ask'") -> str:
    return _PC.replace("{t}", f"{of} AND ({test})").replace("{o}", of)


@query(
    "usage_kpis",
    f"WITH {_LOGD} SELECT count(CASE WHEN kind = 'ask' THEN 1 END) AS asks, count(DISTINCT CASE WHEN kind = 'ask' THEN session END) AS sessions, "
    f"count(DISTINCT CASE WHEN kind = 'ask' THEN institution END) AS institutions, {_pc(chr(114) + 'oute = ' + chr(39) + 'data' + chr(39))} AS data_percent, "
    f"{_pc('route = ' + chr(39) + 'error' + chr(39) + ' OR error IS NOT NULL')} AS error_percent, {_pc('chart <> ' + chr(39) + 'none' + chr(39), _DRAWN)} AS charted_percent, "
    "count(CASE WHEN kind = 'ask' AND vote = 'up' THEN 1 END) AS votes_up, count(CASE WHEN kind = 'ask' AND vote = 'down' THEN 1 END) AS votes_down, "
    f"{_pc('mobile', _DRAWN)} AS mobile_percent, count(CASE WHEN kind = 'rate_limited' THEN 1 END) AS rate_limited FROM l",
)
def usage_kpis(spark, d):
    return ev.usage_kpis(_log(spark, d))


_AT = "max(CASE WHEN i = least(floor({q} * n), n - 1) THEN {c} END)"


def _ranked(column: str) -> str:
    return f"SELECT institution, {column}, row_number() OVER (PARTITION BY institution ORDER BY {column}) - 1 AS i, count(*) OVER (PARTITION BY institution) AS n FROM a WHERE {column} IS NOT NULL"


@query(
    "usage_latency",
    f"WITH {_LOGD}, t AS ({_ranked('total_ms')}), k AS ({_ranked('calls')}), x AS (SELECT institution, {_AT.format(q='0.5', c='total_ms')} AS p50, {_AT.format(q='0.95', c='total_ms')} AS p95 FROM t GROUP BY institution), "
    f"y AS (SELECT institution, {_AT.format(q='0.5', c='calls')} AS median_calls FROM k GROUP BY institution) SELECT x.institution, p50, p95, median_calls FROM x LEFT JOIN y ON x.institution = y.institution",
)
def usage_latency(spark, d):
    return ev.usage_latency(_log(spark, d).where("kind = 'ask'"), ["institution"])


@query("usage_per_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS asks FROM events GROUP BY 1 ORDER BY 1")
def usage_per_day(spark, d):
    return ev.usage_per_day(table(spark, d, "events"))


def _breakdown(name: str, column: str, is_list: bool, data: bool, most: int) -> str:
    value = f"unnest(string_split({column}, ','))" if is_list else column
    rows = f"SELECT {value} AS value FROM a" + (" WHERE route = 'data'" if data else "")
    return f"(SELECT '{name}' AS breakdown, value, count(*) AS n FROM ({rows}) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT {most})"


@query("usage_breakdowns", f"WITH {_LOGD} " + " UNION ALL ".join(f"SELECT * FROM {_breakdown(*b)}" for b in ev.BREAKDOWNS))
def usage_breakdowns(spark, d):
    return ev.usage_breakdowns(_log(spark, d))


@query("guard_downvotes", f"WITH {_LOGD}, g AS (SELECT vote = 'down' AS down, unnest(string_split(guards, ',')) AS guard FROM a) SELECT guard, count(*) AS n, count(CASE WHEN down THEN 1 END) AS n_down FROM g WHERE guard <> '' GROUP BY guard")
def guard_downvotes(spark, d):
    return ev.guard_downvotes(_log(spark, d).where("kind = 'ask'"), F.col("guards"), F.col("vote") == "down")


_QUEUES = {"rejected": "route = 'data' AND prose_issues <> ''", "down": "vote = 'down'", "error": "route = 'error' OR error IS NOT NULL", "clarify": "route = 'clarify'"}


@query("review_queues", f"WITH {_LOGD} " + " UNION ALL ".join(f"SELECT '{q}' AS queue, event_id, ts FROM a WHERE {t}" for q, t in _QUEUES.items()) + " UNION ALL SELECT * FROM (SELECT 'recent', event_id, ts FROM a ORDER BY ts DESC, event_id DESC LIMIT 200)")
def review_queues(spark, d):
    return ev.review_queues(_log(spark, d))


@query(
    "event_facts",
    f"WITH {_LOGD}, f AS (SELECT *, list_sort(list_distinct(regexp_extract_all(coalesce(filter, ''), chr(39) || '([A-Z]{{3}})' || chr(39), 1))) AS c FROM a) "
    "SELECT event_id, template, array_to_string(c, ' ') AS countries, contains(groups, 'CNT') AND len(c) = 0 AS all_countries, coalesce(rows, 0) AS rows, template = 'raw_sql' AS raw_sql, "
    "coalesce(substitution <> '', FALSE) AS substitution, coalesce(limitation <> '', FALSE) AS limitation, benchmarks <> '' AS has_benchmarks FROM f",
)
def event_facts(spark, d):
    return ev.event_facts(_log(spark, d).where("kind = 'ask'"))


@query("scan_event_export", f"WITH {_LOGD} SELECT event_id, route, len(string_split(countries, ',')) AS n_countries, string_split(variables, ',')[1] AS variable FROM a")
def scan_event_export(spark, d):
    path = work_path(spark, "export")
    _sql(spark, d, _LOG, "events").select("event_id", "kind", "route", F.replace("countries", F.lit(","), F.lit("|")).alias("countries"), F.replace("variables", F.lit(","), F.lit("||")).alias("variables")).write.option("header", True).csv(path)
    rows = ingest.scan_event_export(spark, path, ["countries", "variables"])
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "route", F.size("countries").cast("long").alias("n_countries"), F.get("variables", 0).alias("variable"))


@query("append_events", f"WITH {_LOGD} SELECT event_id, route, CASE WHEN vote = 'down' THEN 'down' END AS vote FROM a")
def append_events(spark, d):
    path, asks = work_path(spark, "log"), _log(spark, d).where("kind = 'ask'")
    ingest.append_events(asks.select(F.col("event_id").alias("id"), F.lit(1).alias("seq"), "route"), path)
    ingest.append_events(asks.where("vote = 'down'").select(F.col("event_id").alias("id"), F.lit(2).alias("seq"), "vote"), path)
    rows = spark.read.schema("id bigint, seq int, route string, vote string").json(path)
    return ev.latest_state(rows, "id", ["seq"], ["route", "vote"], limit=1 << 30).select(F.col("id").alias("event_id"), "route", "vote")


# -- reconciliation --------------------------------------------------------------------------------

_PUB = "CASE WHEN cnt = 'NATION_4' THEN round(estimate, 2) + 1 ELSE round(estimate, 2) END"
_RES = f"{sql_f()}, {sql_rep(CNT, pv())}, {sql_comb(CNT)}"


@query("reconcile_means", f"WITH {_RES}, p AS (SELECT cnt, {_PUB} AS published FROM c), m AS (SELECT * FROM c WHERE cnt <> 'NATION_8') SELECT p.cnt, published, round(estimate, 6) AS estimate, round(abs(published - estimate), 6) AS difference, CASE WHEN estimate IS NULL THEN 'missing' WHEN abs(published - estimate) <= 0.05 THEN 'ok' ELSE 'fail' END AS status FROM p LEFT JOIN m ON p.cnt = m.cnt")
def reconcile_means(spark, d):
    res = stats.weighted_mean(survey(spark, d), DESIGN, pva(), CNT).select("cnt", "estimate")
    return rounded(quality.reconcile_means(res.select("cnt", F.expr(_PUB).alias("published")), res.where("cnt <> 'NATION_8'"), CNT))


@query("reconcile_se", f"WITH {_RES}, z AS (SELECT cnt, sum(w0) AS pop FROM f GROUP BY cnt) SELECT c.cnt, CASE WHEN c.cnt = 'NATION_8' THEN 'missing' WHEN c.cnt = 'NATION_2' THEN 'noted' WHEN c.cnt IN ('NATION_4', 'NATION_5', 'NATION_6') THEN 'fail' ELSE 'ok' END AS status FROM c")
def reconcile_se(spark, d):
    df = survey(spark, d)
    res = stats.weighted_mean(df, DESIGN, pva(), CNT).select("cnt", "n", "se").join(df.groupBy("cnt").agg(F.sum("w0").alias("pop")), "cnt")
    at = lambda c, x, y: F.when(F.col("cnt") == c, x).otherwise(y)
    pub = res.select("cnt", at("NATION_4", F.col("n") + 2, F.col("n")).alias("p_n"), at("NATION_5", F.col("pop") * 1.01, F.col("pop")).alias("p_pop"), F.when(F.col("cnt") != "NATION_2", at("NATION_6", F.col("se") + 1, F.round("se", 2))).alias("p_se"))
    return quality.reconcile_se(pub, res.where("cnt <> 'NATION_8'"), CNT)


@query("result_drift", f"WITH {_RES}, g AS (SELECT cnt, CASE WHEN cnt = 'NATION_4' THEN estimate + 1 WHEN cnt = 'NATION_5' THEN NULL ELSE estimate END AS golden FROM c WHERE cnt <> 'NATION_1'), n AS (SELECT cnt, estimate AS current FROM c WHERE cnt <> 'NATION_2') SELECT coalesce(g.cnt, n.cnt) AS cnt, round(golden, 6) AS golden, round(current, 6) AS current, CASE WHEN g.cnt IS NULL THEN 'new' WHEN n.cnt IS NULL THEN 'gone' WHEN abs(golden - current) <= 0.02 THEN 'same' ELSE 'moved' END AS status FROM g FULL JOIN n ON g.cnt = n.cnt")
def result_drift(spark, d):
    res = stats.weighted_mean(survey(spark, d), DESIGN, pva(), CNT).select("cnt", "estimate")
    golden = res.where("cnt <> 'NATION_1'").withColumn("estimate", F.when(F.col("cnt") == "NATION_4", F.col("estimate") + 1).when(F.col("cnt") != "NATION_5", F.col("estimate")))
    return rounded(quality.result_drift(golden, res.where("cnt <> 'NATION_2'"), CNT))


_RUN = "SELECT question, arg_max(event_id, (ts, event_id)) AS e FROM a WHERE {w} GROUP BY question"
_ONE = "SELECT a.*, [100.5 + event_id % 7] || CASE WHEN event_id % 3 * 60 >= 100 THEN [event_id % 3 * 60.0] ELSE [] END || [2022.0] AS nums FROM a JOIN ({r}) r ON a.event_id = r.e"
_SPLIT = "ts < TIMESTAMP '2024-01-15'"


@query(
    "answer_drift",
    f"WITH {_LOGD}, o AS ({_ONE.replace('{r}', _RUN.replace('{w}', _SPLIT))}), n AS ({_ONE.replace('{r}', _RUN.replace('{w}', 'NOT ' + _SPLIT))}), "
    "x AS (SELECT o.question, o.route IS NOT DISTINCT FROM n.route AS same_route, o.template IS NOT DISTINCT FROM n.template AS same_template, string_split(o.variables, ',') AS v, string_split(n.variables, ',') AS w, "
    "len(list_filter(o.nums, lambda z: NOT list_contains(n.nums, z))) AS n_numbers_lost, CASE WHEN n.error IS NOT NULL THEN 'fails now' WHEN o.error IS NOT NULL THEN 'fixed' END AS error FROM o JOIN n ON o.question = n.question) "
    "SELECT question, same_route, same_template, array_to_string(list_sort(list_filter(v, lambda z: NOT list_contains(w, z))), ' ') AS variables_gone, array_to_string(list_sort(list_filter(w, lambda z: NOT list_contains(v, z))), ' ') AS variables_new, CAST(n_numbers_lost AS INTEGER) AS n_numbers_lost, error FROM x",
)
def answer_drift(spark, d):
    log, old = _log(spark, d).where("kind = 'ask'"), F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return quality.answer_drift(log.where(old), log.where(~old))

