"""Variable catalog, coverage, comparability and keyword search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_family, compact
from ..plans.design import SurveyDesign


#: Columns whose presence one long holds.
BITS = 63


def coverage_table(df: DataFrame, economy: str, columns: Sequence[str]) -> DataFrame:
    """Per variable: economies with at least a value, and the codes with and without one.

    A row's presences are packed into longs, 63 columns each, and merged by bitwise or in the tasks, so
    that any number of columns takes one scan and a row an economy is shuffled.
    """
    bits = [F.shiftleft(F.col(c).isNotNull().cast("long"), k % BITS) for k, c in enumerate(columns)]
    words = [reduce(lambda a, b: a.bitwiseOR(b), bits[k : k + BITS]) for k in range(0, len(bits), BITS)]
    packed = df.groupBy(economy).agg(*[F.bit_or(w).alias(f"_w{j}") for j, w in enumerate(words)])
    names, all_words = F.array(*[F.lit(c) for c in columns]), F.array(*[f"_w{j}" for j in range(len(words))])
    long = packed.select(economy, all_words.alias("_w"), F.posexplode(names).alias("_k", "variable"))
    has = F.expr(f"shiftright(_w[_k DIV {BITS}], CAST(_k % {BITS} AS INT)) & 1 = 1")
    codes = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col(economy)))), " ")
    return long.groupBy("variable").agg(F.count_if(has).alias("n_with"), F.count("*").alias("n_economies"), codes(has).alias("with_data"), codes(~has).alias("missing"))


def coverage_check(plan: DataFrame, coverage: DataFrame, named: Sequence[str], noise: int = 8) -> DataFrame:
    """Per plan variable: whether it is partial (fewer economies by more than ``noise``), named ones missing, and blocked."""
    out = plan.join(coverage, "variable", "left")
    gone = F.array_intersect(F.split(F.coalesce("missing", F.lit("")), " "), F.array(*[F.lit(n) for n in named]))
    partial = (F.col("n_economies") - F.col("n_with")) > noise
    return out.select("variable", F.coalesce(partial, F.lit(False)).alias("partial"), F.array_join(F.sort_array(gone), " ").alias("named_missing"), (F.size(gone) == len(named)).alias("blocked"))


def no_school_link(df: DataFrame, economy: str, school: str) -> DataFrame:
    return df.groupBy(economy).agg(F.count(school).alias("_n")).where("_n = 0").select(economy)


def mode_by_economy(df: DataFrame, economy: str, code: str, labels: dict, least: float = 0.9) -> DataFrame:
    """Majority mode of administration: its label at ``least`` or more of the rows, else mixed; of equal codes the smaller counts.

    ``labels`` maps codes to labels, or cycles to such maps where a code means another mode in another cycle.
    A code without a label gives NULL.
    """
    counts = df.where(F.col(code).isNotNull()).groupBy("cycle", economy, code).agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.col(code)).alias("_c")))["_c"]
    g = counts.groupBy("cycle", economy).agg((-top).alias("top"), (F.max("n") / F.sum("n")).alias("part"))
    by_cycle = labels if labels and all(isinstance(v, dict) for v in labels.values()) else {None: labels}
    name = F.lit(None).cast("string")
    for cycle, codes in by_cycle.items():
        for value, label in codes.items():
            here = F.col("top") == value
            name = F.when(here if cycle is None else here & (F.col("cycle") == cycle), label).otherwise(name)
    return g.select("cycle", economy, F.when(F.col("part") >= least, name).otherwise("mixed").alias("mode"))


def mode_changes(modes: DataFrame, economy: str, first: str, last: str) -> DataFrame:
    """Economies whose mode in the last cycle is not that of the first: (economy, mode_first, mode_last)."""
    one = lambda c: F.max(F.when(F.col("cycle") == c, F.col("mode")))
    wide = modes.groupBy(economy).agg(one(first).alias("mode_first"), one(last).alias("mode_last"))
    return wide.where("mode_first <> mode_last")


def sample_counts(df: DataFrame, design: SurveyDesign, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Students, schools, economies and the weighted population, overall or by group."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*by).agg(
        F.count("*").alias("students"), F.count_distinct(design.school).alias("schools"),
        F.count_distinct(design.economy).alias("economies"), F.sum(design.weight).alias("population"),
    )


def flag_members(df: DataFrame, economy: str, flag: Column) -> DataFrame:
    """Economies whose rows carry a flag."""
    return df.where(flag).select(economy).distinct()


def check_columns(tables: dict[str, DataFrame], wanted: Sequence[str], use: str) -> None:
    """Raise for columns that table ``use`` lacks, naming the tables that have them; names compare without case."""
    names = {t: {c.lower() for c in df.columns} for t, df in tables.items()}
    said = []
    for c in wanted:
        if c.lower() not in names[use]:
            where = sorted(t for t, have in names.items() if c.lower() in have)
            said.append(f"{c} is not in {use}" + (f" but in {', '.join(where)}" if where else " nor in any other table"))
    if said:
        raise ValueError("; ".join(said))


def cycles_with(cycles: dict[str, DataFrame], measures: dict[str, Sequence[str]]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """The cycles that have each measure's columns, and the (measure, cycle) pairs left out; no cycle at all raises."""
    have = {name: [c for c, df in cycles.items() if {x.lower() for x in cols} <= {x.lower() for x in df.columns}] for name, cols in measures.items()}
    left = [(name, c) for name, found in have.items() for c in cycles if c not in found]
    if not any(have.values()):
        raise ValueError(f"no cycle has the columns of {', '.join(measures)}")
    return have, left


def benchmark_keys(by: Sequence[str], economy: str, economies: Sequence[str], benchmarks: Sequence[str]) -> list[str]:
    """Group columns of a plan: several economies or a benchmark are never pooled, so the economy comes first."""
    pooled = economy not in by and (len(economies) != 1 or bool(benchmarks))
    return [economy, *by] if pooled else list(by)


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A catalog, coverage or comparability table; None where the file is missing, which switches its check off."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def catalog_variables(tables: DataFrame) -> DataFrame:
    """One row per (variable, table) from metadata rows with label and type maps."""
    each = tables.select("table_name", "cycle", "types", "labels", "value_labels", F.explode("types").alias("variable", "var_type"))
    values = F.col("value_labels")[F.col("variable")]
    return each.select("table_name", "cycle", "variable", "var_type", F.col("labels")[F.col("variable")].alias("label"), values.alias("value_labels"), F.coalesce(F.size(F.from_json(values, "map<string,string>")), F.lit(0)).alias("n_value_labels"))


def comparability(catalog: DataFrame, cycles: Sequence[str]) -> DataFrame:
    """Per (table, variable) of tables in two cycles or more: cycles that have it, and whether the label changes."""
    here = [F.max(F.when(F.col("cycle") == c, True).otherwise(False)).alias(f"in_{c}") for c in cycles]
    wide = catalog.groupBy("table_name", "variable").agg(*here, F.count_distinct("cycle").alias("n_cycles"), (F.count_distinct(F.lower(F.trim("label"))) > 1).alias("label_changed"))
    many = catalog.groupBy("table_name").agg(F.count_distinct("cycle").alias("_n")).where("_n > 1").select("table_name")
    return wide.join(many, "table_name", "left_semi")


def describe_variable(catalog: DataFrame, name: str, cycle: str | None = None) -> DataFrame:
    out = catalog.where(F.upper("variable") == name.upper())
    return out if cycle is None else out.where(F.col("cycle") == cycle)


#: Words that say nothing about a topic.
STOP_WORDS = (
    "the and for with how what which who are is of in on to by about data dataset variable variables well very much many any all from this "
    "that these those you your their own do does did have has at as or an a be being"
).split()
#: Words that name the respondent, not a topic.
ENTITY_WORDS = "teacher teachers student students school schools parent parents country countries".split()


def words_of(text: str) -> list[str]:
    """Words of a query that say something: two characters or more, no stop words."""
    return [t for t in re.split(r"\W+", text.lower()) if len(t) >= 2 and t not in STOP_WORDS]


#: Points of a catalog row for a word that is the name, a name that holds it, a whole word of the label, a label
#: that holds it, its first four letters at a word's start in the label and at the name's start, and the whole phrase.
POINTS = {"name": 100, "in_name": 30, "word": 8, "in_label": 3, "stem": 4, "name_stem": 30, "phrase": 25}
#: Letters of the pieces under which names and labels are listed for "holds".
GRAM = 3


def _pieces(text: Column) -> Column:
    """All runs of ``GRAM`` characters of a text, and its runs of two."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))
    return F.array_distinct(F.concat(F.coalesce(runs(GRAM), F.array().cast("array<string>")), F.coalesce(runs(2), F.array().cast("array<string>"))))


def search_index(catalog: DataFrame) -> DataFrame:
    """The inverted index of a catalog: (kind, key, variable, name, label, squeezed), a posting for each way to find a row.

    Kinds are ``word`` and ``stem`` of the label (whole words, and their first four letters), ``name_stem`` (the
    name's first four letters), ``piece`` and ``name_piece`` (runs of two and three characters of label and name) and
    ``phrase`` (such runs of the label without spaces and signs). Rows with equal names and labels are listed once.
    """
    name = F.lower("variable")
    extra = F.when(F.col("variable").rlike(r"^PV\d+"), " score plausible value pv").when(F.col("variable").rlike("^W_FST"), " weight").otherwise("")
    label = F.concat(F.lower(F.coalesce("label", F.lit(""))), extra)
    rows = catalog.select("variable", name.alias("name"), label.alias("label"), compact(label).alias("squeezed")).distinct()
    words = F.array_distinct(F.regexp_extract_all("label", F.lit(r"\w+"), F.lit(0)))
    long = F.filter(words, lambda w: F.length(w) >= 4)
    keys = {
        "word": words, "stem": F.array_distinct(F.transform(long, lambda w: F.substr(w, F.lit(1), F.lit(4)))), "name_stem": F.array(F.substring("name", 1, 4)),
        "piece": _pieces(F.col("label")), "name_piece": _pieces(F.col("name")), "phrase": _pieces(F.col("squeezed")),
    }
    listed = lambda kind, some: F.transform(some, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    each = F.explode(F.flatten(F.array(*[listed(kind, some) for kind, some in keys.items()])))
    return rows.select(each.alias("_p"), "*").select("_p.*", *rows.columns)


def _probes(text: str, entities: Sequence[str]) -> list[tuple[int, str, str, str, str]]:
    """(points, kind, key, test, part): which postings a phrase looks up, and the test that its rows must pass."""
    phrase, out = re.sub("[^a-z0-9]", "", text.lower()), []
    if len(phrase) >= 5:
        out.append((POINTS["phrase"], "phrase", phrase[:GRAM], "in_squeezed", phrase))
    for t in words_of(text):
        key = t[:GRAM]
        out += [(POINTS["name"], "name_piece", key, "is_name", t), (POINTS["in_name"], "name_piece", key, "in_name", t)]
        out += [(POINTS["word"], "word", t, "", t), (POINTS["in_label"], "piece", key, "in_label", t)]
        if len(t) >= 6:
            out.append((POINTS["stem"], "stem", t[:4], "", t[:4]))
            if t not in entities:
                out.append((POINTS["name_stem"], "name_stem", t[:4], "", t[:4]))
    return out


def scores(index: DataFrame, terms: Sequence[str], entities: Sequence[str] = ENTITY_WORDS) -> DataFrame:
    """(variable, term, score) of every row with points for a term, a row's best per variable; all terms in one lookup.

    The terms' keys are joined with the index; only rows that share a key are tested for the whole word.
    """
    probes = [(k, *p) for k, t in enumerate(terms) for p in dict.fromkeys(_probes(t, entities))]
    asked = index.sparkSession.createDataFrame(probes, "term int, points int, kind string, key string, test string, part string")
    hit = index.join(F.broadcast(asked), ["kind", "key"])  # a few rows for each word asked
    held = lambda c: F.contains(F.col(c), F.col("part"))
    ok = F.when(F.col("test") == "in_squeezed", held("squeezed")).when(F.col("test") == "is_name", F.col("name") == F.col("part"))
    ok = ok.when(F.col("test") == "in_name", held("name")).when(F.col("test") == "in_label", held("label")).otherwise(True)
    rows = hit.where(ok).groupBy("term", "variable", "name", "label").agg(F.sum("points").cast("int").alias("score"))
    return rows.groupBy("term", "variable").agg(F.max("score").alias("score"))


def search(catalog: DataFrame, text: str, n: int = 20, entities: Sequence[str] = ENTITY_WORDS, index: DataFrame | None = None) -> DataFrame:
    """All rows of the ``n`` best variables for a phrase, with the variable's best score; ``index`` may be a stored ``search_index``."""
    index = search_index(catalog) if index is None else index
    best = scores(index, [text], entities).orderBy(F.col("score").desc(), "variable").limit(n)
    return catalog.join(best.select("variable", "score"), "variable")


def retrieve(catalog: DataFrame, terms: Sequence[str], n: int = 40, entities: Sequence[str] = ENTITY_WORDS, index: DataFrame | None = None) -> DataFrame:
    """Variables for several terms: weighted best score, raised by 10 % for every further term that hits."""
    index = search_index(catalog) if index is None else index
    weights = F.element_at(F.array(*[F.lit(w) for w in ([1.0, 0.5] + [0.3] * max(0, len(terms) - 2))[: max(1, len(terms))]]), F.col("term") + 1)
    g = scores(index, terms, entities).groupBy("variable").agg(F.max(weights * F.col("score")).alias("best"), F.count_distinct("term").alias("terms_hit"))
    scored = g.select("variable", "terms_hit", F.round(F.col("best") * (1 + 0.1 * (F.col("terms_hit") - 1)), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "variable").limit(n)


def explore(
    catalog: DataFrame, topics: DataFrame, topic: str, terms: Sequence[str], n: int = 40, least: float = 4.5,
    cycles: Sequence[str] = (), tables: str | None = None, own: Sequence[str] = (), index: DataFrame | None = None,
) -> DataFrame:
    """Variables of a verified topic first, then related ones, a row per family.

    ``cycles`` keeps rows of those cycles and ``tables`` those of questionnaire tables (a pattern); a
    related variable must hold one of the ``own`` words of the question, if there are any, in its name or
    at a word's start in a label. The topic's patterns are a few, so the pattern join stays small. A stored
    ``index`` must be that of the rows kept.
    """
    rows = catalog.where(F.col("cycle").isin(*cycles)) if cycles else catalog
    rows = rows.where(F.col("table_name").rlike(tables)) if tables else rows
    rule = topics.where(F.col("topic") == topic).select("pattern")
    sure = rows.join(F.broadcast(rule), F.expr("variable RLIKE pattern"), "left_semi").select("variable").distinct()
    near = retrieve(rows, terms, 10 * n, index=index).where(F.col("score") >= least).join(sure, "variable", "left_anti")
    if own:
        test = reduce(lambda a, b: a | b, [F.lower("variable").contains(w.lower()) | F.col("label").rlike(rf"(?i)\b{re.escape(w)}") for w in own])
        near = near.join(rows.where(test).select("variable").distinct(), "variable", "left_semi")
    both = sure.select("variable", F.lit(True).alias("verified"), F.lit(None).cast("double").alias("score")).unionByName(near.select("variable", F.lit(False).alias("verified"), "score"))
    g = both.groupBy(collapse_family(F.col("variable")).alias("family")).agg(F.max("verified").alias("verified"), F.max("score").alias("score"), F.count("*").alias("n_variables"))
    return g.orderBy(F.col("verified").desc(), F.col("score").desc_nulls_last(), "family").limit(n)


def alternatives(found: DataFrame, coverage: DataFrame, named: Sequence[str]) -> DataFrame:
    """Retrieved variables that all named economies collected, best first. ``found`` is a list of ``retrieve``, which its ``n`` bounds."""
    have = F.array_intersect(F.split("with_data", " "), F.array(*[F.lit(x) for x in named]))
    left = found.join(coverage.where(F.size(have) == len(named)).select("variable"), "variable", "left_semi")
    ranked = left.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "variable"))).alias("_l"))
    return ranked.select(F.posexplode("_l").alias("_k", "_x")).select((F.col("_k") + 1).alias("rank"), "_x.variable", (-F.col("_x.s")).alias("score"))
