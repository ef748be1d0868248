"""Reading, checking and publishing source files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scan_instrument(spark: SparkSession, path: str, instrument: str, cycle: str) -> DataFrame:
    """A cycle's file as the temporary view ``<instrument>_<cycle>``."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(f"{instrument}_{cycle}")
    return df


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Files of one economy that were released apart; columns one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cast_schema(df: DataFrame, strings: Sequence[str] = (), timestamps: Sequence[str] = ()) -> DataFrame:
    """The fixed schema: named strings and timestamps, everything else double."""
    kind = lambda c: "string" if c in strings else "timestamp" if c in timestamps else "double"
    return df.select(*[F.col(c).cast(kind(c)).alias(c) for c in df.columns])


def validate_source(df: DataFrame, rows: int, keys: Sequence[str], economy: str, economies: int) -> DataFrame:
    """Tidy checks (check, ok, detail) from one aggregate: row count, economies, key columns."""
    got = df.agg(F.count("*").alias("n"), F.count_distinct(economy).alias("e"))
    gone = sorted(set(keys) - set(df.columns))
    checks = [("rows", F.col("n") == rows, F.col("n").cast("string")), ("economies", F.col("e") == economies, F.col("e").cast("string")), ("keys", F.lit(not gone), F.lit(" ".join(gone)))]
    return got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), ok.alias("ok"), d.alias("detail")) for k, ok, d in checks])).alias("x")).select("x.*")


def publish_parquet(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Write to a staging folder, verify the count, then rename; a mismatch deletes the staging and raises.

    The rows are counted as they are written (``Observation``), so nothing is read twice.
    """
    spark = df.sparkSession
    staging = f"{path}.{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(staging), hadoop.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    found = seen.get["rows"]
    if rows is not None and found != rows:
        fs.delete(source, True)
        raise ValueError(f"{path}: {found} rows, {rows} expected")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)
    return spark.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def scan_published(df: DataFrame, name: str, value: str, codes: DataFrame) -> DataFrame:
    """A published table as (code, published): footnote digits leave names, values are coerced, unknown names go."""
    clean = F.trim(F.regexp_replace(name, r"\s*\d+\)?$", ""))
    rows = df.select(clean.alias("name"), F.expr(f"try_cast({value} AS DOUBLE)").alias("published"))
    return rows.join(codes, "name").select("code", "published")


#: Plan nodes that pass rows on as they are; what they show is aggregated if their inputs are.
_PASSING = {"Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "Distinct", "Deduplicate", "Window", "Union", "Join", "Except", "Intersect", "View"}


def _aggregated(plan: object, ctes: dict[int, object]) -> bool:
    """Whether every row of a plan comes from an aggregate."""
    name = plan.nodeName()
    inputs = [plan.children().apply(i) for i in range(plan.children().size())]
    if name == "Aggregate":
        return True
    if name == "WithCTE":
        defs = [plan.cteDefs().apply(i) for i in range(plan.cteDefs().size())]
        return _aggregated(plan.plan(), ctes | {d.id(): d.child() for d in defs})
    if name == "CTERelationRef":
        return _aggregated(ctes[plan.cteId()], ctes)
    return name in _PASSING and bool(inputs) and all(_aggregated(x, ctes) for x in inputs)


def _listed(seq: object) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Lineage:
    """Which attributes of an analysed plan carry identifiers, by their expression ids, and whether a statement uses one.

    A column of a relation with an identifier's name carries one; so does every alias made from such a
    column, other than a count of it, through views, subqueries and common tables.
    """

    def __init__(self, identifiers: Sequence[str]):
        self.names = {i.lower() for i in identifiers}
        self.carry: dict[int, str] = {}
        self.used: set[str] = set()

    def _of(self, expression: object) -> set[str]:
        return {self.carry[a.exprId().id()] for a in _listed(expression.references().toSeq()) if a.exprId().id() in self.carry}

    def visit(self, plan: object, in_view: bool, ctes: dict[int, list]) -> None:
        name, inputs = plan.nodeName(), _listed(plan.children())
        if name == "WithCTE":
            for d in _listed(plan.cteDefs()):
                self.visit(d.child(), in_view, ctes)
                ctes = ctes | {d.id(): _listed(d.child().output())}
            self.visit(plan.plan(), in_view, ctes)
            return
        for x in [*inputs, *_listed(plan.subqueries())]:
            self.visit(x, in_view or name == "View", ctes)
        output, expressions = _listed(plan.output()), _listed(plan.expressions())
        if name == "CTERelationRef":
            self._same(output, ctes[plan.cteId()])
        elif not inputs:
            self.carry.update({a.exprId().id(): a.name() for a in output if a.name().lower() in self.names})
        elif name == "Union":
            for x in inputs:
                self._same(output, _listed(x.output()))
        else:
            before = {a.exprId().id() for x in inputs for a in _listed(x.output())}
            for e in expressions:
                if met := self._of(e):
                    if not in_view:
                        self.used |= met
                    made = [e] if hasattr(e, "exprId") and self._named(e) else [a for a in output if a.exprId().id() not in before]
                    for a in made:
                        if a.exprId().id() not in before and not re.match(r"count\(", e.toString()):
                            self.carry[a.exprId().id()] = min(met)

    @staticmethod
    def _named(expression: object) -> bool:
        return expression.getClass().getSimpleName() in ("Alias", "AttributeReference")

    def _same(self, output: list, source: list) -> None:
        for a, b in zip(output, source, strict=False):
            if b.exprId().id() in self.carry:
                self.carry[a.exprId().id()] = self.carry[b.exprId().id()]


def safe_sql(spark: SparkSession, sql: str, identifiers: Sequence[str], most: int = 500) -> DataFrame:
    """Run one aggregating SELECT; at most ``most`` rows come out.

    Every input of the result must be an aggregate, ``SELECT *`` is refused, and the statement may use no
    column that comes from an identifier, under whatever name a view or a subquery gives it. A literal or an
    alias that reads like one is no identifier. What a view does inside is its owner's business.
    """
    text = sql.strip().rstrip(";")
    bare = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S))
    if ";" in bare or not re.match(r"(?i)(select|with)\b", bare.strip()):
        raise ValueError("one SELECT or WITH statement is allowed")
    if re.search(r"(?i)\bselect\s+(distinct\s+)?\*|\w\.\*", bare):
        raise ValueError("the query must aggregate: SELECT * is not allowed")
    df = spark.sql(text)
    plan = df._jdf.queryExecution().analyzed()
    lineage = _Lineage(identifiers)
    lineage.visit(plan, False, {})
    if lineage.used:
        raise ValueError(f"identifiers {sorted(lineage.used)} may not be used")
    if not _aggregated(plan, {}):
        raise ValueError("the query must aggregate: rows of respondents are never returned")
    return df.limit(most)


@dataclass(frozen=True)
class Source:
    """One file of a survey: where it comes from, where its published table goes, and its official number of rows, if known."""

    name: str
    instrument: str
    cycle: str
    path: str
    output: str
    rows: int | None = None


def select_sources(sources: Sequence[Source], only: Sequence[str] = ()) -> list[Source]:
    """Sources by name, instrument or cycle (all without a filter); an unknown word raises."""
    known = {w for s in sources for w in (s.name, s.instrument, s.cycle)}
    if unknown := set(only) - known:
        raise ValueError(f"no source is called {sorted(unknown)}")
    return [s for s in sources if not only or {s.name, s.instrument, s.cycle} & set(only)]


def convert(spark: SparkSession, sources: Sequence[Source], only: Sequence[str] = (), force: bool = False) -> dict[str, str]:
    """Publish every selected source as Parquet; outputs that exist are skipped unless forced. (name: published or skipped.)

    A source whose rows are not its official number raises, and its old output stays.
    """
    done = {}
    for s in select_sources(sources, only):
        path = spark._jvm.org.apache.hadoop.fs.Path(s.output)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and not force:
            done[s.name] = "skipped"
            continue
        df = spark.read.parquet(s.path) if not s.path.endswith(".csv") else spark.read.option("header", True).csv(s.path)
        if fs.exists(path):
            # the new table is whole before the old one goes
            publish_parquet(df, f"{s.output}.new", s.rows)
            fs.delete(path, True)
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{s.output}.new"), path)
        else:
            publish_parquet(df, s.output, s.rows)
        done[s.name] = "published"
    return done


def scan_event_export(spark: SparkSession, path: str, arrays: Sequence[str] = ("variables",)) -> DataFrame:
    """A CSV export of the event log: asks only, ``|``-joined lists back to arrays without empty parts."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).where("kind = 'ask'")
    return df.withColumns({c: F.array_remove(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), "") for c in arrays if c in df.columns})


def append_events(rows: DataFrame, path: str) -> None:
    """Append whole events or partial updates (an id and some fields) as JSON lines; absent fields are not written.

    An event without an id or time gets one, as the first line of an event has both.
    """
    made = {}
    if "id" not in rows.columns:
        made["id"] = F.expr("uuid()")
    if "ts" not in rows.columns and "id" not in rows.columns:
        made["ts"] = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows.withColumns(made).write.mode("append").json(path)


def since_days(days: int, now: Column | None = None) -> Column:
    """The time so many days ago, from which a log is read."""
    return (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days))
