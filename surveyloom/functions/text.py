"""Scalar functions on text: families of variables, levels, regions, entities, numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import Phrases


def collapse_family(name: Column) -> Column:
    """PV6MATH belongs to PV1-10MATH, a weight W_..23 to W_..1-80; other names are their own family."""
    pv = F.regexp_replace(name, r"^(PV)\d+([A-Za-z]+)$", "$11-10$2")
    return F.regexp_replace(pv, r"^(W_[A-Z]+)\d+$", "$11-80")


def level_of_score(score: Column, cuts: dict[str, float]) -> Column:
    """Highest level whose cut the score reaches, or "below" the lowest; NULL stays NULL."""
    steps = sorted(cuts.items(), key=lambda x: x[1])
    out = F.when(score < steps[0][1], f"below {steps[0][0]}")
    for (name, _), (_, high) in zip(steps, steps[1:], strict=False):
        out = out.when(score < high, name)
    return out.when(score.isNotNull(), steps[-1][0])


def compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def region_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Region of every name: an alias equal after normalisation, else the longest alias it contains.

    Names are listed under their runs of one to three characters and met by an alias's first ones, so only
    pairs that share such a run are compared; both sides may be of any size.
    """
    run = lambda text, n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))
    none = F.array().cast("array<string>")
    n = names.select("name", compact(F.col("name")).alias("_n")).distinct()
    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[F.coalesce(run(F.col("_n"), k), none) for k in (1, 2, 3)]))
    listed = n.select("name", "_n", F.explode(runs).alias("_run"))
    a = aliases.select(compact(F.col("alias")).alias("_a"), "region").distinct().withColumn("_run", F.substring("_a", 1, 3))
    hits = listed.join(a, "_run").where(F.col("_n").contains(F.col("_a")))
    best = F.max(F.struct((F.col("_n") == F.col("_a")).alias("same"), F.length("_a").alias("size"), F.col("region")))
    found = hits.groupBy("name").agg(best.alias("b")).select("name", F.col("b.region").alias("region"))
    return names.select("name").distinct().join(found, "name", "left")


#: Phrases up to which the automaton is built and sent to the tasks.
DICTIONARY = 200_000
_WORD = re.compile("[A-Za-z0-9]+")


def _exploded(text: Column, lower: bool, longest: int) -> Column:
    """All runs of up to ``longest`` words of a text (letters a-z and digits), each once."""
    clean = F.lower(text) if lower else text
    words = F.array_remove(F.split(F.regexp_replace(clean, "[^A-Za-z0-9]", " "), " "), "")
    runs = lambda w: F.transform(w, lambda x, i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(w, i + 1, n), " ")))
    return F.array_distinct(F.flatten(F.flatten(F.transform(F.array(words), runs))))


def _walked(docs: DataFrame, kind: str, known: list[tuple[str, str, str]]) -> DataFrame:
    """(id, code, kind) of every known (code, phrase, kind) that stands in a text; codes in capitals as they are."""
    phrases = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = [(c, p.split(" "), k) for c, p, k in phrases.value if k != "code"]
        walk, codes = Phrases(p for _, p, _ in lower), {p for _, p, k in phrases.value if k == "code"}
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {(lower[k][0], lower[k][2]) for k in walk.found(_WORD.findall(text.lower()))}
                hits |= {(c, "code") for c in codes.intersection(_WORD.findall(text))}
                rows += [(id_, *h) for h in hits]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            types = (batch.schema.field(0).type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "code", "kind"])

    return docs.mapInArrow(run, f"id {kind}, code string, kind string")


def tag_entities(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, negatives: DataFrame | None = None, longest: int = 4) -> DataFrame:
    """(id, code): entities that a text names by their code, in capitals only, or by an alias of up to ``longest`` words.

    ``aliases`` has rows (code, alias); ``negatives`` (code, alias) are phrases that name something else,
    such as "north korea": where one stands, only aliases that are no part of it count. The phrases make an
    automaton that walks each text once; a dictionary of more than ``DICTIONARY`` phrases, which the tasks
    should not hold, is joined with the texts' runs of words instead. Null texts name nothing, rows with one id
    are one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = aliases.select("code", F.lower("alias").alias("phrase")).distinct()
    wrong = negatives.select("code", F.lower("alias").alias("not_this")).distinct() if negatives is not None else names.select("code", F.col("phrase").alias("not_this")).limit(0)
    part = names.join(wrong, "code").where(F.col("not_this").contains(F.col("phrase"))).select("code", "phrase").distinct().withColumn("part", F.lit(True))
    known = names.join(part, ["code", "phrase"], "left").select("code", "phrase", F.when(F.col("part").isNull(), "name").otherwise("part").alias("kind"))
    known = known.unionByName(wrong.select("code", F.col("not_this").alias("phrase"), F.lit("not").alias("kind")))
    known = known.where(F.size(F.split("phrase", " ")) <= longest)
    known = known.unionByName(names.select("code", F.col("code").alias("phrase"), F.lit("code").alias("kind")).distinct())
    few = known.limit(DICTIONARY + 1).collect()
    if len(few) <= DICTIONARY:
        met = _walked(rows, rows.schema["id"].dataType.simpleString(), [tuple(r) for r in few])
    else:
        runs = rows.select("id", F.explode(_exploded(F.col("text"), True, longest)).alias("phrase")).join(known.where("kind <> 'code'"), "phrase")
        caps = rows.select("id", F.explode(_exploded(F.col("text"), False, 1)).alias("phrase")).join(known.where("kind = 'code'"), "phrase")
        met = runs.select("id", "code", "kind").unionByName(caps.select("id", "code", "kind"))
    has = lambda k: F.max(F.col("kind") == k)
    found = met.groupBy("id", "code").agg((has("code") | has("name") | (has("part") & ~has("not"))).alias("named"))
    return found.where("named").select("id", "code")


#: Decimals to which numbers are compared.
DIGITS = 12
#: Numbers in prose, grouped thousands first; not parts of words, versions or lists.
NUMBER = r"(?U)(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\w.])|(?<![\w.,])\d+(?:\.\d+)?(?!\w|\.\d|,\d{3})"


def ungrounded_numbers(texts: DataFrame, id_col: str, text_col: str, pool: DataFrame) -> DataFrame:
    """Numbers of a text that no pool value matches at the written precision; years and integers up to 12 pass.

    A number of d decimals (``DIGITS`` at most) is an integer of 10^-d, and a pool value matches the one or
    two such integers within half a unit, so every precision is met by one equi-join.
    """
    found = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(NUMBER), F.lit(0)))).alias("number"))
    clean = F.regexp_replace("number", ",", "")
    digits = F.least(F.length(F.regexp_extract(clean, r"\.(\d+)$", 1)), F.lit(DIGITS))
    found = found.withColumns({"value": clean.cast("double"), "digits": digits})
    found = found.where(~(F.col("number").rlike(r"^(19|20)\d\d$") | ((F.col("digits") == 0) & (F.col("value") <= 12))))
    unit = F.pow(F.lit(10.0), F.col("digits"))
    found = found.withColumn("units", F.round(F.col("value") * unit).cast("decimal(38,0)"))
    near = pool.select(F.abs(F.col("value").cast("double")).alias("value")).distinct().select("value", F.explode(F.sequence(F.lit(0), F.lit(DIGITS))).alias("digits"))
    low, high = F.ceil(F.col("value") * unit - 0.5 - 1e-9 * unit), F.floor(F.col("value") * unit + 0.5 + 1e-9 * unit)
    near = near.select("digits", F.explode(F.array(low.cast("decimal(38,0)"), high.cast("decimal(38,0)"))).alias("units")).distinct()
    return found.join(near, ["digits", "units"], "left_anti").select("id", "number")


def number_text(value: Column, decimals: int | None = None) -> Column:
    """A number as a reader sees it: one decimal from 10 on, two below; "no estimate" without one."""
    text = lambda d: F.format_string(f"%.{d}f", value)
    shown = text(decimals) if decimals is not None else F.when(F.abs(value) >= 10, text(1)).otherwise(text(2))
    return F.when(value.isNull() | F.isnan(value), "no estimate").otherwise(shown)
