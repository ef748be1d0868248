"""Joins of respondent files with schools, domains, patches, labels and other cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_missing_columns(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that brings only the columns ``df`` lacks; rows without a partner stay."""
    new = [c for c in other.columns if c not in df.columns]
    return df.join(other.select(*keys, *new), list(keys), "left")


def patch(df: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill NULLs of ``columns`` from a patch file."""
    renamed = values.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return df.join(renamed, list(keys), "left").withColumns({c: F.coalesce(c, f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def per_cycle(df: DataFrame, cycle: str, column: str, overrides: dict[str, Column]) -> DataFrame:
    """Replace a column in some cycles, such as a renamed or recoded one."""
    out = F.col(column)
    for name, value in overrides.items():
        out = F.when(F.col(cycle) == name, value).otherwise(out)
    return df.withColumn(column, out)


def recoded(column: Column, aliases: dict) -> Column:
    """Codes with their aliases replaced; other values stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[column], column) if aliases else column


def economy_filter(column: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), aliases: dict[str, str] | None = None) -> Column:
    """Rows of some economies without others; both lists may use alias codes."""
    named = lambda codes: [(aliases or {}).get(c, c) for c in codes]
    keep = column.isin(*named(include)) if include else F.lit(True)
    return keep & ~column.isin(*named(exclude)) if exclude else keep


def stratum_filter(column: Column, strata: Sequence, exclude: bool = False) -> Column:
    """Rows in a set of strata; exclusion also drops rows without a stratum."""
    return column.isNotNull() & ~column.isin(*strata) if exclude else column.isin(*strata)


def region_rows(df: DataFrame, regions: DataFrame, region: str, economy: str) -> DataFrame:
    """Respondents of a region's members."""
    members = regions.where(F.col("region") == region).select(F.col("code").alias("_member"))
    return df.join(members, F.col(economy) == F.col("_member"), "left_semi")


def region_members(regions: DataFrame, present: DataFrame) -> DataFrame:
    """(region, code, cycle, present): members of every region in every cycle, absent ones marked."""
    cycles = present.select("cycle").distinct()
    have = present.select("code", "cycle").distinct().withColumn("_here", F.lit(True))
    return regions.crossJoin(F.broadcast(cycles)).join(have, ["code", "cycle"], "left").select("region", "code", "cycle", F.coalesce("_here", F.lit(False)).alias("present"))


def unknown_codes(asked: DataFrame, present: DataFrame) -> DataFrame:
    """Codes that were asked for and that no cycle has."""
    return asked.select("code").distinct().join(present.select("code"), "code", "left_anti")


def participation(present: DataFrame, first: str, last: str) -> DataFrame:
    """Per code: cycles it took part in, and whether it is new in the last or gone since the first."""
    g = present.select("code", "cycle").distinct().groupBy("code")
    out = g.agg(F.array_join(F.sort_array(F.collect_set("cycle")), " ").alias("cycles"), F.max((F.col("cycle") == last).cast("int")).alias("_l"), F.min("cycle").alias("_f"))
    return out.select("code", "cycles", (F.col("_f") == last).alias("is_new"), (F.col("_l") == 0).alias("is_gone"))


def code_key(value: Column) -> Column:
    """Codes as label keys: 1.0 is '1'."""
    return F.regexp_replace(value.cast("string"), r"\.0+$", "")


def label_codes(df: DataFrame, column: str, catalog: DataFrame, variable: str, out: str) -> DataFrame:
    """Add the label of a coded column from the catalog's JSON label map; few labels, so the join broadcasts by itself."""
    labels = catalog.where(F.col("variable") == variable).select(F.explode(F.from_json("value_labels", "map<string,string>")).alias("_code", out))
    return df.join(labels, code_key(F.col(column)) == F.col("_code"), "left").drop("_code")


def codes_left_out(df: DataFrame, column: str, used: Sequence, labels: DataFrame) -> DataFrame:
    """Codes present in the data that a filter drops, without labels that mean missing."""
    here = df.where(F.col(column).isNotNull()).select(code_key(F.col(column)).alias("code")).distinct()
    out = here.join(labels, "code", "left").where(~F.col("code").isin(*[str(u) for u in used]))
    return out.where(~F.coalesce(F.col("label"), F.lit("")).rlike("(?i)missing|no response|invalid|not applicable"))


def normal_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", " ")


def match_items(catalog: DataFrame, a: str, b: str) -> DataFrame:
    """Items of cycle ``a`` under another code in cycle ``b``: equal wording and labels, exactly one partner.

    Partners are counted, never listed: an item has as many as its wording has items in ``b``, less those under
    its own code. A single one is the lowest or the highest code there, as all others are the item's own. The
    join is merged, as the size of a catalog's file says little of its rows and a broadcast would pass the driver.
    """
    keys, cycle, variable = ["wording", "codes"], F.col("cycle"), F.col("variable")
    rows = catalog.where(cycle.isin(a, b)).select("cycle", "variable", normal_label(F.col("label")).alias("wording"), F.coalesce("value_labels", F.lit("")).alias("codes"))
    # dealt out first, as few rows of a part of the file fall together
    dealt = rows.where("variable IS NOT NULL AND wording IS NOT NULL").repartition(*keys, "variable")
    items = dealt.groupBy(*keys, "variable").agg(F.count_if(cycle == a).alias("_a"), F.count_if(cycle == b).alias("_b"))
    there = items.where("_b > 0").groupBy(*keys).agg(F.sum("_b").alias("_all"), F.min("variable").alias("_low"), F.max("variable").alias("_high"))
    met = items.where("_a > 0").hint("merge").join(there, keys).withColumn("_n", F.col("_a") * (F.col("_all") - F.col("_b"))).where("_n > 0")
    other = F.when(F.col("_low") == variable, F.col("_high")).otherwise(F.col("_low"))
    single = met.groupBy(variable.alias(f"variable_{a}")).agg(F.sum("_n").alias("_n"), F.min(other).alias(f"variable_{b}"))
    return single.where("_n = 1").drop("_n")


def item_similarity(catalog: DataFrame, a: str, b: str, least: float = 0.85) -> DataFrame:
    """Items of two cycles with equal codes and labels whose edit similarity reaches ``least``.

    Labels that close have a common piece: of the k + 1 pieces of a label at fixed places, k edits leave
    one unchanged and at most k places away, so labels meet by such pieces, by (table, codes, length band).
    Each wording is compared once, whatever the number of its items, which join the close ones afterwards.
    Joins are merged: rows that are made of a label are no part of Spark's estimate, and a broadcast of them would
    pass the driver.
    """
    keys = ["table_name", "codes"]
    items = lambda c: catalog.where(F.col("cycle") == c).select("table_name", F.coalesce("value_labels", F.lit("")).alias("codes"), normal_label(F.col("label")).alias(f"w_{c}"), F.col("variable").alias(f"variable_{c}")).distinct()
    labels = lambda c: items(c).select(*keys, f"w_{c}").distinct()
    size = F.length(f"w_{a}")
    # the longer label has at most size / least characters, so it differs by at most this many edits
    edits = F.floor((1 - least) * size / least + 1e-9).cast("int")
    width = F.greatest(F.floor(size / (edits + 1)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct((i * width).alias("at"), width.alias("width"), F.substring(F.col(f"w_{a}"), i * width + 1, width).alias("piece")))
    left = labels(a).withColumn("edits", edits).select("*", F.explode(cut).alias("p")).select("*", "p.*").drop("p")
    left = left.select("*", F.explode(F.sequence(F.greatest(F.col("at") - F.col("edits"), F.lit(0)), F.col("at") + F.col("edits"))).alias("place"))
    long = F.length(f"w_{b}")
    # piece widths of all labels that may be close to one of this length
    lengths = F.sequence(F.floor(long * least).cast("int"), F.ceil(long / least).cast("int"))
    every = F.array_distinct(F.transform(lengths, lambda n: F.greatest(F.floor(n / (F.floor((1 - least) * n / least + 1e-9) + 1)), F.lit(1)).cast("int")))
    right = labels(b).select("*", F.explode(every).alias("width"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.greatest(long - F.col("width"), F.lit(0)))).alias("place"))
    right = right.withColumn("piece", F.substring(F.col(f"w_{b}"), F.col("place") + 1, F.col("width")))
    met = left.hint("merge").join(right, [*keys, "width", "place", "piece"]).select(*keys, f"w_{a}", f"w_{b}").distinct()
    sim = 1 - F.try_divide(F.levenshtein(f"w_{a}", f"w_{b}"), F.greatest(F.length(f"w_{a}"), F.length(f"w_{b}")))
    close = met.withColumn("similarity", F.round(sim, 6)).where(F.col("similarity") >= least)
    pairs = close.hint("merge").join(items(a), [*keys, f"w_{a}"]).drop(f"w_{a}")
    pairs = pairs.hint("merge").join(items(b), [*keys, f"w_{b}"])
    return pairs.select("table_name", f"variable_{a}", f"variable_{b}", "similarity").distinct()
