"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask keeps some of the words in a window and ignores the others, so a replaced word
costs only the seeds that look at it. Hashes of the kept words are looked up among those
of the benchmark; around each hit the two texts are laid side by side on the hit's
diagonal and the best stretch is scored +1 per equal and -3 per replaced word, which
tolerates a replaced word in four or more equal ones. A diagonal on which most of the item's
words are equal counts too, so that short items bear a replaced word as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import near, stored, without

#: Word positions that a seed looks at; 1 keeps, 0 ignores. Fixed values.
MASKS = ("1110111", "110110011", "101100111")
SPAN = max(map(len, MASKS))
MISMATCH = -3
#: An item is met too if so many per cent of its words are equal on one diagonal.
ITEM_PERCENT = 80
#: Items of fewer words than the shortest mask have no seeds and are compared as a whole.
SHORTEST = min(map(len, MASKS))
#: A benchmark whose seed table stays under this many rows is sent to every task.
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, cut at ASCII characters that aren't letters or digits; none for null."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.transform(F.array_remove(split, ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, key: str, words_col: str, place: str) -> DataFrame:
    """(key, place, seed): the masked hashes of every window, ``place`` being its first word.

    Windows are exploded before they are hashed, which keeps the hashing in generated code.
    """
    last = F.size(words_col) - SHORTEST
    each = df.select(key, words_col, F.explode(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))).alias(place))
    picks = [[k for k, c in enumerate(mask) if c == "1"] for mask in MASKS]
    # each mask has its own last window
    masked = [
        F.when(F.col(place) + len(MASKS[m]) <= F.size(words_col), F.xxhash64(F.lit(m), *[F.get(words_col, F.col(place) + k) for k in ks])) for m, ks in enumerate(picks)
    ]
    return each.select(key, place, F.explode(F.array(*masked)).alias("seed")).where("seed IS NOT NULL")


def whole(d: DataFrame, short: DataFrame) -> DataFrame:
    """Every place of a document where all words of an item shorter than the masks stand: doc_id, item_id, x."""
    sizes = sorted(n for (n,) in short.select(F.size("iw")).distinct().collect())
    w = d.select("doc_id", words(F.col("_text")).alias("dw"))

    def runs(n: int) -> Column:
        last = F.size("dw") - n
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        one = lambda i: F.struct(i.alias("doc_start"), F.xxhash64(F.slice("dw", i + 1, F.lit(n))).alias("key"), F.slice("dw", i + 1, F.lit(n)).alias("run"))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), one)

    each = w.select("doc_id", F.explode(F.concat(*[runs(n) for n in sizes])).alias("r"))
    keyed = short.withColumn("_key", F.xxhash64("iw"))
    if keyed.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        keyed = F.broadcast(keyed)
    met = each.select("doc_id", "r.*").join(keyed, (F.col("key") == F.col("_key")) & (F.col("run") == F.col("iw")))
    n = F.size("iw")
    return met.select("doc_id", "item_id", F.struct(n.alias("score"), n.alias("length"), n.alias("n_equal"), "doc_start").alias("x"))


def _best(same: Column) -> Column:
    """Best-scoring stretch of an array of booleans: struct(score, start, length)."""
    zero = lambda: F.lit(0)
    start = F.struct(zero().alias("at"), zero().alias("run"), zero().alias("since"), zero().alias("score"), zero().alias("start"), zero().alias("length"))

    def step(acc: Column, x: Column) -> Column:
        gain = F.when(x, F.lit(1)).otherwise(F.lit(MISMATCH))
        fresh = acc["run"] <= 0
        run = F.when(fresh, gain).otherwise(acc["run"] + gain)
        since = F.when(fresh, acc["at"]).otherwise(acc["since"])
        better = run > acc["score"]
        return F.struct(
            (acc["at"] + 1).alias("at"),
            run.alias("run"),
            since.alias("since"),
            F.when(better, run).otherwise(acc["score"]).alias("score"),
            F.when(better, since).otherwise(acc["start"]).alias("start"),
            F.when(better, acc["at"] + 1 - since).otherwise(acc["length"]).alias("length"),
        )

    return F.aggregate(same, start, step)


def overlaps(docs: DataFrame, bench: DataFrame, *, min_score: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best overlap of each (document, benchmark item) that reaches the threshold.

    Columns: doc_id, item_id, score, length and n_equal (words of the stretch, and those that are
    equal), doc_start (its first word). The threshold is ``min_score``, or the item's words when it
    has fewer; ``ITEM_PERCENT`` of the item's words on one diagonal suffice as well. Items under
    ``SHORTEST`` words have no seeds and must stand in a document word for word. Null
    texts have no words; repeated rows and rows with one id count as one document; empty tables
    give no rows; further columns are ignored.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    b = bench.select(bench[item_col].alias("item_id"), words(bench[item_text]).alias("iw")).distinct()
    found = seeds(d.select("doc_id", words(F.col("_text")).alias("dw")), "doc_id", "dw", "i")
    wanted = seeds(b, "item_id", "iw", "j").join(b.select(F.col("item_id").alias("_item"), F.size("iw").alias("n")), F.col("item_id").eqNullSafe(F.col("_item")))
    if wanted.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    hits = found.join(wanted, "seed").select(F.col("doc_id").alias("_doc"), "item_id", "n", (F.col("i") - F.col("j")).alias("shift"))
    # a document's diagonals come to it together, so that its words are made once; each takes only the words beside its item
    hits = stored(hits.groupBy("_doc").agg(F.collect_set(F.struct("item_id", "n", "shift")).alias("hits")), "hits")
    # only texts with a hit, and few others, may be shuffled
    met = near(d, "doc_id", hits, "_doc").join(hits, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", words(F.col("_text")).alias("dw"), "hits")
    start = lambda x: F.greatest(x["shift"], F.lit(0))
    beside = lambda x, w: F.slice(w, start(x) + 1, F.greatest(x["n"] + F.least(x["shift"], F.lit(0)), F.lit(0)))
    cut = lambda w: F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), start(x).alias("from"), F.greatest(-x["shift"], F.lit(0)).alias("first"), beside(x, w).alias("dw")))
    # inside a lambda the words are split once a text, not once a hit
    met = met.select("doc_id", F.explode(F.flatten(F.transform(F.array("dw"), cut))).alias("x")).select("doc_id", "x.*")
    pair = met.join(b.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
    same = F.zip_with("dw", F.slice("iw", F.col("first") + 1, F.size("dw")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    scored = pair.where("size(dw) > 0").select("doc_id", "item_id", F.size("iw").alias("n"), "from", _best(same).alias("x"), F.size(F.filter(same, lambda x: x)).alias("equal"))
    good = scored.where((F.col("x.score") >= F.least(F.lit(min_score), F.col("n"))) | (100 * F.col("equal") >= ITEM_PERCENT * F.col("n")))
    n_equal = ((F.col("x.score") - MISMATCH * F.col("x.length")) / (1 - MISMATCH)).cast("int")
    best = good.select("doc_id", "item_id", F.struct(F.col("x.score").alias("score"), F.col("x.length").alias("length"), n_equal.alias("n_equal"), (F.col("from") + F.col("x.start")).alias("doc_start")).alias("x"))
    short = b.where(F.size("iw").between(1, SHORTEST - 1))
    if short.limit(1).count():
        best = best.unionByName(whole(d, short))
    return best.groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, bench: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item; same columns, repeated rows included."""
    bad = stored(overlaps(docs, bench, **options).select(F.col("doc_id").alias("_bad")).distinct(), "leaks")
    return without(docs, options.get("id_col", "doc_id"), bad, "_bad", null_safe=True)
