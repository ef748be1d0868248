"""Quality rules with cross-document line frequency.

Base rules look at one document. The method counts, per host, in how many distinct
documents each normalised line stands; lines above the host's limit go, and a document
that keeps too small a part of its words is rejected. Documents are told apart by a hash
of all their line hashes, so that a group of copies with the same lines counts once and is
left to deduplication instead of being rejected as boilerplate; any other document counts,
however many lines it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import blocks, mix, windows, words_of
from .workers import small_batches, tidy

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "uid long, doc_id long, host string, " + ", ".join(f"{x} long" for x in STATS) + ", doc_key long, line_hash array<long>, line_words array<int>"


def line_key(line: bytes) -> int:
    """60-bit hash of a line with A-Z lowered and white space collapsed."""
    return int(hashlib.md5(b" ".join(line.lower().split())).hexdigest()[:15], 16)


def _lines(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Lines equal to an earlier one, and the hash and words of every line; a line without words has hash 0."""
    seen, dup, keys, words = set(), 0, [], []
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            dup += line in seen
            seen.add(line)
        keys.append(line_key(line) if n else 0)
        words.append(n)
    return dup, np.array(keys, np.int64), np.array(words, np.int32)


def _doc_key(keys: np.ndarray) -> int:
    """60-bit hash of a document's distinct line hashes; that of a document without lines is the same everywhere."""
    return int(hashlib.md5(np.unique(keys[keys != 0]).tobytes()).hexdigest()[:15], 16)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), kind))


def _measure(batches: Iterator[pa.RecordBatch], at: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Columns uid, doc_id, host and one struct or text column; further columns pass as they are.

    ``at`` is the path of the text: the column, and perhaps its field.
    """
    for batch in batches:
        for part in blocks(batch, at=at):
            col = part.column(at[0])
            if len(at) > 1:
                col = col.field(at[1])
            w = words_of(col)
            h = w.hashes()
            chars = (w.data & 0xC0) != 0x80
            in_words = np.zeros(len(w.data) + 1, np.int64)
            np.add.at(in_words, w.starts, 1)
            np.add.at(in_words, w.ends, -1)
            inside = np.cumsum(in_words[:-1]) > 0
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
            win, first = windows(h, w.bounds, 3)
            doc = np.repeat(np.arange(len(col)), np.diff(w.bounds))
            _, inverse, count = np.unique(mix(win + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            twice = first[count[inverse] > 1]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[twice + k] = True
            repeat = np.bincount(doc[covered], minlength=len(col))
            data = w.data.tobytes()
            dup, keys, words = zip(*(_lines(data[a:b]) for a, b in zip(w.offsets.tolist(), w.offsets[1:].tolist(), strict=False)), strict=True)
            ints = [np.diff(w.bounds), total(chars & inside), total(SYMBOLS[w.data]), dup, repeat, [_doc_key(k) for k in keys]]
            out = {x: part.column(x) for x in ("uid", "doc_id", "host")}
            out |= {x: pa.array(v, pa.int64()) for x, v in zip([*STATS, "doc_key"], ints, strict=True)}
            out |= {"line_hash": _lists(keys, pa.int64()), "line_words": _lists(words, pa.int32())}
            if len(at) > 1:
                out[at[0]] = part.column(at[0])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, whole: bool = False) -> DataFrame:
    """Per row: base statistics, and hash and words of every line, written to the shared folder.

    ``uid`` is written with them, so it names the same row for every later reader. ``whole`` keeps the
    row itself as the struct ``row``. A null host counts as the host ''.
    """
    small_batches(df.sparkSession)
    cols = [
        F.monotonically_increasing_id().alias("uid"),
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[host_col].cast("string"), F.lit("")).alias("host"),
    ]
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(*cols, own.alias("row") if whole else df[text_col].alias("text"))
    at = ["row", text_col] if whole else ["text"]
    schema = _SCHEMA + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else "")
    return stored(rows.mapInArrow(tidy(lambda batches: _measure(batches, at)), schema), "lines")


def frequent_lines(measured: DataFrame, min_docs: int = 5, share: float = 0.03) -> DataFrame:
    """(host, key) of the lines that stand in more distinct documents of the host than its limit.

    The limit is ``share`` of the host's distinct documents, ``min_docs`` at least. Copies go before
    lines are exploded, so a line's rows add up in the tasks that read them.
    """
    docs = measured.select("host", "doc_key", F.array_distinct("line_hash").alias("line_hash")).dropDuplicates(["host", "doc_key"])
    each = docs.select("host", F.explode("line_hash").alias("key")).where("key <> 0")
    hosts = measured.select("host", "doc_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    often = each.groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs).join(hosts, "host")
    return often.where(F.col("docs") > F.col("host_docs") * share).select("host", "key")


def removed_lines(measured: DataFrame, often: DataFrame) -> DataFrame:
    """(uid, n_removed_words, keys): what every row loses, for rows that lose anything.

    A row sends each of its distinct lines once. A very common line is one key of this join: Spark
    broadcasts ``often`` where its file is small, and else splits the key's rows (AQE).
    """
    zipped = F.arrays_zip(F.col("line_hash").alias("key"), F.col("line_words").alias("words"))
    each = measured.select("uid", "host", F.explode(zipped).alias("x")).select("uid", "host", "x.key", "x.words").where("key <> 0")
    return each.join(often, ["host", "key"]).groupBy("uid").agg(F.sum("words").alias("n_removed_words"), F.collect_set("key").alias("keys"))


def judge(measured: DataFrame, often: DataFrame, keep_percent: int = 40) -> DataFrame:
    """``measured`` with ``n_removed_words``, ``keys`` (lines that go), ``base_failed`` and ``kept``, given the lines over the limit."""
    out = measured.join(stored(removed_lines(measured, often), "removed"), "uid", "left")
    out = out.withColumns({"n_removed_words": F.coalesce("n_removed_words", F.lit(0).cast("long")), "base_failed": base_failed()})
    enough = 100 * (F.col("n_words") - F.col("n_removed_words")) >= keep_percent * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & enough)


def quality_rules(df: DataFrame, *, min_docs: int = 5, share: float = 0.03, keep_percent: int = 40, **cols: str) -> DataFrame:
    """One row per row of ``df``: base statistics, ``n_removed_words``, ``base_failed`` and ``kept``.

    A row is kept if it passes the base rules and at least ``keep_percent`` of its words stand in
    lines within the limit. Null and empty texts have no words and fail; an empty table gives no
    rows; repeated rows and rows with one id are judged each by its own text; further columns of
    ``df`` are ignored.
    """
    measured = measure(df, **cols)
    often = stored(frequent_lines(measured, min_docs, share), "often")
    return judge(measured.drop("doc_key"), often, keep_percent).select("doc_id", *STATS, "n_removed_words", "base_failed", "kept")


def clean_documents(df: DataFrame, *, min_docs: int = 5, share: float = 0.03, keep_percent: int = 40, **cols: str) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without their lines over the limit; same columns.

    The text loses those lines and ``n_chars``, if there is such a column, follows it; a text without
    such a line is unchanged. Own columns of any name, null texts, repeated rows and rows with one id
    pass as ``quality_rules`` says.
    """
    measured = measure(df, **cols, whole=True)
    often = stored(frequent_lines(measured, min_docs, share), "often")
    kept = judge(measured.drop("doc_key"), often, keep_percent).where("kept").select("row", "line_hash", "keys")
    name = cols.get("text_col", "text")
    text = F.col("row").getField(name)
    stay = F.filter(F.arrays_zip(F.split(text, "\n", -1).alias("line"), F.col("line_hash").alias("key")), lambda x: ~F.array_contains(F.col("keys"), x["key"]))
    new = F.when(F.col("keys").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    out = kept.select("row", "keys", new.alias("new"))
    value = {name: F.col("new"), "n_chars": F.when(F.col("keys").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("new"))}
    return out.select(*[(value[c].cast(df.schema[c].dataType) if c in value else F.col("row").getField(c)).alias(c) for c in df.columns])
