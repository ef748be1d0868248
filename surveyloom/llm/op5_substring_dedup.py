"""Substring deduplication by relative Lempel-Ziv parsing against an index of all documents.

The reference is the whole corpus, cut into blocks of documents. Every window of 13 words
has a smallest 5-word hash among its inner positions; a window that stands in two
documents brings the same one to both, so these anchors, a fifth of the words, tell which
windows need the index at all. The windows around shared anchors are indexed with the
smallest document that holds them and their place in it.

Each document is then parsed greedily from left to right: at a word whose window stands
in an earlier document, a factor follows that document's text as far as the index goes on
in it, and the parse jumps to the factor's end; other words are literals. Windows that
cross a factor's end are looked up apart, as they may stand in another document. Factors
and these boundary windows are the duplicate spans, and the words in them go.

Blocks send what they hold packed by hash range, each hash once, which keeps a passage
that every document holds as small as any other in the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import blocks, windows, words_of

#: Words in an anchor.
GRAM = 5
NONE = np.iinfo(np.int64).max
#: Blocks whose keys one range of the index takes, each block holding about 2 MB of text.
BLOCKS_A_RANGE = 16


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    out, width = h, 1
    while width < k:
        step = min(width, k - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


class Block:
    """Words of a block of documents, its windows and their anchors."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int):
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.words = words_of(texts)
        h = self.words.hashes()
        self.windows, self.at = windows(h, self.words.bounds, width)
        self.doc = np.searchsorted(self.words.bounds, self.at, side="right") - 1
        self.place = self.at - self.words.bounds[self.doc]
        gram, where = windows(h, self.words.bounds, min(GRAM, width))
        full = np.zeros(len(h), np.uint64)
        full[where] = gram
        reach = width - min(GRAM, width) + 1
        self.anchor = _sliding_min(full, reach)[self.at] if len(self.at) else full[:0]


_PACKED = "range long, block long, keys binary, low binary, place binary, gap binary"


def _pack(block: int, keys: np.ndarray, ids: np.ndarray, ranges: int, place: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per hash range: the block's keys in it, each once, with the smallest id, its first place there, and the way to the largest id.

    Without places, ``gap`` tells in one byte whether two documents of the block hold the key.
    """
    order = np.lexsort((ids, keys))  # stable, so places of one document stay in their order
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    keys, low, high = keys[first], ids[first], ids[last]
    part = (((keys >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(part))[: len(cuts)]
    cols = [keys, low[:0], low[:0], (high != low).astype(np.uint8)] if place is None else [keys, low, place[order][first].astype("<i4"), high - low]
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in cols]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), block, np.int64)), *packed], names=["range", "block", "keys", "low", "place", "gap"])


def _unpack(col: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and how many each row has."""
    rows = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return (np.concatenate(rows) if rows else np.zeros(0, kind)), np.array([len(x) for x in rows], np.int64)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Send back to every block which of its keys stand in another document as well."""
    keys, sizes = _unpack(table.column("keys"), "<u8")
    many, _ = _unpack(table.column("gap"), "<u1")
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count > 1
    twice[inverse[many > 0]] = True
    return _sent(table, sizes, twice[inverse], {"keys": keys})


def _earlier_windows(table: pa.Table) -> pa.Table:
    """Send back to every block its keys that a document before its last one holds, with the first such and the place there."""
    keys, sizes = _unpack(table.column("keys"), "<u8")
    low, _ = _unpack(table.column("low"), "<i8")
    place, _ = _unpack(table.column("place"), "<i4")
    gap, _ = _unpack(table.column("gap"), "<i8")
    order = np.lexsort((place, low, keys))
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else order
    _, inverse = np.unique(keys, return_inverse=True)
    least, at = low[order][first][inverse], place[order][first][inverse]
    return _sent(table, sizes, least < low + gap, {"keys": keys, "low": least, "place": at})


def _sent(table: pa.Table, sizes: np.ndarray, wanted: np.ndarray, values: dict[str, np.ndarray]) -> pa.Table:
    """One row per packed row with wanted values: its block and those values."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    each = np.concatenate([[0], np.cumsum(wanted)])[cuts]
    some = np.flatnonzero(np.diff(each))
    out = {"block": table.column("block").take(pa.array(some))}
    for name, x in values.items():
        x = x[wanted]
        out[name] = pa.array([x[each[r] : each[r + 1]].tobytes() for r in some.tolist()], pa.binary())
    return pa.table(out)


def _gathered(rows: list[bytes] | None, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind) if rows else np.zeros(0, kind)


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, width: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Greedy parse of one document: its factors and its boundary windows, each (first word, words, earlier document).

    ``at`` are the ascending starts of the windows that the index knows from an earlier document,
    ``source`` that document and ``place`` their start in it. A factor begins at the first such
    window not before the last factor's end and goes on while the next window follows in the same
    source. A known window that no factor holds crosses the end of one: a boundary window.
    """
    if not len(at):
        return [], []
    breaks = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    new = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(at)]])
    whole, edges, k = [], [], 0
    while k < len(at):
        last = int(new[np.searchsorted(new, k, side="right")]) - 1
        end = int(at[last]) + width
        whole.append((int(at[k]), end - int(at[k]), int(source[k])))
        after = int(np.searchsorted(at, end))
        edges += [(int(at[j]), width, int(source[j])) for j in range(last + 1, after)]
        k = after
    return whole, edges


def _spans(found: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    """Spans in the order of their start; those of one source that overlap become one."""
    out: list[dict[str, int]] = []
    for start, length, source in sorted(found):
        if out and out[-1]["source"] == source and start <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], start + length - out[-1]["start"])
        else:
            out.append({"start": start, "length": length, "source": source})
    return out


def parse(df: DataFrame, *, width: int = 13, blocks_a_range: int = BLOCKS_A_RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept (text), spans.

    A word goes when a factor or boundary window covers it, which is when a window of ``width`` words
    covers it that also starts in a document with a smaller id, judged on the input. ``spans`` are
    the factors and boundary windows (start, length, source) in words, ``kept`` the other words
    joined by a space. Null and empty texts have no words; of rows that share an id none is earlier
    than another; a row with a null id counts as the last of all and is no one's source; an empty
    table gives no rows; further columns are ignored. Blocks are written once with their names, so
    a lost executor changes nothing; the parts of the index grow in number with the blocks.
    """
    spark = df.sparkSession
    ids = F.coalesce(df[id_col].cast("long"), F.lit(NONE))
    docs = df.select(F.monotonically_increasing_id().alias("uid"), ids.alias("doc_id"), df[text_col].alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents as one row each, named by their first row."""
        for batch in batches:
            for part in blocks(batch):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in (part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *lists], names=["block", "ids", "texts"])

    held = stored(docs.mapInArrow(cut, "block long, ids array<long>, texts array<string>"), "blocks", row_group=16 << 20)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.select("block").count() // blocks_a_range)

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Block, int]]:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)
            yield one.column(0)[0].as_py(), Block(one.column(1).flatten(), one.column(2).flatten(), width), r

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, b, _ in opened(batch):
                yield _pack(block, b.anchor, b.ids[b.doc], ranges)

    shared = held.mapInArrow(anchors, _PACKED).select("range", "block", "keys", "gap").groupBy("range").applyInArrow(_shared_anchors, "block long, keys binary")
    shared = stored(shared.groupBy("block").agg(F.collect_list("keys").alias("anchors")), "anchors")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows whose anchor other documents hold as well."""
        for batch in batches:
            for block, b, r in opened(batch):
                k = np.flatnonzero(np.isin(b.anchor, _gathered(batch.column(3)[r].as_py(), "<u8")))
                yield _pack(block, b.windows[k], b.ids[b.doc[k]], ranges, b.place[k])

    # both joins deal the blocks out by the same key, so their texts are shuffled once
    index = held.join(shared, "block", "left").select("block", "ids", "texts", "anchors").mapInArrow(around, _PACKED)
    earlier = index.groupBy("range").applyInArrow(_earlier_windows, "block long, keys binary, low binary, place binary")
    earlier = earlier.groupBy("block").agg(*[F.collect_list(F.struct("keys", "low", "place")).alias("found")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b, r in opened(batch):
                rows = batch.column(3)[r].as_py() or []
                got = [_gathered([x[c] for x in rows], kind) for c, kind in (("keys", "<u8"), ("low", "<i8"), ("place", "<i4"))]
                yield _finished(b, *got, width)

    span = "array<struct<start: long, length: long, source: long>>"
    parsed = held.join(earlier, "block", "left").select("block", "ids", "texts", "found")
    out = parsed.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, kept string, spans {span}")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))


def _finished(b: Block, keys: np.ndarray, low: np.ndarray, place: np.ndarray, width: int) -> pa.RecordBatch:
    order = np.argsort(keys, kind="stable")
    keys, low, place = keys[order], low[order], place[order]
    k = np.minimum(np.searchsorted(keys, b.windows), max(len(keys) - 1, 0))
    known = (keys[k] == b.windows) & (low[k] < b.ids[b.doc]) if len(keys) else np.zeros(len(b.windows), bool)
    found = np.flatnonzero(known)
    at, bounds = b.at[found], b.words.bounds
    cut = np.searchsorted(at, bounds)
    data = b.words.data.tobytes()
    n_removed, kept, spans = [], [], []
    for d in range(len(b.ids)):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        mine = slice(cut[d], cut[d + 1])
        whole, edges = factors(at[mine] - lo, low[k[found[mine]]], place[k[found[mine]]], width)
        stay = np.ones(hi - lo, bool)
        for start, length, _ in (*whole, *edges):
            stay[start : start + length] = False
        left = np.flatnonzero(stay) + lo
        n_removed.append(hi - lo - len(left))
        kept.append(b" ".join([data[x:y] for x, y in zip(b.words.starts[left].tolist(), b.words.ends[left].tolist(), strict=True)]))
        spans.append(_spans([*whole, *edges]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(b.ids), pa.array(np.diff(bounds), pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(spans, kind)],
        names=["doc_id", "n_words", "n_removed", "kept", "spans"],
    )


def digest(parsed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
