"""N-gram Jaccard join with a prefix tree; near-duplicate components of documents.

Documents with equal n-gram sets form a class, and one set stands for it. Sets are ordered
by the n-gram hashes. Two sets that reach the similarity differ in few elements, so when
the ordered sets are cut at fixed hashes into more segments than that, some segments are equal: equal segments are
the candidates, exactly. Before that, sets that share too little with all others together leave:
in the order of the hashes, two similar sets have some of their smallest elements in common,
so only those prefixes are sent, packed by hash range. A few segments more than needed let each set leave out its most
frequent ones, such as those inside a passage that many documents share: of the equal
segments the rarest is never left out by either set. Classes tied by candidates form blocks; in a block the sets go into a prefix tree, and every set is matched against
all of them in one walk that shares the overlap of common prefixes and leaves a subtree
when what remains cannot reach the required overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, near, stored, without
from .words import blocks, mix, windows, words_of
from .workers import small_batches, tidy, tidy_group

#: Sizes of one interval span this factor; sets of two sizes that can match share an interval.
SPREAD = 1.4
#: Empty segments say nothing; so many of them may agree beside an equal segment that is not empty.
EMPTIES = 2
#: Segments beyond the necessary ones, as a part of them; a set leaves out as many, the most frequent first.
EXTRA = 0.3
#: Part of a set's elements that it must share, beside those a similar set may lack, before its segments are made.
GUARD = 0.1
#: Elements in a node of a tree with more than LARGE elements.
PIECE, LARGE = 64, 30_000
#: Classes in a block at most, on average.
BLOCK = 2048


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Ordered hashes of the distinct ``n``-word shingles of each text (A-Z lowered)."""
    w = words_of(col, lower=True)
    h = w.hashes()
    win, at = windows(h, w.bounds, n)
    cut = np.searchsorted(at, w.bounds)
    sets = []
    for d in range(len(col)):
        size = w.bounds[d + 1] - w.bounds[d]
        if 0 < size < n:
            own = h[w.bounds[d] : w.bounds[d + 1]]
            sets.append(windows(own, np.array([0, size]), int(size))[0])
        else:
            sets.append(np.unique(win[cut[d] : cut[d + 1]]))
    return sets


def set_key(s: np.ndarray) -> np.uint64:
    """Identity of a whole set, from its size and elements."""
    return mix(np.add.reduce(mix(s), keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0]


def required(a: int, b: int, percent: int) -> int:
    """Least intersection with which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def intervals(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(interval, segments, segments to leave out) that a set of this size takes part in.

    Sets that reach the similarity differ in ``most`` elements at most, so of the segments of an
    interval at least 1 + EMPTIES + left-out are equal.
    """
    t = percent / 100
    k = math.floor(math.log(size) / math.log(SPREAD) + 1e-9)
    found = []
    while k >= 0 and size <= SPREAD ** (k + 1) / t + 1e-9:
        high = SPREAD ** (k + 1)
        most = math.floor((high + high / t) * (1 - t) / (1 + t) + 1e-9)
        extra = int(EXTRA * most)
        found.append((k, most + 1 + EMPTIES + extra, extra))
        k -= 1
    return found


def segment_keys(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(interval, segments to leave out, hashes of the segments) by which a set meets its candidates."""
    out = []
    for k, m, extra in intervals(len(s), percent) if len(s) else ():
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held = part[at]
        value = np.add.reduceat(mix(s), at)
        salt = np.uint64(k * 1_000_003 + m)
        keys = mix(value ^ mix(held * np.uint64(0x9E3779B97F4A7C15) + salt))
        if m - len(held) > EMPTIES:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
            keys = np.concatenate([keys, mix(mix(empty * np.uint64(0x9E3779B97F4A7C15) + salt) + np.uint64(1))])
        out.append((k, extra, keys))
    return out


class PrefixTree:
    """Ordered sets as a path-compressed trie, held level by level in arrays.

    A node has its run of elements, its parent, the range of sets below it (in sorted order), and
    the smallest and largest of their sizes. In a large tree long runs are cut into a chain of
    nodes, so that a walk can leave them early.
    """

    def __init__(self, sets: list[np.ndarray]):
        most = PIECE if sum(map(len, sets)) > LARGE else 1 << 62
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        ordered = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in ordered], np.int64)
        shared = [0]
        for a, b in zip(ordered, ordered[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        self.lcp = np.array([*shared, 0], np.int64)
        self.levels: list[dict[str, np.ndarray]] = []
        todo = [(0, len(ordered), 0, -1)]
        while todo:
            nodes, deeper = [], []
            for low, high, depth, parent in todo:
                cuts = [low, *(low + 1 + np.flatnonzero(self.lcp[low + 1 : high] <= depth)).tolist(), high]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    whole = int(self.lcp[a + 1 : b].min()) if b - a > 1 else int(self.sizes[a])
                    end = min(whole, depth + most)
                    if b - a > 1 or end < whole:
                        deeper.append((a, b, end, len(nodes)))
                    nodes.append((parent, a, b, depth, end, ordered[a][depth:end]))
            sizes = [self.sizes[a:b] for _, a, b, *_ in nodes]
            runs = [x[5] for x in nodes]
            lens = np.array([len(r) for r in runs], np.int64)
            self.levels.append(
                {
                    "parent": np.array([x[0] for x in nodes], np.int64), "low": np.array([x[1] for x in nodes], np.int64),
                    "high": np.array([x[2] for x in nodes], np.int64), "end": np.array([x[4] for x in nodes], np.int64),
                    "small": np.array([x.min() for x in sizes]), "large": np.array([x.max() for x in sizes]),
                    "at": np.cumsum(lens) - lens, "lens": lens, "run": np.concatenate(runs) if runs else np.zeros(0, np.uint64),
                    "last": np.array([ordered[x[1]][x[4] - 1] if x[4] else 0 for x in nodes], np.uint64),
                }
            )
            todo = deeper

    def matches(self, probe: np.ndarray, percent: int, open_: np.ndarray) -> np.ndarray:
        """Sorted-order places of the open sets that reach the similarity with ``probe``."""
        n, found = len(probe), []
        below = np.concatenate([[0], np.cumsum(open_)])
        overlap_up = np.zeros(1, np.int64)
        alive_up = None
        for level in self.levels:
            parent = level["parent"]
            alive = below[level["high"]] > below[level["low"]]
            if alive_up is not None:
                alive &= alive_up[parent]
            k = np.flatnonzero(alive)
            overlap = np.zeros(len(parent), np.int64)
            if not len(k):
                break
            lens = level["lens"][k]
            first = np.cumsum(lens) - lens
            run = level["run"][np.repeat(level["at"][k] - first, lens) + np.arange(int(lens.sum()))]
            place = np.searchsorted(probe, run)
            hit = np.concatenate([[0], np.cumsum(probe[np.minimum(place, n - 1)] == run)])
            overlap[k] = hit[first + lens] - hit[first] + (overlap_up[parent[k]] if alive_up is not None else 0)
            rest = np.minimum(level["large"][k] - level["end"][k], n - np.searchsorted(probe, level["last"][k], side="right"))
            need = -(-percent * (n + level["small"][k]) // (100 + percent))
            reach = overlap[k] + np.maximum(rest, 0) >= need
            leaf = (level["high"][k] - level["low"][k] == 1) & (level["end"][k] == level["large"][k]) & reach
            sure = k[leaf]
            found.append(level["low"][sure][overlap[sure] >= -(-percent * (n + level["small"][sure]) // (100 + percent))])
            alive_up = np.zeros(len(parent), bool)
            alive_up[k[reach]] = True
            overlap_up = overlap
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def tree_join(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of sets in a block, and each set's count of links found.

    Sets of one component are not compared again, so the counts are links that the components need.
    ``probes`` marks the sets to match against all (default: every one).
    """
    tree = PrefixTree(sets)
    label = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)
    for p, i in enumerate(tree.order):
        if probes is not None and not probes[i]:
            continue
        n = len(sets[i])
        open_ = (label != label[p]) & (100 * np.minimum(tree.sizes, n) >= percent * np.maximum(tree.sizes, n))
        if not open_.any():
            continue
        got = tree.matches(sets[i], percent, open_)
        got = got[open_[got]]
        if len(got):
            links[p] += len(got)
            links[got] += 1
            merged = np.isin(label, np.append(label[got], label[p]))
            label[merged] = label[merged].min()
    back = np.empty(len(sets), np.int64)
    back[tree.order] = np.arange(len(sets))
    return label[back], links[back]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key) per document; the key is 0 for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column(1), n)
                keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys)], names=["doc_id", "n_shingles", "key"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, key long")


def prefix_length(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's smallest elements are compared first, and how many it must share there with one other.

    A set has ``free`` elements at most that a similar one lacks. Of the common elements in order, the
    first ``extra`` are within the first ``free + extra`` of both, where ``extra`` is that of the smaller
    set, which has at least ``percent`` of the size.
    """
    must = lambda n: -(-percent * n // 100)
    extra = lambda n: min(int(GUARD * n) + 1, must(n))
    return size - must(size) + extra(size), extra(must(size))


def _sent_prefixes(docs: DataFrame, n: int, percent: int, ranges: int) -> DataFrame:
    """(range, hashes, owners): per block of documents and hash range, the prefixes' elements with their sets' keys.

    An element that sets of one block share is counted for them there, in rows of the ranges from
    ``ranges`` on (keys and counts instead), and sent once, with the owner 0: a passage or a group of
    near copies costs an entry a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                own = {int(set_key(x)): x for x in shingle_sets(part.column(1), n) if len(x)}
                if not own:
                    continue
                cut = [x[: prefix_length(len(x), percent)[0]] for x in own.values()]
                h = np.concatenate(cut)
                owner = np.repeat(np.array(list(own), np.uint64), [len(x) for x in cut])
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                same = np.zeros(len(h) + 1, bool)
                same[1:-1] = h[1:] == h[:-1]
                shared = same[:-1] | same[1:]
                counted = _counted(*np.unique(owner[shared], return_counts=True), ranges)
                first = ~same[:-1]
                h, owner = h[first], np.where(shared, np.uint64(0), owner)[first]
                where = (((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)
                at = np.flatnonzero(np.diff(where, prepend=-1))
                ends = [*at[1:].tolist(), len(h)][: len(at)]
                packed = [pa.array([x[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)], pa.binary()) for x in (h, owner)]
                names = ["range", "hashes", "owners"]
                yield pa.RecordBatch.from_arrays([pa.array(where[at]), *packed], names=names)
                local = pa.array(counted.column("part").to_numpy() + ranges)
                yield pa.RecordBatch.from_arrays([local, *(counted.column(c).combine_chunks() for c in ("keys", "counts"))], names=names)

    return docs.mapInArrow(tidy(run), "range long, hashes binary, owners binary")


_COUNTS = "part long, keys binary, counts binary"


def _counted(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """Counts per set, packed into one row for each part of the keys."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    ends = [*at[1:].tolist(), len(keys)][: len(at)]
    cells = [pa.array([x[order][i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)], pa.binary()) for x in (keys, counts.astype(np.int32))]
    return pa.table([pa.array(part[order][at]), *cells], names=["part", "keys", "counts"])


def _unpacked(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(column).to_pylist()] or [np.zeros(0, kind)])


def _shared_elements(table: pa.Table, parts: int) -> pa.Table:
    """How many elements of the range each set shares with any other; counts of blocks pass as they are."""
    if table.num_rows and table.column("range")[0].as_py() >= parts:
        return pa.table([pa.array(table.column("range").to_numpy() - parts), table.column("hashes"), table.column("owners")], names=["part", "keys", "counts"])
    h, owner = _unpacked(table, "hashes", np.uint64), _unpacked(table, "owners", np.uint64)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    # the owner 0 stands for sets that their block has counted
    asks = (same[:-1] | same[1:]) & (owner != 0)
    return _counted(*np.unique(owner[asks], return_counts=True), parts)


def _total(table: pa.Table) -> pa.Table:
    """(key, shared): a part's counts added up over all ranges."""
    keys, inverse = np.unique(_unpacked(table, "keys", np.uint64), return_inverse=True)
    total = np.bincount(inverse, _unpacked(table, "counts", np.int32), len(keys)).astype(np.int64)
    return pa.table({"key": pa.array(keys.view(np.int64)), "shared": pa.array(total)})


def promising(docs: DataFrame, classes: DataFrame, n: int, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """(key, set) of the classes that share enough of their prefixes with others to have a similar one; written."""
    spark = docs.sparkSession
    # a range takes the prefixes of about as many documents as BLOCK times eight
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() // (8 * BLOCK))
    shared = _sent_prefixes(docs, n, percent, ranges).groupBy("range").applyInArrow(tidy_group(lambda t: _shared_elements(t, ranges)), _COUNTS)
    shared = shared.groupBy("part").applyInArrow(tidy_group(_total), "key long, shared long")
    size = F.col("n_shingles")
    must = F.ceil(size * percent / F.lit(100)).cast("long")
    need = F.least(F.floor(F.lit(GUARD) * must).cast("long") + 1, F.ceil(must * percent / F.lit(100)).cast("long"))
    kept = stored(shared.join(classes, "key").where(F.col("shared") >= need).select("key", "rep"), "promising", scratch=scratch)
    rows = near(docs.withColumnRenamed("doc_id", "_rep"), "_rep", kept, "rep").join(kept, F.col("_rep").eqNullSafe(F.col("rep"))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column(1), n)
                want = part.column(0).to_numpy()
                # an id that several texts carry brings them all; only the class's own text stays
                good = [i for i, x in enumerate(sets) if len(x) and set_key(x).view(np.int64) == want[i]]
                offs = pa.array(np.cumsum([0, *[len(sets[i]) for i in good]]), pa.int32())
                flat = np.concatenate([sets[i] for i in good]) if good else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good, pa.int64())), pa.ListArray.from_arrays(offs, pa.array(flat.view(np.int64)))], names=["key", "set"])

    return stored(rows.mapInArrow(tidy(run), "key long, set array<long>").dropDuplicates(["key"]), "sets", scratch=scratch)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The sets of an array column."""
    values, offs = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)]


def segments(sets: DataFrame, percent: int) -> DataFrame:
    """(segment, key, slot, extra): every segment of every set, with its interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(key, *x) for key, s in zip(part.column(0).to_pylist(), _lists(part.column(1)), strict=True) for x in segment_keys(s, percent)]
                lens = [len(x[3]) for x in rows]
                flat = np.concatenate([x[3] for x in rows]) if rows else np.zeros(0, np.uint64)
                own = [np.repeat(np.array([x[c] for x in rows], kind), lens) for c, kind in ((0, np.int64), (1, np.int32), (2, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *map(pa.array, own)], names=["segment", "key", "slot", "extra"])

    return sets.mapInArrow(tidy(run), "segment long, key long, slot int, extra int")


def candidates(sets: DataFrame, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """(u, v): ties of each class to the smallest one that keeps an equal segment."""
    seg = segments(sets, percent)
    shared = seg.groupBy("segment").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("often"))
    shared = stored(shared.where("low <> high").select("segment", "often"), "shared", scratch=scratch)
    order = Window.partitionBy("key", "slot").orderBy(F.col("often").desc(), "segment")
    rows = seg.join(shared, "segment").withColumn("place", F.row_number().over(order))
    kept = stored(rows.where("place > extra").select("segment", "key"), "kept", scratch=scratch)
    low = kept.groupBy("segment").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("segment", "low")
    return kept.join(low, "segment").where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v")).distinct()


_LINKS = "u long, v long"


def _with_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the set to (block, half, key)."""
    return members.join(sets, "key").select("block", "half", "key", "set")


def _stars(links: DataFrame) -> DataFrame:
    """(node, component) of links that join each node to the first of its component already."""
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of all blocks; half 1 are members, half 0 (if any) the probes matched against them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, half = table.column("key").to_numpy(), table.column("half").to_numpy()
        _, first = np.unique(key, return_index=True)
        if (half == 0).any():  # a class that is probe and member at once stays a probe
            first = np.array([next((j for j in np.flatnonzero(key == key[i]) if half[j] == 0), i) for i in first])
        lists = table.column("set").combine_chunks()
        values, offs = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets = [values[offs[i] : offs[i + 1]] for i in first]
        probes = half[first] == 0
        label, _ = tree_join(sets, percent, probes if probes.any() else None)
        k = key[first]
        _, root = np.unique(label, return_index=True)
        top = dict(zip(label[root].tolist(), k[root].tolist(), strict=True))
        v = np.array([top[x] for x in label.tolist()], np.int64)
        return pa.table({"u": pa.array(k[k != v]), "v": pa.array(v[k != v])})

    return rows.groupBy("block").applyInArrow(tidy_group(run), _LINKS)


def jaccard_components(df: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, class_size.

    Documents link when 100 * |A and B| >= ``percent`` * |A or B| of their distinct ``n``-word shingle
    sets (of fewer words: the whole sequence as one). ``component_id`` is the smallest id reachable.
    Null and empty texts have no shingles, link with nothing and keep their own id; repeated rows
    share a class; a null id is never smallest unless all are null; empty tables give no rows;
    further columns are ignored. Blocks of one candidate group have a bounded size: larger groups
    are dealt out at random, each block with the group's first class, and only what that leaves
    apart is matched block by block.
    """
    small_batches(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    own = stored(document_sets(docs, n), "sets")
    classes = own.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n_shingles"))
    scratch: list[DataFrame] = []
    stored_ = lambda x, name: stored(x, name, scratch=scratch)
    classes = stored_(classes, "classes")
    sets = promising(docs, classes, n, percent, scratch)
    tied = stored_(candidates(sets, percent, scratch), "tied")
    groups = stored_(components(tied), "groups")
    # only large groups are named, so that a group's rows need not meet
    sized = stored_(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("cuts")).where("cuts > 1"), "sized")
    cuts = F.coalesce("cuts", F.lit(1))
    cut = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), cuts)
    placed = stored_(groups.join(sized, "component", "left").select(F.col("component").alias("group"), cuts.alias("cuts"), cut.alias("cut"), F.col("node").alias("key")), "placed")
    block = lambda *c: F.xxhash64("group", *c)
    first = placed.where("key = group and cuts > 1").select("group", "key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    rows = placed.select(block("cut").alias("block"), F.lit(1).alias("half"), "key").unionByName(first.select(block("cut").alias("block"), F.lit(1).alias("half"), "key"))
    links = stored_(_joined(_with_sets(rows, sets), percent), "links")
    large = placed.where("cuts > 1")
    if large.isEmpty():
        found = _stars(links)
    else:
        found = components(links)
        apart = large.join(found, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key"))
        main = apart.where("key = group").select("group", F.col("part").alias("main"))
        left = stored_(apart.join(main, "group").where("part <> main").select("group", "cuts", "key"), "left")
        some = left.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("probe_cuts"))
        probes = left.join(some, "group").withColumn("p", F.pmod(F.xxhash64(F.col("key"), F.lit(11)), F.col("probe_cuts")))
        probes = probes.select("group", "p", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "key").select(block("p", "cut").alias("block"), F.lit(0).alias("half"), "key")
        against = placed.join(some, "group").select("group", "cut", F.explode(F.sequence(F.lit(0), F.col("probe_cuts") - 1)).alias("p"), "key")
        against = against.select(block("p", "cut").alias("block"), F.lit(1).alias("half"), "key")
        more = _joined(_with_sets(probes.unionByName(against), sets), percent)
        found = components(stored_(links.unionByName(more), "links"))
    # classes of one document without links keep their own id, so only the others are joined to documents
    linked = classes.join(stored_(found, "found"), F.col("key") == F.col("node"), "left").where("node IS NOT NULL OR class_size > 1")
    linked = linked.withColumn("part", F.coalesce("component", "key"))
    least = linked.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = stored(linked.join(least, "part").select("key", "component_id", "class_size"), "named")
    out = own.where("n_shingles > 0").join(named, "key", "left").unionByName(own.where("n_shingles = 0").selectExpr("*", "CAST(NULL AS BIGINT) AS component_id", "CAST(NULL AS BIGINT) AS class_size"))
    discard(*scratch)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deduplicate(df: DataFrame, **options: object) -> DataFrame:
    """``df`` with one document of each component left: that with the smallest id; same columns.

    Rows without shingles and rows with a null id stay; a repeated row of the kept document stays
    once.
    """
    parts = jaccard_components(df, **options)
    gone = stored(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return without(df, options.get("id_col", "doc_id"), gone, "_gone")
