"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern and each match is merged apart. The matches of a block
that a task has not met yet lie in one linked list of parts, in which no pair crosses a match's end.
Every merge rank has a bucket of list positions, and a bitmap over the ranks, with a bitmap over its
words and so on, gives the lowest rank that has positions by find-first-set. A merge changes its
neighbours' pairs; their old entries stay and are skipped when they come up. A match of n bytes so
takes about n steps, where scanning for the lowest pair each time takes their square.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import blocks

#: Units of text whose ids a task remembers, and their bytes; a full memory is emptied, which changes no result.
REMEMBERED, REMEMBERED_BYTES = 800_000, 32 << 20
#: Characters of a text that is put together at once; longer ones go through in so many matches.
PORTION = 1 << 17
BITS = 64
#: Positions of one rank from which they are merged together, by arrays.
WIDE = 40


class RankQueue:
    """A set of (rank, position); positions of one rank share a bucket, the lowest rank is found by bitmaps."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // BITS)
            self.levels.append([0] * ranks)
            if ranks <= 1:
                break

    def fill(self, ranks: np.ndarray) -> None:
        """Start with position k at rank ranks[k], -1 for none."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[at])) + 1
        for bucket in np.split(at, cuts) if len(at) else []:
            rank = int(ranks[bucket[0]])
            self.buckets[rank] = [bucket]
            self._mark(rank)

    def _mark(self, at: int) -> None:
        for level in self.levels:
            word, bit = divmod(at, BITS)
            before = level[word]
            level[word] = before | (1 << bit)
            if before:
                return
            at = word

    def lowest(self) -> int:
        """The lowest rank that has a bucket, -1 if none has."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at * BITS + (word & -word).bit_length() - 1
        return at

    def take(self, rank: int, pair: np.ndarray) -> np.ndarray | list[int]:
        """A rank's positions, taken out in ascending order; of many, those at which ``pair`` has another rank by now stay out."""
        bucket = self.buckets.pop(rank)
        self._clear(rank)
        wide = [x for x in bucket if not isinstance(x, int)]
        if not wide and len(bucket) < WIDE:
            bucket.sort()
            return bucket
        if len(wide) < len(bucket):
            wide.append(np.array([x for x in bucket if isinstance(x, int)]))
        at = np.concatenate(wide) if len(wide) > 1 else wide[0]
        at = at[pair[at] == rank]
        return at if len(wide) == 1 and wide[0] is bucket[0] else np.unique(at)

    def push_many(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push positions[k] at ranks[k], for those with a rank."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        ranks, positions = ranks[at], positions[at]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        names, single = ranks[cuts[:-1]].tolist() if len(at) else [], positions.tolist()
        for rank, low, high in zip(names, cuts, cuts[1:], strict=False):
            if high - low < WIDE:
                bucket = self.buckets.get(rank)
                if bucket is None:
                    self.buckets[rank] = single[low:high]
                    self._mark(rank)
                else:
                    bucket.extend(single[low:high])
            else:
                self.push(rank, positions[low:high])

    def push(self, rank: int, position: int | np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self._mark(rank)
        else:
            bucket.append(position)

    def _clear(self, at: int) -> None:
        for level in self.levels:
            word, bit = divmod(at, BITS)
            level[word] &= ~(1 << bit)
            if level[word]:
                return
            at = word


class Bpe:
    """The ranks of a vocabulary file, its pattern and the ids remembered so far."""

    def __init__(self, ranks: str, pattern: str):
        import regex

        with open(ranks, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([x])] for x in range(256)], np.int32)
        self.pair = np.full(1 << 16, -1, np.int32)
        for token, rank in self.rank.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        size = len(self.token)
        halves = [(self.rank[t[:k]] * size + self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.halves, self.joined = (x[np.argsort(y)] for y in (np.array([k for k, _ in halves]),) for x in (y, np.array([r for _, r in halves], np.int32)))
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(len(self.token))
        self.known: dict[str, bytes | None] = {}
        self.matches: dict[str, bytes] = {}
        self.known_bytes = 0
        self.size = np.array([len(t) for t in self.token])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def merge(self, matches: list[bytes]) -> list[bytes]:
        """The ids of each match: in it the pair of lowest rank is merged, of equal ones the leftmost, till none is left."""
        data = b"".join(matches)
        n, sizes = len(data), np.array([len(m) for m in matches])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8)
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.pair[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ranks[ends - 1] = -1
        edge = np.zeros(n + 1, np.uint8)
        edge[0] = edge[ends] = 1
        first = edge.tobytes()  # 1 where a match starts, and at the end
        places = np.arange(-1, n + 1, dtype=np.int32)
        after, before = array("i", places[2:].tobytes()), array("i", places[:-1].tobytes())
        pair, token = array("i", ranks.tobytes()), array("i", self.byte[raw].tobytes())
        alive = bytearray(b"\1") * n
        self.queue.fill(ranks)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        views = [np.frombuffer(x, np.int32) for x in (after, before, pair, token)]
        views += [np.frombuffer(alive, np.uint8), edge]
        now = views[2]
        rank, queue, push = self.rank.get, self.queue, self.queue.push
        while (r := queue.lowest()) >= 0:
            bucket = queue.take(r, now)
            if len(bucket) >= WIDE and self._merge_wide(r, bucket, of, *views):
                continue
            bucket = bucket if isinstance(bucket, list) else bucket.tolist()
            for k, i in enumerate(bucket):
                if pair[i] != r:
                    continue  # stale: one of the two parts has been merged since
                gone = after[i]
                end = after[i] = after[gone]
                alive[gone] = 0
                token[i] = r
                pair[gone] = q = -1
                lower = False
                if not first[end]:
                    before[end] = i
                    q = rank(data[i : after[end]], -1)
                    if q >= 0:
                        push(q, i)
                        lower = q < r
                pair[i] = q
                if not first[i]:
                    left = before[i]
                    pair[left] = q = rank(data[left:end], -1)
                    if q >= 0:
                        push(q, left)
                        if q < r:
                            lower = True
                if lower:  # a part made by this merge goes before the rest of its match
                    for i in bucket[k + 1 :]:
                        push(r, i)
                    break
        left = np.flatnonzero(np.frombuffer(alive, np.uint8))
        ids = np.frombuffer(token, np.int32)[left].astype("<u4").tobytes()
        cuts = (np.searchsorted(left, ends) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _rank_of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The rank of parts joined, -1 for none."""
        key = left * np.int64(len(self.token)) + right
        at = np.minimum(np.searchsorted(self.halves, key), len(self.halves) - 1)
        return np.where(self.halves[at] == key, self.joined[at], -1)

    def _merge_wide(self, r: int, at: np.ndarray, of: np.ndarray, after: np.ndarray, before: np.ndarray, pair: np.ndarray, token: np.ndarray, alive: np.ndarray, first: np.ndarray) -> bool:
        """Merge the first of ascending positions in each match, which do not touch each other; the rest goes back.

        Where most positions lie in few matches nothing is done, and False is returned.
        """
        match = of[at]
        own = np.ones(len(at), bool)
        own[1:] = match[1:] != match[:-1]
        if 2 * own.sum() < len(own):
            return False
        if not own.all():
            self.queue.push(r, at[~own])
            at = at[own]
        gone = after[at]
        end = after[gone]
        after[at] = end
        alive[gone] = 0
        token[at] = r
        pair[gone] = pair[at] = -1
        inner = first[end] == 0
        i, end = at[inner], end[inner]
        before[end] = i
        pair[i] = right = self._rank_of(r, token[end])
        led = at[first[at] == 0]
        left = before[led]
        pair[left] = ahead = self._rank_of(token[left].astype(np.int64), r)
        self.queue.push_many(np.concatenate([right, ahead]), np.concatenate([i, left]))
        return True

    def _learn(self, units: set[str]) -> None:
        """Find the ids of units of text that are not remembered; None for one that does not stand alone."""
        if len(self.known) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.matches.clear()
            self.known_bytes = 0
        found = {u: self.pattern.findall(" " + u) if u and not u[0].isspace() else None for u in units.difference(self.known)}
        self._match(set().union(*filter(None, found.values())))
        get = self.matches.__getitem__
        self.known.update({u: None if m is None else b"".join(map(get, m)) for u, m in found.items()})
        self.known_bytes += sum(map(len, found))

    def _match(self, matches: set[str]) -> None:
        """Find the ids of matches that are not remembered."""
        new = [(m, m.encode()) for m in matches.difference(self.matches)]
        self.matches.update({m: self.rank[b].to_bytes(4, "little") for m, b in new if b in self.rank})
        rest = [(m, b) for m, b in new if b not in self.rank]
        if rest:
            self.matches.update(zip([m for m, _ in rest], self.merge([b for _, b in rest]), strict=True))
        self.known_bytes += sum(len(b) for _, b in new)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(index of the text, ids) in order; ids are little-endian unsigned 32-bit integers, long texts come in portions.

        A match of the pattern never goes on over a space that a non-space precedes and follows, so texts
        are cut there and the ids of such units remembered; a text with other spaces goes match by match.
        """
        split = [t.split(" ") if len(t) <= PORTION else [""] for t in texts]
        firsts = [units.pop(0) for units in split]
        self._learn(set().union(*split))
        leads = [self.pattern.findall(x) for x in firsts]
        self._match(set().union(*leads))
        get, match = self.known.__getitem__, self.matches.__getitem__
        for k, (text, first, units) in enumerate(zip(texts, leads, split, strict=True)):
            if len(text) <= PORTION and (first or not units):
                try:
                    rest = b"".join(map(get, units))
                except TypeError:  # a unit that does not stand alone
                    pass
                else:
                    yield k, b"".join(map(match, first)) + rest
                    continue
            found = self.pattern.finditer(text)
            while portion := [m.group() for m in islice(found, PORTION)]:
                yield k, self._ids(portion)

    def _ids(self, matches: list[str]) -> bytes:
        self._match(set(matches))
        return b"".join(map(self.matches.__getitem__, matches))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary is an error."""
        at = np.frombuffer(ids, "<u4")
        size = self.size[at]
        end = np.cumsum(size)
        where = np.repeat(self.start[at] - (end - size), size)
        return self.bytes[where + np.arange(len(where))].tobytes()


def encode(df: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ``ids`` are little-endian unsigned 32-bit integers.

    ``ranks`` is a tiktoken vocabulary that has all single bytes. A null or empty text has no ids;
    repeated rows and null doc_ids are rows like others; an empty table gives no rows; other columns
    are ignored. Nothing is shuffled; strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks, pattern)
        for batch in batches:
            for part in blocks(batch, most=8 << 20):
                ids = [b""] * len(part)
                for k, portion in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids[k] += portion
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(df: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of every row of ids as ``encode`` makes them; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks, pattern)
        for batch in batches:
            for part in blocks(batch, text="ids"):
                data = [bpe.decode(x) if x else b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "decoded"])

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("binary").alias("ids"))
    return cols.mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again in one pass.

    As ``encode`` and ``decode``, but ids and bytes are hashed portion by portion and never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks, pattern)
        for batch in batches:
            for part in blocks(batch, most=8 << 20):
                n, ids, data = [0] * len(part), [hashlib.sha256() for _ in range(len(part))], [hashlib.sha256() for _ in range(len(part))]
                for k, portion in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    n[k] += len(portion) // 4
                    ids[k].update(portion)
                    data[k].update(bpe.decode(portion))
                ids, data = ([h.hexdigest() for h in x] for x in (ids, data))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
