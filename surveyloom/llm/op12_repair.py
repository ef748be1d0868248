"""Conversation structure repair as lightest derivations.

A repair is a derivation: an item says that the first rows of a conversation can be rewritten so that
the output so far is nothing, or ends in a system, user or assistant turn; keeping, re-roling or
deleting the next row, or inserting a turn, deduces a further item. A derivation weighs (cost, audit),
added and appended edit by edit, which is monotone, so Knuth's agenda pops items lightest first, each
is final when popped, and the repair is found when the goal item is. Runs of rows are solved apart for
every state they may start in; their results are deductions of the same kind, one run a step, so a
conversation of any length is put together some runs at a time and no task holds its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: What the output so far is: nothing, or its last turn's role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Rows of a run, and results that one step puts together.
RUN, FAN_IN = 256, 64
INSERT, REROLE, DELETE, OPEN_END = 2, 2, 3, 1
Edges = Callable[[int, int], Iterable[tuple[int, int, int, str]]]
Weight = tuple[int, str]


def lightest(n: int, start: int, edges: Edges) -> dict[int, Weight]:
    """The lightest derivation of every item (n, state) from the axiom (0, start).

    ``edges(i, state)`` gives (i, state, cost, audit) of each deduction with that antecedent.
    """
    final: dict[tuple[int, int], Weight] = {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    goals = 4
    while agenda and goals:
        cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        goals -= i == n
        for j, t, more, edit in edges(i, state):
            if (j, t) not in final:
                heappush(agenda, (cost + more, audit + edit, j, t))
    return {t: final[n, t] for t in range(4) if (n, t) in final}


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=50_000)
def solve_rows(rows: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, audit) of the lightest repairs of a run of rows.

    Each row is a character: s, u, a, or o for other roles; upper case if its end is open; x if it must go.
    """

    def edges(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        wanted = _next(state)
        yield i, wanted, INSERT, "I"
        if i == len(rows):
            return
        yield i + 1, state, DELETE, "D"
        row = rows[i]
        if row == "x":
            return
        role, penalty = row.lower(), OPEN_END if row.isupper() else 0
        if role == ("a" if wanted == ASSISTANT else "u"):
            yield i + 1, wanted, penalty, "K"
        elif role == "s" and state == START:
            yield i + 1, SYSTEM, penalty, "K"
        yield i + 1, wanted, REROLE + penalty, "R"

    return tuple((s, t, *w) for s in range(4) for t, w in sorted(lightest(len(rows), s, edges).items()))


def join_runs(charts: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The same of adjacent runs put together."""
    if len(charts) == 1:
        return charts[0]
    ways: list[dict[int, list[tuple[int, int, str]]]] = [{} for _ in charts]
    for way, chart in zip(ways, charts, strict=True):
        for s, t, cost, audit in chart:
            way.setdefault(s, []).append((t, cost, audit))

    def edges(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        if i < len(ways):
            for t, cost, audit in ways[i].get(state, ()):
                yield i + 1, t, cost, audit

    return [(s, t, *w) for s in range(4) for t, w in sorted(lightest(len(ways), s, edges).items())]


def best(chart: Iterable[tuple[int, int, int, str]]) -> Weight:
    """The lightest repair of a whole conversation: it starts from nothing and ends there or after an assistant."""
    return min((cost, audit) for s, t, cost, audit in chart if s == START and t in (START, ASSISTANT))


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns; ``rows`` are read one at a time."""
    state, names = START, {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = _next(state)
            role = role if edit == "K" else names[state]
        yield role, text


_COUNTS = "n blank duplicate truncated illegal turns".split()
_RUN = "conv_id long, at long, first string, last string, low long, high long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", chart array<struct<s:int,t:int,cost:long,audit:string>>"
_RUN_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), *[(c, pa.int64()) for c in _COUNTS]]
    + [("chart", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Part:
    """Counts and lightest repairs of adjacent rows of one conversation."""

    def __init__(self, conv_id: int | None, at: int):
        self.conv_id, self.at, self.first, self.last = conv_id, at, None, None
        self.low = self.high = None
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.chart: list = []

    def _touch(self, first: str, last: str, low: int | None, high: int | None, turns: int) -> None:
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.illegal += 1
        self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def row(self, turn: int | None, initial: str, fault: str | None) -> str:
        """Count one row; the character that stands for it."""
        self._touch(initial, initial, turn, turn, 1)
        self.n += 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if fault in ("blank", "duplicate"):
            return "x"
        role = initial if initial in ("s", "u", "a") else "o"
        return role.upper() if fault else role

    def part(self, other: dict) -> None:
        """Count a later part."""
        self._touch(other["first"], other["last"], other["low"], other["high"], other["turns"])
        for c in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + other[c])

    def record(self) -> dict:
        chart = [{"s": s, "t": t, "cost": c, "audit": a} for s, t, c, a in self.chart]
        return {c: getattr(self, c) for c in ("conv_id", "at", "first", "last", "low", "high", *_COUNTS)} | {"chart": chart}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 1 + sum(len(c["audit"]) for c in r.get("chart") or ()) // 1000 + len(r.get("text") or "") // 1000
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the rows of a task, which come ordered by conversation and place in it."""

    def runs() -> Iterator[dict]:
        part, rows = None, []
        for batch in batches:
            for conv_id, at, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or part.conv_id != conv_id or len(rows) == RUN:
                    if part:
                        part.chart = solve_rows("".join(rows))
                        yield part.record()
                    part, rows = _Part(conv_id, at), []
                rows.append(part.row(turn, initial, fault))
        if part:
            part.chart = solve_rows("".join(rows))
            yield part.record()

    yield from _batches(runs(), _RUN_ARROW)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring results of the same conversation and group put together; they come ordered."""

    def parts() -> Iterator[dict]:
        part, group, charts = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if part is None or (part.conv_id, group) != (r["conv_id"], r["grp"]):
                    if part:
                        part.chart = join_runs(charts)
                        yield part.record()
                    part, group, charts = _Part(r["conv_id"], r["grp"]), r["grp"], []
                part.part(r)
                charts.append([(c["s"], c["t"], c["cost"], c["audit"]) for c in r["chart"]])
        if part:
            part.chart = join_runs(charts)
            yield part.record()

    yield from _batches(parts(), _RUN_ARROW)


def rows_of(turns: DataFrame, tie: Column | None = None) -> DataFrame:
    """(conv_id, ord, turn, role, text) of all rows, written in their order: by conv_id, turn (nulls first), role, text and ``tie``.

    ``ord`` rises along the table; a long conversation lies in many of its pieces.
    """
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")]
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    flat = turns.select(*cols, (F.lit(0) if tie is None else tie).alias("tie"))
    placed = flat.repartitionByRange(*key[:3], F.substring("text", 1, 32), F.col("tie")).sortWithinPartitions(*key)
    return stored(placed.select("conv_id", F.monotonically_increasing_id().alias("ord"), "turn", "role", "text"), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, ord, turn, initial, fault): the first fault of each row of ``rows_of``.

    blank: no character but space and 0x09-0x0D; duplicate: its role and text stand earlier in the
    conversation (compared by two 64-bit hashes); truncated: its last such character is not . ! or ?
    """
    spaces = r"[\x20\x09-\x0D]"
    marked = rows.select(
        "conv_id", "ord", "turn", F.substring("role", 1, 1).alias("initial"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{spaces}*\z")).alias("open"),
    )
    first = marked.where("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("a").alias("p"), F.col("b").alias("q")).agg(F.min("ord").alias("first"), F.count("*").alias("many")).where("many > 1")
    told = marked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("ord") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return told.select("conv_id", "ord", "turn", "initial", fault.alias("fault"))


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows_of``."""
    told = faults(rows).repartitionByRange("ord").sortWithinPartitions("ord")
    parts = stored(told.select("conv_id", "ord", "turn", "initial", "fault").mapInArrow(_cut, _RUN), "runs")
    while True:
        # a conversation's runs get their numbers from those of all others with several: few rows beside the table
        several = parts.groupBy("conv_id").agg(F.count("*").alias("many"), F.min("at").alias("least")).where("many > 1")
        if several.isEmpty():
            break
        parts = stored(_level(parts, several), "runs")
    return parts.mapInArrow(_told, _SUMMARY)


def _level(parts: DataFrame, several: DataFrame) -> DataFrame:
    """One level of joins: up to about FAN_IN neighbouring results of a conversation become one."""
    number = parts.select("conv_id", "at").join(several.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    number = number.select(F.col("conv_id").alias("c"), F.col("at").alias("p"), F.expr(f"(row_number() OVER (PARTITION BY conv_id ORDER BY at) - 1) DIV {FAN_IN}").alias("grp"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("p"))
    grouped = parts.join(number, on, "left").select(*parts.columns, F.coalesce("grp", F.lit(0)).cast("long").alias("grp"))
    return grouped.repartition("conv_id", "grp").sortWithinPartitions("conv_id", "grp", "at").mapInArrow(_join, _RUN)


_SUMMARY_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()], ("audit", pa.string())])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                cost, audit = best((c["s"], c["t"], c["cost"], c["audit"]) for c in r["chart"])
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
                yield {c: r[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}

    yield from _batches(rows(), _SUMMARY_ARROW)


def _with_audit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All rows of each conversation in one task in their order, its audit first."""
    head = found.select("conv_id", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = head.unionByName(rows.select("conv_id", "ord", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "ord")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str]]:
    """(conv_id, k, role, text) of repaired turns, k from 0; k is -1 once before each conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead:
        conv_id, audit, ended = ahead[0], ahead[3], False

        def own() -> Iterator[tuple[str, str]]:
            nonlocal ahead, ended
            for ahead in rows:
                if ahead[1] < 0:
                    return
                yield ahead[2], ahead[3]
            ended = True

        mine = own()
        yield conv_id, -1, "", ""
        for k, (role, text) in enumerate(replay(audit, mine)):
            yield conv_id, k, role, text
        for _ in mine:  # only to reach the next conversation
            raise AssertionError("an audit ended before its rows")
        if ended:
            return


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, k, role, text): the repaired turns of every conversation, ``k`` from 0. Rows stream through their task."""
    schema = pa.schema([("conv_id", pa.int64()), ("k", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((dict(zip(schema.names, r, strict=True)) for r in _turns(batches) if r[1] >= 0), schema)

    return _with_audit(rows, found).mapInArrow(run, "conv_id long, k long, role string, text string")


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired `role:text` lines, joined by line feeds; rows stream through their task."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv_id, digest = None, None
        for c, k, role, text in _turns(batches):
            if k < 0:
                if digest:
                    yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}
                conv_id, digest = c, hashlib.sha256()
            else:
                digest.update((("\n" if k else "") + f"{role}:{text}").encode())
        if digest:
            yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(hashes(batches), schema)

    return _with_audit(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32(`conv_id:turn`) % 20, nulls written as one space; ``tie`` orders a repeated row after itself.

    0 drops the row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes it a user's.
    """
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("tie")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``turns`` has conv_id, turn, role, text; an integer column ``tie`` orders equal rows of a turn, other
    columns are ignored. ``ids`` may name conversations (conv_id) that have no rows left: zeros, an empty
    audit and the hash of nothing. Null roles and texts count as one space, null turns come first, rows
    with a null conv_id form one conversation; an empty table gives no rows.
    """
    rows = rows_of(turns, F.col("tie") if "tie" in turns.columns else None)
    found = stored(repairs(rows), "repairs")
    told = found.join(repaired_hashes(rows, found).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    if ids is None:
        return told
    every = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
