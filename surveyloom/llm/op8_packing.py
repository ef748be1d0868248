"""Vector bin packing of tokenised documents into fixed-length training sequences.

Every document becomes its token ids plus an end token and is cut into pieces; a piece
is a vector (tokens, one segment, loss-bearing tokens). Each task packs the documents of
its partition: of the open pieces the one with the largest dot product between its vector
and what the sequence has left goes in next; when no whole piece fits, pieces are cut to fill
the rest. The loss limit may be one for instruction data alone, which holds for sequences that
hold prompts; prompts are then brought together so that such sequences are full too. Only where what a task
has left, or a limit of segments, cannot fill a sequence, it is cut back to a power of two,
which needs no padding. Nothing is shuffled, a task holds a bounded number of documents, and
a retried task rebuilds the same sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks
from .workers import small_batches, tidy

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)
#: Units whose ids a task remembers; a full memory is emptied, which changes no result.
REMEMBERED = 300_000


class Encoder:
    """Token ids as the tokenizer file gives them, found once per space-led unit of text.

    The byte-level pattern ends a token before every space that a non-space follows, so such
    units are encoded apart: the new ones of a block in one go, by the same vocabulary as
    ranks, then split at their spaces. A text with other spaces is encoded whole, one with a
    special token's string by the tokenizer itself. The tests compare all with the tokenizer.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = self.whole.get_added_tokens_decoder()
        self.size = np.zeros(max(*table.values(), *added) + 1, np.int64)
        self.size[list(added)] = [len(x.content.encode()) for x in added.values()]
        self.size[list(table.values())] = [len(x) for x in table]
        self.part = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def inside(self, ids: np.ndarray, size: int) -> int:
        """How many of the first tokens end within the first ``size`` bytes of their text."""
        return int(np.searchsorted(np.cumsum(self.size[ids]), size, side="right"))

    def _ids(self, text: str) -> np.ndarray:
        return self.part.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def _learn(self, new: set[str]) -> None:
        plain = []
        for x in new:
            if not x or x[0].isspace():
                self.known[x] = None
            else:
                plain.append(x)
        if plain:
            text = " " + " ".join(plain)
            ids = self._ids(text)
            spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            cuts = np.searchsorted(np.cumsum(self.size[ids]) - self.size[ids], spaces) * 4
            raw, cuts = ids.tobytes(), [*cuts.tolist(), 4 * len(ids)]
            self.known.update({x: raw[a:b] for x, a, b in zip(plain, cuts, cuts[1:], strict=False)})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text of a block."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [t.split(" ") for t in texts]
        firsts = [units.pop(0) for units in split]
        self._learn(set().union(*split).difference(self.known))
        out, get = [], self.known.__getitem__
        for text, first, units in zip(texts, firsts, split, strict=True):
            if any(x in text for x in self.special):
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            try:
                out.append(np.frombuffer(self._ids(first).tobytes() + b"".join(map(get, units)), "<u4"))
            except TypeError:  # a unit without ids of its own
                out.append(self._ids(text))
        return out


class Packer:
    """Documents waiting in one task, and the sequences made of them so far."""

    def __init__(self, room: int, segments: int, loss: int, base: int, plain_loss: int | None = None):
        self.room, self.plain_loss = room, loss if plain_loss is None else plain_loss
        self.caps = np.array([room, segments, loss], np.float64)
        self.sequence, self.rows, self.open, self.tokens = base, [], [], 0

    def add(self, doc_id: int, ids: np.ndarray, masked: int = 0) -> None:
        """Queue one document; its first ``masked`` tokens bear no loss."""
        self.open.append([doc_id, ids, 0, min(masked, len(ids))])
        self.tokens += len(ids)

    def _close(self, chosen: list[tuple[int, int]]) -> None:
        """Write one sequence from (open piece, tokens of it to take), cut back to a power of two unless it is full."""
        total = sum(n for _, n in chosen)
        rest = self.room if total >= self.room else 1 << (total.bit_length() - 1)
        self.tokens -= rest
        offset = 0
        for k, most in chosen:
            length = min(most, rest)
            if not length:
                break
            doc_id, ids, at, masked = self.open[k]
            lossy = length - min(max(0, masked - at), length)
            crc = zlib.crc32(ids[at : at + length].tobytes())
            self.rows.append((doc_id, at, length, crc, len(ids), self.sequence, offset, lossy))
            self.open[k][2] += length
            offset += length
            rest -= length
        self.open = [p for p in self.open if p[2] < len(p[1])]
        self.sequence += 1

    def fill(self, last: bool = False) -> bool:
        """Fill one sequence; False if what waits cannot fill one yet (never with ``last``).

        With ``plain_loss`` as large as the room, text without a prompt, and what follows a prompt that stands
        in an earlier sequence, fills sequences of its own. A sequence with prompts takes documents with prompts until their prompts make
        up what must bear no loss, then any. Whole pieces go by the dot-product rule, then pieces are cut to
        fill the rest. Where too few prompts wait they wait on; the task's last sequences take them as they are.
        """
        left_of = np.array([len(ids) - at for _, ids, at, _ in self.open], np.float64)
        free = np.array([max(0, m - at) for _, _, at, m in self.open], np.float64)
        quiet = self.room - self.caps[2]  # tokens without loss that a full sequence must have
        mixed = quiet <= 0 or self.plain_loss < self.room or (free.any() and free.sum() >= quiet and left_of.sum() >= self.room)
        if not mixed and left_of[free == 0].sum() < self.room:
            if not last:
                return False
            mixed = bool(free.any())
        caps = self.caps if mixed else np.array([self.room, self.caps[1], self.room], np.float64)
        need = np.stack([left_of, np.ones(len(left_of)), left_of - free], 1)
        weight, gap, chosen = need / caps, caps.copy(), []
        live = np.ones(len(need), bool) if mixed else free == 0

        def put(k: int, length: float) -> None:
            chosen.append((k, int(length)))
            gap[:] -= (length, 1, max(0.0, length - free[k]))
            live[k] = False

        if mixed and self.plain_loss >= self.room and 0 < free.sum() < quiet:  # at the end: all prompts that are left, at once
            for k in np.flatnonzero(free)[: int(caps[1]) - 1]:
                put(int(k), min(free[k], gap[0]))
        while gap[0] >= 1 and gap[1] >= 1 and live.any():
            some = live & (free > 0) if mixed and gap[0] > gap[2] and (live & (free > 0)).any() else live
            fits = some & (need <= gap).all(1)
            if gap[1] == 1 or not fits.any():
                most = np.where(some, np.minimum(np.minimum(left_of, gap[0]), free + gap[2]), 0)
                k = int(most.argmax())
                if most[k] < 1:
                    break
                put(k, most[k])
            else:
                k = int(np.where(fits, weight @ (gap / caps), -1.0).argmax())
                put(k, left_of[k])
        self._close(chosen)
        return True

    def drain(self, waiting: int) -> None:
        """Fill sequences until at most ``waiting`` documents, of ``waiting`` sequences' tokens, wait (or too few to fill one)."""
        while self.open and (len(self.open) > waiting or self.tokens > waiting * self.room):
            if not self.fill(last=not waiting):
                break

    def take(self) -> pa.RecordBatch:
        """The rows made since the last call."""
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=names)


def first_line_bytes(text: Column) -> Column:
    """Bytes of a text's first line with its line end, where more text follows; else 0."""
    at = F.instr(text, "\n")
    return F.when((at > 0) & (at < F.length(text)), F.octet_length(F.substring(text, 1, at))).otherwise(0)


def pack(
    df: DataFrame,
    tokenizer: str,
    ranks: str,
    pattern: str,
    *,
    end_id: int = 1,
    room: int = 2048,
    segments: int = 64,
    loss: int = 2048,
    plain_loss: int | None = None,
    waiting: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_bytes: Column | None = None,
) -> DataFrame:
    """Pack ``df`` into sequences of at most ``room`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens.

    One row per piece (``SCHEMA``). A null or empty text is the end token alone; a repeated row is
    packed as often as it stands there; an empty table gives no rows; other columns are ignored.
    Every sequence is full or has a length that is a power of two. ``prompt_bytes`` tells how many
    of a text's first bytes are a prompt; tokens inside it bear no loss (null: none). ``room`` must
    be a power of two and ``loss`` positive. ``plain_loss`` is the limit of sequences without a prompt
    (``loss`` unless given); with ``room`` itself no sequence stays half empty for want of prompts. A task holds about ``waiting`` documents beside the
    block of texts at hand; while too few prompts wait to fill a sequence, up to ``room - loss`` documents
    more.
    """
    if room < 1 or room & (room - 1) or segments < 1 or loss < 1:
        raise ValueError("room must be a power of two, segments and loss positive")
    small_batches(df.sparkSession)
    prompt = F.lit(0) if prompt_bytes is None else F.coalesce(prompt_bytes, F.lit(0))
    cols = [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), prompt.cast("long").alias("prompt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks, pattern)
        packer = Packer(room, segments, loss, TaskContext.get().partitionId() << 40, plain_loss)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in blocks(batch, most=1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids, size in zip(part.column(0).to_pylist(), encoder.ids(texts), part.column(2).to_pylist(), strict=True):
                    packer.add(doc, np.concatenate([ids, end]), encoder.inside(ids, size) if size > 0 else 0)
                    packer.drain(waiting)
            yield packer.take()
        packer.drain(0)
        yield packer.take()

    return df.select(*cols).mapInArrow(tidy(run), SCHEMA)
