"""Quality classifier: kernel ridge by random Fourier features, calibrated by isotonic regression.

Document statistics are measured where the text is read. Cosines of random projections
approximate a Gaussian kernel over them; each task sums its part of the normal equations,
the driver solves a system whose size is a parameter, and a monotone step function over a
histogram of raw scores turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import blocks, mix, windows, words_of

FEATURES = (
    "log_words word_length word_length_sd long_words upper capital_words digits exclaim pipes symbols punctuation "
    "non_ascii spaces line_breaks words_a_line distinct_words top_word repeated_triples repeated_words letters"
).split()
#: Raw scores are counted in bins of 1 / BINS from LOW on; both are fixed, so the driver gets at most SPAN * BINS rows.
LOW, SPAN, BINS = -1.0, 3, 1024


def _in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_UPPER, _LOWERCASE, _DIGIT = _in(bytes(range(65, 91))), _in(bytes(range(97, 123))), _in(b"0123456789")
_CLASSES = {"digits": _DIGIT, "exclaim": _in(b"!"), "pipes": _in(b"|"), "symbols": _in(b"#*$%&<>@^~"), "punctuation": _in(b".,;:?'\"()-")}


def features(col: pa.Array) -> np.ndarray:
    """Statistics of every text of a column (``FEATURES``), in [0, 1] or on a log scale; zeros for an empty text."""
    w = words_of(col)
    n, docs = np.diff(w.bounds), len(col)
    one, size = np.maximum(n, 1), np.maximum(np.diff(w.offsets), 1)
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    of_words = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.bounds])
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    lens = (chars[w.ends] - chars[w.starts]).astype(float)
    mean = of_words(lens) / one
    doc = np.repeat(np.arange(docs), n)
    upper = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
    lower = np.concatenate([[0], np.cumsum(_LOWERCASE[w.data])])
    caps = (upper[w.ends] - upper[w.starts] > 1) & (lower[w.ends] == lower[w.starts])
    h = w.hashes()
    salt = np.uint64(0x9E3779B97F4A7C15)
    _, where, count = np.unique(mix(h + doc.astype(np.uint64) * salt), return_index=True, return_counts=True)
    distinct = np.bincount(doc[where], minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, doc[where], count)
    win, at = windows(h, w.bounds, 3)
    _, inverse, many = np.unique(mix(win + doc[at].astype(np.uint64) * salt), return_inverse=True, return_counts=True)
    triples = np.bincount(doc[at[many[inverse] > 1]], minlength=docs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    breaks = per_doc(w.data == 10)
    got = {
        "log_words": np.log1p(n), "word_length": np.log1p(mean), "word_length_sd": np.log1p(np.sqrt(np.maximum(of_words(lens**2) / one - mean**2, 0))),
        "long_words": of_words(lens > 12) / one, "upper": per_doc(_UPPER[w.data]) / size, "capital_words": of_words(caps) / one,
        "non_ascii": per_doc(w.data >= 128) / size, "spaces": per_doc(w.data == 32) / size, "line_breaks": np.log1p(breaks),
        "words_a_line": np.log1p(n / (1 + breaks)), "distinct_words": distinct / one, "top_word": top / one,
        "repeated_triples": triples / one, "repeated_words": of_words(again) / one,
        "letters": (per_doc(_UPPER[w.data]) + per_doc(_LOWERCASE[w.data]) + per_doc(w.data >= 128)) / size,
    }
    got |= {k: np.sqrt(per_doc(v[w.data]) / size) for k, v in _CLASSES.items()}
    return np.stack([np.asarray(got[k], float) for k in FEATURES], 1)


@dataclass
class Model:
    """Everything a task needs to score; its size depends on the number of cosines only."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(z @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: (place, value) of each pool."""
    pools: list[list[float]] = []
    for x, s, n in zip(at, total, count, strict=True):
        pools.append([s, n, x * n])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, x = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + x]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                x = features(part.column(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["doc_id", "x"])

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return stored(cols.mapInArrow(run, "doc_id long, x array<double>"), "features")


def _normal_equations(rows: DataFrame, model: Model, merges: int = 16) -> np.ndarray:
    """Sums of (cosines, y) products over rows (x, y): one packed row a task, merged before the driver adds ``merges`` of them."""
    size = len(model.phase) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size, size + 1))
        for batch in batches:
            z = model.cosines(_matrix(batch, 0))
            a += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % merges], pa.int64()), pa.array([a.tobytes()], pa.binary())], names=["k", "a"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(size * (size + 1))
        for batch in batches:
            for x in batch.column(1):
                a += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["a"])

    parts = rows.select("x", "y").mapInArrow(sums, "k long, a binary").repartition(merges, "k").mapInArrow(merged, "a binary")
    return sum(np.frombuffer(r.a, np.float64) for r in parts.collect()).reshape(size, size + 1)


def solve(a: np.ndarray, rows: int, ridge: float) -> np.ndarray:
    """Ridge weights from the normal equations of so many rows; the constant is not penalised."""
    penalty = ridge * rows * np.eye(len(a))
    penalty[-1, -1] = 0
    return np.linalg.solve(a[:, :-1] + penalty / (len(a) - 1), a[:, -1])


def fit(train: DataFrame, *, cosines: int = 192, width: float = 5.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on ``train`` (x array<double>, y double); with no rows the model scores 0.5 everywhere.

    A quarter of the rows, told by a hash of their statistics, is kept from the ridge fit and
    calibrates it; with no rows on one of the two sides all rows do both.
    """
    d = len(FEATURES)
    part = F.pmod(F.xxhash64("x"), F.lit(4)) == 0
    moments = train.agg(
        F.count("*").alias("n"),
        F.count_if(part).alias("calibrates"),
        *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)],
        *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)],
    ).first()
    rng = np.random.default_rng(seed)
    project, phase = rng.normal(0, 1 / width, (d, cosines)), rng.uniform(0, 2 * np.pi, cosines)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), project, phase)
    scale = np.array([moments[f"s{k}"] for k in range(d)])
    model = Model(np.array([moments[f"m{k}"] for k in range(d)]), np.where(scale > 1e-9, scale, 1.0), project, phase)
    apart = 0 < moments["calibrates"] < moments["n"]
    learns, calibrates = (train.where(~part), train.where(part)) if apart else (train, train)
    model.weights = solve(_normal_equations(learns, model), moments["n"] - (moments["calibrates"] if apart else 0), ridge)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.clip(((model.raw(_matrix(batch, 0)) - LOW) * BINS).astype(int), 0, SPAN * BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(1)], names=["k", "y"])

    # SPAN * BINS rows at most reach the driver
    bins = calibrates.select("x", "y").mapInArrow(binned, "k long, y double").groupBy("k").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    rows = np.array(sorted(tuple(r) for r in bins.collect()))
    model.steps = isotonic(LOW + (rows[:, 0] + 0.5) / BINS, rows[:, 1], rows[:, 2])
    return model


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", **options: float) -> DataFrame:
    """Score every row of ``df`` by a model learned from labelled rows outside the held-out third.

    A row is held out when crc32 of its id as text, modulo 3, is 1. Only statistics of the text enter
    a score. Null and empty texts score as a text without words; null labels or ids teach nothing;
    repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
    """
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    measured = measure(df)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).where("y is not null")
    train = stored(measured.where(~held(F.col("doc_id"))).join(known, "doc_id").select("x", "y"), "train")
    scored = apply(measured, fit(train, **options))
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", "predicted")
