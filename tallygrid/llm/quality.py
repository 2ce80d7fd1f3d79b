"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are counts over a text's bytes. Random cosine features of them approximate a Gaussian kernel; each partition
sums its normal equations, Spark adds them up, and the driver solves one small system. A part of the training rows is
kept for calibration: their scores are counted in a histogram and pool-adjacent-violators makes it monotone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, give_back, remainder, row_sums, saved, table

FEATURES = 192
KERNEL_WIDTH = 3.0
RIDGE = 1.0
BINS = 512
THRESHOLD = 0.3
#: Byte classes: lower, upper, digit, space, newline, common punctuation, other ASCII, non-ASCII.
CLASSES = 8
#: Other ASCII marks with a count of their own.
MARKS = b"!|#$%&*<>{}=_/@"
STATS = CLASSES + len(MARKS) + 8


def byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 7
    out[[32, 9, 11, 12]] = 3
    out[[10, 13]] = 4
    out[np.frombuffer(b".,;:?'\"-()", np.uint8)] = 5
    return out


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """STATS numbers for each text, zeros for an empty one: shares of byte classes and marks, lengths, repeats."""
    n_rows = len(at) - 1
    n = np.diff(at).astype(np.float64)
    row = np.repeat(np.arange(n_rows), np.diff(at))
    kind = np.full(256, 0, np.int64)
    kind[:] = byte_classes()
    wide = CLASSES + len(MARKS)
    for k, mark in enumerate(MARKS):
        kind[mark] = CLASSES + k
    counts = np.bincount(row * wide + kind[data], minlength=n_rows * wide).reshape(n_rows, wide).astype(np.float64)
    inside = (kind[data] != 3) & (kind[data] != 4)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & inside[1:]
    joint = np.zeros(len(data), bool)  # a mark directly after a word's last letter
    joint[1:] = (kind[data[1:]] >= 5) & (kind[data[1:]] != 7) & ((kind[data[:-1]] <= 1) | (kind[data[:-1]] == 7))
    caps = np.zeros(len(data), bool)
    caps[1:] = (kind[data[1:]] == 1) & (kind[data[:-1]] == 1)
    words, repeats, joints, capitals = (row_sums(x.astype(np.float64), at) for x in (starts, same, joint, caps))
    some = np.maximum(n, 1)
    lines = counts[:, 4] + 1
    shares = np.sqrt(counts / some[:, None])
    more = np.stack([np.log1p(n), np.log1p(words), row_sums(inside.astype(np.float64), at) / np.maximum(words, 1), np.log1p(words / lines), repeats / some, joints / np.maximum(words, 1), np.sqrt(capitals / some), lines / np.maximum(words, 1)], 1)
    return np.hstack([shares, more]) * (n > 0)[:, None]


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, STATS), np.float32)
        for lo, hi, data, at in chunks(batch.column(1)):
            out[lo:hi] = statistics(data, at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), STATS).cast(pa.list_(pa.float32()))], names=["doc_id", "stats"])


def described(documents: DataFrame) -> DataFrame:
    """doc_id and stats of each row."""
    return documents.select("doc_id", "text").mapInArrow(describe, "doc_id long, stats array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all partitions of the arrays that part(batches) gives for each, added up in two levels by Spark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(1):
                total += np.frombuffer(v.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    sums = rows.mapInArrow(each, "k int, v binary").repartition(16, "k").mapInArrow(add, "k int, v binary")
    return np.sum([np.frombuffer(bytes(r["v"]), np.float64) for r in sums.collect()], axis=0)  # 16 rows


class Model:
    """mean and spread of the statistics, the random projection, ridge weights, and the calibration by bins."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.project = rng.standard_normal((len(mean), FEATURES)) / KERNEL_WIDTH / np.sqrt(len(mean) / 8)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve = np.full(BINS, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    @staticmethod
    def bins(raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated chance of label 1, between the middles of neighbouring bins on a line."""
        return np.clip(np.interp((self.raw(stats) + 0.5) / 2 * BINS - 0.5, np.arange(BINS), self.curve), 0, 1)


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing curve nearest to good / n with weights n (pool adjacent violators); empty bins lie between."""
    full = np.flatnonzero(n)
    if not len(full):
        return np.full(len(n), 0.5)
    pools: list[list[float]] = []
    for k in full:
        pools.append([good[k], n[k], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, m, c = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + m, pools[-1][2] + c]
    values = np.repeat([g / m for g, m, _ in pools], [int(c) for _, _, c in pools])
    return np.interp(np.arange(len(n)), full, values)


def train(rows: DataFrame) -> Model:
    """A model from rows of stats, label (0 or 1) and calibrate (boolean: kept for the calibration).

    Without rows every score is 0.5; without calibration rows all rows serve for both.
    """
    first = summed(rows.select("stats"), lambda b: (lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))(matrix(b.column(0)) if b.num_rows else np.zeros((0, STATS))), 1 + 2 * STATS)
    n, s, ss = first[0], first[1 : STATS + 1], first[STATS + 1 :]
    mean = s / max(n, 1)
    model = Model(mean, np.sqrt(np.maximum(ss / max(n, 1) - mean**2, 0)) + 1e-3)
    if not n:
        return model
    wide = FEATURES + 1
    kept = rows.where("calibrate").limit(1).count() > 0

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        x, y = model.features(matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        k, y = model.bins(model.raw(matrix(batch.column(0)))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([np.bincount(k, y, BINS), np.bincount(k, minlength=BINS)])

    fit = summed((rows.where("NOT calibrate") if kept else rows).select("stats", "label"), normal, wide * wide + wide)
    xx = fit[: wide * wide].reshape(wide, wide)
    model.weights = np.linalg.solve(xx + RIDGE * np.diag([1.0] * FEATURES + [1e-6]), fit[wide * wide :])
    counts = summed((rows.where("calibrate") if kept else rows).select("stats", "label"), histogram, 2 * BINS)
    model.curve = isotonic(counts[:BINS], counts[BINS:])
    return model


def scorer(model: Model, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(matrix(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, label and calibrate of the labelled rows that may teach."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    rows = labels.where(remainder("doc_id", 5) != 0).join(stats, "doc_id")
    return saved(rows.select("stats", "label", (remainder("doc_id", 5) == 1).alias("calibrate")))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted.

    Labelled rows whose crc32(doc_id as text) mod 5 is not 0 train the model (those with remainder 1 calibrate it);
    null labels and ids teach nothing, and a doc_id with several labels counts with each. Only text is looked at. A null
    or empty text has statistics of zero and so a score of its own.
    """
    stats = saved(described(documents))
    model = train(training_rows(stats, labels))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return stats.select("doc_id", held.alias("held_out"), "stats").mapInArrow(scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def sieve(model: Model, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, data, at in chunks(batch.column(text_at)):
                good[lo:hi] = model.score(statistics(data, at).astype(np.float32).astype(np.float64)) >= threshold
            yield batch.filter(pa.array(good))
        give_back()

    return run


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, whose score is at least threshold. The model is that of
    score_quality(); rows are scored where they are read and nothing is joined."""
    model = train(training_rows(described(documents), labels))
    return documents.mapInArrow(sieve(model, threshold, documents.columns.index("text")), documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
