"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit a binary classifier over hashed byte trigrams (log-odds of the
two sides, from counts) predicts it. A text's margins are decoded to the codeword of the least loss, each bit weighted
by how well its classifier does on that language. A small gap between the best two flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, remainder, row_sums, table

DIMS = 1 << 16
#: Training texts: about so many at most, picked by a hash of the id. All of them are counted whole.
SAMPLE_ROWS = 20_000
MAX_LANGUAGES = 256
SMOOTH = 0.5
SHARPNESS = 2.5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, second string, ambiguous boolean"


def codebook(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all splits of the classes up to 5 of them, else random ones of about 15 log2 k bits."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1.0, *rest] for rest in itertools.product((1.0, -1.0), repeat=k - 1) if min(rest) < 0]).T
    rng, bits, best = np.random.default_rng(7), math.ceil(15 * math.log2(k)), (-1, None)
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def letters() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, ASCII non-letters to a space, others as they are."""
    out = np.full(256, 32, np.uint8)
    out[97:123], out[65:91], out[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """The hashed trigram that starts at each byte; DIMS where it would leave the text or is only spaces."""
    low = lut[data].astype(np.uint32)
    codes = np.full(len(low), DIMS, np.int64)
    if len(low) >= 3:
        mixed = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        codes[:-2] = np.where(mixed == 0x202020, DIMS, (mixed * np.uint32(2654435761)) >> np.uint32(16))
        for back in (1, 2):
            codes[np.maximum(offsets[1:] - back, 0)] = DIMS
    return codes


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, code, n of a partition's rows of lang and text."""
    lut, sums = letters(), {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, hi, data, at in chunks(batch.column(1)):
            codes = trigrams(data, at, lut)
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            for lang in set(langs[lo:hi]):
                got = np.bincount(codes[(langs[lo:hi] == lang)[row]], minlength=DIMS + 1)[:DIMS]
                sums[lang] = sums.get(lang, 0) + got
    for lang, got in sums.items():
        some = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(got[some], pa.int64())], names=["lang", "code", "n"])


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights.astype(np.float32)
        self.scale = np.ones(code.shape[1])
        self.trust = np.full(code.shape, 1.0 / max(1, code.shape[1]))

    def margins(self, data: np.ndarray, at: np.ndarray, lut: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit for each text, by its scale; 0 for a text without trigrams."""
        codes = trigrams(data, at, lut)
        n = row_sums((codes < DIMS).astype(np.float64), at)
        return row_sums(self.weights[codes], at) / np.maximum(n, 1)[:, None] / self.scale

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Shares of the languages, from loss-weighted distances to the codewords."""
        loss = np.stack([(np.exp(-np.clip(margins, -4, 4) * word) * trust).sum(1) for word, trust in zip(self.code, self.trust, strict=True)], 1)
        z = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from doc_id, text and lang; rows without text or lang are left out. None if nothing is left.

    At most about sample_rows rows are used, picked by a hash of doc_id, so that training has a fixed cost. Counts are
    summed by Spark; the driver gets DIMS counts for each language.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    counts = rows.select("lang", "text").mapInArrow(counter, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return None
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MAX_LANGUAGES}")
    full = np.zeros((len(langs), DIMS))
    full[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), counts["code"].to_numpy()] = counts["n"].to_numpy()
    share = (full + SMOOTH) / (full.sum(1, keepdims=True) + SMOOTH * DIMS)
    code = codebook(len(langs))
    sides = [[share[code[:, b] == s].mean(0) if (code[:, b] == s).any() else share.mean(0) for s in (1, -1)] for b in range(code.shape[1])]
    model = Model(langs, code, np.vstack([np.log(np.array([p / q for p, q in sides])).T, np.zeros(code.shape[1])]))
    trust(model, rows)
    return model


def trust(model: Model, rows: DataFrame) -> None:
    """Sets each bit's scale (its mean size of margins) and its weight for each language (its accuracy there)."""
    index, bits = {x: i for i, x in enumerate(model.langs)}, model.code.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, right, size, n = letters(), np.zeros(model.code.shape), np.zeros(model.code.shape), np.zeros(len(model.langs))
        for batch in batches:
            who = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, at in chunks(batch.column(1)):
                m, own = model.margins(data, at, lut), who[lo:hi]
                np.add.at(right, own, np.sign(m) == model.code[own])
                np.add.at(size, own, np.abs(m))
                np.add.at(n, own, 1)
        some = np.flatnonzero(n)
        r, b = np.repeat(some, bits), np.tile(np.arange(bits), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(right[r, b]), pa.array(size[r, b]), pa.array(n[r])], names=["r", "b", "good", "size", "n"])

    got = rows.select("lang", "text").mapInArrow(judge, "r int, b int, good double, size double, n double").groupBy("r", "b").agg(*(F.sum(c).alias(c) for c in ("good", "size", "n"))).toPandas()
    good = np.zeros(model.code.shape)
    good[got["r"], got["b"]] = got["good"] / got["n"]
    sizes = got.groupby("b")[["size", "n"]].sum().sort_index()
    model.scale = np.maximum((sizes["size"] / sizes["n"]).to_numpy(), 1e-9)
    model.trust = good / np.maximum(good.sum(1, keepdims=True), 1e-9)


def predictor(model: Model | None, least_gap: float = 0.1):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = letters()
        names = np.array([*(model.langs if model else []), "und"], dtype=object)
        for batch in batches:
            n, text = batch.num_rows, batch.column(2)
            best, second, score, gap = np.full(n, -1), np.full(n, -1), np.zeros(n), np.zeros(n)
            lettered = np.zeros(n, bool)
            for lo, hi, data, at in chunks(text):
                ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
                lettered[lo:hi] = row_sums(ascii_letter.astype(np.float64), at) > 0
                high = row_sums((data >= 128).astype(np.float64), at) > 0
                for r in np.flatnonzero(high & ~lettered[lo:hi]):  # other scripts
                    lettered[lo + r] = any(c.isalpha() for c in bytes(data[at[r] : at[r + 1]]).decode("utf-8", "replace"))
                if model:
                    p = model.decode(model.margins(data, at, lut))
                    order = np.argsort(-p, axis=1, kind="stable")
                    rows = np.arange(hi - lo)
                    best[lo:hi], score[lo:hi] = order[:, 0], p[rows, order[:, 0]]
                    second[lo:hi] = order[:, 1] if p.shape[1] > 1 else -1
                    gap[lo:hi] = score[lo:hi] - (p[rows, order[:, 1]] if p.shape[1] > 1 else 0)
            if text.null_count:
                lettered &= ~text.is_null().to_numpy(zero_copy_only=False)
            best, second, score = np.where(lettered, best, -1), np.where(lettered, second, -1), np.where(lettered & (best >= 0), score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(np.where(second >= 0, names[second], None), pa.string()), pa.array((best >= 0) & (gap < least_gap))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return predict


def identify_languages(documents: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score, second (the next best), ambiguous.

    Only text is looked at. lang_pred is `und` with score 0 if the text is null or has no letter, or without a model.
    """
    return documents.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(predictor(model), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(remainder("doc_id", 4) != 2))
    return identify_languages(documents, model)
