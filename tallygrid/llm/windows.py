"""Repeated windows of words, found behind a count-min sketch.

Each window has an anchor: of its runs of GRAM words the one with the smallest hash, the first of equal ones. Equal
windows have their anchor at the same place, so a window that stands twice has an anchor that stands at two places.
Windows side by side mostly share an anchor; together they are a piece. Each task counts the anchors of its texts in a
sketch, the sketches are merged cell by cell, and what the merged one counts is never less than how often a window
stands. Windows whose anchor it counts once are done with; no others are left out.

A second pass groups the rest exactly. Pieces go first, by a 128-bit BLAKE2 digest of their words: all windows of a
piece that stands twice are repeated. Where an anchor has different pieces, the windows of those that stand once are
grouped one by one, with one copy of each that stands more often. Equal pieces and windows of a task travel as one row,
so a passage that a third of all texts share costs no more than one row a task.

The sketch is a table of bits in every task, so its size is bounded (MOST_CELLS). Beyond some 20 GB of text it lets more
anchors through; the second pass then groups more pieces, about a row for each 10 words of text, and stays exact.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallygrid.llm.common import BLOCK_BYTES, chunks, drop_folder, give_back, saved, shared_dir, table

WORDS, GRAM = 35, 12
#: Rows of the sketch, cells of a row at most, cells of a slice, partition sketches merged at once.
ROWS, MOST_CELLS, SLICE, MERGED = 2, 1 << 28, 1 << 20, 512
#: Bytes of text to an anchor, about; cells to an anchor.
ANCHOR_BYTES, CELLS = 64, 4
#: What a task holds before it passes it on: anchors for the sketch, places of pieces or windows.
HELD_ANCHORS, HELD_PLACES = 1 << 20, 200_000
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd base of the hash of words, its inverse modulo 2^64, and odd multipliers of the sketch's rows and of grams.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ROW_FACTORS, STEP = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 0xD6E8FEB86659FD93
#: A place: the text's key, a word, and how many windows from it on.
PLACE = np.dtype([("key", "S16"), ("first", "<u4"), ("n", "<u2")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(STEP)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(ROW_FACTORS[0])
    return h ^ (h >> np.uint64(32))


class Text:
    """The words of some texts: where each starts and ends, and the text it is in."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.raw = data, data.tobytes()
        inside = ~WHITE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[1:] > at[:-1]
        first[at[:-1][full]] = inside[at[:-1][full]]
        last[at[1:][full] - 1] = inside[at[1:][full] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(at) - 1))  # the first word of each text
        #: How many gaps before each word are not just one space.
        self.gaps = np.concatenate([[0], np.cumsum((self.starts[1:] != self.ends[:-1] + 1) | (data[self.ends[:-1]] != 0x20))]) if len(self.starts) else np.zeros(1, np.int64)

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A hash of each word, from sums of powers over blocks of the text."""
        out = np.zeros(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + block, "right")))
            a, b = self.starts[lo], self.ends[hi - 1]
            up, down = powers(int(b - a))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * up)])
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            out[lo:hi] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            lo = hi
        return out

    def pieces(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: its first window (the word it starts at), how many it has, and the hash of their anchor."""
        gram = min(GRAM, words)
        none = np.zeros(0, np.int64)
        n = len(self.starts) - words + 1
        windows = np.flatnonzero(self.text[:n] == self.text[words - 1 :]) if n > 0 else none
        if not len(windows):
            return none, none, none.astype(np.uint64)
        h = self.hashes()
        g = np.zeros(len(h) - gram + 1, np.uint64)
        for k in range(gram):
            g = g * np.uint64(STEP) + h[k : len(h) - gram + 1 + k]
        g = mixed(g)
        span, at, width = words - gram + 1, np.arange(len(g)), 1
        while 2 * width <= span:
            at, width = smaller(g, at[:-width], at[width:]), 2 * width
        at = smaller(g, at[:n], at[span - width : span - width + n])[windows]
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
        return windows[new], np.diff(new, append=len(windows)), g[at[new]]

    def digests(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """Digests of the words from first to last, joined by one space."""
        odd = self.gaps[last] - self.gaps[first]
        for a, b, joined in zip(self.starts[first].tolist(), self.ends[last].tolist(), odd.tolist(), strict=True):
            words = self.raw[a:b]
            yield hashlib.blake2b(b" ".join(words.split()) if joined else words, digest_size=16).digest()


POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n, modulo 2^64."""
    if not POWERS or len(POWERS[0]) < n:
        size = max(n, 1 << 16)
        POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (BASE, INVERSE)]
    return POWERS[0][:n], POWERS[1][:n]


def smaller(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of places a before places b: where the hash is smaller, a if equal."""
    return np.where(g[a] <= g[b], a, b)


def cells_of(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return (anchors * np.uint64(ROW_FACTORS[row])) >> np.uint64(64 - (width.bit_length() - 1))


def squeezed(cells: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes())


def spread(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=4 * SLICE + 64), np.uint32), dtype=np.int64)


SKETCH = "slice int, once binary, often binary"


def sketch_row(at: int, once: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([squeezed(once)], pa.binary()), pa.array([squeezed(often)], pa.binary())], names=["slice", "once", "often"])


def partition_sketches(width: int, words: int) -> Callable:
    """Of texts: the cells that their anchors count up, once or more often, by slices of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held)
            held.clear()
            for row in range(ROWS):
                cells, n = np.unique(cells_of(anchors, row, width), return_counts=True)
                edges = np.searchsorted(cells, np.arange(0, width + 1, min(SLICE, width)).astype(np.uint64))
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    if lo < hi:
                        some = cells[lo:hi].astype(np.int64) - k * SLICE
                        yield sketch_row(row * (len(edges) - 1) + k, some[n[lo:hi] == 1], some[n[lo:hi] > 1])

        for batch in batches:
            for _, _, data, at in chunks(batch.column(0), 1 << 20):
                held.append(Text(data, at).pieces(words)[2])
                if sum(map(len, held)) > HELD_ANCHORS:
                    yield from out()
        if held:
            yield from out()
        give_back()

    return run


def merge_slices(rows: pa.Table) -> pa.Table:
    """Sketches of one slice added up; a count stays at two."""
    counts = np.zeros(SLICE, np.uint8)
    for once, often in zip(rows.column("once"), rows.column("often"), strict=True):
        counts[spread(once.as_py())] += 1
        counts[spread(often.as_py())] = 2
        np.minimum(counts, 2, out=counts)
    return pa.Table.from_batches([sketch_row(rows.column("slice")[0].as_py(), np.flatnonzero(counts == 1), np.flatnonzero(counts == 2))])


def merged_sketch(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Bits of the cells that count two or more, one row for each row of the sketch; cells of a row."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, 1 << max(10, math.ceil(math.log2(1 + CELLS * total / ANCHOR_BYTES))))
    parts = max(1, math.ceil(total / (BLOCK_BYTES * MERGED)))
    sketches = texts.select("text").mapInArrow(partition_sketches(width, words), SKETCH).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    while True:
        sketches = sketches.groupBy("slice", "part").applyInArrow(merge_slices, SKETCH)
        if parts == 1:
            break
        parts = math.ceil(parts / MERGED)
        sketches = sketches.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    slices = -(-width // SLICE)
    bits = np.zeros((ROWS * slices, min(SLICE, width) // 8), np.uint8)
    for r in saved(sketches.select("slice", "often")).toLocalIterator():
        counted = np.zeros(min(SLICE, width), bool)
        counted[spread(bytes(r["often"]))] = True
        bits[r["slice"]] = np.packbits(counted, bitorder="little")
    return bits.reshape(ROWS, -1), width


FOUND = "digest binary, anchor long, n long, lead binary, places binary"


class Found:
    """Digests with their places, as rows: equal ones fall together."""

    def __init__(self):
        self.held: list[tuple] = []
        self.size = 0

    def add(self, digests: list[bytes], anchors: np.ndarray, places: np.ndarray, placed: np.ndarray) -> None:
        """placed: which places go along; the others count only."""
        self.held.append((np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), anchors, places, placed))
        self.size += len(digests)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            digest, anchors, places, placed = (np.concatenate(c) for c in zip(*self.held, strict=True))
            order = np.lexsort((~placed, digest[:, 1], digest[:, 0]))
            digest, anchors, places, placed = digest[order], anchors[order], places[order], placed[order]
            first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]).any(1)]))
            ends = np.append(first, len(order))
            at = np.concatenate([[0], np.cumsum(placed)])[ends]
            raw = places.view(np.uint8).reshape(-1, PLACE.itemsize)
            columns = [binaries(digest[first]), pa.array(anchors[first]), pa.array(np.diff(ends)), binaries(raw[first, :20]), binaries(raw[placed], at)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])
        self.held, self.size = [], 0


def binaries(rows: np.ndarray, at: np.ndarray | None = None) -> pa.Array:
    """Each row's bytes as a value; with `at`, those of the rows from one place to the next."""
    rows = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1) if at is None else at
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * (rows.shape[1] * rows.itemsize)).astype(np.int32)), pa.py_buffer(rows)])


def places_of(keys: np.ndarray, first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(first), PLACE)
    out["key"], out["first"], out["n"] = keys, first, n
    return out


def pieces_found(sketch, width: int, words: int) -> Callable:
    """Of keys and texts: the pieces whose anchor the sketch counts twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, found = sketch.value, Found()
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), "S16")
            for lo, _, data, at in chunks(batch.column(1), 1 << 20):
                text = Text(data, at)
                first, n, anchors = text.pieces(words)
                often = np.ones(len(first), bool)
                for row in range(ROWS):
                    cell = cells_of(anchors, row, width)
                    often &= (bits[row][(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
                first, n, anchors = first[often], n[often], anchors[often].view(np.int64)
                where = text.text[first]
                found.add(list(text.digests(first, first + n + words - 2)), anchors, places_of(keys[lo + where], first - text.first[where], n), np.ones(len(first), bool))
                if found.size > HELD_PLACES:
                    yield from found.rows()
        yield from found.rows()
        give_back()

    return run


def windows_found(words: int) -> Callable:
    """Of keys, texts and marks: the windows of open pieces; places of those whose piece stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in batches:
            keys, marks = np.array(batch.column(0).to_pylist(), "S16"), batch.column(2).flatten()
            row = np.repeat(np.arange(len(keys)), batch.column(2).value_lengths().to_numpy())
            first, n, kind = (marks.field(c).to_numpy() for c in ("first", "n", "kind"))
            for lo, hi, data, at in chunks(batch.column(1), 1 << 20):
                text = Text(data, at)
                some = slice(*np.searchsorted(row, [lo, hi]))
                many = n[some]
                of = np.repeat(np.arange(len(many)), many)
                word = np.repeat(first[some], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = text.first[row[some][of] - lo] + word
                found.add(list(text.digests(start, start + words - 1)), np.zeros(len(of), np.int64), places_of(keys[row[some][of]], word, 1), kind[some][of] == 2)
                if found.size > HELD_PLACES:
                    yield from found.rows()
        yield from found.rows()
        give_back()

    return run


def places_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places, kind and lead: a row for each place; a piece of kind 3 (repeated, of an open anchor) is of kind 1 but at lead."""
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, PLACE.itemsize)
        many = pc.binary_length(batch.column(0)).to_numpy() // PLACE.itemsize
        of = np.repeat(np.arange(len(many)), many)
        at, kind = raw.reshape(-1).view(PLACE), batch.column(1).to_numpy()[of]
        lead = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 20)[of]
        kind = np.where((kind == 3) & (raw[:, :20] != lead).any(1), 1, kind)
        yield pa.RecordBatch.from_arrays([binaries(raw[:, :16]), pa.array(at["first"].astype(np.int32)), pa.array(at["n"].astype(np.int32)), pa.array(kind.astype(np.int32))], names=["key", "first", "n", "kind"])


MARKS = "key binary, first int, n int, kind int"


def text_key(documents: DataFrame) -> Column:
    """A digest of doc_id and text: rows that agree in both have the same windows."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary")))


def repeated_windows(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """key (see text_key), first and n: runs of n windows of so many words, from word `first` on, that stand elsewhere too."""
    spark = documents.sparkSession
    texts = documents.select(text_key(documents).alias("key"), "text")
    bits, width = merged_sketch(texts, words)
    sketch = spark.sparkContext.broadcast(bits)
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    try:
        texts.mapInArrow(pieces_found(sketch, width, words), FOUND).write.parquet(f"{folder}/pieces")
        found = spark.read.schema(FOUND).parquet(f"{folder}/pieces")
        pieces = found.groupBy("digest").agg(F.first("anchor").alias("anchor"), F.sum("n").alias("total"), F.min("lead").alias("first_lead"))
        opened = pieces.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1").select("anchor", F.lit(2).alias("open"))
        kinds = pieces.join(opened, "anchor", "left").select("digest", "first_lead", (F.when(F.col("total") > 1, 1).otherwise(0) + F.coalesce("open", F.lit(0))).alias("kind")).where("kind > 0")
        marks = saved(found.join(kinds, "digest").select("places", "kind", "first_lead").mapInArrow(places_apart, MARKS))
        of_texts = marks.where("kind > 1").groupBy("key").agg(F.collect_list(F.struct("first", "n", "kind")).alias("marks"))
        texts.join(of_texts, "key").mapInArrow(windows_found(words), FOUND).write.parquet(f"{folder}/windows")
        found = spark.read.schema(FOUND).parquet(f"{folder}/windows")
        often = found.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
        more = saved(found.join(often, "digest").select("places", F.lit(1).alias("kind"), "lead").mapInArrow(places_apart, MARKS))
    finally:
        drop_folder(spark, folder)
        sketch.unpersist()
    return marks.where("kind <> 2").union(more).select("key", "first", "n")


CUT = "struct<kept: string, n_words: bigint, n_removed: bigint>"


def cutter(words: int) -> Callable:
    """Of a text and runs of windows: its words but those in a window, joined by a space, and how many there are."""

    @arrow_udf(CUT)
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(texts, runs, strict=True):
            each = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(each))
            if spans.is_valid and len(spans):
                edge = np.zeros(len(each) + 1, np.int64)
                for s in spans.as_py():
                    edge[s["first"]] += 1
                    edge[s["first"] + s["n"] + words - 1] -= 1
                left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                each = [each[k] for k in left]
            n_removed.append(n_words[-1] - len(each))
            kept.append(b" ".join(each))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["kept", "n_words", "n_removed"])

    return cut


def cut_windows(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_removed, and kept, its words joined by one space but for
    those in a window of so many words that also starts anywhere else, in the same document or another.

    Words are what stands between ASCII white space, unchanged. Windows are judged on the input: repeats are removed
    wherever they stand, first places too. A null text has no words. Rows that repeat doc_id and text are documents of
    their own, so all their windows are repeated. A null doc_id is a value like others. Texts are read whole, at any
    length; texts under `words` words keep all. Other columns are ignored. An empty table gives no rows.
    """
    runs = repeated_windows(documents, words).groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    rows = documents.select("doc_id", "text", text_key(documents).alias("key")).join(runs, "key", "left")
    return rows.select("doc_id", cutter(words)("text", "runs").alias("cut")).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT d, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS s FROM (SELECT d, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
rep AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 35)) AS k FROM rep),
lists AS (SELECT d, list(k) AS ks FROM gone GROUP BY d),
cut AS (SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed, [w[k] FOR k IN range(1, len(w) + 1) IF ks IS NULL OR NOT list_contains(ks, k)] AS kept FROM docs LEFT JOIN lists USING (d))
SELECT doc_id, n_words, n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM cut
"""
