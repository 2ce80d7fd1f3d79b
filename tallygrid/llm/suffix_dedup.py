"""Removal of repeated passages: every byte covered by a string of `length` bytes that also starts earlier.

1. Documents are dealt in order into runs. In each window of `length` bytes the least of the hashes of its GRAM-byte
   strings is its anchor; equal windows have equal anchors at the same place. Hashes of anchors are shuffled (each once
   for a run), and those that occur twice are sent back to their runs. A window whose anchor occurs once can't repeat.
2. Windows in a row with the same anchor form a piece of text. Pieces whose anchor repeats are dealt into suffix buckets
   by the anchor, unless the same piece (its bytes are compared) stands earlier in the run: so a passage that stands in a
   third of all documents leaves each run a single time.
   Pieces of an anchor that is very common (the edges of a common passage, with other text around each) are cut into
   ranges of NARROW windows, of one window if it is commoner still, and dealt by a hash of what all windows of a range
   have in common. Hashes only say which bucket a window goes to.
3. In each bucket the suffixes of pieces that share an anchor are sorted with a difference cover (see suffixes.py), some
   anchors at a time. Of equal windows all but the first go.
4. Removed windows return to their runs, which cut them from the texts.

What is shuffled is about 1 hash for 35 bytes, and 4 bytes for each byte of passages that may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm.common import blocks_for, chunks, dealt_by_ranges, lean, lean_pair, packed, table, unpacked
from tallygrid.llm.suffixes import sorted_suffixes

LENGTH = 100
GRAM = 32
#: Places within a chunk fit in so many bits; longer texts are cut into overlapping chunks.
PLACE_BITS = 23
LONGEST = 4 << 20
#: From about so many pieces on, in all runs together, the pieces of an anchor are cut into ranges of NARROW windows, from
#: COMMONER times as many on into single windows.
HOT, COMMONER, NARROW = 4096, 64, 9
#: Runs whose anchors are meant to meet in one bucket, and bytes of pieces that are sorted at once.
RUNS, SORTED_BYTES = 8, 2 << 20
#: The lowest bits of an anchor's hash carry the power of two of its count on the way out, and how common it is back.
TAG = np.uint64(15)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hasher:
    """Polynomial hashes of substrings, for all substrings of one kind at once."""

    def __init__(self):
        self.powers = []

    def sums(self, data: np.ndarray, k: int) -> np.ndarray:
        if not self.powers or len(self.powers[0]) < len(data) + 1:
            size, self.powers = max(len(data) + 1, (1 << 19) + 1), []
            for base in BASES:
                for x in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(size, x, np.uint64)
                    steps[0] = 1
                    self.powers.append(np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[2 * k][: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.powers[2 * k + 1][starts])

    def grams(self, data: np.ndarray, n: int) -> np.ndarray:
        sums = self.sums(data, 0)
        return mixed((sums[n:] - sums[:-n]) * self.powers[1][: len(data) - n + 1])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, in a row."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def documents_of(rows: pa.Table) -> pa.Table:
    """A run's documents in order: doc_id (null first), then text; a null text is empty."""
    rows = unpacked(rows.column("block"))
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
    return rows.set_column(rows.column_names.index("text"), "text", pc.fill_null(rows.column("text"), ""))


def stretches(texts: pa.ChunkedArray, length: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each text, its offsets, the place in its text where it begins): texts in chunks, those over longest
    bytes in parts that overlap by length - 1 bytes."""
    for lo, hi, data, at in chunks(texts):
        if hi - lo > 1 or len(data) <= longest:
            yield data, np.arange(lo, hi), at, np.zeros(hi - lo, np.int64)
            continue
        for a in range(0, len(data) - length + 1, longest - length + 1):
            part = data[a : a + longest]
            yield part, np.array([lo]), np.array([0, len(part)]), np.array([a])


def anchored(data: np.ndarray, at: np.ndarray, length: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Pieces: (text of the chunk, first window, last window, place and hash of the anchor) of each run of windows with one
    anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = hasher.grams(data, GRAM)
    key = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = length - GRAM + 1, 1
    least = key
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(data) - length + 1], least[span - wide :])
    n = np.maximum(np.diff(at) - length + 1, 0)
    starts = ranges(at[:-1], n)
    of = np.repeat(np.arange(len(n)), n)
    place = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(first) else first
    return of[first], starts[first], starts[last], place[first], grams[place[first]]


def mark(buckets: int, length: int, longest: int):
    """Pass 1: the hashes of a run's anchors, dealt by hash; TAG holds the power of two of how often it stands there."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("run")[0].as_py()
        hasher = Hasher()
        found = [anchored(data, at, length, hasher)[4] for data, _, at, _ in stretches(documents_of(rows).column("text"), length, longest)]
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]) & ~TAG, return_counts=True)
        keys |= np.minimum(np.log2(n).astype(np.uint64), TAG)
        to = bucket_of(keys, buckets)
        order = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.diff(to[order], prepend=-1))
        return pa.table([pa.array(to[order][edges], pa.int32()), pa.array(np.full(len(edges), number), pa.int32()), pa.array([x.tobytes() for x in np.split(keys[order], edges[1:])] if len(edges) else [], pa.binary())], names=["bucket", "run", "hashes"])

    return run


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(4)) % np.uint64(buckets)).astype(np.int64)


def repeated(hot: int):
    """Pass 1, in a bucket: for each run those of its anchors that stand twice in it or in another run too; the lowest
    bits are 1 for common ones and 2 for those that are commoner still."""

    def run(rows: pa.Table) -> pa.Table:
        runs = rows.column("run").to_pylist()
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
        keys = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(keys, kind="stable")
        bare, owner, n = keys[order] & ~TAG, owner[order], np.left_shift(1, (keys[order] & TAG).astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(bare) else np.zeros(0, np.int64)
        total = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(bare))) if len(bare) else n
        bare, owner = (bare | (total >= hot).astype(np.uint64) + (total >= hot * COMMONER).astype(np.uint64))[total > 1], owner[total > 1]
        order = np.argsort(owner, kind="stable")
        edges = np.flatnonzero(np.diff(owner[order], prepend=-1))
        own = owner[order][edges]
        return pa.table([pa.array([runs[k] for k in own], pa.int32()), pa.array([x.tobytes() for x in np.split(bare[order], edges[1:])] if len(edges) else [], pa.binary())], names=["run", "hashes"])

    return run


def windows_block(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    return packed(pa.table([pa.array(doc.astype(np.int32)), pa.array(start), pa.array(n.astype(np.int32))], names=["doc", "start", "n"]))


def stand_earlier(key: np.ndarray, one: np.ndarray, sizes: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether an equal piece with the same key stands before: the first with this key and hash, its bytes compared."""
    order = np.lexsort((np.arange(len(key)), sizes, one, key))
    like = (key[order][1:] == key[order][:-1]) & (one[order][1:] == one[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
    later = np.flatnonzero(np.concatenate([[False], like])) if len(order) else order
    lead = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~like]), np.arange(len(order)), 0))] if len(order) else order
    gone = np.zeros(len(order), bool)
    for lo in range(0, len(later), 5000):
        some = later[lo : lo + 5000]
        a, b = order[some], lead[some]
        unlike = pool[ranges(begin[a], sizes[a])] != pool[ranges(begin[b], sizes[b])]
        gone[a] = np.add.reduceat(unlike, np.cumsum(sizes[a]) - sizes[a]) == 0
    return gone


def dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order], prepend=-1))
    for some in np.split(order, edges[1:]) if len(edges) else []:
        yield int(to[some[0]]), some


PIECES = "bucket int, anchor long, run int, doc int, start long, n int, text binary"


def narrowed(first, last, place, anchor, common, length, sums, hasher) -> tuple[np.ndarray, ...]:
    """(piece, first, last, key) of the parts of pieces: whole ones, keyed by the anchor, or ranges of windows that begin
    equally far before the anchor, keyed by a hash of what the windows of a range have in common."""
    span = length - GRAM + 1
    wide = np.array([span, NARROW, 1])[common]
    whole = np.flatnonzero(common == 0)
    cut = np.flatnonzero(common > 0)
    n = last[cut] - first[cut] + 1
    window, piece = ranges(first[cut], n), np.repeat(cut, n)
    part = (place[piece] - window) // wide[piece]
    new = np.ones(len(window), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window))[: len(head)] - 1
    piece, part = piece[head], part[head]
    near = part * wide[piece]
    far = np.minimum(near + wide[piece], span) - 1
    key = mixed(hasher.of(sums, 0, place[piece] - near, place[piece] - far + length) ^ anchor[piece] * np.uint64(3) ^ part.astype(np.uint64))
    return np.concatenate([whole, piece]), np.concatenate([first[whole], window[head]]), np.concatenate([last[whole], window[tail]]), np.concatenate([anchor[whole], key])


def cut_pieces(buckets: int, length: int, longest: int):
    """Pass 2: the pieces whose anchor repeats, to suffix buckets; those that stand earlier in the run are removed (rows
    without text)."""

    def run(rows: pa.Table, hashes: pa.Table) -> pa.Table:
        names, kinds = [x.split()[0] for x in PIECES.split(", ")], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        if not rows.num_rows or not hashes.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        number = rows.column("run")[0].as_py()
        wanted = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in hashes.column("hashes")]))
        hasher, parts, texts = Hasher(), [], []
        for data, row, at, begins in stretches(documents_of(rows).column("text"), length, longest):
            of, first, last, place, anchor = anchored(data, at, length, hasher)
            anchor = anchor & ~TAG
            found = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
            keep = (wanted[found] & ~TAG) == anchor
            of, first, last, place, anchor, common = of[keep], first[keep], last[keep], place[keep], anchor[keep], (wanted[found] & TAG)[keep].astype(np.int64)
            sums = hasher.sums(data, 0)
            piece, first, last, key = narrowed(first, last, place, anchor, common, length, sums, hasher)
            of, n = of[piece], last - first + 1
            parts.append((row[of], first - at[of] + begins[of], n, key, hasher.of(sums, 0, first, last + length)))
            texts.append((data, first, n + length - 1))
        doc, start, n, key, one = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = n + length - 1
        begin = np.cumsum(sizes) - sizes
        pool = np.concatenate([data[ranges(f, s)] for data, f, s in texts])
        at, where = begin, np.lexsort((start, doc))  # the first of equal ones is the earliest
        doc, start, n, key, one, sizes, begin = (x[where] for x in (doc, start, n, key, one, sizes, begin))
        gone = stand_earlier(key, one, sizes, begin, pool)
        order = np.concatenate([np.flatnonzero(~gone), np.flatnonzero(gone)])
        fresh = len(order) - int(gone.sum())
        # The pool holds the pieces in a row as they were cut; Arrow picks them without an index for each byte.
        cut = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(np.append(at, len(pool)).astype(np.int32).tobytes()), pa.py_buffer(pool)])
        text = pa.concat_arrays([cut.take(pa.array(where[order[:fresh]])), pa.nulls(len(order) - fresh, pa.binary())])
        bucket = np.where(gone, number % buckets, bucket_of(key, buckets))[order]
        cols = [bucket, key[order].view(np.int64), np.full(len(order), number), doc[order], start[order], n[order]]
        return pa.table([*(pa.array(c, k) for c, k in zip(cols, kinds[:-1], strict=True)), text], names=names)

    return run


def sort_bucket(length: int):
    """Pass 3: of the windows of a bucket, those that also start earlier, for each run."""

    def run(rows: pa.Table) -> pa.Table:
        lost = rows.filter(pc.is_null(rows.column("text")))
        rows = rows.filter(pc.is_valid(rows.column("text"))).sort_by("anchor")
        found = [[lost.column(c).to_numpy() for c in ("run", "doc", "start", "n")]]
        anchor, number, doc, start, n = (rows.column(c).to_numpy() for c in ("anchor", "run", "doc", "start", "n"))
        same = anchor[1:] == anchor[:-1]
        shared = np.zeros(len(anchor), bool)  # a piece that has its anchor for itself can't repeat
        shared[1:] |= same
        shared[:-1] |= same
        own = np.flatnonzero(shared)
        first = np.flatnonzero(np.diff(anchor[own], prepend=anchor[own][:1] - 1))
        size = np.cumsum(np.add.reduceat(n[own].astype(np.int64) + length - 1, first)) if len(first) else first
        texts, at = rows.column("text"), 0
        while at < len(first):  # as many anchors as make SORTED_BYTES, one at least
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SORTED_BYTES, "right")))
            some = own[first[at] : first[to] if to < len(first) else None]
            block = np.frombuffer(b"".join(t.as_buffer() for t in texts.take(pa.array(some))), np.uint8)
            found.append(repeated_windows(number[some], doc[some], start[some], n[some].astype(np.int64), block, length))
            at = to
        number, doc, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
        out = [(k, windows_block(doc[some], start[some], n[some])) for k, some in dealt(number)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["run", "block"])

    return run


def repeated_windows(number, doc, start, n, block, length):
    """(run, doc, start, 1) of the windows of pieces that also start earlier; block: the pieces' bytes in a row."""
    sizes = n + length - 1
    own = np.cumsum(sizes) - sizes
    at = ranges(own, n)
    of_byte = np.full(len(block), -1, np.int64)
    of_byte[at] = np.repeat(np.arange(len(n)), n)
    suffixes, group = sorted_suffixes(block, np.repeat(own + sizes, sizes), at, length)
    p = of_byte[suffixes]
    place = start[p] + suffixes - own[p]
    order = np.lexsort((place, doc[p], number[p], group))
    lost = order[np.concatenate([[False], group[order][1:] == group[order][:-1]])]
    return number[p[lost]], doc[p[lost]], place[lost], np.ones(len(lost), np.int64)


def removed_from(rows: pa.Table, removed: pa.Table, length: int) -> Iterator[tuple[object, bytes, np.ndarray]]:
    """(doc_id, bytes, whether each byte goes) of a run's documents."""
    docs = documents_of(rows)
    texts = docs.column("text").cast(pa.binary())
    if removed.num_rows:
        lost = unpacked(removed.column("block"))
        doc, start, n = (lost.column(c).to_numpy() for c in ("doc", "start", "n"))
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order].astype(np.int64), start[order], start[order] + n[order] + length - 1
    else:
        doc = start = end = np.zeros(0, np.int64)
    edges = np.searchsorted(doc, np.arange(docs.num_rows + 1))
    for k, doc_id in enumerate(docs.column("doc_id").to_pylist()):
        raw = texts[k].as_py()
        depth = np.zeros(len(raw) + 1, np.int32)
        own = slice(edges[k], edges[k + 1])
        np.add.at(depth, start[own], 1)
        np.add.at(depth, end[own], -1)
        yield doc_id, raw, np.cumsum(depth[:-1], dtype=np.int32) > 0


def report(length: int):
    def run(rows: pa.Table, removed: pa.Table) -> pa.Table:
        out = []
        for doc_id, raw, gone in removed_from(rows, removed, length) if rows.num_rows else ():
            n = int(gone.sum())
            kept = raw if not n else np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(raw), n, int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if n else 0, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def cleaned(length: int, columns: list[str]):
    def run(rows: pa.Table, removed: pa.Table) -> pa.Table:
        docs = documents_of(rows)
        texts = [raw.decode("utf-8") if not gone.any() else np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for _, raw, gone in removed_from(rows, removed, length)]
        docs = docs.set_column(docs.column_names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in columns:
            docs = docs.set_column(docs.column_names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts], pa.int64()))
        return docs.select(columns)

    return run


def runs_and_removed(documents: DataFrame, length: int, hot: int = HOT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    n = blocks_for(documents)
    runs = dealt_by_ranges(documents, "doc_id")
    marks = runs.groupBy("run").applyInArrow(lean(mark(-(-n // RUNS), length, longest)), "bucket int, run int, hashes binary")
    twice = marks.groupBy("bucket").applyInArrow(lean(repeated(hot)), "run int, hashes binary")
    pieces = runs.groupBy("run").cogroup(twice.groupBy("run")).applyInArrow(lean_pair(cut_pieces(n, length, longest)), PIECES)
    return runs, pieces.groupBy("bucket").applyInArrow(lean(sort_bucket(length)), "run int, block binary")


def repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT, longest: int = LONGEST) -> DataFrame:
    """One row for each row of documents: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256.

    A byte goes if a string of length bytes covers it that also starts earlier: in a row before (by doc_id, null first,
    then text) or earlier in the same text. Strings never cross texts. A null text counts as an empty one. length must
    be at least 64. Texts over longest bytes are worked through in overlapping parts. All rows of one doc_id (and all
    with none) are in one run.
    """
    runs, removed = runs_and_removed(documents.select("doc_id", "text"), length, hot, longest)
    return runs.groupBy("run").cogroup(removed.groupBy("run")).applyInArrow(lean_pair(report(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, without those bytes; what is left of a cut character is left out. n_chars
    follows the text where there is such a column. A null text becomes an empty one."""
    columns = documents.columns
    runs, removed = runs_and_removed(documents, length)
    return runs.groupBy("run").cogroup(removed.groupBy("run")).applyInArrow(lean_pair(cleaned(length, columns)), documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
