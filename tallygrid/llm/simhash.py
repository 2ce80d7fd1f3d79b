"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits have a variant in common that is at most half of that from both.
So every distinct fingerprint emits all variants within half the radius, equal variants meet, and what meets is
linked. Fingerprints of 64 bits have 2,081 variants within 2 bits; to keep them out of the shuffle, it deals by the
lowest bits of the variant: a fingerprint goes to each block that some variant of it has (once), and the variants that
belong to the block are made there. Blocks are the leaves of a binary tree over the lowest bits, which is grown where
fingerprints crowd, so that a family of near copies is spread like the rest; what still crowds at DEPTH bits is worked
through in slices of variants, in bounded memory.

All texts that share a variant are within the radius of each other, so one link from the smallest to each other one
keeps every connection, however large the group is. Links are checked by counting bits, and of a block's links only as
many leave it as are needed to connect what they connect.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, give_back, lean, saved, table
from tallygrid.llm.components import connected_components

WORDS, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Prints (4 bytes each up to 32 bits, else 8), keys (none where they are the prints), and where a node isn't the key.
DEALT = "block int, prints binary, keys binary, spots binary, nodes binary"
#: Fingerprints that are meant to meet in one block; each has some 60 variants there.
BLOCK_PRINTS = 40_000
#: Blocks are told apart by up to so many bits; counts of 2 ** DEPTH values go to the driver.
DEPTH = 16
#: Variants that a task holds at once.
SLICE = 1_500_000


def lower_table() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, words: int, lower: bytes) -> list[int]:
    """XXH64 of each run of so many words, joined by spaces; of all words if there are fewer; none if there is no word."""
    parts = text.translate(lower).split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    return [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(parts[k:] for k in range(words)), strict=False)]


def bit_table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(hashes: list[int], bits_of: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits_of for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def with_fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with f in place of their text."""
    others = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, bits_of = lower_table(), bit_table()
        for batch in batches:
            out = []
            for _, _, data, at in chunks(batch.column(len(others))):
                raw, at = data.tobytes(), at.tolist()
                out += [fingerprint(shingle_hashes(raw[a:b], words, lower), bits_of) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(out, np.uint64).view(np.int64))], names=[*others, "f"])
        give_back()

    schema = documents.select(*others).schema.add("f", "long")
    return documents.select(*others, "text").mapInArrow(run, schema)


def masks(bits: int, most: int) -> np.ndarray:
    """All patterns of up to `most` ones in the lowest `bits` bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


class Blocks:
    """The leaves (depth, value of the lowest bits) of a tree for each segment; leaf k is block k."""

    def __init__(self, counts: dict[int, np.ndarray], half: int, most: int):
        """counts: for each segment, how many fingerprints have each value of the lowest bits (2 ** d of them)."""
        self.half, self.leaves, self.tables = half, [], {}
        for segment, count in sorted(counts.items()):
            deepest, still = len(count).bit_length() - 1, np.zeros(1, np.int64)
            for depth in range(deepest + 1):
                here = count.reshape(-1, 1 << depth).sum(0)
                load = sum(here[np.arange(1 << depth) ^ int(m)] for m in masks(depth, half))
                done = (load[still] <= most) | (depth == deepest)
                if done.any():
                    table = np.full(1 << depth, -1, np.int32)
                    table[still[done]] = np.arange(len(self.leaves), len(self.leaves) + done.sum())
                    self.leaves += [(depth, int(v)) for v in still[done]]
                    self.tables[segment, depth] = table
                still = np.concatenate([still[~done], still[~done] | (1 << depth)])
        self.flips = {depth: masks(depth, half) for _, depth in self.tables}

    def of(self, segment: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, row of f) of each block that a fingerprint has a variant in."""
        blocks, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for depth, flips in self.flips.items():
            table = self.tables.get((segment, depth))
            if table is not None:
                to = table[((f[:, None] ^ flips[None, :]) & np.uint64((1 << depth) - 1)).astype(np.int64)]
                row = np.nonzero(to >= 0)
                blocks.append(to[row])
                rows.append(row[0])
        return np.concatenate(blocks), np.concatenate(rows)


def blocks_of(counts: DataFrame, half: int, most: int, depth: int) -> Blocks:
    """From rows of segment, low (the lowest depth bits) and n. The driver gets one row for each segment and value."""
    rows = counts.groupBy("segment", "low").agg(F.sum("n").alias("n")).toPandas()
    return Blocks({int(k): np.bincount(g["low"], g["n"], 1 << depth).astype(np.int64) for k, g in rows.groupby("segment")}, half, most)


def dealt_prints(blocks: Blocks, segment: int, bits: int, f: np.ndarray, keys: np.ndarray | None = None, nodes: np.ndarray | None = None) -> pa.RecordBatch:
    """Fingerprints of so many bits with their keys and nodes, as one row (see DEALT) for each block that they go to."""
    to, row = blocks.of(segment, f)
    order = np.argsort(to, kind="stable")
    to, row = to[order], row[order]
    edges = np.flatnonzero(np.diff(to, prepend=-1))
    ends = [*edges[1:].tolist(), len(to)] if len(edges) else []
    prints = f[row].astype("<u4" if bits <= 32 else "<u8")
    own = keys[row] if keys is not None else np.zeros(0, np.int64)
    other = nodes[row] != own if nodes is not None else np.zeros(len(row), bool)
    cols: list[list[bytes]] = [[], [], [], []]
    for lo, hi in zip(edges.tolist(), ends, strict=True):
        spots = np.flatnonzero(other[lo:hi])
        for col, values in zip(cols, (prints[lo:hi], own[lo:hi], spots.astype("<u4"), nodes[row[lo + spots]] if len(spots) else own[:0]), strict=True):
            col.append(values.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(to[edges], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=[x.split()[0] for x in DEALT.split(", ")])


def dealt_back(rows: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prints, keys and nodes of a block."""
    f, keys, nodes = [], [], []
    for x, k, spots, other in zip(*(rows.column(c) for c in ("prints", "keys", "spots", "nodes")), strict=True):
        f.append(np.frombuffer(x.as_buffer(), "<u4" if bits <= 32 else "<u8").astype(np.uint64))
        keys.append(np.frombuffer(k.as_buffer(), np.int64) if len(k.as_buffer()) else f[-1].view(np.int64))
        nodes.append(keys[-1].copy())
        nodes[-1][np.frombuffer(spots.as_buffer(), "<u4")] = np.frombuffer(other.as_buffer(), np.int64)
    return np.concatenate(f), np.concatenate(keys), np.concatenate(nodes)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b among nodes below n to keep, so that what they connect stays connected and no link is
    more than is needed."""
    root, kept = np.arange(n), []
    while True:
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        apart = np.flatnonzero(lo != hi)
        if not len(apart):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *kept]))
        apart = apart[np.lexsort((lo[apart], hi[apart]))]
        apart = apart[np.diff(hi[apart], prepend=-1) != 0]  # each upper root is hung below one other
        kept.append(apart)
        root[hi[apart]] = lo[apart]
        while (root[root] != root).any():
            root = root[root]


def variants_in(f: np.ndarray, depth: int, value: int, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants without their lowest depth bits, rows of f): those whose lowest bits are value, in slices that hold all
    rows of a variant together."""
    low = np.uint64((1 << depth) - 1)
    spent = np.bitwise_count((f & low) ^ np.uint64(value))
    flips = [masks(bits - depth, half - used) << np.uint64(depth) for used in range(half + 1)]
    own = [np.flatnonzero(spent == used) for used in range(half + 1)]
    slices = 1 + sum(len(x) * len(y) for x, y in zip(own, flips, strict=True)) // SLICE
    for part in range(slices):
        variants, rows = [], []
        for row, flip in zip(own, flips, strict=True):
            step = max(1, SLICE // (2 * len(flip)))
            for lo in range(0, len(row), step):
                some = row[lo : lo + step]
                v, r = ((f[some] & ~low)[:, None] ^ flip[None, :]).ravel(), np.repeat(some, len(flip))
                if slices > 1:
                    here = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == part)
                    v, r = v[here], r[here]
                variants.append(v)
                rows.append(r)
        yield np.concatenate([np.zeros(0, np.uint64), *variants]), np.concatenate([np.zeros(0, np.int64), *rows])


def meeter(blocks: Blocks, bits: int):
    """Links a-b of keys that share a variant in one block and have different nodes; they connect all such nodes."""

    def run(rows: pa.Table) -> pa.Table:
        depth, value = blocks.leaves[rows.column("block")[0].as_py()]
        f, keys, nodes = dealt_back(rows, bits)
        order = np.lexsort((keys, f, nodes))
        new = np.ones(len(order), bool)  # of a node's equal fingerprints one is enough
        new[1:] = (f[order][1:] != f[order][:-1]) | (nodes[order][1:] != nodes[order][:-1])
        order = order[new]
        f, keys, nodes = f[order], keys[order], nodes[order]
        names, node = np.unique(nodes, return_inverse=True)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for variants, own in variants_in(f, depth, value, bits, blocks.half):
            order = np.lexsort((own, variants))
            variants, own = variants[order], own[order]
            first = np.ones(len(own), bool)
            first[1:] = variants[1:] != variants[:-1]
            lead = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))] if len(own) else own
            some = (node[lead] != node[own]) & (np.bitwise_count(f[lead] ^ f[own]) <= 2 * blocks.half)
            lead, own = lead[some], own[some]
            kept = forest(node[lead], node[own], len(names))
            a.append(lead[kept])
            b.append(own[kept])
        a, b = np.concatenate(a), np.concatenate(b)
        kept = forest(node[a], node[b], len(names))
        return pa.table([pa.array(keys[a[kept]]), pa.array(keys[b[kept]])], names=["a", "b"])

    return run


def met(dealt: DataFrame, blocks: Blocks, bits: int) -> DataFrame:
    """The links of all blocks, about one block to a task: a block ships little and takes long, so its bytes say nothing."""
    return dealt.repartition(max(1, len(blocks.leaves)), "block").groupBy("block").applyInArrow(lean(meeter(blocks, bits)), "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From rows of f (longs, distinct): pairs a, b of fingerprints within the radius that connect all that are."""
    half = radius // 2
    low = F.col("f").bitwiseAND(F.lit((1 << DEPTH) - 1)).cast("int")
    blocks = blocks_of(prints.select(F.lit(0).alias("segment"), low.alias("low"), F.lit(1).alias("n")), half, BLOCK_PRINTS, DEPTH)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(f), 20_000):
                some = f[lo : lo + 20_000]
                yield dealt_prints(blocks, 0, BITS, some.view(np.uint64))

    return met(prints.select("f").mapInArrow(deal, DEALT), blocks, BITS)


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row for each row of documents: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that
    can be reached over fingerprints within the radius; null only if all of them are null).

    A null text counts as an empty one, whose fingerprint is 0 and is linked like any other. radius must be even.
    Exact copies share a fingerprint, so only distinct ones are compared; the smallest doc_id of each is aggregated
    before the shuffle.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    rows = saved(with_fingerprints(documents.select("doc_id", "text"), words))
    firsts = saved(rows.groupBy("f").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(firsts, radius))
    named = firsts.join(parts, firsts["f"] == parts["node"], "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, of which none is near another one: the row of the smallest doc_id stays of
    each group. Rows with a null doc_id stay; copies that also share their doc_id stay together."""
    groups = near_duplicates(documents, words, radius)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
