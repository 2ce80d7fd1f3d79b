"""Near-duplicates by the similarity of their shingle sets: SimHash ball hashing finds them, exact comparison decides.

A 64-bit fingerprint tells sets with a similarity of 0.8 from others too coarsely: they differ in some ten bits. So the
distinct word shingles of a text make a longer fingerprint, which is cut into segments. In each segment every
fingerprint emits all variants within half the radius and equal variants meet, as in simhash.py. How long a segment is
and how many there are comes from the number of sets: so long that chance meets are rare however many sets there are,
and so many that a pair at the least similarity meets in one of them with a chance of RECALL (over 99.99 % from 0.85 on).
Bits of small sets differ more often than the angle between them says, so that chance is reckoned at the set size where
they differ most.

Sets of up to SHORT shingles have no fingerprint: each emits itself and what is left of it without as many shingles as
may differ, and so do those slightly larger that may be similar to one of them. Two sets are similar enough if and only
if they meet in what they have in common and neither lacks too much, so all short pairs are found, however many sets
there are. What meets is linked to the one that has least besides, which connects all that are similar.

1. What meets in the first FIRST segments, directly or over others, is one node when the rest meet, so that a family of
   thousands of near copies gives a link for each member and no more. Links between fingerprints that differ like
   unrelated ones are dropped. What is connected then are clusters.
2. Within each cluster sets are compared exactly. Members of a large cluster are first compared with some hundred of
   its members; those of its largest group so far needn't be compared with each other again. All other pairs of members
   are compared, in blocks of CHUNK x CHUNK. A block gives no more links than connect what they connect.

So nothing less similar than asked for is ever linked, and within a cluster no link is lost. Work is linear in a family
that hangs together, and grows with the square of those members of a cluster that match nobody (in CHUNK x CHUNK
products of matrices; no pair leaves a task).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, give_back, lean, saved
from tallygrid.llm.components import connected_components
from tallygrid.llm.simhash import DEALT, Blocks, bit_table, blocks_of, dealt_prints, forest, lower_table, masks, met, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: The chance that a pair at the least similarity meets; how many chance meets a set may have in a segment.
RECALL, CHANCE = 0.999, 0.1
#: Sets of up to so many shingles meet by what they have in common.
SHORT = 9
#: Larger sets are held to differ as their angle says.
LARGE = 64
#: Segments whose meets are connected before the rest meet.
FIRST = 2
#: Fingerprints that are meant to meet in one block of a segment.
BLOCK_PRINTS = 400_000
#: Links that differ in more than this share of their bits are chance (unrelated sets differ in half).
UNRELATED = 0.42
#: Sets of a cluster in a chunk, and the bytes of sets it may hold.
CHUNK, CHUNK_BYTES = 512, 8 << 20
#: Members of a large cluster with which all are compared first.
PIVOTS = 128
#: Up to so many keys of clusters (some 20 bytes each) are broadcast.
BROADCAST_KEYS = 2_000_000
SETS = "key long, cluster long, n long, hashes binary"


def may_differ(common: int, similarity: float) -> int:
    """How many shingles two similar sets may have besides the common ones, together."""
    return math.floor(common * (1 - similarity) / similarity + 1e-9)


def share_differing(common: int, x: int, y: int) -> float:
    """The share of bits in which the fingerprints of two sets differ that have so many hashes in common, and x and y
    besides."""
    chances = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    k = np.arange(common + 1)[:, None]
    one = [(chances(own)[None, :] * (2 * (k + np.arange(own + 1)) > common + own)).sum(1) for own in (x, y)]
    return float(chances(common) @ (one[0] * (1 - one[1]) + one[1] * (1 - one[0])))


def most_differing(similarity: float, above: int) -> float:
    """The largest share of differing bits of two similar sets of which one has over `above` hashes."""
    found = [math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi]
    for common in range(1, LARGE + 1):
        own = may_differ(common, similarity)
        found += [share_differing(common, own - y, y) for y in range(own // 2 + 1) if common + own - y > above and common + y > above]
    return max(found)


class Layout:
    """Bits of a segment, half radius and number of segments for n sets, each of over `above` hashes."""

    def __init__(self, n: int, similarity: float, above: int = SHORT):
        p = most_differing(similarity, above)
        best = None
        for half in (1, 2):
            for bits in range(16, 65):
                ball = sum(math.comb(bits, k) for k in range(2 * half + 1))
                if n * ball <= CHANCE * 2**bits or bits == 64:
                    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * half + 1))
                    many = 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - hit))
                    cost = many * (10 * bits + len(masks(bits, half)))  # a bit of the fingerprint costs some ten variants
                    best = min(best or (cost, bits, half, many), (cost, bits, half, many))
                    break
        _, self.bits, self.half, self.segments = best
        self.lanes = -(-self.bits * self.segments // 64)
        #: Blocks are told apart by so many bits.
        self.depth = min(16, 6 + math.ceil(math.log2(max(1, n / BLOCK_PRINTS))))

    def cut(self, wide: np.ndarray) -> np.ndarray:
        """The segments of fingerprints (rows of lanes * 8 bytes) as numbers."""
        bits = np.unpackbits(wide, axis=1, bitorder="little")[:, : self.bits * self.segments].reshape(-1, self.segments, self.bits)
        full = np.zeros((*bits.shape[:2], 64), np.uint8)
        full[:, :, : self.bits] = bits
        return np.packbits(full, axis=2, bitorder="little").view("<u8")[:, :, 0].astype(np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int, lower: bytes) -> list[np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending."""
    raw, at = data.tobytes(), at.tolist()
    return [np.unique(np.array(shingle_hashes(raw[a:b], words, lower), np.uint64)) for a, b in zip(at, at[1:], strict=False)]


def wide_fingerprints(sets: list[np.ndarray], lanes: int, bits_of: np.ndarray) -> np.ndarray:
    """64 * lanes bits for each set, as rows of bytes: a bit is 1 if it is in over half of the set's hashes."""
    n = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(n)) * 256, n)
    out = np.zeros((len(n), lanes * 8), np.uint8)
    weights = (1 << np.arange(8)).astype(np.uint8)
    for lane in range(lanes):
        h = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) & (1 << 64) - 1)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts = np.bincount(row + octets[:, k], minlength=len(n) * 256).reshape(len(n), 256)
            out[:, lane * 8 + k] = ((2 * (counts @ bits_of) > n[:, None]) * weights).sum(1, dtype=np.uint8)
    return out


def fingerprinter(words: int, lanes: int, similarity: float):
    """To doc_id, key and text: a digest of the set, its fingerprint (null for short sets) and its hashes (null for sets
    that can't be similar to another one of up to SHORT)."""
    reach = SHORT + may_differ(SHORT, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, bits_of = lower_table(), bit_table()
        for batch in batches:
            same, wide, hashes = [], [], []
            for _, _, data, at in chunks(batch.column(2), 1 << 20):
                sets = shingle_sets(data, at, words, lower)
                same += [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                prints = iter(wide_fingerprints([s for s in sets if len(s) > SHORT], lanes, bits_of))
                wide += [next(prints).tobytes() if len(s) > SHORT else None for s in sets]
                hashes += [s.tobytes() if len(s) <= reach and may_differ(len(s), similarity) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(wide, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "key", "same", "wide", "hashes"])
        give_back()

    return run


def rows_of(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), -1)


def counter(layout: Layout, segments: range):
    """How many fingerprints of a partition have each lowest bits, for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((layout.segments, 1 << layout.depth), np.int64)
        for batch in batches:
            f = layout.cut(rows_of(batch.column(0))) & np.uint64((1 << layout.depth) - 1) if batch.num_rows else np.zeros((0, layout.segments), np.uint64)
            for k in segments:
                counts[k] += np.bincount(f[:, k].astype(np.int64), minlength=1 << layout.depth)
        k, low = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(low, pa.int32()), pa.array(counts[k, low])], names=["segment", "low", "n"])

    return run


def dealer(layout: Layout, segments: range, blocks: Blocks):
    """Segments of key, node and wide to the blocks that their variants belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                some = batch.slice(lo, 20_000)
                keys, nodes = (some.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                f = layout.cut(rows_of(some.column(2)))
                for k in segments:
                    yield dealt_prints(blocks, k, layout.bits, np.ascontiguousarray(f[:, k]), keys, nodes)
        give_back()

    return run


def related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a, b and their fingerprints: the links that don't differ like unrelated sets."""
    for batch in batches:
        if batch.num_rows:
            x, y = rows_of(batch.column(2)), rows_of(batch.column(3))
            yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= UNRELATED * 8 * x.shape[1]))


def subsets_of(similarity: float):
    """To key and hashes: key, a hash of each subset of up to SHORT that a similar set may have in common with it, how
    many are in that and how many are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            size, keys = np.array([len(s) for s in sets], np.int64), batch.column(0).to_numpy()
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                hashes = np.stack([sets[k] for k in own.tolist()])
                whole = hashes.sum(1, dtype=np.uint64)
                for besides in range(max(0, n - SHORT), n):
                    if besides > may_differ(n - besides, similarity):
                        break
                    out = np.array(list(itertools.combinations(range(n), besides)), np.int64).reshape(math.comb(n, besides), besides)
                    left = whole[:, None] - hashes[:, out].sum(2, dtype=np.uint64) + np.uint64((n - besides) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    many = left.size
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[own], len(out))), pa.array(left.ravel().view(np.int64)), pa.array(np.full(many, n - besides, np.int32)), pa.array(np.full(many, besides, np.int32))], names=["key", "subset", "common", "besides"])

    return run


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all similar sets (key, hashes; distinct) of which one has up to SHORT hashes.

    Two sets are similar if what both have besides a common subset is no more than may differ. If a set is similar to
    any other one in a subset then it is to the one that has least besides, so links to that are enough: one a row.
    """
    meets = saved(sets.mapInArrow(subsets_of(similarity), "key long, subset long, common int, besides int"))
    first = F.min(F.struct("besides", "key")).alias("first")
    shared = meets.groupBy("subset", "common").agg(first, F.count("*").alias("n")).where("n > 1").select("subset", "common", "first")
    most = F.element_at(F.lit([may_differ(n, similarity) for n in range(1, SHORT + 1)]), F.col("common"))
    links = meets.join(shared, ["subset", "common"]).where((F.col("key") != F.col("first.key")) & (F.col("besides") + F.col("first.besides") <= most))
    return links.select(F.col("first.key").alias("a"), F.col("key").alias("b")).distinct()


def clusters(prints: DataFrame, layout: Layout, edges: DataFrame | None = None) -> DataFrame:
    """node (a key) and component of the keys that are connected by edges (a, b) or by related meets of prints (key,
    wide); others have no row."""
    parts = None
    for segments in (range(min(FIRST, layout.segments)), range(min(FIRST, layout.segments), layout.segments)):
        if not len(segments):
            continue
        named = prints.withColumn("node", F.col("key")) if parts is None else prints.join(parts, prints["key"] == parts["node"], "left").select("key", F.coalesce("component", "key").alias("node"), "wide")
        blocks = blocks_of(prints.select("wide").mapInArrow(counter(layout, segments), "segment int, low int, n long"), layout.half, BLOCK_PRINTS, layout.depth)
        links = met(named.select("key", "node", "wide").mapInArrow(dealer(layout, segments, blocks), DEALT), blocks, layout.bits).distinct()
        side = lambda name: prints.select(F.col("key").alias(name), F.col("wide").alias(f"w{name}"))
        new = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(related, "a long, b long")
        edges = saved(new if edges is None else edges.union(new))
        parts = connected_components(edges)
    return parts


def set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = lower_table()
        for batch in batches:
            sets = [s for _, _, data, at in chunks(batch.column(2)) for s in shingle_sets(data, at, words, lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "cluster", "n", "hashes"])
        give_back()

    return run


def sets_of(documents: DataFrame, parts: DataFrame, words: int) -> DataFrame:
    """key, cluster, n and hashes of the sets of the documents that are in a cluster."""
    parts = parts.select(F.col("node").alias("member"), F.col("component").alias("cluster"))
    few = parts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    texts = texts.join(F.broadcast(parts) if few else parts, F.col("key") == F.col("member")).dropDuplicates(["key"])
    return saved(texts.select("key", "cluster", "text").mapInArrow(set_maker(words), SETS))


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left has in common with each on the right."""
    both = [*left, *right]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    hashes = np.concatenate([np.zeros(0, np.uint64), *both])
    order = np.argsort(hashes, kind="stable")
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(new) - 1
    n = np.bincount(column)
    n_left = np.bincount(column[row < len(left)], minlength=len(n))
    useful = ((n_left > 0) & (n_left < n))[column]
    row, column = row[useful], (np.cumsum((n_left > 0) & (n_left < n)) - 1)[column[useful]]
    out, wide = np.zeros((len(left), len(right)), np.float32), 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + wide, wide))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = np.zeros((len(both), min(wide, int(column[hi - 1]) + 1 - k * wide)), np.float32)
        part[row[lo:hi], column[lo:hi] - k * wide] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def comparer(least: float):
    """Links among the sets of each cluster of a group that are at least so similar: of side 1 with those of side 2, of
    side 0 among each other. Sets that share a label needn't be compared."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        key, cluster, label, side, n = (rows.column(c).to_numpy() for c in ("key", "cluster", "label", "side", "n"))
        hashes = rows.column("hashes")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = np.flatnonzero(np.diff(cluster, prepend=cluster[:1] - 1))
        for lo, hi in zip(edges, [*edges[1:], len(key)], strict=True):
            left, right = (np.flatnonzero((side[lo:hi] == 0) | (side[lo:hi] == k)) + lo for k in (1, 2))
            sets = {k: np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in {*left.tolist(), *right.tolist()}}
            both = in_common([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()])
            near = (both >= least * (n[left][:, None] + n[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
            x, y = np.nonzero(near)
            names, node = np.unique(key[lo:hi], return_inverse=True)
            x, y = left[x], right[y]
            kept = forest(node[x - lo], node[y - lo], len(names))
            a.append(key[x[kept]])
            b.append(key[y[kept]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    return rows.select("g", "key", "cluster", "label", "side", "n", "hashes").groupBy("g").applyInArrow(lean(comparer(similarity)), "a long, b long")


def exact_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all sets (see SETS) of a cluster that are so similar, directly or over others."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("own")
    parts = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("long")
    sized = sets.join(saved(sizes.withColumn("parts", parts)), "cluster")
    small, large = sized.where("parts = 1"), sized.where("parts > 1")
    whole = sizes.agg(F.sum("bytes")).first()[0] or 0
    small = compared(small.select(F.pmod(F.xxhash64("cluster"), F.lit(1 + whole // CHUNK_BYTES)).alias("g"), "*", F.col("key").alias("label"), F.lit(0).alias("side")), similarity)
    if not large.limit(1).count():
        return small
    # Every member with the pivots, which go to each chunk.
    members = large.select(F.xxhash64("cluster", own).alias("g"), "*", F.col("key").alias("label"), F.lit(1).alias("side"))
    pivots = large.where(F.pmod(F.xxhash64("key", F.lit(1)), F.col("m")) < PIVOTS)
    pivots = pivots.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).select(F.xxhash64("cluster", "own").alias("g"), *large.columns, F.col("key").alias("label"), F.lit(2).alias("side"))
    found = saved(compared(members.unionByName(pivots), similarity))
    # The largest group so far of each cluster, and the others, in chunks of their own.
    labels = connected_components(found).select(F.col("node").alias("key"), F.col("component").alias("label"))
    named = large.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    groups = named.groupBy("cluster", "label").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    named = saved(named.join(groups, "cluster").withColumn("is_main", F.col("label") == F.col("main")))
    counts = named.groupBy("cluster", "is_main").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes")).withColumn("parts", parts)
    counts = counts.groupBy("cluster").agg(F.coalesce(F.sum(F.when(~F.col("is_main"), F.col("parts"))), F.lit(0)).cast("int").alias("others"), F.coalesce(F.sum(F.when(F.col("is_main"), F.col("parts"))), F.lit(0)).cast("int").alias("mains"))
    named = named.drop("parts").join(counts, "cluster")
    spot = F.pmod(F.xxhash64("key"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    named = named.withColumn("own", spot + F.when(F.col("is_main"), F.col("others")).otherwise(F.lit(0)))
    # Chunks 0 to others - 1 meet each other and the main ones; main ones don't meet each other. Below i < j.
    last = F.col("others") + F.col("mains") - 1
    lower = F.when(~F.col("is_main"), F.sequence(F.col("own"), last))
    upper = F.when(F.col("is_main") & (F.col("others") > 0), F.sequence(F.lit(0), F.col("others") - 1)).when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1))
    x = named.select("*", F.explode(lower).alias("to")).select(F.xxhash64("cluster", "own", "to").alias("g"), "key", "cluster", "label", F.when(F.col("own") == F.col("to"), 0).otherwise(1).alias("side"), "n", "hashes")
    y = named.select("*", F.explode(upper).alias("to")).select(F.xxhash64("cluster", "to", "own").alias("g"), "key", "cluster", "label", F.lit(2).alias("side"), "n", "hashes")
    return small.union(found).union(compared(x.union(y), similarity))


def similar_documents(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of documents: doc_id, key (a hash of doc_id and text) and first_key, the key of the row that
    stands for its group: the smallest doc_id (null first), then key, over all that are linked.

    Texts without words are copies of each other; a null text counts as an empty one. Equal sets count once. Other
    columns are ignored.
    """
    documents = documents.select("doc_id", "text")
    layout = Layout(documents.count(), similarity)
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = saved(rows.mapInArrow(fingerprinter(words, layout.lanes, similarity), "doc_id long, key long, same binary, wide binary, hashes binary"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")
    firsts = rows.groupBy("same").agg(F.min(order).alias("first"), F.min_by(F.struct("wide", "hashes"), order).alias("set"))
    firsts = saved(firsts.select("same", "first", F.col("first.key").alias("key"), "set.*"))
    short = saved(short_links(firsts.where("hashes IS NOT NULL").select("key", "hashes"), similarity))
    parts = clusters(firsts.where("wide IS NOT NULL").select("key", "wide"), layout, short)
    linked = connected_components(exact_links(sets_of(documents, parts, words), similarity))
    named = firsts.join(linked, firsts["key"] == linked["node"], "left").select("same", "first", F.coalesce("component", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(least, "label").select("same", F.col("least.key").alias("first_key"))
    return rows.join(named, "same").select("doc_id", "key", "first_key")


def without_similar(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, of which one stays of each group; rows that repeat doc_id and text stay
    together."""
    gone = saved(similar_documents(documents, words, similarity).where("key <> first_key").select(F.col("key").alias("_gone")).distinct())
    few = gone.count() <= BROADCAST_KEYS
    return documents.join(F.broadcast(gone) if few else gone, F.xxhash64(documents["doc_id"], documents["text"]) == F.col("_gone"), "left_anti")
