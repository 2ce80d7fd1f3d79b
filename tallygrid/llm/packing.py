"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Pieces (documents, or parts of long ones) are placed by falling length, each into the fullest bin that still has room
and holds nothing of the same source or of the same duplicate cluster. Open bins are ordered by what room is left and
carry a bitmap of sources and one of clusters; the search goes up from the tightest bin until one is compatible.

Duplicate clusters are those of SimHash fingerprints (see simhash.py): near copies never share a bin.

Packing is done in shards: a piece's shard is a hash of its document and number, so every shard gets its share of a
hot source or of a large cluster, and shards have about SHARD_PIECES pieces however many pieces a document makes.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import simhash
from tallygrid.llm.common import lean, saved, table
from tallygrid.llm.components import connected_components

CAPACITY = 2048
SHARD_PIECES = 4096
#: Up to so many fingerprints of near copies (16 bytes each) are broadcast.
BROADCAST_PRINTS = 2_000_000
SCHEMA = "doc_id long, piece int, source string, n_words int, bin_id long, bin_offset int, bin_used int"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece, for pieces in the order they are to be placed. A None never conflicts."""
    source_bits = {x: 1 << k for k, x in enumerate(dict.fromkeys(x for x in sources if x is not None))}
    seen: dict = {}
    for x in clusters:
        seen[x] = seen.get(x, 0) + 1
    cluster_bits = {x: 1 << k for k, x in enumerate(x for x, n in seen.items() if n > 1 and x is not None)}
    order: list[tuple[int, int]] = []  # (room left, bin)
    holds: list[list[int]] = []  # bitmaps of each bin
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bits.get(source, 0), cluster_bits.get(cluster, 0)
        for k in range(bisect.bisect_left(order, (n, -1)), len(order)):
            room, b = order[k]
            if not holds[b][0] & s and not holds[b][1] & c:
                del order[k]
                holds[b][0] |= s
                holds[b][1] |= c
                break
        else:
            room, b = capacity, len(holds)
            holds.append([s, c])
        bisect.insort(order, (room - n, b))
        out.append((b, capacity - room))
    return out


def shard_packer(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        cols = {c: rows.column(c).to_pylist() for c in rows.column_names}
        placed = best_fit(cols["n_words"], cols["source"], cols["cluster"], capacity)
        used: dict[int, int] = {}
        for (b, _), n in zip(placed, cols["n_words"], strict=True):
            used[b] = used.get(b, 0) + n
        base = cols["shard"][0] << 32
        values = [cols["doc_id"], cols["piece"], cols["source"], cols["n_words"], [base + b for b, _ in placed], [at for _, at in placed], [used[b] for b, _ in placed]]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return lean(run)


def counted(documents: DataFrame) -> DataFrame:
    """doc_id, source, n (words) and cluster (null without words) of each row; each text is read once."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = saved(simhash.with_fingerprints(documents.select("doc_id", F.col("source").cast("string").alias("source"), n.alias("n"), "text")))
    near = connected_components(simhash.links(rows.where("n > 0").select("f").distinct()))
    few = near.limit(BROADCAST_PRINTS + 1).count() <= BROADCAST_PRINTS
    rows = rows.join(F.broadcast(near) if few else near, F.col("f") == F.col("node"), "left")
    return rows.select("doc_id", "source", "n", F.when(F.col("n") > 0, F.coalesce("component", "f")).alias("cluster"))


def pack(documents: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces of every row of documents (doc_id, text, source): doc_id, piece (from 0), source, n_words, bin_id,
    bin_offset (words before it in its bin) and bin_used.

    A text of more than capacity words (runs of anything but ASCII white space) is cut into pieces of capacity words and
    a rest. A null or empty text is one piece of no words. Pieces of one source, or of near copies, never share a bin; a
    null source or a text without words has no conflict. The order of equal pieces is by doc_id (null last), piece,
    source.
    """
    rows = saved(counted(documents))
    many = F.greatest(F.ceil(F.col("n") / capacity).cast("int"), F.lit(1))
    shards = max(1, -(-(rows.agg(F.sum(many)).first()[0] or 0) // shard_pieces))
    rows = rows.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    rows = rows.select("doc_id", "piece", "source", "cluster", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_words"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInArrow(shard_packer(capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
