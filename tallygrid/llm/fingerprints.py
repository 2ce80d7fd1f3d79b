"""Document fingerprints: an exact digest of canonical text.

Canonical text: NFKC, case-folded, NFKC again, runs of white space as one space, none at the ends. Its fingerprint is
the 128-bit XXH3 in hex. Texts whose fingerprints agree are compared byte by byte, edited texts by their SHA-256 with
these; should different canonical texts share a fingerprint, each gets it with its SHA-256 appended.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import dealt_by_ranges, saved, table, unpacked

#: Up to so many copies (ids and fingerprints, about 100 bytes each) are broadcast for the byte comparison.
BROADCAST_COPIES = 500_000
#: Up to so many shared fingerprints are broadcast; there are none but by chance.
BROADCAST_CLASHES = 100_000


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t.as_py())) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; a null text counts as an empty one."""
    return documents.select("doc_id", "text").mapInArrow(fingerprint_rows, "doc_id long, fingerprint string")


def canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        canon = [canonical(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(c) for c in canon], pa.string()), pa.array(canon, pa.binary())], names=["doc_id", "fingerprint", "canon"])


def collisions(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """doc_id, fingerprint and own (the fingerprint to use instead) of rows whose canonical text differs from another
    one of the same fingerprint.

    Only rows whose fingerprint repeats are looked at. Copies are grouped by fingerprint and canonical bytes, so they
    fall together in the tasks that read them, and a large group costs no more than a small one.
    """
    often = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    copies = prints.join(often, "fingerprint", "left_semi").select("doc_id").distinct()
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    copies = copies.withColumnRenamed("doc_id", "copy_id")
    rows = documents.select("doc_id", "text")
    rows = rows.join(F.broadcast(copies) if few else copies, rows["doc_id"].eqNullSafe(copies["copy_id"]), "left_semi").mapInArrow(canonical_rows, "doc_id long, fingerprint string, canon binary")
    texts = rows.groupBy("fingerprint", "canon").agg(F.count("*").alias("n")).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    return rows.join(texts, "fingerprint", "left_semi").select("doc_id", "fingerprint", F.concat("fingerprint", F.lit("-"), F.sha2("canon", 256)).alias("own"))


def compare_run(rows: pa.Table) -> pa.Table:
    rows = unpacked(rows.column("block"))
    order = pc.sort_indices(rows, sort_keys=[("next_run", "ascending"), ("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    rows = rows.take(order)
    ids, texts, tail = rows.column("doc_id").to_pylist(), rows.column("text"), rows.column("next_run").to_pylist()
    own = len(ids) - sum(tail)
    out: list[tuple] = []
    text = texts[0].as_py() or ""
    canon = canonical(text)
    for k in range(own):
        follower = (texts[k + 1].as_py() or "") if k + 1 < len(ids) else text
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        canon_edited, canon_next = canonical(edited) if edited != text else canon, canonical(follower)
        out.append((ids[k], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(canon), digest(canon_edited), float(canon == canon_edited), float(canon == canon_next), hashlib.sha256(canon).hexdigest(), hashlib.sha256(canon_edited).hexdigest()))
        text, canon = follower, canon_next
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canon_sha256 string, canon_edited_sha256 string"


def told_apart(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows with fingerprints of their own where they are among the shared ones or stand for different canonical texts,
    by their SHA-256, anywhere in rows."""
    both = rows.select("fingerprint", F.col("canon_sha256").alias("sha")).union(rows.select("edited_fingerprint", "canon_edited_sha256"))
    differ = both.groupBy("fingerprint").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("fingerprint")
    clash = saved(shared.select("fingerprint").union(differ).distinct())
    few = clash.count() <= BROADCAST_CLASHES
    for name, sha in (("fingerprint", "canon_sha256"), ("edited_fingerprint", "canon_edited_sha256")):
        side = clash.select(F.col("fingerprint").alias("clash"))
        rows = rows.join(F.broadcast(side) if few else side, F.col(name) == F.col("clash"), "left")
        rows = rows.withColumn(name, F.when(F.col("clash").isNotNull(), F.concat(name, F.lit("-"), sha)).otherwise(F.col(name))).drop("clash")
    return rows.drop("canon_sha256", "canon_edited_sha256")


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: its fingerprint, that of its edited text (the second half replaced by the
    beginning of the next document's), and whether they and the next document's are the same (1 or 0).

    Rows are in order of doc_id (null first), then text (null first); after the last comes the first. A null text
    counts as an empty one. All rows of one doc_id (and all with none) are worked through together. Other columns are
    ignored.
    """
    documents = documents.select("doc_id", "text")
    runs = dealt_by_ranges(documents, "doc_id", neighbours=True)
    rows = saved(runs.groupBy("run").applyInArrow(compare_run, SCHEMA))
    return told_apart(rows, collisions(documents, rows.select("doc_id", "fingerprint")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
