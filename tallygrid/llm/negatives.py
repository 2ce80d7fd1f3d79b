"""Hard negatives: for an anchor and each of its positives, rows of other labels that score high, but surely below it.

A kNN join over Voronoi cells. Scores are inner products of whole numbers. A coordinate sqrt(M^2 - |x|^2), with M the
largest norm, is added to each row and a zero to each anchor; then the best score is the smallest distance. Rows go to
the cell of their nearest pivot and travel in blocks of such rows. By the triangle inequality a cell whose rows lie
between two distances from the pivot can hold a row within a distance of an anchor only if the pivot is near enough, or
far enough, from the anchor.

Anchors are worked through in blocks of neighbours. Each block first meets the cells that its anchors lie in; what is
found there bounds what can still come in, and then only the cells that may hold better rows are sent to it. Blocks
meet in parts of bounded size and give the best rows of each part; the best of all parts are the result. So a cell with
a third of all rows is many blocks, and an anchor with many candidates is several parts.

A block of anchors meets all cells in the worst case, which data without clusters come near to; it is the number of
anchors to a block that then bounds what is sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import lean_pair, saved, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Pivots at most (the driver holds them, and each task), rows to a block, anchors to a block, rows to a part.
PIVOTS, BLOCK_ROWS, BLOCK_ANCHORS, PART_ROWS = 1024, 4096, 512, 1 << 17
#: Products are exact below this: the place in a block goes into the same number.
EXACT = 1 << 50
BLOCK = "cell int, near double, far double, n int, ids binary, labels binary, vectors binary"
ANCHORS = "ids binary, labels binary, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
HIT = "block long, anchor int, anchor_id long, nth int, positive_id long, positive_score long, id long, score long"
NONE = np.iinfo(np.int64).min


def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and vector (array of long) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = flat[at[0] : at[-1]]
    return out


class Space:
    """Pivots and the form of vectors: their width, number type, and the square of the largest norm."""

    def __init__(self, pivots: np.ndarray, width: int, top: float, largest: int):
        self.width, self.top = width, top
        self.kind = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")
        self.real = np.float32 if width * largest * largest < 1 << 24 else np.float64  # exact in any order of sums
        self.pivots = pivots.astype(np.float64)
        self.norms = (self.pivots**2).sum(1)
        self.last = np.sqrt(np.maximum(0, top - self.norms))
        self.slack = 1e-6 * (1 + math.sqrt(top))

    def rows_to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows, with their added coordinate."""
        x = x.astype(np.float64)
        norms = (x**2).sum(1)
        last = np.sqrt(np.maximum(0, self.top - norms))
        return np.sqrt(np.maximum(0, norms[:, None] + self.norms - 2 * (x @ self.pivots.T) + (last[:, None] - self.last) ** 2))

    def anchors_to_pivots(self, x: np.ndarray) -> np.ndarray:
        return self.distance(x, x.astype(np.float64) @ self.pivots.T)

    def distance(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Of anchors to what has these scores (a row of scores for each anchor)."""
        norms = (anchors.astype(np.float64) ** 2).sum(1)
        return np.sqrt(np.maximum(0, norms[:, None] + self.top - 2 * scores))

    def vectors(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width) if self.width else np.zeros((0, 0), self.kind)


def blocks_of_rows(space: Space, flush: int = 1 << 16) -> Callable:
    """Of vec_id, label, vector: blocks of the rows of one cell, from the nearest to the pivot to the farthest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, labels, x, cell, near = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((near, cell))
            edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for lo, end in zip(edges, [*edges[1:], len(order)], strict=True):
                for at in range(lo, end, BLOCK_ROWS):
                    k = order[at : min(end, at + BLOCK_ROWS)]
                    row = [pa.array([cell[k[0]]], pa.int32()), [near[k[0]]], [near[k[-1]]], pa.array([len(k)], pa.int32()), [ids[k].tobytes()], [labels[k].tobytes()], [x[k].tobytes()]]
                    yield pa.RecordBatch.from_pydict(dict(zip((c.split()[0] for c in BLOCK.split(", ")), row, strict=True)))

        rows = 0
        for batch in batches:
            x = matrix(batch.column(2), space.width)
            to = space.rows_to_pivots(x)
            cell = to.argmin(1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), x.astype(space.kind), cell, to[np.arange(len(cell)), cell]))
            rows += len(cell)
            if rows > flush:
                yield from out()
                rows = 0
        if held:
            yield from out()

    return run


def blocks_of_anchors(space: Space, groups: int) -> Callable:
    """Of vec_id, label, vector: blocks of anchors that are near to the same of the first `groups` pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), space.width)) for b in batches]
        if not held:
            return
        ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(space.anchors_to_pivots(x)[:, :groups].argmin(1), kind="stable")
        for at in range(0, len(order), BLOCK_ANCHORS):
            k = order[at : at + BLOCK_ANCHORS]
            yield pa.RecordBatch.from_pydict({"ids": [ids[k].tobytes()], "labels": [labels[k].tobytes()], "vectors": [x[k].astype(space.kind).tobytes()]})

    return run


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row, by score descending, then id; a score of NONE is no entry."""
    order = np.lexsort((ids, -scores.astype(np.float64)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Best:
    """The best k rows of each of n lists, while blocks go by."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """scores: lists x rows, rows in ascending order of id; fits: which of them count."""
        fits &= scores >= self.scores[:, -1:]
        some = np.flatnonzero(fits.any(1))
        if not len(some):
            return
        n = scores.shape[1]
        key = np.where(fits[some], scores[some] * n + np.arange(n - 1, -1, -1), NONE)  # a smaller id is the larger key
        k = min(self.k, n)
        key = np.take_along_axis(key, np.argpartition(key, n - k, axis=1)[:, n - k :], 1)
        found = key != NONE
        place = np.where(found, n - 1 - key % n, 0)
        new = np.where(found, key // n, NONE)
        self.scores[some], self.ids[some] = first_rows(np.concatenate([self.scores[some], new], 1), np.concatenate([self.ids[some], ids[place]], 1), self.k)


def positive_lists(anchors: dict, k: int) -> tuple[list, Callable]:
    """One list for each anchor: rows of its label that are not itself."""

    def fits(_: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels == anchors["labels"][:, None]) & (ids != anchors["ids"][:, None])

    return [Best(len(anchors["ids"]), k)], fits


def negative_lists(anchors: dict, k: int) -> tuple[list, Callable]:
    """One list for each anchor and positive: rows of other labels within the limits."""

    def fits(nth: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels != anchors["labels"][:, None]) & (scores >= anchors["low"][:, nth : nth + 1]) & (scores <= anchors["high"][:, nth : nth + 1])

    return [Best(len(anchors["ids"]), k) for _ in range(anchors["low"].shape[1])], fits


def opened(space: Space, row: dict) -> dict:
    """An anchor block's columns as arrays; low and high are the limits for each positive."""
    out = {"ids": np.frombuffer(row["ids"], np.int64), "labels": np.frombuffer(row["labels"], np.int64)}
    out["vectors"] = space.vectors(row["vectors"]) if space.width else np.zeros((len(out["ids"]), 0), space.kind)
    for name in ("positive_ids", "positive_scores", "low", "high"):
        if name in row:
            out[name] = np.frombuffer(row[name], np.int64).reshape(len(out["ids"]), -1)
    return out


def meeting(space: Space, lists: Callable, k: int) -> Callable:
    """Of one part's blocks of rows and the block of anchors: the best rows of each list."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in HIT.split(", ")]
        if not len(rows) or not len(anchors):
            return pa.table({n: pa.array([], pa.int32() if n in ("anchor", "nth") else pa.int64()) for n in names})
        row = anchors.slice(0, 1).to_pylist()[0]
        a = opened(space, row)
        best, fits = lists(a, k)
        q = a["vectors"].astype(space.real)
        for r in rows.select(["ids", "labels", "vectors"]).to_batches(max_chunksize=1):
            ids, labels = np.frombuffer(r.column(0)[0].as_py(), np.int64), np.frombuffer(r.column(1)[0].as_py(), np.int64)
            order = np.argsort(ids, kind="stable")
            x = space.vectors(r.column(2)[0].as_py()) if space.width else np.zeros((len(ids), 0), space.kind)
            scores = (q @ x[order].astype(space.real).T).astype(np.int64)
            for nth, b in enumerate(best):
                b.take(scores, ids[order], fits(nth, scores, ids[order], labels[order]))
        cols: list[list[np.ndarray]] = [[] for _ in names]
        for nth, b in enumerate(best):
            at, j = np.nonzero(b.scores != NONE)
            told = [a[c][at, nth] if c in a else np.zeros(len(at), np.int64) for c in ("positive_ids", "positive_scores")]
            for col, v in zip(cols, [np.full(len(at), row["block"]), at, a["ids"][at], np.full(len(at), nth), *told, b.ids[at, j], b.scores[at, j]], strict=True):
                col.append(v)
        return pa.table({n: pa.array(np.concatenate(c), pa.int32() if n in ("anchor", "nth") else pa.int64()) for n, c in zip(names, cols, strict=True)})

    return run


class Bounds:
    """How near to its pivot and how far from it the rows of each cell lie."""

    def __init__(self, space: Space, cells: list):
        self.space, n = space, len(space.pivots)
        self.near, self.far = np.full(n, np.inf), np.full(n, -np.inf)
        for r in cells:
            self.near[r["cell"]], self.far[r["cell"]] = r["near"], r["far"]

    def least(self, to: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance to any row of each cell; infinite where a cell has none."""
        return np.where(np.isinf(self.near), np.inf, np.maximum(0, np.maximum(to - self.far, self.near - to)))

    def own(self, vectors: np.ndarray) -> set[int]:
        """The cells that anchors lie in."""
        return set(np.where(np.isinf(self.near), np.inf, self.space.anchors_to_pivots(vectors)).argmin(1).tolist())


class Join:
    """The rows in blocks and what bounds their cells."""

    def __init__(self, rows: DataFrame, space: Space):
        self.space = space
        self.blocks = saved(rows.mapInArrow(blocks_of_rows(space), BLOCK).withColumn("at", F.monotonically_increasing_id()))
        #: One row for each pivot at most.
        self.cells = saved(self.blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")))
        self.bounds = Bounds(space, self.cells.collect())

    def meet(self, anchors: DataFrame, lists: Callable, k: int) -> DataFrame:
        """HIT rows: the best of each part for the lists of each block of anchors, over the cells in its column `cells`."""
        needs = anchors.select("block", F.explode("cells").alias("cell"))
        parts = needs.join(self.cells, "cell").groupBy("block").agg(F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("parts"))
        sent = needs.join(parts, "block").join(self.blocks.select("cell", "at", "ids", "labels", "vectors"), "cell")
        sent = sent.select(F.col("block").alias("block"), F.pmod(F.xxhash64("at"), F.col("parts")).cast("int").alias("part"), "ids", "labels", "vectors")
        to = anchors.drop("cells").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return sent.groupBy("block", "part").cogroup(to.groupBy("block", "part")).applyInArrow(lean_pair(meeting(self.space, lists, k)), HIT)


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each list, with their rank."""
    first = Window.partitionBy("block", "anchor", "nth").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def positive_table(hits: pa.Table, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranked hits as anchors x lists x k: scores, ids (NONE where there is none), of lists in order of nth."""
    lists = 1 + max([0, *hits.column("nth").to_pylist()])
    scores, ids = np.full((n, lists, k), NONE), np.zeros((n, lists, k), np.int64)
    at = tuple(hits.column(c).to_numpy() for c in ("anchor", "nth")) + (hits.column("rank").to_numpy() - 1,)
    scores[at], ids[at] = hits.column("score").to_numpy(), hits.column("id").to_numpy()
    return scores, ids, at[0]


def own_cells(bounds: Bounds) -> Callable:
    """To anchor blocks: the cells that its anchors lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for row in batch.to_pylist():
                cells.append(sorted(bounds.own(opened(bounds.space, row)["vectors"])))
            yield batch.append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return run


def wider(bounds: Bounds, k: int) -> Callable:
    """Of the block of anchors and the positives found so far: the other cells that may hold better ones."""

    def run(anchors: pa.Table, hits: pa.Table) -> pa.Table:
        row = anchors.to_pylist()[0]
        a = opened(bounds.space, row)
        scores = positive_table(hits, len(a["ids"]), k)[0][:, 0, -1]
        reach = np.where(scores == NONE, np.inf, bounds.space.distance(a["vectors"], np.where(scores == NONE, 0, scores)[:, None])[:, 0])
        need = (bounds.least(bounds.space.anchors_to_pivots(a["vectors"])) <= reach[:, None] + bounds.space.slack) & ~np.isinf(bounds.near)
        cells = sorted(set(np.flatnonzero(need.any(0)).tolist()) - set(row["cells"]))
        return anchors.set_column(anchors.schema.get_field_index("cells"), "cells", pa.array([cells], pa.list_(pa.int32())))

    return run


def with_limits(bounds: Bounds, k: int, least: int, most: int) -> Callable:
    """Of the block of anchors and their positives: the block with these and the limits for negatives; the cells that
    rows within the limits may lie in, the anchors' own ones first (cells) and the others (others)."""

    def run(anchors: pa.Table, hits: pa.Table) -> pa.Table:
        row = anchors.to_pylist()[0]
        a = opened(bounds.space, row)
        scores, ids, _ = positive_table(hits, len(a["ids"]), k)
        scores, ids = scores[:, 0], ids[:, 0]
        there = (scores != NONE) & (scores >= 0)  # below zero the limits are the wrong way round: no score is within them
        s = np.where(there, scores, 0)
        low, high = np.where(there, -(-least * s // 100), 1), np.where(there, most * s // 100, 0)
        own, need = bounds.own(a["vectors"]), reachable(bounds, a["vectors"], low, high)
        new = {"positive_ids": ids, "positive_scores": scores, "low": low, "high": high}
        out = {**{c: [row[c]] for c in ("block", "ids", "labels", "vectors")}, **{c: [np.ascontiguousarray(v).tobytes()] for c, v in new.items()}}
        return pa.table({**out, "cells": pa.array([sorted(need & own)], pa.list_(pa.int32())), "others": pa.array([sorted(need - own)], pa.list_(pa.int32()))})

    return run


def reachable(bounds: Bounds, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> set[int]:
    """Cells that may hold a row between the limits of some list of some anchor."""
    some = (low <= high).any(1)
    if not some.any():
        return set()
    low, high = np.where(low <= high, low, np.iinfo(np.int64).max).min(1), np.where(low <= high, high, NONE).max(1)
    a, low, high = vectors[some], low[some], high[some]
    far, near = (bounds.space.distance(a, x.astype(np.float64)[:, None]) for x in (low, high))
    to = bounds.space.anchors_to_pivots(a)
    need = (bounds.least(to) <= far + bounds.space.slack) & (to + bounds.far >= near - bounds.space.slack) & ~np.isinf(bounds.near)
    return set(np.flatnonzero(need.any(0)).tolist())


def closer(bounds: Bounds, k: int) -> Callable:
    """Of the block with its limits and the negatives found so far: limits that only better ones are within, and the
    other cells that may hold such."""

    def run(anchors: pa.Table, hits: pa.Table) -> pa.Table:
        row = anchors.to_pylist()[0]
        a = opened(bounds.space, row)
        low = a["low"].copy()
        scores = positive_table(hits, len(a["ids"]), k)[0]
        last = scores[:, :, -1]
        low[:, : last.shape[1]] = np.maximum(low[:, : last.shape[1]], last)
        cells = sorted(reachable(bounds, a["vectors"], low, a["high"]) & set(row["others"]))
        out = {c: [row[c]] for c in ("block", "ids", "labels", "vectors", "positive_ids", "positive_scores", "high")}
        return pa.table({**out, "low": [np.ascontiguousarray(low).tobytes()], "cells": pa.array([cells], pa.list_(pa.int32()))})

    return run


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, pivots: int = PIVOTS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding)
    that is_anchor names: their first `positives` rows of the same label, and for each of these the first `negatives`
    rows of other labels whose score is `least` to `most` hundredths of the positive's.

    Components become floor(scale * x); scores are exact inner products; higher ones come first, ties by smaller vec_id.
    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part. Vectors of
    fewer components than others end in zeros. An anchor's other rows are those with another vec_id; an anchor row that
    repeats counts once, any other row as often as it stands there. Empty tables and anchors without positives give no
    rows. Other columns are ignored. Components so large that a score could pass 2^50 are refused.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, scale)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    largest = F.coalesce(F.array_max(F.transform("vector", lambda v: F.greatest(v, -v))), F.lit(0))
    n, anchors_n, top, width, largest = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(squares), F.max(F.size("vector")), F.max(largest)).first()
    if not n or not anchors_n:
        return spark.createDataFrame([], RESULT)
    if width * largest * largest >= EXACT:
        raise ValueError(f"components up to {largest} in {width} dimensions are too large for exact scores")
    picked = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(min(pivots, max(1, math.ceil(math.sqrt(n) / 4))))
    at = np.array([r["vector"] + [0] * (width - len(r["vector"])) for r in picked.collect()], np.int64).reshape(-1, width)
    space = Space(np.unique(at, axis=0), width, float(top), int(largest))
    join = Join(rows, space)
    groups = min(len(space.pivots), math.ceil(anchors_n / BLOCK_ANCHORS))
    chosen = rows.where(is_anchor).distinct().repartition(math.ceil(anchors_n / (16 * BLOCK_ANCHORS)), "vec_id")
    anchors = saved(chosen.mapInArrow(blocks_of_anchors(space, groups), ANCHORS).withColumn("block", F.monotonically_increasing_id()))

    anchors = anchors.mapInArrow(own_cells(join.bounds), f"{ANCHORS}, block long, cells array<int>")
    found = saved(best_hits(join.meet(anchors, positive_lists, positives), positives))
    then = anchors.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(wider(join.bounds, positives), f"{ANCHORS}, block long, cells array<int>")
    found = saved(best_hits(found.drop("rank").union(join.meet(saved(then), positive_lists, positives)), positives))

    bounded = f"block long, {ANCHORS}, positive_ids binary, positive_scores binary, low binary, high binary, cells array<int>, others array<int>"
    anchors = saved(anchors.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(with_limits(join.bounds, positives, least, most), bounded))
    hits = saved(best_hits(join.meet(anchors.drop("others"), negative_lists, negatives), negatives))
    closed = f"block long, {ANCHORS}, positive_ids binary, positive_scores binary, high binary, low binary, cells array<int>"
    then = saved(anchors.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(closer(join.bounds, negatives), closed))
    hits = best_hits(hits.drop("rank").union(join.meet(then, negative_lists, negatives)), negatives)
    return hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT DISTINCT vec_id, label, q FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
