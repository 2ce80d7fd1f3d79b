"""Hard negatives, repeated windows and source divergence against SQL and brute force, with odd, hot and empty tables."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import divergence, negatives, windows
from tests.conftest import same_rows

QUERIES = {"op11": negatives, "op12": windows, "op13": divergence}


@pytest.mark.parametrize("name", QUERIES)
def test_queries_match_sql(spark, small, duck, name):
    got, want = same_rows(QUERIES[name].query(spark, small), duck, QUERIES[name].ORACLE_SQL)
    assert got == want


VECTORS = "vec_id long, label int, embedding array<float>, cell int, block long, id long, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5, 4) for r in rows], VECTORS)


def written(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clusters(n=900, seed=1):
    """Rows in tight clusters, a third of them in one; ties and exact copies among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    which = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 9, n))
    x = np.round(centres[which] * 0.6 + rng.normal(size=(n, 6)) * 0.02, 2)
    return [(i, int(rng.integers(0, 4)), [float(v) for v in x[i]]) for i in range(n)]


@pytest.mark.parametrize(("rows_to_block", "anchors_to_block", "part"), [(negatives.BLOCK_ROWS, negatives.BLOCK_ANCHORS, negatives.PART_ROWS), (7, 3, 50)])
def test_hard_negatives_of_clusters(spark, tmp_path, monkeypatch, rows_to_block, anchors_to_block, part):
    for name, value in (("BLOCK_ROWS", rows_to_block), ("BLOCK_ANCHORS", anchors_to_block), ("PART_ROWS", part)):
        monkeypatch.setattr(negatives, name, value)
    folder = written(spark, tmp_path, "embeddings", vectors(spark, clusters()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got, want = same_rows(negatives.query(spark, folder), con, negatives.ORACLE_SQL)
    assert got == want and len(got) > 100


def test_far_cells_are_not_sent(spark, monkeypatch):
    """The second meeting gets only what the bounds leave: most cells of clustered rows are left out."""
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    seen, meet = [], negatives.Join.meet

    def counted(self, anchors, lists, k):
        seen.append((anchors.select(F.sum(F.size("cells"))).first()[0], anchors.count() * self.cells.count()))
        return meet(self, anchors, lists, k)

    monkeypatch.setattr(negatives.Join, "meet", counted)
    negatives.hard_negatives(vectors(spark, clusters()), F.col("vec_id") % 100 == 0).count()
    assert len(seen) == 4 and all(0 <= sent < 0.7 * all_pairs for sent, all_pairs in seen)


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 1, [1.0, 0.5, 0.25]), (3, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.6]), (None, 2, [0.7]), (5, None, [0.7]), (6, 2, None), (8, 2, [nan]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (11, 2, []), (100, 3, [-1.0, -1.0]), (200, 7, [0.1])]
    df = vectors(spark, rows)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault((r["anchor_id"], r["positive_id"]), []).append((r["rank"], r["negative_id"]))
    assert {k: sorted(v) for k, v in by.items()} == {(0, 1): [(1, 3), (2, 3), (3, 4)], (0, 2): [(1, 3), (2, 3), (3, 4)]}
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).collect() == []
    assert negatives.hard_negatives(df, F.col("vec_id") == -1).collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors(spark, [(0, 1, [1e9]), (1, 1, [1e9])]), F.col("vec_id") == 0)


def slow_cut(texts, words):
    split = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - words + 1) if n[tuple(w[i : i + words])] > 1 for k in range(i, i + words)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


DOCS = "doc_id long, text string, lang string, source string, key binary, runs int, first int, n int, kind int, term string, docs int"


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, b"k", 1, 2, 3, 4, "t", 5) for i, r in enumerate(rows)], DOCS)


def some_texts(seed, n=60):
    """Texts of a few words, with shared passages, odd spaces, one word over and over, edited copies."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 30, k))
    passage = word(25)
    out = [None, "", " \n\t ", "alone", "a " * 40, passage, passage, "é中 x " * 12, word(400) + " " + passage]
    out += [word(int(rng.integers(0, 30))) + "\t\x0b " + passage.replace(" ", "  ") + " " + word(5) for _ in range(n // 3)]  # many share it
    out += [passage.replace("w1 ", f"e{k} ", 1) for k in range(n // 3)]
    return out + [word(int(rng.integers(1, 60))) for _ in range(n // 3)]


@pytest.mark.parametrize("words", [1, 4, 10, 35])
@pytest.mark.parametrize("narrow", [False, True])
def test_windows_against_counting(spark, monkeypatch, words, narrow):
    """Also with a sketch so narrow that it lets everything through, merged in several rounds, and tasks that hold little."""
    if narrow:
        for name, value in (("MOST_CELLS", 1 << 10), ("MERGED", 2), ("BLOCK_BYTES", 1000), ("HELD_ANCHORS", 50), ("HELD_PLACES", 20)):
            monkeypatch.setattr(windows, name, value)
    texts = some_texts(words)
    got = windows.cut_windows(documents(spark, [(t, "en", "s") for t in texts]).repartition(5), words).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == slow_cut(texts, words)


def test_windows_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"x{k}" for k in range(90_000))
    rows = [(1, long), (1, long), (None, "one two three four five"), (None, "one two three four six"), (3, long[: len(long) // 2])]
    got = windows.cut_windows(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(5, 4), (5, 4), (len(rows[4][1].split()), len(rows[4][1].split()) - (0 if long[len(rows[4][1])] == " " else 1)), (90_000, 90_000), (90_000, 90_000)]
    assert windows.cut_windows(spark.createDataFrame([], DOCS)).collect() == []


def test_the_sketch_never_counts_too_little(spark):
    texts = documents(spark, [(t, "en", "s") for t in some_texts(7)]).select("text")
    bits, width = windows.merged_sketch(texts, 10)
    data = [(t["text"] or "").encode() for t in texts.collect()]
    at = np.cumsum([0, *map(len, data)])
    anchors = Counter(windows.Text(np.frombuffer(b"".join(data), np.uint8), at).pieces(10)[2].tolist())
    often = np.array([a for a, n in anchors.items() if n > 1], np.uint64)
    for row in range(windows.ROWS):
        cell = windows.cells_of(often, row, width).astype(np.int64)
        assert len(often) and ((bits[row][cell >> 3] >> (cell & 7)) & 1).all()


def slow_divergence(rows, top, least):
    terms = [(lang or "", source or "", Counter(terms_of(text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in terms}:
        docs = Counter(t for x in terms if x[0] == lang for t in x[2])
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: Counter() for x, s, _ in terms if x == lang}
        for x, s, c in terms:
            if x == lang:
                count[s].update({t: c[t] for t in kept if c[t]})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            far = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in count if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(far)}
            far = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(far)}
    return out


def terms_of(text):
    return re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@pytest.mark.parametrize("small_parts", [False, True])
def test_divergence_against_counting(spark, monkeypatch, small_parts):
    """Groups without terms, nulls, languages of one source, ties, a source with a third of all rows."""
    if small_parts:
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "MEET", 2)
    rng = np.random.default_rng(3)
    word = lambda: " ".join(f"{'ÀÉß'[x % 3]}{chr(97 + x % 26)}{'Zz'[x % 2]}" for x in np.minimum(rng.geometric(0.08, 30), 80))
    rows = [(word(), "en", f"s{0 if k % 3 == 0 else k % 7}") for k in range(80)]
    rows += [(None, "en", "empty"), ("12 34", "en", None), (None, None, None), ("same same", "fr", "a"), ("same same", "fr", "b"), ("same", "fr", "c"), ("only here", "de", "x"), (rows[0][0], "en", "s1"), (rows[0][0], "en", "s1")]
    for top in (3, 200):
        got = [tuple(r) for r in divergence.divergence(documents(spark, rows), top).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_divergence(rows, top, 3)
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_are_exact(spark):
    pairs = [(0, 1), (5, 7), (10**12, 3 * 10**12), (999_999_999_999, 10**12), (2, 10**15)]
    got = spark.createDataFrame(pairs, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["total"] for r in got)
