"""Source divergence: how far the words of each source stand from those of its language and of its other sources.

Terms are counted in the tasks that read the texts; one shuffle sums what they found. A group is the documents of one
language and source; its share of a term is a whole number, so that nothing depends on the order of sums.

Terms of a group that stand out most are found by upper bounds: terms are put in buckets by their count in the group
and the scale of their count in the language. All terms of a bucket have the group's share in common, so the smallest
share that any of them has in the language bounds the value of each. Buckets are evaluated best bound first, in waves
that double, until no unseen bound reaches the last value kept; bounds that equal it are evaluated too, for ties.

Values of pairs of sources come from postings: terms that both have are met by a join on the term; what either has
alone depends on its counts only, so it is taken from a table of counts; terms that neither has are one product.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, give_back, saved, table

#: Terms are runs of ASCII letters and characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
TOP, LEAST_DOCUMENTS = 200, 3
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: Sources that have one term and meet in one task.
MEET = 1_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lang, source, text: for each group its terms with occurrences and documents, and a row without a term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = [None, *times]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, _, data, at in chunks(batch.column(2)):
            raw, at = data.tobytes().lower(), at.tolist()
            for k in range(len(at) - 1):
                times, docs = held.setdefault((langs[lo + k] or "", sources[lo + k] or ""), (Counter(), Counter()))
                terms = TERM.findall(raw, at[k], at[k + 1])
                times.update(terms)
                docs.update(set(terms))
            if sum(len(times) for times, _ in held.values()) > HELD:
                yield from out()
    yield from out()
    give_back()


def kept_counts(documents: DataFrame, least_documents: int) -> DataFrame:
    """lang, source, term, n (occurrences in the group), lang_n (in the lang), and first (of one source of the term only),
    of terms in so many documents of the lang; and one row with a null term for each group.

    What tasks have counted goes to its (lang, term) once; sums by source and over the lang are made there.
    """
    rows = documents.select("lang", "source", "text").mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    term = Window.partitionBy("lang", "term")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("docs"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return rows.where(F.col("term").isNull() | (F.col("docs") >= least_documents)).drop("docs")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) for n < total, by long division, so that no product is beyond 64 bits."""
    rest, out = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        whole = F.call_function("div", rest * 1000, total)
        out, rest = out * 1000 + whole, rest * 1000 - whole * total
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


class Postings:
    """What both parts start from: groups and the kept terms' postings, each written once."""

    def __init__(self, documents: DataFrame, least_documents: int = LEAST_DOCUMENTS):
        counts = saved(kept_counts(documents, least_documents))
        rows = counts.where("term IS NOT NULL")
        langs = rows.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
        totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
        groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "v", "lang_total"])
        #: lang, source, total (N), terms (kept terms it has), v, lang_total, none (its share of a term that it hasn't).
        self.groups = saved(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total") + F.col("v")))))
        by_group = self.groups.select("lang", "source", "total", "v", "lang_total", "none")
        #: lang, source, term, n, p (the group's share), q (the language's share), none.
        self.rows = saved(
            rows.join(by_group, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", share(F.col("n"), F.col("total") + F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"), "none")
        )


def far_terms(postings: Postings, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the first `top` terms of each group with p > q, by value, then term."""
    key = ["lang", "source"]
    above = postings.rows.where("p > q").withColumn("scale", F.floor(F.log2("lang_n")))
    buckets = above.groupBy(*key, "n", "scale").agg(F.count("*").alias("m"), F.min("q").alias("q"), F.first("p").alias("p"))
    best_first = Window.partitionBy(*key).orderBy(F.desc("bound"), "n", "scale")
    buckets = buckets.select(*key, "n", "scale", "m", distance(F.col("p"), F.col("q")).alias("bound"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("m").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = saved(buckets.withColumn("wave", F.when(F.col("before") < top, 0).otherwise(F.floor(F.log2(F.col("before") / top)) + 1).cast("int")))
    ranked = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    kept, wave = None, 0
    unseen = buckets
    while (first := unseen.agg(F.min("wave")).first()[0]) is not None:
        wave = first
        open_now = unseen.where(F.col("wave") == wave).select(*key, "n", "scale")
        seen = above.join(open_now, [*key, "n", "scale"]).select(*key, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        kept = saved((seen if kept is None else seen.union(kept.drop("rank"))).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
        last = kept.where(F.col("rank") == top).select(*key, F.col("value").alias("last"))
        # Strictly below the last value kept: no term of the bucket can come in.
        unseen = buckets.where(F.col("wave") > wave).join(last, key, "left").where("last IS NULL OR bound >= last").drop("last")
    return kept if kept is not None else above.select(*key, F.col("term").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank")).limit(0)


def source_pairs(postings: Postings) -> DataFrame:
    """lang, source, item (another source of the lang), value, rank."""
    groups = postings.groups
    a, b = groups.select("lang", "source", F.col("terms").alias("terms_a"), "v", F.col("none").alias("none_a")), groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms_b"), F.col("none").alias("none_b"))
    pairs = a.join(b, "lang").where("source <> item")
    # Terms that neither has, as if no term were in both.
    parts = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("terms_a") - F.col("terms_b")) * distance(F.col("none_a"), F.col("none_b"))).otherwise(0).alias("value"))
    # What one has and the other hasn't, as if none were in both: by the counts of one only.
    counts = postings.rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    own = counts.join(pairs.select("lang", "source", "item", "none_b"), ["lang", "source"])
    parts = parts.union(own.select("lang", "source", "item", (F.col("m") * distance(F.col("p"), F.col("none_b"))).alias("value")))
    parts = parts.union(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * distance(F.col("none_b"), F.col("p"))).alias("value")))
    # Terms in both: the difference to that. Terms of very many sources are split.
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, math.ceil(most / MEET))
    left = postings.rows.select("lang", "term", "source", "p", "none", F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
    right = postings.rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("none_q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    p, q, none_p, none_q = F.col("p"), F.col("q"), F.col("none"), F.col("none_q")
    both = left.join(right, ["lang", "term", "salt"]).where("source <> item")
    parts = parts.union(both.select("lang", "source", "item", (distance(p, q) - distance(p, none_q) - distance(none_p, q) + distance(none_p, none_q)).alias("value")))
    values = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(documents: DataFrame, top: int = TOP, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value and rank: for each (lang, source) the other sources of the lang by how far their
    words differ (part `pair`, all), and the terms that it has more often than its lang (part `term`, the first `top`).

    A null text, lang or source is an empty one; a row is a document, also where rows repeat. Groups without terms are
    groups; where a lang keeps no term, its pairs have value 0. Ties go to the smaller item by its UTF-8 bytes. Texts
    are read whole, at any length; other columns are ignored. An empty table gives no rows.
    """
    postings = Postings(documents, least_documents)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return source_pairs(postings).withColumn("part", F.lit("pair")).select(names).union(far_terms(postings, top).withColumn("part", F.lit("term")).select(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT *, (1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::HUGEINT AS p
  FROM full_counts),
lang_shares AS (SELECT lang, term, (1 + 1000000000 * (lang_n::HUGEINT + 1) // (sum(lang_n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::HUGEINT AS q FROM kept),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (SELECT lang, source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
