"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, quantities and names turn into typed placeholders, all else is lower-cased without
outer punctuation. A number and its unit are one placeholder (`12 kg` like `12kg`), as are names in a row. Windows of
the template are hash-joined with those of the benchmark, checked word by word, and laid on diagonals (document position
less item position). Along a diagonal each value of the item stands for one value of the document and the other way
round, by the most windows; windows that disagree are dropped, and what is left counts. So a question with other numbers
or names is still caught, while placeholders that agree only by type are not.

Windows of the plain words (lower-cased, without outer punctuation) are joined in the same way, without slots: they find
what has too few literal words for a template, and copies in upper or lower case. Items too short for a window are
joined as a whole.

Only DataFrame functions are used. The benchmark's windows are counted first: up to BROADCAST_WINDOWS of them are
broadcast, so that the documents' windows are never shuffled; beyond that both sides are shuffled on the window's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import table

WINDOW = 8
#: A template's window needs so many words that are no placeholders.
LEAST_LITERALS = 4
#: Items of so many words at least, but under WINDOW, are looked for as a whole.
LEAST_ITEM = 4
#: Words in a row on one diagonal, or the share of the item's windows, that make a leak.
LEAST_RUN, LEAST_SHARE = 13, 0.5
#: About 200 bytes each, so 40 MB.
BROADCAST_WINDOWS = 200_000
#: Units of measure, in lower case.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "pounds", "ml", "l", "litre", "litres", "liter", "liters",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "mph", "kmh",
)
NUMBER = r"^[-+$€£#(]*[0-9][0-9.,:/]*[%)]*[.,;:!?]*$"
GLUED = r"^[-+$€£#(]*[0-9][0-9.,:/]*(" + "|".join(UNITS) + r")[%)]*[.,;:!?]*$"
OUTER = ".,;:!?\"'()[]"
#: What is taken off a quantity's value, so that `12kg` and `12` of `12 kg` are one.
UNIT_TAIL = r"[a-z]+$"


def canonical_words(df: DataFrame, text: str) -> DataFrame:
    """Adds plain (the words, lower-cased and without outer punctuation; one empty word for a null or blank text) and the
    template: canon and values (of the same length, the latter as written).

    Plain words come from one replacement in the whole text and a split, and words before and after from shifted copies: a
    lambda that names an array of the row may have that array computed again for each element. Most words begin with a
    small letter and need no regular expression.
    """
    white, space, outer = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+", r"[.,;:!?\"'()\[\]]*"
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(white))
    plain = F.split(F.regexp_replace(F.btrim(F.lower(bare), F.lit(OUTER)), outer + space + outer, " "), " ")
    df = df.withColumn("words", F.split(bare, space)).withColumn("plain", plain)
    none = F.lit(None).cast("string")
    back = lambda k: F.concat(F.array(*[none] * k), F.slice("words", F.lit(1), F.size("words") - k))
    after = F.concat(F.slice("plain", F.lit(2), F.size("plain")), F.array(none))
    one_back, two_back = back(1), F.when(F.size("words") > 1, back(2)).otherwise(F.array(none))
    df = df.withColumn("parts", F.arrays_zip(F.col("words").alias("w"), F.col("plain").alias("inner"), one_back.alias("before"), two_back.alias("before2"), after.alias("after")))
    # What a number starts with sorts before small letters, but for the signs that are no ASCII.
    starts = lambda x: (x < "a") | F.substring(x, 1, 1).isin("€", "£")
    number = lambda x: starts(x) & F.rlike(x, F.lit(NUMBER))

    def name(w, inner, before):
        first = F.substring(w, 1, 1)
        inside = before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?", ":", "|")
        return inside & (F.lower(first) != first) & (F.substring(F.lower(w), 2, 1000) == F.substring(w, 2, 1000)) & (F.length(inner) > 1)

    def part(t):
        w, inner, before = t["w"], t["inner"], t["before"]
        kind = lambda c: F.struct(c.alias("c"), w.alias("w"))
        own = F.btrim(F.lower(before), F.lit(OUTER))
        again = name(before, own, t["before2"]) & ~(own.isin(*UNITS) & F.coalesce(number(t["before2"]), F.lit(False)))
        dropped = F.lit(None).cast("struct<c:string,w:string>")
        unit = inner.isin(*UNITS) & F.coalesce(number(before), F.lit(False))
        return (
            F.when((w >= "a") & (w < "{") & ~unit, kind(inner))
            .when(number(w), kind(F.when(t["after"].isin(*UNITS), "<qty>").otherwise("<num>")))
            .when(starts(w) & F.rlike(F.lower(w), F.lit(GLUED)), kind(F.lit("<qty>")))
            .when(unit, dropped)
            .when(name(w, inner, before), F.when(F.coalesce(again, F.lit(False)), dropped).otherwise(kind(F.lit("<name>"))))
            .otherwise(kind(inner))
        )

    df = df.withColumn("kept", F.filter(F.transform("parts", part), lambda x: x.isNotNull()))
    return df.select("*", F.col("kept")["c"].alias("canon"), F.col("kept")["w"].alias("values")).drop("words", "parts", "kept")


def windows(df: DataFrame, of: str, size: int, keep: list[str]) -> DataFrame:
    """One row for each window of `size` elements of the array `of`: keep, pos (from 0) and h. A shorter one has none."""
    keys = df.withColumn("keys", F.transform(of, lambda c: F.xxhash64(c)))
    n = F.size("keys")
    # The outer form keeps the optimizer from moving a filter on the array's size, and with it all the above, to the scan.
    rows = keys.select(*keep, "keys", F.explode_outer(F.when(n >= size, F.sequence(F.lit(0), n - size))).alias("pos"))
    return rows.select(*keep, "pos", F.xxhash64(*(F.get("keys", F.col("pos") + k) for k in range(size))).alias("h")).where("pos IS NOT NULL")


def at_window(column: str, size: int = WINDOW) -> F.Column:
    return F.slice(column, F.col("pos") + 1, size)


def met(docs: DataFrame, items: DataFrame, of: str, size: int) -> DataFrame:
    """doc_id, pos and the columns of items (h, item_id, ipos, iwords and more) where a document's window has the item's
    words; with dvalues where items have values."""
    more = [c for c in items.columns if c == "ivalues"]
    if items.count() <= BROADCAST_WINDOWS:
        hits = windows(docs, of, size, ["doc_id", of, *(["values"] if more else [])]).join(F.broadcast(items), "h")
        hits = hits.select("doc_id", "item_id", "pos", "ipos", at_window(of, size).alias("dwords"), "iwords", *(at_window("values", size).alias("dvalues") for _ in more), *more)
    else:
        rows = windows(docs, of, size, ["doc_id", of, *(["values"] if more else [])])
        rows = rows.select("doc_id", "pos", "h", at_window(of, size).alias("dwords"), *(at_window("values", size).alias("dvalues") for _ in more))
        hits = rows.join(items, "h")
    return hits.where(F.array_contains(F.array("iwords"), F.col("dwords")))  # an equality would become a join key, built for every window


def agreeing(hits: DataFrame) -> DataFrame:
    """The template's hits whose values agree with what most windows of their diagonal say: a value of the item stands
    for one value of the document, and the other way round (of equally many, the greatest)."""
    line = ["doc_id", "item_id", "diagonal"]
    value = lambda v, c: F.when(c == "<qty>", F.regexp_replace(F.btrim(F.lower(v), F.lit(OUTER)), UNIT_TAIL, "")).otherwise(F.btrim(v, F.lit(OUTER)))
    trio = F.filter(F.arrays_zip("iwords", "ivalues", "dvalues"), lambda t: F.startswith(t["iwords"], F.lit("<")))
    slots = F.transform(trio, lambda t: F.struct(value(t["ivalues"], t["iwords"]).alias("i"), value(t["dvalues"], t["iwords"]).alias("d")))
    rows = hits.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", F.explode_outer(slots).alias("s")).select(*line, "ipos", "s.i", "s.d")
    votes = rows.withColumn("n", F.count("*").over(Window.partitionBy(*line, "i", "d")))
    top = lambda side, other: F.max(F.struct("n", other)).over(Window.partitionBy(*line, side))[other]
    votes = votes.withColumn("top_d", top("i", "d")).withColumn("top_i", top("d", "i"))
    good = F.col("i").isNull() | ((F.col("top_d") == F.col("d")) & (F.col("top_i") == F.col("i")))
    return votes.groupBy(*line, "ipos").agg(F.min(good).alias("good")).where("good").drop("good")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs doc_id, item_id of documents that hold a passage of an item, with run_words (the longest run of words on one
    diagonal, of the template or as written) and share (the largest share of the item's windows on one).

    A pair is a leak from LEAST_RUN words in a row or LEAST_SHARE of the item's windows on. Items under WINDOW words are
    found where they stand as a whole; those under LEAST_ITEM words say too little and are not looked for. Rows with a
    null doc_id or item_id take part like others; rows that repeat an id count as one document or item.
    """
    items = canonical_words(benchmark.select("item_id", "text"), "text")
    docs = canonical_words(documents.select("doc_id", "text"), "text")
    sizes, found = [], []
    short = sorted(r["n"] for r in items.select(F.size("plain").alias("n")).where(f"n BETWEEN {LEAST_ITEM} AND {WINDOW - 1}").distinct().collect())  # a few numbers below WINDOW
    for kind, of, size in [("template", "canon", WINDOW), ("plain", "plain", WINDOW), *((f"whole{n}", "plain", n) for n in short)]:
        own = items.where(F.size("plain") == size) if kind.startswith("whole") else items
        rows = windows(own, of, size, ["item_id", of, "values"]).select("item_id", F.col("pos").alias("ipos"), "h", at_window(of, size).alias("iwords"), *([at_window("values").alias("ivalues")] if kind == "template" else []))
        sizes.append(rows.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows")).withColumn("kind", F.lit(kind)))
        if kind == "template":
            rows = rows.where(F.size(F.filter("iwords", lambda c: ~F.startswith(c, F.lit("<")))) >= LEAST_LITERALS)
        hits = met(docs, rows.dropDuplicates([c for c in rows.columns if c != "h"]), of, size)
        hits = agreeing(hits) if kind == "template" else hits.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos").distinct()
        found.append(hits.withColumns({"kind": F.lit(kind), "size": F.lit(size)}))
    hits, windows_of = found[0], sizes[0]
    for more, many in zip(found[1:], sizes[1:], strict=True):
        hits, windows_of = hits.union(more), windows_of.union(many)
    line = ["kind", "size", "doc_id", "item_id", "diagonal"]
    runs = hits.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*line).orderBy("ipos"))).groupBy(*line, "run").agg(F.count("*").alias("n"))
    lines = runs.groupBy(*line).agg(F.sum("n").alias("n"), F.max("n").alias("longest")).withColumnsRenamed({"kind": "own_kind", "item_id": "own_item"})
    lines = lines.join(windows_of, (F.col("own_kind") == F.col("kind")) & F.col("own_item").eqNullSafe(F.col("item_id")))
    best = lines.groupBy("doc_id", "item_id").agg(F.max(F.col("longest") + F.col("size") - 1).cast("long").alias("run_words"), F.round(F.max(F.col("n") / F.col("item_windows")), 6).alias("share"))
    return best.where((F.col("run_words") >= LEAST_RUN) | (F.col("share") >= LEAST_SHARE))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose doc_id is in no leak. Rows with a null doc_id stay unless one of
    them leaks."""
    found = leaks(documents, benchmark).select("doc_id").distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CHARS = OUTER.replace("'", "''")
_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _oracle_side(name: str, key: str) -> str:
    return f"""
{name}_w AS (SELECT {key}, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS words FROM (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {'documents' if key == 'doc_id' else 'benchmark'})),
{name}_m AS (SELECT {key}, words, list_transform(words, lambda w: trim(lower(w), '{_CHARS}')) AS plain, list_transform(words, lambda w, i:
  CASE WHEN regexp_matches(w, '{NUMBER}') THEN '<num>'
       WHEN regexp_matches(lower(w), '{GLUED}') THEN '<qty>'
       WHEN lower(trim(w, '{_CHARS}')) IN ({_UNITS}) AND regexp_matches(CASE WHEN i > 1 THEN words[i - 1] ELSE '' END, '{NUMBER}') THEN '<unit>'
       WHEN lower(w[1]) <> w[1] AND i > 1 AND words[i - 1][-1] NOT IN ('.', '!', '?', ':', '|')
            AND lower(w[2:]) = w[2:] AND length(trim(w, '{_CHARS}')) > 1 THEN '<name>'
       ELSE lower(trim(w, '{_CHARS}')) END) AS marks FROM {name}_w),
{name}_k AS (SELECT {key}, plain, words, marks, list_filter(range(1, len(marks) + 1), lambda k: marks[k] <> '<unit>' AND NOT (k > 1 AND marks[k] = '<name>' AND marks[k - 1] = '<name>')) AS kept FROM {name}_m),
{name}_c AS (SELECT {key}, plain, list_transform(kept, lambda k: words[k]) AS vals,
  list_transform(kept, lambda k: CASE WHEN marks[k] = '<num>' AND k < len(marks) AND marks[k + 1] = '<unit>' THEN '<qty>' ELSE marks[k] END) AS canon FROM {name}_k),
{name}_t AS (SELECT {key}, pos, canon[pos + 1:pos + {WINDOW}] AS {name}words, vals[pos + 1:pos + {WINDOW}] AS {name}vals
  FROM (SELECT {key}, canon, vals, unnest(range(0, len(canon) - {WINDOW - 1})) AS pos FROM {name}_c WHERE len(canon) >= {WINDOW})),
{name}_p AS (SELECT {key}, pos, size, plain[pos + 1:pos + size] AS {name}words FROM (SELECT {key}, plain, size, unnest(range(0, len(plain) - size + 1)) AS pos
  FROM {name}_c, (SELECT unnest(range({LEAST_ITEM}, {WINDOW + 1})) AS size) WHERE len(plain) >= size{" AND (size = " + str(WINDOW) + " OR len(plain) = size)" if name == "i" else ""}))"""


def _value(v: str) -> str:
    return f"CASE WHEN iwords[k] = '<qty>' THEN regexp_replace(trim(lower({v}[k]), '{_CHARS}'), '{UNIT_TAIL}', '') ELSE trim({v}[k], '{_CHARS}') END"


ORACLE_SQL = f"""
WITH {_oracle_side('d', 'doc_id')}, {_oracle_side('i', 'item_id')},
t_hits AS (SELECT doc_id, item_id, d_t.pos - i_t.pos AS diagonal, i_t.pos AS ipos, iwords, ivals, dvals FROM d_t JOIN i_t ON dwords = iwords
           WHERE len(list_filter(iwords, lambda c: c[1] <> '<')) >= {LEAST_LITERALS}),
slots AS (SELECT doc_id, item_id, diagonal, ipos, {_value('ivals')} AS si, {_value('dvals')} AS sd FROM t_hits, (SELECT unnest(range(1, {WINDOW + 1})) AS k) WHERE iwords[k][1] = '<'),
votes AS (SELECT doc_id, item_id, diagonal, si, sd, count(*) AS n FROM slots GROUP BY ALL),
firm AS (SELECT doc_id, item_id, diagonal, si, sd FROM votes
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, diagonal, si ORDER BY n DESC, sd DESC) = 1 AND row_number() OVER (PARTITION BY doc_id, item_id, diagonal, sd ORDER BY n DESC, si DESC) = 1),
off AS (SELECT DISTINCT doc_id, item_id, diagonal, ipos FROM slots ANTI JOIN firm USING (doc_id, item_id, diagonal, si, sd)),
hits AS (SELECT DISTINCT 'template' AS kind, {WINDOW} AS size, doc_id, item_id, diagonal, ipos FROM t_hits ANTI JOIN off USING (doc_id, item_id, diagonal, ipos)
   UNION ALL SELECT DISTINCT 'plain', d_p.size, doc_id, item_id, d_p.pos - i_p.pos, i_p.pos FROM d_p JOIN i_p ON d_p.size = i_p.size AND dwords = iwords),
sizes AS (SELECT 'template' AS kind, {WINDOW} AS size, item_id, count(DISTINCT pos) AS item_windows FROM i_t GROUP BY ALL
   UNION ALL SELECT 'plain', size, item_id, count(DISTINCT pos) FROM i_p GROUP BY ALL),
numbered AS (SELECT *, ipos - row_number() OVER (PARTITION BY kind, size, doc_id, item_id, diagonal ORDER BY ipos) AS run FROM hits),
runs AS (SELECT kind, size, doc_id, item_id, diagonal, run, count(*) AS n FROM numbered GROUP BY ALL),
lines AS (SELECT kind, size, doc_id, item_id, diagonal, sum(n) AS n, max(n) AS longest FROM runs GROUP BY ALL),
best AS (SELECT doc_id, item_id, CAST(max(longest + size - 1) AS BIGINT) AS run_words, round(max(n / item_windows), 6) AS share FROM lines JOIN sizes USING (kind, size, item_id) GROUP BY ALL)
SELECT doc_id, item_id, run_words, share FROM best WHERE run_words >= {LEAST_RUN} OR share >= {LEAST_SHARE}
"""
