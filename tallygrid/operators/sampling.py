"""What is shown to a reviewer: estimates of size, samples of rows, complex formulas. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHARS_PER_TOKEN = 3
MOST_TOKENS = 780_000
BATCH_ROWS = 100


def token_estimate(cells: DataFrame) -> DataFrame:
    """Formula cells of each workbook, the characters of a listing of them by sheet, its tokens, and whether all of it
    fits."""
    listed = cells.where("formula IS NOT NULL")
    per_cell = F.sum(F.length("addr") + 3 + F.length("formula") + 1)
    sheets = listed.groupBy("workbook_id", "sheet").agg(F.count("*").alias("n"), per_cell.alias("chars"))
    sums = sheets.groupBy("workbook_id").agg(F.sum("n").alias("formula_cells"), F.sum(F.col("chars") + F.length("sheet") + 4).alias("characters"))
    tokens = F.round(F.col("characters") / CHARS_PER_TOKEN).cast("long")
    return sums.withColumn("tokens", tokens).withColumn("fits", F.col("tokens") <= MOST_TOKENS)


def listing(cells: DataFrame) -> DataFrame:
    """The formulas of each sheet as one text, a line for each cell in order."""
    lines = F.array_sort(F.collect_list(F.struct("row", "col", F.concat_ws("=", "addr", "formula").alias("line"))))
    return cells.where("formula IS NOT NULL").groupBy("workbook_id", "sheet").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("listing"))


def meaningful_rows(rows: DataFrame, high: str, low: str, most: int = 20) -> DataFrame:
    """A sample of each sheet's rows (workbook_id, sheet, row, label, numeric): numeric rows whose label matches `high`
    (up to most - 2), then `low` (half of the rest), then other numeric ones, with up to 5 places for rows of text."""
    rows = rows.where("label IS NOT NULL OR numeric")
    rank = F.when(~F.col("numeric"), 3).when(F.col("label").rlike(high), 0).when(F.col("label").rlike(low), 1).otherwise(2)
    rows = rows.withColumn("tier", rank)
    sheet = W.partitionBy("workbook_id", "sheet")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("workbook_id", "sheet", "tier").orderBy("row")))
    rows = rows.withColumn("n_high", F.least(F.count_if(F.col("tier") == 0).over(sheet), F.lit(max(1, most - 2))))
    low_cap = F.greatest(F.lit(1), F.floor((most - F.col("n_high")) / 2))
    rows = rows.withColumn("n_low", F.least(F.count_if(F.col("tier") == 1).over(sheet), low_cap))
    left = F.greatest(most - F.col("n_high") - F.col("n_low"), F.lit(0))
    n_text = F.least(F.count_if(F.col("tier") == 3).over(sheet), F.lit(5), left)
    rows = rows.withColumns({"n_text": n_text, "left": left})
    keep = F.when(F.col("tier") == 0, F.col("k") <= F.col("n_high")).when(F.col("tier") == 1, F.col("k") <= F.col("n_low")).when(F.col("tier") == 3, F.col("k") <= F.col("n_text")).otherwise(F.col("k") <= F.col("left") - F.col("n_text"))
    return rows.where(keep).select("workbook_id", "sheet", "row", "label", "numeric", "tier")


def batches(rules: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Rules numbered into batches of `size`."""
    return rules.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("domain").orderBy("rule_id")) - 1) / size).cast("int"))


def complex_formulas(unique: DataFrame, least: int = 4, most: int = 40) -> DataFrame:
    """The most complex unique formulas of each workbook."""
    order = W.partitionBy("workbook_id").orderBy(F.desc("fscore"), "ufi")
    return unique.where(F.col("fscore") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def _bound(value, use):
    """use(value) with value computed once, however often it stands in what use makes of it."""
    return F.get(F.transform(F.array(value), use), 0)


def _pushed(stack, piece):
    """Open brackets after a piece of JSON that stands outside strings."""
    push = lambda open_, m: F.when(m.isin("{", "["), F.concat(open_, m)).when(m.isin("}", "]"), F.left(open_, F.greatest(F.length(open_) - 1, F.lit(0)))).otherwise(open_)
    return _bound(F.regexp_replace(piece, r"[^\[\]{}]+", ""), lambda marks: F.when(marks == "", stack).otherwise(F.aggregate(F.split(marks, ""), stack, push)))


def with_quotes_escaped(text):
    """JSON in which quotes inside strings are escaped.

    A string ends at a quote that is followed by a colon, a closing bracket or the end, or by a comma with what may come
    after it: in an array the start of a value, in an object a string and a colon. All other quotes in a string belong to
    it. The text is cut at its quotes, once; one fold over the pieces carries whether a string is open, which brackets are
    and which quotes stay.
    """
    return _bound(F.split(text, r'(?<!\\)"'), _escaped)


def _escaped(pieces):
    n, first = F.size(pieces), F.get(pieces, 0)

    def ends(k, stack):
        piece, last, array = F.get(pieces, k), k == n - 1, F.right(stack, F.lit(1)) == "["
        value = piece.rlike(r"^\s*,\s*[{\[\-0-9tfn]") | (~last & piece.rlike(r"^\s*,\s*$"))
        key = piece.rlike(r"^\s*,\s*$") & F.coalesce(F.get(pieces, k + 2).rlike(r"^\s*:"), F.lit(False))
        return piece.rlike(r"^\s*[:}\]]") | (last & piece.rlike(r"^\s*$")) | F.when(array, value).otherwise(key)

    def step(state, k):
        inside, stack, marks = state["inside"], state["stack"], state["marks"]
        kept = lambda still, stack: F.struct(F.lit(still).alias("inside"), stack.alias("stack"), F.concat(marks, F.lit("q")).alias("marks"))
        escaped = F.struct(F.lit(True).alias("inside"), stack.alias("stack"), F.concat(marks, F.lit("e")).alias("marks"))
        return F.when(~inside, kept(True, stack)).when(ends(k, stack), kept(False, _pushed(stack, F.get(pieces, k)))).otherwise(escaped)

    start = F.struct(F.lit(False).alias("inside"), _pushed(F.lit(""), first).alias("stack"), F.lit("").alias("marks"))
    quotes = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    marks = F.split(F.aggregate(quotes, start, step, lambda state: state["marks"]), "")
    return F.concat(first, F.array_join(F.zip_with(F.slice(pieces, 2, n), marks, lambda piece, m: F.concat(F.when(m == "q", '"').otherwise('\\"'), piece)), ""))


def parsed_reply(text, schema: str):
    """A JSON object out of a reply: without fences and what stands around it, read as it is or else with quotes inside
    strings escaped, without trailing commas, or both (commas first, as one would hide where a string ends); null if none of these can be read (as a reply that breaks off)."""
    inner = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    without_commas = lambda x: F.regexp_replace(x, r",(\s*[}\]])", "$1")
    readable = lambda x: _bound(x, lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x))
    forms = lambda x: F.coalesce(readable(x), readable(with_quotes_escaped(x)))
    return F.from_json(_bound(inner, lambda x: F.coalesce(forms(x), _bound(without_commas(x), forms))), schema, {"mode": "PERMISSIVE"})


def snapshot(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of each check on each file, by the file's contents: 0 where there are none."""
    checks = findings.select("check_id").distinct()
    grid = files.select("workbook_id", "sha256").crossJoin(F.broadcast(checks))  # one row for each check of a fixed set
    n = findings.groupBy("workbook_id", "check_id").agg(F.count("*").alias("n"))
    return grid.join(n, ["workbook_id", "check_id"], "left").select("check_id", "sha256", F.coalesce("n", F.lit(0)).alias("n"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that changed, came or went between two snapshots."""
    rows = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), ["check_id", "sha256"], "full_outer")
    what = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return rows.withColumn("what", what).where("what IS NOT NULL")
