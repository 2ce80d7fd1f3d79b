"""Queries over the driver's tables, each with DuckDB SQL for the same rows.

The SQL states what a check means without the library: it reads the projections directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import scoring, text
from tallygrid.functions.addresses import address_part, col_to_num, num_to_col
from tallygrid.operators import algebra, calls, core, graph, labels, predicates, ranges, series
from tallygrid.plans.projections import EDGES, FINDINGS, FORMULAS, GRID, LABELS, RUNS, SERIES, duck, formula_model, grid_model, project, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_F, _G, _L = f"({duck(FORMULAS)})", f"({duck(GRID)})", f"({duck(LABELS)})"
_NORMAL = r"upper(trim(regexp_replace(regexp_replace(formula, '\$?[A-Z]{1,3}\$?[0-9]{1,7}', 'CELL', 'g'), '\s+', ' ', 'g')))"
_HARD = r"regexp_matches(upper(formula), '(^|[^A-Z0-9_])[2-9][0-9]*(\.[0-9]+)?([^A-Z0-9_]|$)')"
_HARD_COUNTED = r"regexp_matches(upper(formula), '(^|[^A-Z0-9_$])[2-9][0-9]*(\.[0-9]+)?([^A-Z0-9_]|$)')"
_SCORE = rf"""(CASE WHEN length(formula) > 500 THEN 3 WHEN length(formula) > 250 THEN 2 WHEN length(formula) > 100 THEN 1 ELSE 0 END
  + len(regexp_extract_all(formula, '\b(IF|IFS|CHOOSE|SWITCH)\s*\('))
  + CAST(regexp_matches(formula, '\b(XLOOKUP|INDEX|MATCH|VLOOKUP|HLOOKUP)\s*\(') AS INT)
  + 3 * CAST(regexp_matches(formula, '\b(OFFSET|INDIRECT)\s*\(') AS INT) + 3 * CAST(regexp_matches(formula, '\b(TODAY|NOW|RAND|RANDBETWEEN)\s*\(') AS INT)
  + 5 * CAST(contains(formula, '[') AS INT) + CAST({_HARD} AS INT) + CAST(regexp_matches(formula, '\b(IFERROR|IFNA|ISERROR)\s*\(') AS INT) + CAST(contains(formula, '!') AS INT)
  + CASE WHEN len(regexp_extract_all(formula, '[+\-*/<>=&]')) > 10 THEN 2 WHEN len(regexp_extract_all(formula, '[+\-*/<>=&]')) > 5 THEN 1 ELSE 0 END)"""
_BAND = "CASE WHEN fscore >= 13 THEN 'Critical' WHEN fscore >= 8 THEN 'High' WHEN fscore >= 4 THEN 'Moderate' ELSE 'Low' END"
_UNIQUE = f"""(SELECT normal, instances, formula, CAST({_SCORE} AS INT) AS fscore, {_HARD_COUNTED} AS hardcode
  FROM (SELECT {_NORMAL} AS normal, count(*) AS instances, arg_min(formula, (CAST(substr(sheet, 2) AS INT), sheet, row_no, col_no)) AS formula FROM {_F} GROUP BY 1))"""


@query(f"SELECT normal, instances, fscore, {_BAND} AS band, hardcode FROM {_UNIQUE}")
def ufi_fscore_band(spark, sf):
    """Unique formulas with score and band."""
    return core.unique_formulas(formula_model(spark, sf).cells).select("normal", "instances", "fscore", "band", "hardcode")


@query(f"""SELECT band, count(*) AS formulas, CAST(sum(CASE band WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 5 WHEN 'High' THEN 12 ELSE 20 END) AS BIGINT) AS price,
  CAST(round(sum(sum(CASE band WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 5 WHEN 'High' THEN 12 ELSE 20 END)) OVER () * 1.1) AS BIGINT) AS total FROM (SELECT {_BAND} AS band FROM {_UNIQUE}) GROUP BY band""")
def pricing_by_band(spark, sf):
    """The price of unique formulas by band."""
    return core.price(core.unique_formulas(formula_model(spark, sf).cells)).drop("workbook_id")


@query(rf"""SELECT CASE WHEN contains(formula, '[') THEN 'Link' WHEN regexp_matches(formula, '\b(IF|IFS|CHOOSE|SWITCH|AND|OR|NOT)\s*\(') THEN 'Logic'
  WHEN regexp_matches(formula, '\b(XLOOKUP|VLOOKUP|HLOOKUP|INDEX|MATCH)\s*\(') THEN 'Lookup' WHEN regexp_matches(formula, '\b(SUM|SUMIF|SUMIFS|COUNT|COUNTIF|AVERAGE)\s*\(') THEN 'Aggregation'
  WHEN regexp_matches(formula, '\b(DATE|EOMONTH|DAYS|MONTH|YEAR|TODAY|NOW)\s*\(') THEN 'Date' WHEN regexp_matches(formula, '\b(NPV|IRR|XNPV|XIRR|PV|FV|PMT)\s*\(') THEN 'Valuation'
  WHEN regexp_matches(formula, '[+\-*/<>=]') THEN 'Arithmetic' ELSE 'Other' END AS formula_class, count(*) AS formulas, count(*) FILTER (WHERE {_HARD_COUNTED}) AS hardcoded FROM {_F} GROUP BY 1""")
def formula_class(spark, sf):
    """Classes of formulas and how many hold a hard-coded number."""
    f = project(spark, sf, FORMULAS)
    return f.groupBy(scoring.formula_class(F.col("formula")).alias("formula_class")).agg(F.count("*").alias("formulas"), F.count_if(F.col("formula").rlike(scoring.HARD_CODE_COUNTED)).alias("hardcoded"))


@query(f"""SELECT sheet AS target, to_sheet AS precedent, count(*) AS link_count FROM (SELECT sheet, row_no, CASE template_no WHEN 2 THEN 'F1' WHEN 6 THEN 'F2' END AS to_sheet FROM {_F})
  WHERE to_sheet IS NOT NULL AND to_sheet <> sheet GROUP BY ALL""")
def sheet_dependency(spark, sf):
    """How many formulas of a sheet lead to another (C4)."""
    return core.sheet_dependencies(formula_model(spark, sf)).drop("workbook_id")


@query(f"""SELECT sheet, count(*) AS formula_count, count(*) FILTER (WHERE template_no IN (3, 8)) AS iferror_count, count(*) FILTER (WHERE template_no = 4) AS offset_count,
  count(*) FILTER (WHERE template_no = 17) AS external_count, max(row_no) AS max_row, max(col_no) AS max_col FROM {_F} GROUP BY ROLLUP (sheet)""")
def sheet_stats_rollup(spark, sf):
    """Counts of sheets and the whole."""
    rows = core.sheet_stats(formula_model(spark, sf).cells)
    return rows.select("sheet", "formula_count", "iferror_count", "offset_count", "external_count", "max_row", "max_col")


@query("SELECT o_orderkey, chr(65 + CAST(o_orderkey % 26 AS INT)) AS letters, CAST(o_orderkey % 26 AS INT) + 1 AS n, CAST(o_orderkey % 16000 AS INT) + 1 AS back FROM orders")
def col_letters_roundtrip(spark, sf):
    """Letters of a column and back."""
    o = table(spark, sf, "orders")
    n = (F.col("o_orderkey") % 16000).cast("int") + 1
    one = (F.col("o_orderkey") % 26).cast("int") + 1
    return o.select("o_orderkey", num_to_col(one).alias("letters"), col_to_num(num_to_col(one)).alias("n"), col_to_num(address_part(F.concat(F.lit("$"), num_to_col(n), F.lit("$7")), "col")).alias("back"))


@query(rf"""SELECT check_id, sheet, row_no FROM (SELECT sheet, row_no, unnest(list_filter([
    CASE WHEN len(regexp_extract_all(formula, '\(')) >= 3 THEN 'T0-COMPLEXFML-001' END, CASE WHEN template_no = 9 THEN 'T0-CONSTFORMULA-001' END, CASE WHEN template_no = 10 THEN 'T0-TEXTBOOLFLAG-001' END,
    CASE WHEN template_no = 13 THEN 'T0-2DIGITYEAR-001' END, CASE WHEN template_no = 5 THEN 'T0-NPV-001' END, CASE WHEN template_no = 4 THEN 'T0-INDIRECT-001' END], lambda x: x IS NOT NULL)) AS check_id FROM {_F})""")
def single_cell_checks(spark, sf):
    """All checks of one cell in one pass."""
    return predicates.single_cell_findings(formula_model(spark, sf).cells).select("check_id", "sheet", F.col("row").alias("row_no"))


@query(f"""SELECT check_id, sheet, row_no FROM (SELECT sheet, row_no, unnest(CASE template_no WHEN 1 THEN ['T0-NESTEDIF-001'] WHEN 2 THEN ['T0-LOOKUPMATCH-001'] WHEN 5 THEN ['T0-NPVP0-001']
  WHEN 8 THEN CASE WHEN size <> 0 THEN ['T0-ERRMASK-001'] ELSE [] END WHEN 11 THEN ['T0-FLAGERRMASK-001'] WHEN 12 THEN ['T0-IFERRLIT-001'] WHEN 15 THEN ['T0-STDEVA-001', 'T0-STDEVA-001'] ELSE [] END) AS check_id FROM {_F})
  UNION ALL SELECT 'T0-PMTSIGN-001', NULL, NULL FROM {_F} HAVING count(*) FILTER (WHERE template_no = 18) > 0 AND count(*) FILTER (WHERE template_no = 19) > 0""")
def call_checks(spark, sf):
    """Checks of calls and arguments."""
    return calls.call_findings(formula_model(spark, sf).tokenized()).select("check_id", "sheet", F.col("row").alias("row_no"))


@query(f"SELECT sheet, row_no, '$A1:A$9' AS range FROM {_F} WHERE template_no = 14")
def mixed_references(spark, sf):
    """Ranges whose corners differ in what is absolute."""
    return predicates.mixed_references(formula_model(spark, sf)).select("sheet", F.col("row").alias("row_no"), F.col("detail").alias("range"))


@query(f"SELECT sheet, row_no, CAST(count(*) AS BIGINT) AS cells FROM {_F} WHERE template_no = 20 GROUP BY ALL")
def degenerate_covenants(spark, sf):
    """Tests that pass on a zero basis."""
    return predicates.degenerate_covenants(formula_model(spark, sf).cells).select("sheet", F.col("row").alias("row_no"), "cells")


@query(f"SELECT 'COUNTA(A1:A5)+COUNTA(B1:B3)' AS chain, CAST(40 AS BIGINT) AS target, 8 AS most, count(*) AS cells FROM {_F} WHERE template_no = 21 HAVING count(*) > 0")
def impossible_targets(spark, sf):
    """COUNTA sums that can't reach their target."""
    return predicates.impossible_targets(formula_model(spark, sf).cells).select("chain", "target", "most", "cells")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS BIGINT) AS emails FROM documents
  WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')""")
def pii_email_scan(spark, sf):
    """E-mail addresses in texts."""
    cells = table(spark, sf, "documents").select(F.lit("w").alias("workbook_id"), F.lit("d").alias("sheet"), F.col("doc_id").alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.col("text").alias("txt"), F.lit(None).cast("string").alias("formula"))
    hits = predicates.personal_data(cells).where("what = 'email'")
    return hits.groupBy(F.col("row").alias("doc_id")).agg(F.count("*").alias("emails"))


_CARDS = r"""SELECT doc_id, regexp_replace(m, '[ -]', '', 'g') AS card FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d[ -]?){13,19}\b')) AS m FROM documents)"""


@query(f"""SELECT doc_id, concat(left(card, 2), repeat('*', length(card) - 4), right(card, 2)) AS redacted FROM ({_CARDS}) WHERE length(card) BETWEEN 13 AND 19
  AND list_sum(list_transform(range(0, length(card)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(card[length(card) - k] AS INT) WHEN CAST(card[length(card) - k] AS INT) >= 5 THEN 2 * CAST(card[length(card) - k] AS INT) - 9 ELSE 2 * CAST(card[length(card) - k] AS INT) END)) % 10 = 0""")
def pii_luhn(spark, sf):
    """Card numbers in texts, redacted; only those whose check digit fits."""
    cells = table(spark, sf, "documents").select(F.lit("w").alias("workbook_id"), F.lit("d").alias("sheet"), F.col("doc_id").alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.col("text").alias("txt"), F.lit(None).cast("string").alias("formula"))
    return predicates.personal_data(cells).where("what = 'card'").select(F.col("row").alias("doc_id"), "redacted")


@query(r"""SELECT event_id, txt FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 1 THEN concat('(', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '%)') WHEN 2 THEN CAST(1990 + event_id % 111 AS VARCHAR) ELSE event_type END AS txt FROM events)
  WHERE regexp_matches(txt, '^\s*(-?\$?[0-9,]+\.?[0-9]*%?|\(\$?[0-9,]+\.?[0-9]*%?\))\s*$') AND regexp_matches(txt, '[0-9]') AND NOT (regexp_matches(txt, '^\s*[0-9]{4}\s*$') AND TRY_CAST(trim(txt) AS INT) BETWEEN 1990 AND 2100)""")
def number_as_text(spark, sf):
    """Texts that are numbers."""
    n = F.floor("value").cast("bigint").cast("string")
    k = F.col("event_id") % 4
    txt = F.when(k == 0, n).when(k == 1, F.concat(F.lit("("), n, F.lit("%)"))).when(k == 2, (F.lit(1990) + F.col("event_id") % 111).cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", txt.alias("txt")).where(text.looks_like_number(F.col("txt")))


@query(f"""SELECT g.sheet, g.row_no, g.col_no, l.txt AS left_label FROM {_G} g LEFT JOIN {_L} l ON g.sheet = l.sheet AND g.row_no = l.row_no AND g.col_no - l.col_no <= 8""")
def label_left_nearest(spark, sf):
    """The nearest label to the left of each number (L1)."""
    rows = labels.with_left_label(grid_model(spark, sf).cells).where("kind = 'number'")
    return rows.select("sheet", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "left_label")


@query(f"""SELECT g.sheet, g.row_no, arg_min(num, g.col_no) AS value, min(g.col_no) AS col_no, CASE WHEN any_value(l.txt) = 'Debt balance' THEN 'debt balance' ELSE 'closing cash' END AS term
  FROM {_L} l JOIN {_G} g ON g.sheet = l.sheet AND g.row_no = l.row_no WHERE l.txt IN ('Debt balance', 'Closing cash') AND g.col_no <= 7 GROUP BY g.sheet, g.row_no""")
def label_right_first_number(spark, sf):
    """The first number to the right of a label (L2)."""
    rows = labels.labelled_values(grid_model(spark, sf).cells, ("debt balance", "closing cash"))
    return rows.select("sheet", F.col("row").alias("row_no"), "value", F.col("col").alias("col_no"), "term")


@query(f"""WITH p AS (SELECT g.sheet, g.row_no, g.col_no, num, coalesce(lag(g.col_no) OVER w, 1) AS before FROM {_G} g JOIN {_L} l ON g.sheet = l.sheet AND g.row_no = l.row_no WHERE l.txt = 'Closing cash' WINDOW w AS (PARTITION BY g.sheet, g.row_no ORDER BY g.col_no)),
  q AS (SELECT *, sum(CASE WHEN col_no - before - 1 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, row_no ORDER BY col_no) AS ended FROM p)
  SELECT sheet, row_no, count(*) AS points, round(sum(num), 2) AS total FROM q WHERE ended = 0 GROUP BY ALL""")
def row_series_gaps(spark, sf):
    """Series to the right of a label, ended by three gaps (L3)."""
    rows = labels.labelled_series(grid_model(spark, sf).cells, ("closing cash",))
    return rows.groupBy("sheet", F.col("row").alias("row_no")).agg(F.count("*").alias("points"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH g AS (SELECT user_id, d, date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS gap FROM ({duck(SERIES)})),
  b AS (SELECT *, CAST(round(gap / 6.0) * 6 AS INT) AS bucket FROM g), n AS (SELECT user_id, bucket, count(*) AS n FROM b WHERE gap IS NOT NULL GROUP BY ALL),
  u AS (SELECT user_id, arg_max(bucket, (n, -bucket)) AS usual, max(n) AS n FROM n GROUP BY user_id), s AS (SELECT user_id, count(*) AS dates FROM g GROUP BY user_id)
  SELECT b.user_id, b.d, CAST(b.gap AS INT) AS gap, u.usual, s.dates FROM b JOIN u ON b.user_id = u.user_id JOIN s ON s.user_id = b.user_id WHERE s.dates >= 6 AND u.n >= 0.5 * s.dates AND b.gap > 1.5 * u.usual""")
def period_gap(spark, sf):
    """Unusual gaps between a user's dates."""
    return series.period_gaps(project(spark, sf, SERIES), ["user_id"], "d")


@query(f"""WITH t AS (SELECT sheet, row_no, col_no, CAST(floor(log2(num)) AS INT) AS v FROM {_G}), n AS (SELECT sheet, row_no, v, count(*) AS n FROM t GROUP BY ALL),
  m AS (SELECT sheet, row_no, sum(n) AS total, max(n) AS most, arg_max(v, n) AS common FROM n GROUP BY ALL)
  SELECT t.sheet, t.row_no, t.col_no, t.v FROM t JOIN m ON t.sheet = m.sheet AND t.row_no = m.row_no WHERE total >= 4 AND most >= 3 AND most >= 0.7 * total AND v <> common""")
def row_majority_pattern(spark, sf):
    """Cells off the commonest magnitude of their row."""
    rows = project(spark, sf, GRID).select("sheet", "row_no", "col_no", F.floor(F.log2("num")).cast("int").alias("v"))
    return series.minority(rows, ["sheet", "row_no"], "v").select("sheet", "row_no", "col_no", "v")


@query("""WITH t AS (SELECT l_partkey, l_returnflag, l_linestatus AS v FROM lineitem), n AS (SELECT l_partkey, l_returnflag, v, count(*) AS n FROM t GROUP BY ALL),
  m AS (SELECT l_partkey, l_returnflag, sum(n) AS total, max(n) AS most, arg_max(v, n) AS common FROM n GROUP BY ALL)
  SELECT t.l_partkey, t.l_returnflag, t.v, count(*) AS off FROM t JOIN m USING (l_partkey, l_returnflag) WHERE total >= 4 AND most >= 3 AND most >= 0.7 * total AND v <> common GROUP BY ALL""")
def col_majority_pattern(spark, sf):
    """Lines off the commonest status of their part and flag."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", F.col("l_linestatus").alias("v"))
    return series.minority(rows, ["l_partkey", "l_returnflag"], "v").groupBy("l_partkey", "l_returnflag", "v").agg(F.count("*").alias("off"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 97 < 30 THEN o_totalprice ELSE o_totalprice / 1000000 END AS v FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM s),
  a AS (SELECT o_custkey, count(*) AS total, max(CASE WHEN back = 1 THEN abs(v) END) AS t1, max(CASE WHEN back = 2 THEN abs(v) END) AS t2, avg(CASE WHEN back BETWEEN 3 AND 7 THEN abs(v) END) AS mean,
    min(CASE WHEN back BETWEEN 3 AND 7 THEN abs(v) END) AS least, max(CASE WHEN back = 3 THEN abs(v) END) AS last, max(CASE WHEN back = 7 THEN abs(v) END) AS first FROM r GROUP BY o_custkey)
  SELECT o_custkey, total FROM a WHERE total >= 8 AND mean >= 1 AND least >= 0.3 * mean AND last >= 0.5 * first AND t1 < 0.1 * mean AND t2 < 0.1 * mean""")
def terminal_drop(spark, sf):
    """Customers whose last two orders fall to nearly nothing."""
    v = F.when(F.col("o_orderkey") % 97 < 30, F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 1000000)
    return series.terminal_drops(table(spark, sf, "orders").withColumn("v", v), ["o_custkey"], "o_orderkey", "v").select("o_custkey", "total")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority < '3' THEN -o_totalprice ELSE o_totalprice END AS v FROM orders),
  c AS (SELECT o_custkey, coalesce(CAST((v > 0) <> (lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 0) AS INT), 0) AS changed FROM f WHERE v <> 0)
  SELECT o_custkey, count(*) AS values, CAST(sum(changed) AS BIGINT) AS sign_changes FROM c GROUP BY o_custkey HAVING count(*) >= 3 AND sum(changed) >= 2""")
def irr_sign_changes(spark, sf):
    """Cash flows whose sign changes twice or more."""
    v = F.when(F.col("o_orderpriority") < "3", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return series.sign_changes(table(spark, sf, "orders").withColumn("v", v), ["o_custkey"], ["o_orderkey"], "v").where("values >= 3 AND sign_changes >= 2")


@query("""WITH i AS (SELECT o_custkey % 50 AS g, o_orderkey // 8 AS p FROM orders GROUP BY ALL), j AS (SELECT g, p, p - row_number() OVER (PARTITION BY g ORDER BY p) AS step FROM i)
  SELECT g, min(p) AS island, max(p) AS last, count(*) AS n FROM j GROUP BY g, step""")
def total_block_islands(spark, sf):
    """Unbroken blocks of places."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), F.floor(F.col("o_orderkey") / 8).alias("p")).distinct()
    return series.islands(rows, ["g"], "p").groupBy("g", "island").agg(F.max("p").alias("last"), F.count("*").alias("n"))


_RECT = "(SELECT CAST(s_suppkey AS INT) AS id, concat('S', CAST(CAST(s_suppkey % 5 AS INT) AS VARCHAR)) AS sheet, CAST(s_suppkey % 200 AS INT) + 2 AS r1, CAST(s_suppkey % 200 AS INT) + 2 + CAST(s_suppkey % 40 AS INT) AS r2, 3 AS c1, 3 + CAST(s_suppkey % 8 AS INT) AS c2 FROM supplier)"


def _rects(spark, sf):
    k = F.col("s_suppkey")
    r1 = (k % 200).cast("int") + 2
    return table(spark, sf, "supplier").select(k.cast("int").alias("id"), F.lit("w").alias("workbook_id"), F.concat(F.lit("S"), (k % 5).cast("int").cast("string")).alias("to_sheet"), r1.alias("r1"), (r1 + (k % 40).cast("int")).alias("r2"), F.lit(3).alias("c1"), (3 + (k % 8).cast("int")).alias("c2"))


@query(f"SELECT id, count(*) AS cells, round(sum(num), 2) AS resum FROM {_RECT} r JOIN {_G} g ON g.sheet = r.sheet AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2 GROUP BY id")
def range_resum(spark, sf):
    """Sums of the cells inside rectangles, by running sums."""
    return ranges.range_sums(_rects(spark, sf), ranges.numbers(grid_model(spark, sf)), ["id"]).select("id", F.col("n").alias("cells"), F.round("total", 2).alias("resum"))


@query(f"SELECT id, min(row_no) AS subtotal_row FROM {_RECT} r JOIN {_L} l ON l.sheet = r.sheet AND row_no > r1 AND row_no < r2 AND txt = 'Total revenue' GROUP BY id")
def subtotal_in_range(spark, sf):
    """The first total row inside each rectangle."""
    inner = _rects(spark, sf).withColumns({"r1": F.col("r1") + 1, "r2": F.col("r2") - 1, "c1": F.lit(1), "c2": F.lit(1)})
    totals = grid_model(spark, sf).texts.where("txt = 'Total revenue'").select("workbook_id", "sheet", "row", "col")
    return ranges.covered(inner, totals).groupBy("id").agg(F.min("cell_row").alias("subtotal_row"))


@query(f"""SELECT sheet, row_no, col_no, v FROM (SELECT g.sheet, g.row_no, g.col_no, round(num - 200000, 2) AS v, sum(CASE WHEN g.col_no - before - 1 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY g.sheet, g.row_no ORDER BY g.col_no) AS ended
  FROM (SELECT g.*, coalesce(lag(g.col_no) OVER (PARTITION BY g.sheet, g.row_no ORDER BY g.col_no), 1) AS before FROM {_G} g JOIN {_L} l ON g.sheet = l.sheet AND g.row_no = l.row_no WHERE l.txt = 'Closing cash') g) WHERE ended = 0 AND v < 0""")
def negative_balance(spark, sf):
    """Periods of a cash balance below zero."""
    cells = grid_model(spark, sf).cells.withColumn("num", F.round(F.col("num") - 200000, 2))
    return labels.negative_balances(cells).where("balance = 'Cash balance'").select("sheet", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.col("value").alias("v"))


@query("""WITH v AS (SELECT s_nationkey, s_suppkey, s_name, round(s_acctbal / 2000) + 0.0 AS value FROM supplier), n AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey, value) AS n, min(s_suppkey) OVER (PARTITION BY s_nationkey, value) AS f FROM v),
  m AS (SELECT *, max(n) OVER (PARTITION BY s_nationkey) AS most FROM n)
  SELECT s_nationkey, s_suppkey, value FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, CASE WHEN most = 1 THEN length(s_name) ELSE 0 END, f, s_suppkey) AS k FROM m) WHERE k = 1""")
def modal_candidate(spark, sf):
    """One value for each nation: the commonest, else that of the shortest name."""
    v = table(spark, sf, "supplier").select("s_nationkey", F.lit(0).alias("sheet_idx"), F.lit("s").alias("sheet"), F.col("s_suppkey").alias("row"), F.lit(1).alias("label_col"), F.col("s_name").alias("label"), (F.round(F.col("s_acctbal") / 2000) + 0.0).alias("value"))
    return labels.modal_candidate(v, ["s_nationkey"]).select("s_nationkey", F.col("row").alias("s_suppkey"), "value")


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({duck(EDGES)})), r AS (SELECT 0 AS node, 0 AS wave UNION SELECT e.dst, r.wave + 1 FROM r JOIN e ON e.src = r.node WHERE r.wave < 30)
  SELECT node, min(wave) AS wave FROM r GROUP BY node""")
def reachability(spark, sf):
    """What nation 0 leads to, and in how many steps."""
    return graph.reach(project(spark, sf, EDGES).select("src", "dst"), spark.createDataFrame([(0,)], "node int"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({duck(EDGES)})), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b)
  SELECT a AS node, min(b) AS cycle FROM (SELECT x.a, x.b FROM c x JOIN c y ON x.a = y.b AND x.b = y.a) GROUP BY a""")
def cycles_scc(spark, sf):
    """Nations on cycles, with the smallest of their cycle."""
    return graph.component_of_cycle(project(spark, sf, EDGES).select("src", "dst"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS node, c_custkey - 1 AS next FROM customer WHERE c_custkey % 37 <> 0), r AS (SELECT node, next AS last, 1 AS hops FROM l UNION ALL SELECT r.node, l.next, r.hops + 1 FROM r JOIN l ON l.node = r.last)
  SELECT node, min(last) AS last, CAST(max(hops) AS BIGINT) AS hops FROM r GROUP BY node""")
def daisy_chain_hops(spark, sf):
    """Where chains of links end, by doubling."""
    links = table(spark, sf, "customer").where("c_custkey % 37 <> 0").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") - 1).alias("next"))
    return graph.chain_ends(links)


_KIND = """CASE WHEN lower(urgency) = 'informational' THEN 'Observation' WHEN confidence < 60 AND category = 'Debt' THEN 'Critical Query' WHEN confidence < 60 THEN 'Query'
  WHEN severity IN ('fatal', 'critical') AND confidence < 80 THEN 'Critical Query' WHEN severity IN ('fatal', 'critical', 'high', 'medium', 'low') THEN 'Confirmed Finding' ELSE 'Observation' END"""
_PRIORITY = "CASE WHEN record_type <> 'Confirmed Finding' THEN record_type WHEN severity IN ('fatal', 'critical') THEN 'P1' WHEN severity IN ('high', 'medium') THEN 'P2' ELSE 'P3' END"
_TYPED = f"(SELECT *, {_PRIORITY} AS priority FROM (SELECT *, {_KIND} AS record_type FROM ({duck(FINDINGS)})))"


def _typed(spark, sf):
    f = project(spark, sf, FINDINGS)
    f = f.withColumn("record_type", algebra.record_type(F.col("severity"), F.col("confidence"), F.col("urgency"), F.lower("category")))
    return f.withColumn("priority", algebra.priority(F.col("record_type"), F.col("severity")))


@query(f"SELECT check_id, record_type, priority, count(*) AS findings, CAST(sum(n) AS BIGINT) AS n FROM {_TYPED} GROUP BY ALL")
def record_type_priority(spark, sf):
    """Types and priorities of findings (A3, A4)."""
    return _typed(spark, sf).groupBy("check_id", "record_type", "priority").agg(F.count("*").alias("findings"), F.sum("n").alias("n"))


@query(f"SELECT priority, count(*) AS findings, count(*) FILTER (WHERE priority IN ('P1', 'P2', 'P3', 'Critical Query')) AS confirmed FROM {_TYPED} GROUP BY CUBE (priority)")
def findings_cube(spark, sf):
    """Counts by priority and in all (A5)."""
    return algebra.breakdown(_typed(spark, sf))


_RISK = """2 * least(5, 2 + CASE WHEN category = 'Debt' THEN 2 ELSE 0 END) + CASE WHEN occ >= 20 THEN 5 WHEN occ >= 8 THEN 4 WHEN occ >= 3 THEN 3 WHEN occ >= 1 THEN 2 ELSE 1 END
  + CASE WHEN sheets >= 5 THEN 5 WHEN sheets >= 3 THEN 4 WHEN sheets = 2 THEN 3 WHEN sheets = 1 AND occ > 1 THEN 2 ELSE 1 END + least(5, 2 + CASE WHEN confidence < 70 THEN 2 WHEN confidence < 85 THEN 1 ELSE 0 END)"""


@query(f"""SELECT check_id, category, confidence, occ, sheets, CAST({_RISK} AS INT) AS risk FROM (SELECT check_id, category, confidence, CAST(sum(n) AS BIGINT) AS occ, count(DISTINCT sheet) AS sheets FROM {_TYPED} WHERE record_type = 'Confirmed Finding' GROUP BY ALL)""")
def risk_score(spark, sf):
    """Risk of grouped findings."""
    g = _typed(spark, sf).where("record_type = 'Confirmed Finding'").groupBy("check_id", "category", "confidence").agg(F.sum("n").alias("occ"), F.count_distinct("sheet").alias("sheets"))
    parts = (algebra.consequence(F.lower("category"), F.lit(None)), algebra.exposure(F.col("occ")), algebra.propagation(F.col("sheets"), F.col("occ")), algebra.control_weakness(F.col("confidence"), F.lit(None).cast("boolean")))
    return g.withColumn("risk", algebra.risk_total(*parts).cast("int"))


@query(f"""SELECT check_id, count(*) AS occurrence_count, count(*) FILTER (WHERE severity <> 'low') AS material_occurrence_count, count(DISTINCT sheet) AS sheets, count(*) AS cells, min(sheet) AS first_sheet FROM ({duck(FINDINGS)}) GROUP BY check_id""")
def root_cause_rollup(spark, sf):
    """One row for each check with its occurrences, cells and sheets."""
    f = project(spark, sf, FINDINGS).withColumns({"workbook_id": F.lit("w"), "row": F.lit(1), "col": F.lit(1), "addr": F.lit("A1")})
    r = algebra.root_causes(f)
    return r.select("check_id", "occurrence_count", "material_occurrence_count", F.col("sheet_count").alias("sheets"), F.col("cell_count").alias("cells"), F.element_at("affected_sheets", 1).alias("first_sheet"))


@query(f"""SELECT fingerprint, CASE WHEN in_current AND NOT in_prior THEN 'new' WHEN in_current AND prior_closed THEN 'regressed' WHEN in_current THEN 'still open' WHEN NOT prior_closed THEN 'closed' END AS state,
  CASE WHEN in_current THEN 'open' ELSE 'closed' END AS status, CASE WHEN in_current THEN CASE WHEN in_prior AND prior_closed THEN 1 ELSE 0 END WHEN prior_closed THEN 1 ELSE 1 END AS times_closed
  FROM ({duck(RUNS)}) WHERE in_prior OR in_current""")
def cross_run_diff(spark, sf):
    """New, regressed, still open and closed fingerprints."""
    r = project(spark, sf, RUNS)
    history = r.where("in_prior").select("fingerprint", F.when(F.col("prior_closed"), "closed").otherwise("open").alias("status"), F.col("prior_closed").cast("int").alias("times_closed"))
    return algebra.cross_run(r.where("in_current").select("fingerprint"), history)


@query(f"""WITH s AS (SELECT fingerprint, CASE WHEN in_current AND NOT in_prior THEN 'new' WHEN in_current AND prior_closed THEN 'regressed' WHEN in_current THEN 'still open' WHEN NOT prior_closed THEN 'closed' END AS state FROM ({duck(RUNS)}) WHERE in_prior OR in_current)
  SELECT state, count(*) AS fingerprints, count(DISTINCT split_part(fingerprint, '::', 1)) AS root_causes, count(DISTINCT split_part(fingerprint, '::', 1)) AS rule_causes, CAST(0 AS BIGINT) AS review_causes FROM s WHERE state IS NOT NULL GROUP BY state""")
def cross_run_summary(spark, sf):
    """Counts of the states."""
    return algebra.run_summary(cross_run_diff(spark, sf))


@query("""WITH rules AS (SELECT concat('T', CAST(r_regionkey AS VARCHAR), '-', CAST(n_nationkey AS VARCHAR)) AS rule_id FROM region, nation),
  results AS (SELECT concat('T', CAST(c_nationkey % 5 AS VARCHAR), '-', CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN concat('-', c_mktsegment) ELSE '' END) AS id,
    CASE WHEN c_acctbal < -900 THEN 'fail' WHEN c_acctbal > 9000 THEN 'uncertain' ELSE 'pass' END AS status FROM customer)
  SELECT rule_id, CASE WHEN count(id) = 0 THEN 'not run' WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'issue' WHEN count(*) FILTER (WHERE status = 'uncertain') > 0 THEN 'uncertain' ELSE 'pass' END AS state, count(id) AS results
  FROM rules LEFT JOIN results ON id = rule_id OR starts_with(id, concat(rule_id, '-')) GROUP BY rule_id""")
def coverage_matrix(spark, sf):
    """The state of each rule from results whose id begins with it (A10, T5)."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    rules = nation.crossJoin(F.broadcast(region)).select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")).alias("rule_id"))
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("-"), "c_mktsegment")).otherwise("")
    status = F.when(F.col("c_acctbal") < -900, "fail").when(F.col("c_acctbal") > 9000, "uncertain").otherwise("pass")
    results = customer.select(F.concat(F.lit("T"), (F.col("c_nationkey") % 5).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"), tail).alias("id"), status.alias("status"))
    return algebra.coverage(rules, results).select("rule_id", "state", F.coalesce("results", F.lit(0)).cast("long").alias("results"))


@query("""SELECT c_nationkey, p1, cq, readiness, CASE WHEN (p1 > 0 OR cq > 0) AND readiness >= 60 THEN 'internal only' WHEN p1 > 0 OR cq > 0 THEN 'not ready' WHEN readiness >= 95 AND approved THEN 'transaction'
  WHEN readiness >= 80 THEN 'lender' WHEN readiness >= 60 THEN 'management' ELSE 'internal only' END AS verdict FROM (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < -995) AS p1, count(*) FILTER (WHERE c_acctbal > 9995) AS cq,
    CAST(c_nationkey * 4 AS INT) AS readiness, c_nationkey % 2 = 0 AS approved FROM customer GROUP BY c_nationkey)""")
def verdict_ladder(spark, sf):
    """What may be relied on."""
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < -995).alias("p1"), F.count_if(F.col("c_acctbal") > 9995).alias("cq"))
    readiness, approved = (F.col("c_nationkey") * 4).cast("int"), F.col("c_nationkey") % 2 == 0
    return g.select("c_nationkey", "p1", "cq", readiness.alias("readiness"), algebra.verdict(F.col("p1"), F.lit(0), F.col("cq"), readiness, approved).alias("verdict"))


@query(f"""SELECT check_id, priority, category, sheet FROM (SELECT *, {_RISK.replace('occ', 'n').replace('sheets', '1')} AS risk FROM {_TYPED}) ORDER BY CASE WHEN priority IN ('P1', 'Critical Query') THEN 0 WHEN priority = 'P2' THEN 1 WHEN priority = 'P3' THEN 2 ELSE 3 END,
  CASE WHEN record_type = 'Confirmed Finding' THEN risk END DESC NULLS LAST, check_id, sheet, category, confidence LIMIT 5""")
def top5_blockers(spark, sf):
    """The five findings that matter most."""
    t = _typed(spark, sf)
    parts = (algebra.consequence(F.lower("category"), F.lit(None)), algebra.exposure(F.col("n")), algebra.propagation(F.lit(1), F.col("n")), algebra.control_weakness(F.col("confidence"), F.lit(None).cast("boolean")))
    t = t.withColumns({"risk_weighted_total": F.when(F.col("record_type") == "Confirmed Finding", algebra.risk_total(*parts)), "key_output": F.lit(False), "fscore": F.lit(0)})
    return algebra.top_blockers(t, ties=("sheet", "category", "confidence")).select("check_id", "priority", "category", "sheet")


@query("""SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority LIKE '1%' THEN 7 WHEN o_orderpriority LIKE '2%' THEN 30 ELSE 90 END AS due_on,
  CASE WHEN date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority LIKE '1%' THEN 7 WHEN o_orderpriority LIKE '2%' THEN 30 ELSE 90 END) < 0 THEN 'Overdue'
    WHEN date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority LIKE '1%' THEN 7 WHEN o_orderpriority LIKE '2%' THEN 30 ELSE 90 END) <= 7 THEN 'Due Soon' ELSE 'On Track' END AS timing FROM orders""")
def issue_due_dates(spark, sf):
    """Target dates and how they stand."""
    p = F.when(F.startswith("o_orderpriority", F.lit("1")), "P1").when(F.startswith("o_orderpriority", F.lit("2")), "P2").otherwise("P3")
    due = algebra.due(p, F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", due.alias("due_on"), algebra.timing(due, F.to_date(F.lit("1998-08-02"))).alias("timing"))


@query("""WITH s AS (SELECT DISTINCT CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_brand WHEN 1 THEN concat(p_brand, ' (backup)') WHEN 2 THEN concat(p_brand, '_copy') ELSE concat('X', CAST(p_size AS VARCHAR), ' old') END AS sheet FROM part),
  b AS (SELECT sheet, CASE WHEN sheet LIKE '% (backup)' THEN 'backup' WHEN sheet LIKE '%\\_copy' ESCAPE '\\' THEN 'copy' ELSE 'old' END AS suffix, regexp_replace(sheet, '( \\(backup\\)|_copy| old)$', '') AS base FROM s WHERE regexp_matches(sheet, '( \\(backup\\)|_copy| old)$'))
  SELECT b.sheet, suffix, CASE WHEN s.sheet IS NOT NULL THEN base END AS live FROM b LEFT JOIN s ON lower(s.sheet) = lower(base)""".replace("\\\\", "\\"))
def duplicate_sheet_selfjoin(spark, sf):
    """Sheets named like copies, with their live sheet."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat("p_brand", F.lit(" (backup)"))).when(k == 2, F.concat("p_brand", F.lit("_copy"))).otherwise(F.concat(F.lit("X"), F.col("p_size").cast("string"), F.lit(" old")))
    sheets = table(spark, sf, "part").select(F.lit("w").alias("workbook_id"), name.alias("sheet")).distinct()
    return predicates.duplicate_sheets(sheets).drop("workbook_id")


@query("""WITH a AS (SELECT * FROM (VALUES ('Revenue', 'revenue'), ('Debt', 'debt'), ('Debt', 'interest'), ('Tax', 'tax'), ('Text', 'the ')) AS t(area, kw)),
  m AS (SELECT DISTINCT area, doc_id FROM a JOIN documents ON contains(lower(text), kw)) SELECT a.area, count(DISTINCT doc_id) AS findings FROM (SELECT DISTINCT area FROM a) a LEFT JOIN m USING (area) GROUP BY a.area""")
def assumption_register(spark, sf):
    """Findings by area, over lists of keywords."""
    from tallygrid.plans.report import area_register

    areas = {"Revenue": ("revenue",), "Debt": ("debt", "interest"), "Tax": ("tax",), "Text": ("the ",)}
    return area_register(table(spark, sf, "documents").select("doc_id", "text"), "text", areas)


@query("""SELECT err, count(*) AS cells, count(DISTINCT sheet) AS sheets FROM (SELECT concat('S', CAST(user_id % 7 AS VARCHAR)) AS sheet, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN '#REF!' WHEN 1 THEN '#DIV/0!' WHEN 2 THEN '#N/A' END AS err FROM events) WHERE err IS NOT NULL GROUP BY err""")
def error_matrix(spark, sf):
    """Error cells by code."""
    k = F.col("event_id") % 9
    cells = table(spark, sf, "events").select(F.lit("w").alias("workbook_id"), F.lit(0).alias("sheet_idx"), F.concat(F.lit("S"), (F.col("user_id") % 7).cast("string")).alias("sheet"), F.col("event_id").alias("row"), F.lit(1).alias("col"), F.lit("A1").alias("addr"), F.when(k == 0, "#REF!").when(k == 1, "#DIV/0!").when(k == 2, "#N/A").alias("err"))
    return core.error_matrix(cells).select("err", "cells", "sheets")


@query("""SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 'Zero' WHEN c_acctbal < 0 THEN 'Negative' WHEN c_acctbal <= 1 THEN 'Percentage-like' WHEN c_acctbal = floor(c_acctbal) THEN 'Whole' ELSE 'Decimal' END AS value_type FROM customer""")
def value_types(spark, sf):
    """Buckets of values."""
    return table(spark, sf, "customer").select("c_custkey", text.value_type(F.col("c_acctbal")).alias("value_type"))


@query("""SELECT n_nationkey, n_name, regexp_matches(lower(n_name), '(^|[^a-z0-9])united([^a-z0-9]|$)') OR contains(lower(n_name), 'kingdom') OR contains('kingdom', lower(n_name)) AS hit FROM nation""")
def sheet_keywords(spark, sf):
    """Sheet names against keywords, whole words if short."""
    return table(spark, sf, "nation").select("n_nationkey", "n_name", text.any_keyword(F.col("n_name"), ("united", "kingdom")).alias("hit"))


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS formula_cells, CAST(sum(chars + length(sheet) + 4) AS BIGINT) AS characters, CAST(round(sum(chars + length(sheet) + 4) / 3) AS BIGINT) AS tokens, round(sum(chars + length(sheet) + 4) / 3) <= 780000 AS fits
  FROM (SELECT sheet, count(*) AS n, sum(length(concat('C', row_no)) + 3 + length(formula) + 1) AS chars FROM {_F} GROUP BY sheet)""")
def token_estimate(spark, sf):
    """The size of a listing of all formulas."""
    from tallygrid.operators import sampling

    return sampling.token_estimate(formula_model(spark, sf).cells).drop("workbook_id")


@query("""WITH b AS (SELECT l_returnflag AS check_id, CAST(l_suppkey AS VARCHAR) AS sha256, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), a AS (SELECT l_returnflag AS check_id, CAST(l_suppkey AS VARCHAR) AS sha256, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
  SELECT check_id, sha256, b.n AS before, a.n AS after, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' ELSE 'changed' END AS what FROM b FULL JOIN a USING (check_id, sha256) WHERE b.n IS NULL OR a.n IS NULL OR a.n <> b.n""")
def snapshot_diff(spark, sf):
    """Counts that changed between two snapshots."""
    from tallygrid.operators import sampling

    part = lambda c: table(spark, sf, "lineitem").where(c).groupBy(F.col("l_returnflag").alias("check_id"), F.col("l_suppkey").cast("string").alias("sha256")).agg(F.count("*").alias("n"))
    return sampling.snapshot_changes(part("l_linenumber % 2 = 1"), part("l_linenumber % 2 = 0"))


@query("""SELECT 'n' || CAST(src AS VARCHAR) AS target, 'n' || CAST(dst AS VARCHAR) AS precedent, CAST(link_count * 150 AS BIGINT) AS link_count, 'Normal' AS direction, CASE WHEN link_count * 150 > 500 THEN 'High' WHEN link_count * 150 > 100 THEN 'Moderate' ELSE 'Low' END AS risk FROM (""" + duck(EDGES) + ")")
def edge_risk(spark, sf):
    """Direction and risk of dependencies."""
    e = project(spark, sf, EDGES).select(F.concat(F.lit("n"), F.col("src").cast("string")).alias("target"), F.concat(F.lit("n"), F.col("dst").cast("string")).alias("precedent"), (F.col("link_count") * 150).cast("long").alias("link_count"))
    return core.edges(e)


@query(r"""SELECT c_custkey, lower(trim(regexp_replace(c_name, '[-\s]+', ' ', 'g'))) AS label, repeat('*', CASE WHEN length(c_mktsegment) <= 4 THEN length(c_mktsegment) ELSE 0 END) || CASE WHEN length(c_mktsegment) > 4 THEN left(c_mktsegment, 2) || repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 2) ELSE '' END AS redacted FROM customer""")
def labels_and_redaction(spark, sf):
    """Normal labels and redacted texts."""
    return table(spark, sf, "customer").select("c_custkey", text.normal_label(F.col("c_name")).alias("label"), text.redact(F.col("c_mktsegment")).alias("redacted"))


@query("""SELECT o_orderkey, CASE WHEN v IS NULL OR isnan(v) THEN 'unresolved' WHEN abs(o_totalprice - v) > greatest(1.0, 0.001 * abs(o_totalprice)) THEN CASE WHEN o_custkey % 3 = 0 THEN 'likely masked' ELSE 'mismatch' END ELSE 'match' END AS state
  FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice END AS v FROM orders)""")
def recalc_compare(spark, sf):
    """Cached against recalculated values."""
    place = [F.lit("w").alias("workbook_id"), F.lit("s").alias("sheet"), F.col("o_orderkey").cast("int").alias("row"), F.lit(1).alias("col")]
    o = table(spark, sf, "orders")
    cells = o.select(*place, F.lit("A1").alias("formula"), F.lit("number").alias("kind"), F.col("o_totalprice").alias("num"))
    again = o.where("o_orderkey % 13 <> 0").select(*place, F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice")).alias("value"))
    return graph.recalculation(cells, again, o.where("o_custkey % 3 = 0").select(*place)).select(F.col("row").cast("long").alias("o_orderkey"), "state")


@query("""WITH o AS (SELECT *, o_orderkey % 7 AS k FROM orders) SELECT o_orderkey,
  CASE k WHEN 2 THEN 'status "' || o_orderstatus || '", then "' || o_orderpriority || '" again' WHEN 4 THEN 'a "' || o_orderpriority || '": quoted' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE o_orderpriority END AS note,
  CASE WHEN k < 5 THEN o_custkey END AS n, CASE WHEN k IN (1, 2) THEN 2 WHEN k < 5 THEN 1 END AS tags FROM o""")
def reply_repair(spark, sf):
    """Replies around a JSON object, with quotes and commas where none belong (F30): a form to each remainder of the key."""
    from tallygrid.operators import sampling

    k, key, status, level = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    put = lambda form, *columns: F.format_string(form, *columns)
    reply = (
        F.when(k == 0, put('{"note": "%s", "n": %s, "tags": ["x"]}', level, key))
        .when(k == 1, put('Here it is:\n```json\n{"note": "%s",\n "n": %s, "tags": ["x", "y"]}\n```\nDone.', level, key))
        .when(k == 2, put('{"note": "status "%s", then "%s" again", "n": %s, "tags": ["x", "y"]}', status, level, key))
        .when(k == 3, put('{"note": "%s", "n": %s, "tags": ["x",],}', level, key))
        .when(k == 4, put('{"note": "a \\"%s\\": quoted", "n": %s, "tags": ["say "x" twice",],}', level, key))
        .when(k == 5, put('{"note": "%s", "n": %s, "tags": ["x"', level, key))
        .otherwise(put("no object for %s", level))
    )
    got = sampling.parsed_reply(reply, "note string, n long, tags array<string>")
    return table(spark, sf, "orders").select("o_orderkey", got.alias("got")).select("o_orderkey", "got.note", "got.n", F.when(F.col("got").isNotNull(), F.size("got.tags")).alias("tags"))


_MADE_LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'Real Estate: ' || p_name WHEN 1 THEN p_name || ' (mixed-use), rail transport' WHEN 2 THEN 'Coal/' || p_name WHEN 3 THEN p_name || ' railways' WHEN 4 THEN p_name || ' RAIL' ELSE p_type END"
_HOLDS = "regexp_matches(lower(label), '(^|[^a-z0-9])({})($|[^a-z0-9])')"


@query(f"""SELECT domain, count(*) AS labels FROM (SELECT CASE WHEN {_HOLDS.format('property|real estate|development|hospitality|entertainment venue|venue development|mixed-use|mixed use|corporate')} THEN 'property'
  WHEN {_HOLDS.format('mining|coal|resources|minerals')} THEN 'mining' WHEN {_HOLDS.format('infrastructure|railway|rail|rail transport|rail infrastructure')} THEN 'infrastructure' ELSE label END AS domain FROM (SELECT {_MADE_LABEL} AS label FROM part)) GROUP BY domain""")
def model_domains(spark, sf):
    """Kinds of models by what their labels call them (2.9): phrases meet aliases by equality."""
    from tallygrid.operators.domains import with_domain

    return with_domain(table(spark, sf, "part").select(F.expr(_MADE_LABEL).alias("label")), "label").groupBy("domain").agg(F.count("*").alias("labels"))
