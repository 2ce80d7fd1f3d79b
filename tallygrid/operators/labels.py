"""Values and series found by their labels.

A label is a literal text. Its row is at most a sheet's width, so windows over a row are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.functions import text
from tallygrid.model import Model
from tallygrid.operators.finding import finding

#: Terms of labels.
PLUG = ("balancing figure", "balancing item", "plug", "other/balancing", "residual balancing")
OPENING = ("opening balance", "opening cash balance", "beginning balance")
CONTRIBUTION = ("contributed equity", "paid-in capital", "paid in capital", "share capital", "common stock", "capital contribution", "member contribution")
BASE_RATE = ("base rate", "reference rate", "floating rate index")
RATIO = ("dscr", "interest-cover", "interest cover", "debt yield", "coverage ratio", "icr")
ASSETS = ("development property", "capitalised project cost", "capitalized project cost", "property, plant", "fixed assets", "construction in progress", "capital work in progress")
NEVER_NEGATIVE = {"Cash balance": ("cash balance", "closing cash", "cash and cash equivalents"), "Revolver balance": ("revolver balance", "revolving credit facility balance", "revolver drawn balance")}
SIGNED = {
    "Capex": ("capex", "capital expenditure"),
    "Operating costs": ("operating expense", "opex", "operating costs"),
    "Interest expense": ("interest expense", "interest paid"),
    "Distributions": ("distributions paid", "dividends paid", "distribution to equity"),
    "Depreciation": ("depreciation expense", "depreciation charge"),
    "Cash balance": ("cash balance", "closing cash", "cash and cash equivalents"),
    "Fixed assets": ("fixed assets", "property, plant and equipment", "net fixed assets"),
    "Debt balance": ("debt balance", "loan balance", "closing debt balance"),
}
STATUS_TERMS = ("review required", "not ready", "draft", "incomplete", "pending review", "tbc", "to be confirmed", "not for reliance", "work in progress", "wip", "do not rely", "not final", "unconfirmed", "outstanding")
CHECK_LABEL = r"(?i)\b(check|reconciliation|recon|validation|balance[\s-]?check|error[\s-]?check|errors?|model[\s-]?control|tie[\s-]?out|cross[\s-]?foot|formula\s+(?:error|links)|circular[\s-]?reference)\b"
CHECK_RESULT = r"(?i)^(ok|pass(ed)?|fail(ed)?|error|true|false|balanced|yes|no|tie[sd]?|clean|reconciled|manual(?:ly)?\s*review(?:ed)?)(\s*[-–—:]|$)"
CONTROL_LABEL = r"(?i)control|gate|\bcheck\b"
BARE_LINK = r"^(?:(?:'([^']+)'|([A-Za-z0-9_]+))!)?\$?([A-Z]{1,3})\$?(\d+)$"


def by_row():
    return W.partitionBy("workbook_id", "sheet", "row").orderBy("col")


def label_text() -> Column:
    """The text of a literal text cell; formula-driven labels aren't seen."""
    return F.when((F.col("kind") == "text") & F.col("formula").isNull() & (F.btrim(F.col("txt")) != ""), F.col("txt"))


def with_left_label(cells: DataFrame, distance: int = 8) -> DataFrame:
    """Adds left_label: the nearest literal text up to `distance` columns to the left."""
    near = W.partitionBy("workbook_id", "sheet", "row").orderBy("col").rangeBetween(-distance, -1)
    return cells.withColumn("left_label", F.last(label_text(), ignorenulls=True).over(near))


def with_nearby_label(cells: DataFrame, distance: int = 8) -> DataFrame:
    """Adds label: the nearest text that is no number, to the left, else to the right; '' if there is none."""
    word = F.when(F.expr("try_cast(txt AS double)").isNull(), label_text())
    row = W.partitionBy("workbook_id", "sheet", "row").orderBy("col")
    left, right = F.last(word, ignorenulls=True).over(row.rangeBetween(-distance, -1)), F.first(word, ignorenulls=True).over(row.rangeBetween(1, distance))
    return cells.withColumn("label", F.coalesce(left, right, F.lit("")))


def labelled(cells: DataFrame, terms: tuple[str, ...], skip_backups: bool = True) -> DataFrame:
    """Label cells that contain a term: place, label and the first term in the order of terms."""
    rows = cells.withColumn("label", label_text()).withColumn("term", text.first_term(F.col("label"), terms)).where("term IS NOT NULL")
    if skip_backups:
        rows = rows.where(~F.col("sheet").rlike(text.BACKUP_SHEET))
    return rows.select("workbook_id", "sheet_idx", "sheet", "row", F.col("col").alias("label_col"), F.left("label", F.lit(80)).alias("label"), "term")


def labelled_values(cells: DataFrame, terms: tuple[str, ...], distance: int = 6) -> DataFrame:
    """The first number to the right of each label, up to `distance` columns; another text or boolean ends the search,
    blanks and dates don't."""
    stops = cells.where(((F.col("kind") == "number") & F.col("num").isNotNull()) | label_text().isNotNull() | (F.col("kind") == "bool"))
    stops = stops.select("workbook_id", "sheet", "row", "col", "num", "formula", "kind")
    near = labelled(cells, terms).join(stops, ["workbook_id", "sheet", "row"]).where((F.col("col") > F.col("label_col")) & (F.col("col") <= F.col("label_col") + distance))
    first = near.groupBy("workbook_id", "sheet_idx", "sheet", "row", "label_col", "label", "term").agg(F.min_by(F.struct("col", "kind", "num", F.col("formula").isNotNull().alias("is_formula")), "col").alias("v"))
    return first.where("v.kind = 'number'").select("workbook_id", "sheet_idx", "sheet", "row", "label_col", "label", "term", F.col("v.col").alias("col"), F.col("v.num").alias("value"), F.col("v.is_formula").alias("is_formula"))


def labelled_series(cells: DataFrame, terms: tuple[str, ...], distance: int = 60, gaps: int = 3, lead: int | None = None, through_text: bool = False) -> DataFrame:
    """The numbers to the right of each label, in long form (label_col, col, value).

    A series ends at another text (unless through_text) or after `gaps` columns without a number; before its first
    number, `lead` such columns end it (by default `gaps`).
    """
    row = ["workbook_id", "sheet_idx", "sheet", "row", "label_col", "label", "term"]
    is_number = (F.col("kind") == "number") & F.col("num").isNotNull()
    marks = cells.where(is_number | (label_text().isNotNull() if not through_text else F.lit(False))).select("workbook_id", "sheet", "row", "col", "num", is_number.alias("number"))
    near = labelled(cells, terms, skip_backups=not through_text).join(marks, ["workbook_id", "sheet", "row"]).where((F.col("col") > F.col("label_col")) & (F.col("col") <= F.col("label_col") + distance))
    w = W.partitionBy(*row).orderBy("col")
    before = F.lag("col").over(w)
    gap = F.col("col") - F.coalesce(before, F.col("label_col")) - 1
    most = F.when(before.isNull(), F.lit(lead or gaps)).otherwise(F.lit(gaps))
    near = near.withColumn("ends", (~F.col("number") | (gap >= most)).cast("int"))
    near = near.withColumn("ended", F.sum("ends").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return near.where("ended = 0").select(*row, "col", F.col("num").alias("value"))


def modal_candidate(values: DataFrame, keys: list[str]) -> DataFrame:
    """Of the values of each key: the first with the commonest value (to 6 places); if all differ, the shortest label."""
    place = ["sheet_idx", "sheet", "row", "label_col"]
    rounded = F.format_string("%.6f", F.col("value"))
    by_value = W.partitionBy(*keys, "v6")
    rows = values.withColumn("v6", rounded).withColumn("n", F.count("*").over(by_value)).withColumn("most", F.max("n").over(W.partitionBy(*keys)))
    first_of_value = F.min(F.struct(*place)).over(by_value)
    order = [F.desc("n"), F.when(F.col("most") == 1, F.length("label")).otherwise(F.lit(0)), F.col("first_of_value"), *map(F.col, place)]
    rows = rows.withColumn("first_of_value", first_of_value)
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("v6", "n", "most", "first_of_value", "k")


def bare_link(formula: Column, own_sheet: Column) -> tuple[Column, Column, Column]:
    """(sheet, column letters, row) of a formula that is one reference; row is null otherwise."""
    part = lambda k: F.nullif(F.regexp_extract(F.btrim(formula), BARE_LINK, k), F.lit(""))
    return F.btrim(F.coalesce(part(1), part(2), own_sheet)), part(3), part(4).try_cast("int")


def balance_plugs(cells: DataFrame) -> DataFrame:
    """Formulas with SUM and a subtraction whose nearest left label speaks of a balancing figure."""
    shape = F.col("formula").rlike(r"(?i)\bSUM\s*\(") & F.regexp_replace("formula", "^-", "").rlike("[-−]")
    rows = with_left_label(cells).where(shape & text.first_term(F.col("left_label"), PLUG).isNotNull())
    return finding(rows, "T0-BSPLUG-001", F.col("left_label"))


def blank_boundaries(model: Model) -> DataFrame:
    """Opening balances whose first formula to the right (up to 8 columns, before any typed number) links to a blank cell."""
    stops = model.cells.where("formula IS NOT NULL OR kind = 'number'").select("workbook_id", "sheet", "row", "col", "addr", "formula")
    near = labelled(model.cells, OPENING, skip_backups=False).join(stops, ["workbook_id", "sheet", "row"]).where("col > label_col AND col <= label_col + 8")
    first = near.groupBy("workbook_id", "sheet", "row", "label_col", "label").agg(F.min_by(F.struct("col", "addr", "formula"), "col").alias("v")).select("*", "v.*").where("formula IS NOT NULL")
    to_sheet, letters, to_row = bare_link(F.col("formula"), F.col("sheet"))
    first = first.withColumns({"to_sheet": to_sheet, "to_addr": F.concat(letters, to_row.cast("string"))}).where("to_addr IS NOT NULL")
    real = model.sheets.select("workbook_id", F.col("sheet").alias("to_sheet"))
    filled = model.cells.where("kind <> 'blank' OR formula IS NOT NULL").select("workbook_id", F.col("sheet").alias("to_sheet"), F.col("addr").alias("to_addr"))
    rows = first.join(real, ["workbook_id", "to_sheet"], "left_semi").join(filled, ["workbook_id", "to_sheet", "to_addr"], "left_anti")
    return finding(rows, "T0-BLANKBOUND-001", F.col("label"))


def backward_solved_equity(model: Model) -> DataFrame:
    """Contribution lines computed from a total-assets and a total-liabilities row, one for each row."""
    rows_of = lambda terms: labelled_values(model.cells, terms).select("workbook_id", F.col("row").alias("r1")).distinct()
    refs = model.refs.where(F.col("formula").rlike("[-−]"))
    refs = refs.select("workbook_id", "sheet", "row", "col", F.explode(F.array_distinct(F.array("r1", "r2"))).alias("r1"))
    to = lambda terms: refs.join(rows_of(terms), ["workbook_id", "r1"], "left_semi").select("workbook_id", "sheet", "row", "col").distinct()
    own = with_left_label(model.cells).where("formula IS NOT NULL").where(text.first_term(F.col("left_label"), CONTRIBUTION).isNotNull())
    place = ["workbook_id", "sheet", "row", "col"]
    rows = own.join(to(("total assets",)), place, "left_semi").join(to(("total liabilities",)), place, "left_semi")
    rows = rows.withColumn("k", F.row_number().over(by_row())).where("k = 1")
    return finding(rows, "T0-EQPLUG", F.col("left_label"))


def hardcoded_checks(cells: DataFrame) -> DataFrame:
    """Rows whose first check label (among the first three texts, up to 60 characters) is followed by a typed value
    rather than a formula: place, label and confidence (high if the value looks like a result)."""
    filled = cells.where("formula IS NOT NULL OR coalesce(txt, '') <> '' OR num IS NOT NULL OR bool IS NOT NULL")
    texts = filled.where(label_text().isNotNull()).withColumn("k", F.row_number().over(by_row())).where((F.col("k") <= 3) & (F.length("txt") <= 60) & F.col("txt").rlike(CHECK_LABEL))
    label = texts.groupBy("workbook_id", "sheet_idx", "sheet", "row").agg(F.min_by(F.struct("col", "txt"), "col").alias("l")).select("workbook_id", "sheet_idx", "sheet", "row", F.col("l.col").alias("label_col"), F.btrim("l.txt").alias("label"))
    typed = filled.where("formula IS NULL AND coalesce(merged, false) = false").select("workbook_id", "sheet", "row", "col", "addr", "txt", "num", "bool")
    first = label.join(typed, ["workbook_id", "sheet", "row"]).where("col > label_col").groupBy("workbook_id", "sheet_idx", "sheet", "row", "label").agg(F.min_by(F.struct("col", "addr", "txt", "num", "bool"), "col").alias("v"))
    result = F.col("v.bool").isNotNull() | F.coalesce(F.col("v.num") == 0, F.lit(False)) | F.coalesce(F.btrim("v.txt").rlike(CHECK_RESULT), F.lit(False))
    return first.select("workbook_id", "sheet_idx", "sheet", "row", F.col("v.col").alias("col"), F.col("v.addr").alias("addr"), "label", F.when(result, "high").otherwise("low").alias("confidence"))


def failed_controls(cells: DataFrame) -> DataFrame:
    """Cells that show FAIL beside a control label (8 columns to the left or 4 to the right; the leftmost counts), one
    row for each label."""
    labels = cells.where(label_text().rlike(CONTROL_LABEL)).select("workbook_id", "sheet", "row", F.col("col").alias("label_col"), F.btrim("txt").alias("label"))
    fails = cells.where("lower(trim(txt)) = 'fail'").join(labels, ["workbook_id", "sheet", "row"]).where("label_col BETWEEN col - 8 AND col + 4 AND label_col <> col")
    fails = fails.groupBy("workbook_id", "sheet_idx", "sheet", "row", "col").agg(F.min_by("label", "label_col").alias("label"))
    return fails.groupBy("workbook_id", text.normal_label(F.col("label")).alias("control")).agg(F.count("*").alias("cells"), F.count_distinct("sheet").alias("sheets"), F.min(F.struct("sheet_idx", "sheet", "row", "col")).alias("first"))


def zero_base_rates(model: Model, hops: int = 5) -> DataFrame:
    """Workbooks in which every labelled base rate is zero. A label's value is the first number up to 4 columns to the
    right; a formula without a cached value is followed over up to `hops` bare links."""
    near = labelled(model.cells, BASE_RATE, skip_backups=False).select("workbook_id", "sheet", "row", "label_col", "label")
    cells = model.cells.select("workbook_id", "sheet", "row", "col", "addr", "kind", "num", "formula")
    at = near.join(cells, ["workbook_id", "sheet", "row"]).where("col > label_col AND col <= label_col + 4")
    at = at.select("workbook_id", F.struct("sheet", "row", "label_col").alias("label_at"), "col", "sheet", "num", "kind", "formula")
    target = cells.select("workbook_id", F.col("sheet").alias("to_sheet"), F.col("addr").alias("to_addr"), F.col("num").alias("n2"), F.col("kind").alias("k2"), F.col("formula").alias("f2"))
    for _ in range(hops):
        to_sheet, letters, to_row = bare_link(F.col("formula"), F.col("sheet"))
        open_ = F.col("num").isNull() & F.col("kind").isin("blank", "number") & F.col("formula").isNotNull()
        at = at.withColumns({"to_sheet": F.when(open_, to_sheet), "to_addr": F.when(open_, F.concat(letters, to_row.cast("string")))}).join(target, ["workbook_id", "to_sheet", "to_addr"], "left")
        moved = F.col("k2").isNotNull()
        at = at.select("workbook_id", "label_at", "col", F.when(moved, F.col("to_sheet")).otherwise(F.col("sheet")).alias("sheet"), F.when(moved, F.col("n2")).otherwise(F.col("num")).alias("num"), F.when(moved, F.col("k2")).otherwise(F.col("kind")).alias("kind"), F.when(moved, F.col("f2")).otherwise(F.col("formula")).alias("formula"))
    values = at.where("num IS NOT NULL").groupBy("workbook_id", "label_at").agg(F.min_by("num", "col").alias("value"))
    rows = values.groupBy("workbook_id").agg(F.count("*").alias("rates"), F.bool_and(F.col("value") == 0).alias("all_zero")).where("all_zero")
    return rows.select("workbook_id", "rates")


def date_gated_ratios(cells: DataFrame) -> DataFrame:
    """Ratio rows that are forced to zero before a date, with how many cells are."""
    whole = W.partitionBy("workbook_id", "sheet", "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    word = F.when(~F.col("txt").rlike(r"^\s*[-+]?\.?\d"), label_text())
    rows = cells.withColumn("label", F.first(word, ignorenulls=True).over(whole))
    f = F.col("formula")
    gated = f.rlike(r"(?i)^IF\s*\(\s*OR\s*\(") & F.left(f, F.lit(80)).rlike(r"[A-Z]+\$?\d+\s*<\s*\$?[A-Z]+\$?\d+") & f.rlike(r",\s*0\s*,")
    rows = rows.where(gated & text.first_term(F.col("label"), RATIO).isNotNull())
    return rows.groupBy("workbook_id", "sheet", "row").agg(F.min("label").alias("label"), F.count("*").alias("cells"))


def short_reserve(cells: DataFrame, least_months: float = 5.0) -> DataFrame:
    """Reserve targets worth less than least_months of debt service; a service value of the same sheet is preferred."""
    target = labelled_values(cells, ("dsra target", "dsra required balance", "debt service reserve account target", "dsra requirement"))
    service = labelled_values(cells, ("monthly debt service", "monthly p&i", "monthly principal and interest")).where("value <> 0")
    service = service.select("workbook_id", F.struct("sheet_idx", "sheet", "row", "label_col").alias("at"), F.col("sheet").alias("s_sheet"), F.col("value").alias("monthly"))
    both = target.join(service, "workbook_id")
    order = W.partitionBy("workbook_id", "sheet", "row", "label_col").orderBy(F.col("sheet") != F.col("s_sheet"), "at")
    both = both.withColumn("k", F.row_number().over(order)).where("k = 1").withColumn("months", F.col("value") / F.col("monthly"))
    return both.where(F.col("months") < least_months).select("workbook_id", "sheet", "row", "col", "label", "value", "monthly", "months")


def status_flags(cells: DataFrame) -> DataFrame:
    """Status labels whose first text up to 4 columns to the right says the model isn't final."""
    labels = cells.where(label_text().rlike(r"(?i)\bstatus\b")).select("workbook_id", "sheet", "row", F.col("col").alias("label_col"), F.left("txt", F.lit(60)).alias("label"))
    values = cells.where("coalesce(txt, cast(num AS string), cast(bool AS string)) IS NOT NULL").select("workbook_id", "sheet", "row", "col", F.coalesce("txt", F.col("num").cast("string"), F.col("bool").cast("string")).alias("value"))
    first = labels.join(values, ["workbook_id", "sheet", "row"]).where("col > label_col AND col <= label_col + 4").groupBy("workbook_id", "sheet", "row", "label_col", "label").agg(F.min_by("value", "col").alias("value"))
    return first.where(text.first_term(F.col("value"), STATUS_TERMS).isNotNull())


def negative_balances(cells: DataFrame) -> DataFrame:
    """Numbers below zero in the series of balances that never should be."""
    out = None
    for name, terms in NEVER_NEGATIVE.items():
        part = labelled_series(cells, terms).where("value < 0").withColumn("balance", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def sign_conventions(cells: DataFrame) -> DataFrame:
    """Label groups whose values (at least 1 in size, at least two) have both signs in a workbook."""
    out = None
    for name, terms in SIGNED.items():
        part = labelled_values(cells, terms, 8).where("abs(value) >= 1").withColumn("line", F.lit(name))
        out = part if out is None else out.union(part)
    both = out.groupBy("workbook_id", "line").agg(F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"))
    return both.where("positive > 0 AND negative > 0")


def hardcoded_assets(cells: DataFrame) -> DataFrame:
    """Major asset rows with at least three typed numbers."""
    whole = W.partitionBy("workbook_id", "sheet", "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    word = F.when(~F.col("txt").rlike(r"^\s*[-+]?\.?\d"), label_text())
    rows = cells.withColumn("label", F.first(word, ignorenulls=True).over(whole)).where(text.first_term(F.col("label"), ASSETS).isNotNull())
    rows = rows.where("formula IS NULL AND kind = 'number'")
    return rows.groupBy("workbook_id", "sheet", "row").agg(F.min("label").alias("label"), F.count("*").alias("typed"), F.max("num").alias("largest")).where("typed >= 3")
