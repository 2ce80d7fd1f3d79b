"""The core scan: statistics of sheets, unique formulas, sheet dependencies, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.functions import scoring
from tallygrid.functions.text import any_keyword
from tallygrid.model import Model

ERRORS = ("#REF!", "#VALUE!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!")
OUTPUT_SHEETS = ("Dashboard", "Operational Dashboard", "Graphs", "Summary", "Overview")
CALC_SHEETS = ("IFS", "AFS", "Cons", "Ops", "Debt", "D&T", "Leases", "Balance Sheet", "P&L", "Cashflow", "Cash Flow", "Income Statement", "Equity")
SAMPLES = 20
POSITION = ("sheet_idx", "sheet", "row", "col")


def sheet_stats(cells: DataFrame) -> DataFrame:
    """Counts of each sheet and of each workbook (sheet null). Blank text counts as no value."""
    f = F.col("formula")
    has = f.isNotNull()
    blank = F.col("kind").eqNullSafe("text") & (F.coalesce("txt", F.lit("")) == "")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return (
        cells.rollup("workbook_id", "sheet")
        .agg(
            count(has & ~F.coalesce(F.col("formula_kind") == "dataTable", F.lit(False))).alias("formula_count"),
            count(has).alias("formula_count_with_tables"),
            count(~has & ~blank).alias("value_count"),
            count(f.rlike(scoring.MASKING)).alias("iferror_count"),
            count(f.rlike(scoring.DYNAMIC)).alias("offset_count"),
            count(f.contains("[")).alias("external_count"),
            count(f.rlike(scoring.HARD_CODE_COUNTED)).alias("hardcode_count"),
            F.max("row").alias("max_row"),
            F.max("col").alias("max_col"),
        )
        .where("workbook_id IS NOT NULL")
    )


def unique_formulas(cells: DataFrame) -> DataFrame:
    """One row for each normal form of a workbook: the first formula by position, its score, band and class, and how
    many cells share it. ufi numbers them by first position."""
    place = F.struct(*POSITION, "formula")
    forms = cells.where("formula IS NOT NULL").withColumn("normal", scoring.normal_form(F.col("formula")))
    firsts = forms.groupBy("workbook_id", "normal").agg(F.min(place).alias("first"), F.count("*").alias("instances"))
    firsts = firsts.select("workbook_id", "normal", "instances", "first.*")
    order = W.partitionBy("workbook_id").orderBy(*POSITION)
    f = F.col("formula")
    return (
        firsts.withColumn("ufi", F.concat(F.lit("UF-"), F.lpad(F.row_number().over(order).cast("string"), 4, "0")))
        .withColumn("fscore", scoring.f_score(f))
        .withColumns({"band": scoring.band(F.col("fscore")), "formula_class": scoring.formula_class(f), "hardcode": f.rlike(scoring.HARD_CODE_COUNTED), "explanation": scoring.explanation(f, scoring.band(F.col("fscore")))})
    )


def score_index(cells: DataFrame) -> DataFrame:
    """Each formula cell with the score of its unique formula; the text is cut at 300 characters."""
    forms = cells.where("formula IS NOT NULL").withColumn("normal", scoring.normal_form(F.col("formula")))
    text = F.when(F.length("formula") > 300, F.concat(F.left("formula", F.lit(300)), F.lit("..."))).otherwise(F.col("formula"))
    return forms.select("workbook_id", "sheet", "row", "col", "normal", text.alias("formula_text")).join(unique_formulas(cells).select("workbook_id", "normal", "ufi", "fscore", "band"), ["workbook_id", "normal"])


def price(unique: DataFrame) -> DataFrame:
    """Unique formulas and their price by band, with 10 % tax on the whole in `total` (rounded)."""
    amount = F.lit(0)
    for name, each in scoring.PRICES.items():
        amount = F.when(F.col("band") == name, each).otherwise(amount)
    bands = unique.groupBy("workbook_id", "band").agg(F.count("*").alias("formulas"), F.sum(amount).alias("price"))
    total = F.round(F.sum("price").over(W.partitionBy("workbook_id")) * 1.1).cast("long")
    return bands.withColumn("total", total)


def sheet_dependencies(model: Model) -> DataFrame:
    """target, precedent and how many formulas of target lead to precedent (each once); names count for their sheets."""
    sheets = model.sheets.select("workbook_id", F.col("sheet").alias("precedent"))
    by_ref = model.refs.where("tgt_sheet IS NOT NULL").select("workbook_id", "sheet", "row", "col", F.col("tgt_sheet").alias("precedent"))
    named = model.names.select("workbook_id", "name", F.explode("ranges").alias("range")).withColumn("precedent", F.regexp_extract("range", r"^'?([^'!]+)'?!", 1)).where("length(name) >= 2")
    words = model.formulas.select("workbook_id", "sheet", "row", "col", F.explode(F.array_distinct(F.regexp_extract_all("formula", F.lit(r"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9_(!])")))).alias("name"))
    by_name = words.join(named, ["workbook_id", "name"]).select("workbook_id", "sheet", "row", "col", "precedent")
    used = by_ref.union(by_name).where("precedent <> sheet").distinct().join(sheets, ["workbook_id", "precedent"], "left_semi")
    return used.groupBy("workbook_id", F.col("sheet").alias("target"), "precedent").agg(F.count("*").alias("link_count"))


def edge_risk(target: Column, precedent: Column, link_count: Column) -> tuple[Column, Column]:
    """(direction, risk) of a dependency."""
    backward = any_keyword(precedent, OUTPUT_SHEETS) & any_keyword(target, CALC_SHEETS)
    risk = F.when(backward | (link_count > 500), "High").when(link_count > 100, "Moderate").otherwise("Low")
    return F.when(backward, "Backward").otherwise("Normal"), risk


def edges(dependencies: DataFrame) -> DataFrame:
    direction, risk = edge_risk(F.col("target"), F.col("precedent"), F.col("link_count"))
    return dependencies.withColumns({"direction": direction, "risk": risk})


def error_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("err").isin(*ERRORS))


def first_of(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, ranked in column k. Groups are first cut into 64 parts by a hash of the order, so
    that a large one isn't one task."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    rows = rows.withColumn("_part", part).withColumn("k", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))).where(F.col("k") <= n)
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= n).drop("_part")


def error_matrix(cells: DataFrame) -> DataFrame:
    """Cells of each error code, the sheets they are on, and the first five places."""
    by, found = ["workbook_id", "err"], error_cells(cells)
    sheets = found.groupBy(*by, "sheet").agg(F.count("*").alias("n"))
    counts = sheets.groupBy(*by).agg(F.sum("n").alias("cells"), F.count("*").alias("sheets"))
    some = first_of(found.select(*by, *POSITION, F.concat("sheet", F.lit("!"), "addr").alias("at")).distinct(), by, [*POSITION, "at"], 5)
    places = some.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"]), ", ").alias("samples"))
    return counts.join(places.withColumnsRenamed({"workbook_id": "own", "err": "code"}), F.col("workbook_id").eqNullSafe(F.col("own")) & (F.col("err") == F.col("code"))).drop("own", "code")


def samples(cells: DataFrame, condition: Column, n: int = SAMPLES) -> DataFrame:
    """The first n cells of each workbook that meet the condition."""
    return first_of(cells.where(condition), ["workbook_id"], list(POSITION), n)
