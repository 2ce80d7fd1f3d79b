"""Checks that align two labelled series by column, and the reasonableness of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.operators.labels import labelled, labelled_series, labelled_values, modal_candidate

#: Terms and thresholds.
DISTRIBUTIONS = ("distributions paid", "dividends paid", "distribution to equity", "distributions / buybacks", "distributions/buybacks", "dividends", "distributions")
BACKWARD = ("backward looking dscr", "backward-looking dscr", "historic dscr", "trailing dscr")
FORWARD = ("forward looking dscr", "forward-looking dscr", "projected dscr", "prospective dscr")
TAX = ("tax expense", "income tax expense", "tax charge", "current tax", "income tax")
PRETAX = ("pre-tax income", "pretax income", "profit before tax", "earnings before tax", "ebt", "pbt")
RATE = ("statutory tax rate", "corporate tax rate", "tax rate")
OUTPUTS = (
    ("EBITDA margin", ("ebitda margin",), 0.40, "percent"),
    ("Unlevered IRR", ("unlevered irr", "project irr"), 0.20, "percent"),
    ("Equity IRR", ("equity irr",), 0.25, "percent"),
    ("Exit multiple", ("exit multiple",), 6.0, "multiple"),
    ("Yield on cost (exit)", ("yield on cost (exit)", "yield on cost"), 0.50, "percent"),
    ("Receivable days", ("receivable days", "days sales outstanding", "debtor days"), 90.0, "days"),
    ("Depreciation to gross asset value", ("depreciation to gross asset value", "depreciation / gross assets", "depreciation rate"), 0.20, "percent"),
)
REVENUE_PER_UNIT = (
    "revenue per event", "revenue per patron", "revenue per attendee", "revenue per seat", "revenue per capacity", "revenue per guest", "revenue per visitor", "revenue per customer",
    "revenue per member", "revenue per unit", "revenue per tonne", "revenue per ticket", "average ticket value", "average spend per", "yield per event", "average revenue per",
)
TV_CROSS_CHECKS = ("implied buyer return", "implied purchaser return", "implied yield", "exit yield", "replacement cost", "revenue multiple", "implied cap rate", "implied capitalisation rate")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each point of a left series with that of one right series in its column: the first right series of the same
    sheet, else the first of the workbook. Right columns are prefixed r_."""
    series = right.groupBy("workbook_id", "sheet_idx", "sheet", "row", "label_col").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("r_values"))
    series = series.withColumnsRenamed({"sheet": "r_sheet", "sheet_idx": "r_idx", "row": "r_row", "label_col": "r_label_col"})
    firsts = series.withColumn("k", F.row_number().over(W.partitionBy("workbook_id", "r_sheet").orderBy("r_row", "r_label_col"))).where("k = 1").drop("k")
    heads = left.select("workbook_id", "sheet", "row", "label_col").distinct().join(firsts, "workbook_id")
    order = W.partitionBy("workbook_id", "sheet", "row", "label_col").orderBy(F.col("sheet") != F.col("r_sheet"), "r_idx", "r_sheet")
    heads = heads.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    rows = left.join(heads, ["workbook_id", "sheet", "row", "label_col"]).withColumn("r_value", F.try_element_at("r_values", F.col("col")))
    return rows.drop("r_values").where("r_value IS NOT NULL")


def gated_distributions(cells: DataFrame, floor: float = 1.0) -> DataFrame:
    """Distributions above zero in periods whose cover ratio, looking backward or forward, is below the floor; the plain
    ratio serves where a workbook has neither."""
    paid = labelled_series(cells, DISTRIBUTIONS).where("value > 0")
    back, ahead, plain = (labelled_series(cells, t) for t in (BACKWARD, FORWARD, ("dscr",)))
    specific = back.select("workbook_id").union(ahead.select("workbook_id")).distinct()
    plain = plain.join(specific, "workbook_id", "left_anti")
    out = None
    for name, ratio in (("backward", back), ("forward", ahead), ("plain", plain)):
        part = aligned(paid, ratio).where(F.col("r_value") < floor).withColumn("ratio", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def revolver_and_cash(cells: DataFrame) -> DataFrame:
    """Periods with an undrawn revolver and no cash, or with over 1000 of both."""
    revolver = labelled_series(cells, ("revolver balance", "revolving credit facility balance", "revolver drawn balance", "revolver"))
    rows = aligned(revolver, labelled_series(cells, ("cash balance", "closing cash", "cash and cash equivalents")))
    what = F.when((F.col("value") == 0) & (F.col("r_value") <= 0), "no revolver, no cash").when((F.col("value") > 1000) & (F.col("r_value") > 1000), "revolver drawn beside cash")
    return rows.withColumn("what", what).where("what IS NOT NULL")


def effective_tax(cells: DataFrame, deviation: float = 0.10, least: float = 1000.0) -> DataFrame:
    """Periods whose tax over pre-tax income is more than deviation from the stated rate (a rate over 1 is in percent);
    pre-tax incomes under `least` are left out."""
    named = lambda df: df.where(~F.lower("label").contains("rate") & ~F.lower("label").contains("loss carry"))
    stated = labelled_values(cells, RATE, 8).groupBy("workbook_id").agg(F.min_by("value", F.struct("sheet_idx", "sheet", "row", "label_col")).alias("rate"))
    stated = stated.withColumn("rate", F.when(F.col("rate") > 1, F.col("rate") / 100).otherwise(F.col("rate")))
    rows = aligned(named(labelled_series(cells, TAX)), named(labelled_series(cells, PRETAX))).where(F.col("r_value") >= least).join(stated, "workbook_id")
    rows = rows.withColumn("effective", F.abs("value") / F.col("r_value"))
    return rows.where(F.abs(F.col("effective") - F.col("rate")) > deviation)


def picked(cells: DataFrame, *choices: tuple[str, ...]) -> DataFrame:
    """The modal value of the first choice of terms that a workbook has: workbook_id, sheet, row, col, label, value."""
    out = None
    for k, terms in enumerate(choices):
        part = labelled_values(cells, terms).withColumn("choice", F.lit(k))
        out = part if out is None else out.union(part)
    first = out.withColumn("least", F.min("choice").over(W.partitionBy("workbook_id"))).where("choice = least")
    return modal_candidate(first.drop("choice", "least"), ["workbook_id"])


def discount_rate_overrides(cells: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Workbooks whose calculated discount rate isn't the one in use."""
    own = picked(cells, ("wacc (calculated)", "calculated wacc")).select("workbook_id", F.col("value").alias("calculated"))
    used = picked(cells, ("wacc (input override)", "wacc (override)", "override wacc", "input override wacc"), ("applied discount rate", "discount rate applied"))
    return own.join(used.select("workbook_id", F.col("value").alias("applied")), "workbook_id").where(F.abs(F.col("calculated") - F.col("applied")) > tolerance)


def terminal_value_share(cells: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The share of terminal value in the whole, where it is at least the threshold."""
    tv = picked(cells, ("pv of terminal value",), ("terminal value",)).select("workbook_id", F.col("value").alias("terminal"))
    npv = picked(cells, ("project npv", "total npv"), ("enterprise value",)).select("workbook_id", F.col("value").alias("whole"))
    return tv.join(npv, "workbook_id").withColumn("share", F.try_divide("terminal", "whole")).where(F.col("share") >= threshold)


def unreasonable_outputs(cells: DataFrame) -> DataFrame:
    """Outputs at or over their threshold; percentages over 1 are read as whole percents."""
    out = None
    for name, terms, threshold, unit in OUTPUTS:
        part = picked(cells, *((t,) for t in terms)).select("workbook_id", "sheet", "row", "col", F.lit(name).alias("metric"), (F.when(F.col("value") > 1, F.col("value") / 100).otherwise(F.col("value")) if unit == "percent" else F.col("value")).alias("value"), F.lit(threshold).alias("threshold"))
        out = part if out is None else out.union(part)
    return out.where("value >= threshold")


def missing_metrics(cells: DataFrame) -> DataFrame:
    """Workbooks without any revenue-per-unit metric, and those with a terminal value but no cross-check of it."""
    all_of = cells.select("workbook_id").distinct()
    has = lambda terms: labelled_values(cells, terms).select("workbook_id").distinct()
    per_unit = all_of.join(has(REVENUE_PER_UNIT), "workbook_id", "left_anti").select("workbook_id", F.lit("T0-RSN-004").alias("check_id"))
    unchecked = has(("pv of terminal value", "terminal value")).join(has(TV_CROSS_CHECKS), "workbook_id", "left_anti").select("workbook_id", F.lit("T0-RSN-005").alias("check_id"))
    return per_unit.union(unchecked)


def npv_signs(cells: DataFrame) -> DataFrame:
    """Labels that are the same but for NPV or XNPV, with values of both signs."""
    base = F.lower(F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace("label", r"(?i)\b(x?npv)\b", ""), r"[@().]", " "), r"\s+", " ")))
    rows = labelled_values(cells, ("npv",)).withColumn("base", base).where("base <> ''")
    both = rows.groupBy("workbook_id", "base").agg(F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"))
    return both.where("positive > 0 AND negative > 0")


def valuation_divergence(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Two valuations, none of them zero, that differ by at least the threshold of the larger one."""
    a = picked(cells, ("dcf value", "dcf valuation")).select("workbook_id", F.col("value").alias("dcf"))
    b = picked(cells, ("property value", "capitalisation value", "capitalization value", "income capitalisation value")).select("workbook_id", F.col("value").alias("direct"))
    rows = a.join(b, "workbook_id").where("dcf <> 0 AND direct <> 0")
    return rows.withColumn("divergence", F.abs(F.col("direct") - F.col("dcf")) / F.greatest(F.abs("direct"), F.abs("dcf"))).where(F.col("divergence") >= threshold)


def negative_debt_yields(cells: DataFrame) -> DataFrame:
    """Debt yields below zero in series of two or more periods; six columns may lie before the first one."""
    rows = labelled_series(cells, ("debt yield",), gaps=3, lead=6, through_text=True)
    n = F.count("*").over(W.partitionBy("workbook_id", "sheet", "row", "label_col"))
    return rows.withColumn("n", n).where("n > 1 AND value < 0").drop("n")


def label_counts(cells: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    return labelled(cells, terms).groupBy("workbook_id", "term").agg(F.count("*").alias("labels"))
