"""Checks over function calls and their arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.model import Model
from tallygrid.operators.core import ERRORS
from tallygrid.operators.finding import finding

CELL = ["workbook_id", "sheet_idx", "sheet", "row", "col", "addr", "formula"]


def arg(k: int):
    """The k-th argument (from 1) or null."""
    return F.try_element_at("args", F.lit(k))


def product_masking(model: Model) -> DataFrame:
    """PRODUCT over a division without IFERROR; only a formula's first PRODUCT is looked at."""
    first = model.calls.where("fn = 'PRODUCT'").groupBy(*CELL).agg(F.min_by(F.array_join("args", ","), "pos").alias("inner"))
    return finding(first.where(F.col("inner").contains("/") & ~F.col("formula").rlike(r"(?i)\bIFERROR\s*\(")), "T0-FLAGERRMASK-001", F.col("formula"))


def error_branches(model: Model) -> DataFrame:
    """Branches of IF that are an error literal: one finding for each."""
    rows = model.calls.where("fn = 'IF'").select(*CELL, "pos", F.posexplode("args").alias("k", "value"))
    return finding(rows.where(F.col("k").isin(1, 2) & F.upper(F.btrim("value")).isin(*ERRORS)), "T0-IFERRLIT-001", F.col("value"))


def error_literals(model: Model) -> DataFrame:
    """Error literals elsewhere than as a whole branch of IF: their number in the formula less those branches."""
    pattern = "(?i)" + "|".join(e.replace("?", r"\?").replace("/", r"\/") for e in ERRORS)
    from tallygrid.functions.text import blank_strings

    n = F.regexp_count(blank_strings(F.col("formula")), F.lit(pattern))
    branches = error_branches(model).groupBy("workbook_id", "sheet", "row", "col").agg(F.count("*").alias("branches"))
    rows = model.formulas.where(F.col("formula").contains("#")).withColumn("n", n).where("n > 0").join(branches, ["workbook_id", "sheet", "row", "col"], "left")
    rows = rows.withColumn("rest", F.col("n") - F.coalesce("branches", F.lit(0))).where("rest > 0")
    return finding(rows.withColumn("one", F.explode(F.sequence(F.lit(1), "rest"))), "T0-ERRLITERAL-001", F.col("formula"))


def inexact_lookups(model: Model) -> DataFrame:
    """VLOOKUP, HLOOKUP and MATCH that don't ask for an exact match; one finding for each call."""
    last = F.upper(F.coalesce(F.when(F.col("fn") == "MATCH", arg(3)).otherwise(arg(4)), F.lit("")))
    exact = F.when(F.col("fn") == "MATCH", last == "0").otherwise(last.isin("FALSE", "0"))
    return finding(model.calls.where(F.col("fn").isin("VLOOKUP", "HLOOKUP", "MATCH") & ~exact), "T0-LOOKUPMATCH-001", F.concat("fn", F.lit("("), F.array_join("args", ","), F.lit(")")))


def text_counting_statistics(model: Model) -> DataFrame:
    """Calls of STDEVA and VARA, which count text as zero."""
    return finding(model.calls.where(F.col("fn").isin("STDEVA", "VARA")), "T0-STDEVA-001", F.col("fn"))


def nested_ifs(model: Model) -> DataFrame:
    """Formulas with an IF inside another one."""
    spans = F.sort_array(F.collect_list(F.struct("pos", "end_at")))
    rows = model.calls.where("fn = 'IF'").groupBy(*CELL).agg(spans.alias("spans")).where(F.size("spans") > 1)
    inside = F.exists("spans", lambda a: F.exists("spans", lambda b: (b["pos"] > a["pos"]) & (b["pos"] < a["end_at"])))
    return finding(rows.where(inside), "T0-NESTEDIF-001", F.col("formula"))


def error_masking(model: Model) -> DataFrame:
    """IFERROR and IFNA whose fallback is a number other than zero."""
    fallback = F.array_join(F.slice("args", 2, 99), ",")
    rows = model.calls.where(F.col("fn").isin("IFERROR", "IFNA")).withColumn("fallback", fallback)
    return finding(rows.where(F.col("fallback").rlike(r"^-?\d+(\.\d+)?$") & (F.col("fallback").try_cast("double") != 0)), "T0-ERRMASK-001", F.col("fallback"))


def npv_without_first_period(model: Model) -> DataFrame:
    """Formulas that are nothing but one NPV call, save a sign."""
    first = model.calls.where("fn = 'NPV'").groupBy(*CELL).agg(F.min(F.struct("pos", "end_at")).alias("s"))
    before, after = F.substring("formula", F.lit(1), F.col("s.pos")), F.expr("substring(formula, s.end_at + 1)")
    return finding(first.where(before.rlike(r"^\s*[-+]?\s*$") & (F.btrim(after) == "")), "T0-NPVP0-001", F.col("formula"))


def payment_signs(model: Model) -> DataFrame:
    """Workbooks that pass the present value to PMT, IPMT and PPMT with both signs."""
    value = F.when(F.col("fn") == "PMT", arg(3)).otherwise(arg(4))
    signed = model.calls.where(F.col("fn").isin("PMT", "IPMT", "PPMT")).withColumn("value", value).where("value IS NOT NULL")
    both = signed.groupBy("workbook_id").agg(F.count_if(F.startswith("value", F.lit("-"))).alias("negative"), F.count_if(~F.startswith("value", F.lit("-"))).alias("positive"))
    both = both.where("negative > 0 AND positive > 0")
    return finding(both, "T0-PMTSIGN-001", F.format_string("%d negative, %d positive", "negative", "positive"))


def call_findings(model: Model) -> DataFrame:
    """All of these checks."""
    out = None
    for check in (product_masking, error_branches, error_literals, inexact_lookups, text_counting_statistics, nested_ifs, error_masking, npv_without_first_period, payment_signs):
        out = check(model) if out is None else out.union(check(model))
    return out
