"""Checks over the formulas and numbers of a row or column: majorities, breaks, gaps, drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.functions.tokens import with_relative_form
from tallygrid.model import Model

STATUS_VALUES = ("pass", "fail", "ok", "error", "warning", "controlled", "n/a", "yes", "no", "true", "false")
TOTAL_CALL = r"(?i)^(SUM|SUBTOTAL|AVERAGE)\s*\(\s*(?:\d+\s*,\s*)?\$?([A-Z]{1,3})\$?(\d+)\s*:\s*\$?([A-Z]{1,3})\$?(\d+)\s*\)$"


def minority(rows: DataFrame, group: list[str], value: str, least: int = 4, count: int = 3, share: float = 0.7) -> DataFrame:
    """Rows whose value isn't the group's commonest one, where a group has at least `least` rows and the commonest value
    has at least `count` of them and `share` of all. A share over one half can't tie."""
    n = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    total = n.groupBy(*group).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by(value, "n").alias("common"))
    total = total.where((F.col("total") >= least) & (F.col("most") >= count) & (F.col("most") >= share * F.col("total")))
    return rows.join(total, group).where(F.col(value) != F.col("common"))


def own_total(axis: str) -> Column:
    """Whether a formula totals its own row or column."""
    first, last = F.regexp_extract("formula", TOTAL_CALL, 3).try_cast("int"), F.regexp_extract("formula", TOTAL_CALL, 5).try_cast("int")
    a, b = F.regexp_extract("formula", TOTAL_CALL, 2), F.regexp_extract("formula", TOTAL_CALL, 4)
    letters = F.regexp_extract("addr", "^([A-Z]+)", 1)
    here = (first == F.col("row")) & (last == F.col("row")) if axis == "row" else (a == letters) & (b == letters)
    return F.coalesce(F.col("formula").rlike(TOTAL_CALL) & here, F.lit(False))


def row_patterns(model: Model) -> DataFrame:
    """Formulas that differ, relative to their cell, from most of their row; totals of the row may."""
    return minority(with_relative_form(model.formulas), ["workbook_id", "sheet", "row"], "template").where(~own_total("row"))


def column_patterns(model: Model) -> DataFrame:
    """The same by column, for each type of result; segments that are mostly status words are left out."""
    kind = F.col("kind")
    rows = with_relative_form(model.formulas).withColumn("segment", kind)
    status = F.count_if(F.lower(F.btrim("txt")).isin(*STATUS_VALUES)).over(W.partitionBy("workbook_id", "sheet", "col", "segment"))
    size = F.count("*").over(W.partitionBy("workbook_id", "sheet", "col", "segment"))
    rows = rows.withColumns({"status": status, "size": size}).where("NOT (segment = 'text' AND status >= 0.6 * size)")
    return minority(rows, ["workbook_id", "sheet", "col", "segment"], "template").where(~own_total("col"))


def regime_changes(rows: DataFrame, group: list[str], order: str, value: str, least: int = 8, side: int = 3) -> DataFrame:
    """Groups of at least `least` rows in which value changes exactly once, with at least `side` rows on either side:
    the place of the change and the sizes."""
    w = W.partitionBy(*group).orderBy(order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("changed", changed).withColumn("part", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sums = rows.groupBy(*group).agg(F.count("*").alias("total"), F.sum("changed").alias("changes"), F.count_if(F.col("part") == 0).alias("before"), F.min(F.when(F.col("part") == 1, F.col(order))).alias("change_at"))
    return sums.where((F.col("total") >= least) & (F.col("changes") == 1) & (F.col("before") >= side) & (F.col("total") - F.col("before") >= side)).drop("changes")


def formula_regimes(model: Model) -> DataFrame:
    return regime_changes(with_relative_form(model.formulas), ["workbook_id", "sheet", "row"], "col", "template")


def period_gaps(rows: DataFrame, group: list[str], date: str, least: int = 6, bucket: int = 6, factor: float = 1.5) -> DataFrame:
    """Gaps of more than factor times the usual one between neighbouring dates. Gaps are usual in buckets of `bucket`
    days (the smallest of the commonest), if at least half of the dates have them."""
    gap = F.datediff(F.col(date), F.lag(date).over(W.partitionBy(*group).orderBy(date)))
    rows = rows.withColumn("gap", gap).withColumn("bucket", (F.round(F.col("gap") / bucket) * bucket).cast("int"))
    n = rows.where("gap IS NOT NULL").groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    usual = n.groupBy(*group).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("usual"), F.max("n").alias("usual_n"))
    size = rows.groupBy(*group).agg(F.count(date).alias("dates"))
    usual = usual.join(size, group).where((F.col("dates") >= least) & (F.col("usual_n") >= 0.5 * F.col("dates")))
    return rows.join(usual, group).where(F.col("gap") > factor * F.col("usual")).select(*group, date, "gap", "usual", "dates")


def terminal_drops(rows: DataFrame, group: list[str], order: str, value: str, formula_share: Column | None = None) -> DataFrame:
    """Series of at least 8 values whose last two are under a tenth of the five before: these average at least 1, each
    is at least 30 % of that, and the last of them at least half of the first."""
    back = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(order)))
    rows = rows.withColumn("back", back)
    aggs = [F.count("*").alias("total"), F.max(F.when(F.col("back") == 1, F.abs(F.col(value)))).alias("t1"), F.max(F.when(F.col("back") == 2, F.abs(F.col(value)))).alias("t2")]
    before = F.col("back").between(3, 7)
    size = F.when(before, F.abs(F.col(value)))
    aggs += [F.avg(size).alias("mean"), F.min(size).alias("least"), F.max(F.when(F.col("back") == 3, F.abs(F.col(value)))).alias("last"), F.max(F.when(F.col("back") == 7, F.abs(F.col(value)))).alias("first")]
    if formula_share is not None:
        aggs.append(F.avg(formula_share.cast("int")).alias("share"))
    sums = rows.groupBy(*group).agg(*aggs)
    keep = (F.col("total") >= 8) & (F.col("mean") >= 1) & (F.col("least") >= 0.3 * F.col("mean")) & (F.col("last") >= 0.5 * F.col("first")) & (F.col("t1") < 0.1 * F.col("mean")) & (F.col("t2") < 0.1 * F.col("mean"))
    if formula_share is not None:
        keep = keep & (F.col("share") >= 0.7)
    return sums.where(keep)


def sign_changes(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: how many values aren't zero and how often their sign changes."""
    rows = rows.where((F.col(value) != 0) & ~F.isnan(F.col(value)))
    changed = F.coalesce(((F.col(value) > 0) != (F.lag(value).over(W.partitionBy(*group).orderBy(*order)) > 0)).cast("int"), F.lit(0))
    return rows.withColumn("changed", changed).groupBy(*group).agg(F.count("*").alias("values"), F.sum("changed").alias("sign_changes"))


def islands(rows: DataFrame, group: list[str], place: str) -> DataFrame:
    """Adds island: the first place of the unbroken run of places that a row is in."""
    step = F.col(place) - F.row_number().over(W.partitionBy(*group).orderBy(place))
    rows = rows.withColumn("_step", step)
    return rows.withColumn("island", F.min(place).over(W.partitionBy(*group, "_step"))).drop("_step")
