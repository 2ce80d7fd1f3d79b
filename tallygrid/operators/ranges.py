"""Checks that follow references into the cells they cover.

Sums, counts and whether a cell is covered come from running sums along a column or row: a range is two marks on each
line, so the cost is that of the cells and the ranges, however much they overlap. Where the cells themselves are needed,
a rectangle meets them by an equi-join on sheet and band of rows, then by the exact bounds: each rectangle is sent to
the bands it touches, each cell to its own, so no pair of all with all is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.functions.addresses import num_to_col
from tallygrid.model import Model
from tallygrid.operators.finding import finding
from tallygrid.operators.labels import label_text, with_nearby_label
from tallygrid.operators.series import islands

BAND = 64
AGGREGATES = ("SUM", "AVERAGE", "COUNT", "COUNTA", "MAX", "MIN")
INPUT_SHEET = r"(?i)input|assumption|driver|settings"
BLANK_AWARE = r'(?i)\b(ISBLANK|COUNT|COUNTA|COUNTBLANK|N|T)\s*\(|=\s*""|""\s*='


def covered(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of rectangles (workbook_id, to_sheet, r1, c1, r2, c2 and others) and the cells (row, col as cell_row,
    cell_col) inside them. A rectangle of whole columns is cut to the rows that its sheet uses."""
    used = cells.groupBy("workbook_id", F.col("sheet").alias("to_sheet")).agg(F.max("row").alias("_last"))
    rects = rects.join(used, ["workbook_id", "to_sheet"]).withColumn("r2", F.least("r2", "_last")).where("r1 <= r2").drop("_last")
    rects = rects.withColumn("_band", F.explode(F.sequence(F.floor(F.col("r1") / BAND), F.floor(F.col("r2") / BAND))))
    cells = cells.withColumnsRenamed({"sheet": "to_sheet", "row": "cell_row", "col": "cell_col"}).withColumn("_band", F.floor(F.col("cell_row") / BAND))
    return rects.join(cells, ["workbook_id", "to_sheet", "_band"]).where("cell_row BETWEEN r1 AND r2 AND cell_col BETWEEN c1 AND c2").drop("_band")


def numbers(model: Model) -> DataFrame:
    return model.cells.where("kind = 'number' AND num IS NOT NULL").select("workbook_id", "sheet", "row", "col", F.col("num").alias("value"))


#: Sums are of decimals, so that differences of running sums are exact; larger numbers are summed one by one.
EXACT, HUGE = "decimal(38,8)", 1e22


def _along(line: str) -> W:
    return W.partitionBy("workbook_id", "sheet", line).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)


def sums_up_to(cells: DataFrame, marks: DataFrame, line: str, along: str) -> DataFrame:
    """marks (workbook_id, sheet, `line` (row or col), at, and others) with total, n and huge: sum, count, and count of very
    large ones, of the numbers (row, col, value) on their line up to their place `at`."""
    others = [c for c in marks.columns if c not in ("workbook_id", "sheet", line, "at")]
    small = F.abs("value") < HUGE
    values = cells.select("workbook_id", "sheet", line, F.col(along).alias("at"), F.when(small, F.col("value")).otherwise(0).cast(EXACT).alias("v"), F.lit(1).alias("one"), F.when(small, 0).otherwise(1).alias("large"))
    mark = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    rows = values.withColumn("mark", F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType)).union(marks.select("workbook_id", "sheet", line, "at", F.lit(0).cast(EXACT), F.lit(0), F.lit(0), mark))
    over = _along(line)
    rows = rows.select("workbook_id", "sheet", line, "at", "mark", *(F.sum(c).over(over).alias(name) for c, name in (("v", "total"), ("one", "n"), ("large", "huge"))))
    return rows.where("mark IS NOT NULL").select("workbook_id", "sheet", line, "at", "mark.*", "total", "n", "huge")


def lines_of(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """rects (workbook_id, to_sheet, r1, c1, r2, c2 and others), one row for each column (col) of them that their sheet uses."""
    used = cells.groupBy("workbook_id", F.col("sheet").alias("to_sheet")).agg(F.max("col").alias("_last"))
    rects = rects.join(used, ["workbook_id", "to_sheet"]).where("c1 <= least(c2, _last) AND r1 <= r2")
    return rects.withColumn("col", F.explode(F.sequence("c1", F.least("c2", "_last")))).drop("_last")


def range_sums(rects: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """key, total and n: sum and count of the numbers (row, col, value) in each rectangle, which `key` names."""
    ends = F.explode(F.array(F.struct(F.col("r2").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("r1") - 1).alias("at"), F.lit(-1).alias("sign"))))
    corners = ["workbook_id", "to_sheet", "r1", "c1", "r2", "c2"]
    named = rects.select(*corners, F.struct(*key).alias("key"))  # key may have a col of its own
    marks = lines_of(named, cells).select("workbook_id", F.col("to_sheet").alias("sheet"), "col", ends.alias("end"), "key", F.struct(*corners).alias("rect"))
    marks = marks.select("workbook_id", "sheet", "col", "end.at", "end.sign", "key", "rect")
    sums = sums_up_to(cells, marks, "col", "row").groupBy("key", "rect").agg(*(F.sum(F.col("sign") * F.coalesce(c, F.lit(0))).alias(c) for c in ("total", "n", "huge"))).where("n > 0")
    exact = sums.where("huge = 0").select("key.*", F.col("total").cast("double").alias("total"), "n")
    large = covered(sums.where("huge > 0").select("key", "rect.*"), cells).groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return exact.union(large.select("key.*", "total", "n"))


def covered_cells(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (workbook_id, sheet, row, col) that lie in some rectangle, with `ranges`, how many they lie in."""
    ends = F.explode(F.array(F.struct(F.col("r1").alias("at"), F.lit(1).alias("step")), F.struct((F.col("r2") + 1).alias("at"), F.lit(-1).alias("step"))))
    steps = lines_of(rects, cells).select("workbook_id", F.col("to_sheet").alias("sheet"), "col", ends.alias("end"))
    steps = steps.groupBy("workbook_id", "sheet", "col", F.col("end.at").alias("at")).agg(F.sum("end.step").alias("step")).withColumn("cell", F.lit(False))
    places = cells.select("workbook_id", "sheet", "col", F.col("row").alias("at"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("cell"))
    rows = steps.union(places).withColumn("ranges", F.sum("step").over(_along("col")))
    return rows.where("cell AND ranges > 0").select("workbook_id", "sheet", F.col("at").alias("row"), "col", "ranges")


def aggregate_ranges(model: Model) -> DataFrame:
    """Aggregate calls over one range of their own sheet: the cell, fn and the range's corners."""
    one = model.calls.where(F.col("fn").isin(*AGGREGATES) & (F.size("args") == 1))
    pattern = r"^\$?([A-Z]+)\$?(\d+)\s*:\s*\$?([A-Z]+)\$?(\d+)$"
    from tallygrid.functions.addresses import col_to_num

    at = F.element_at("args", 1)
    part = lambda k: F.regexp_extract(at, pattern, k)
    one = one.where(at.rlike(pattern))
    return one.select("workbook_id", "sheet_idx", "sheet", "row", "col", "addr", "formula", "fn", "pos", "end_at", part(2).try_cast("int").alias("r1"), col_to_num(part(1)).alias("c1"), part(4).try_cast("int").alias("r2"), col_to_num(part(3)).alias("c2"), F.col("sheet").alias("to_sheet"))


def off_by_one(model: Model) -> DataFrame:
    """Ranges that end before what at least 60 % of their peers (three or more: same column or row, function and start)
    do; ranges over their own column or row are left out."""
    r = aggregate_ranges(model)
    across = r.where("r1 = r2 AND c2 <> col").select("*", F.lit("across").alias("way"), F.col("col").alias("line"), F.col("c1").alias("start"), F.col("c2").alias("stop"))
    down = r.where("r1 <> r2 AND c1 = c2 AND r2 <> row").select("*", F.lit("down").alias("way"), F.col("row").alias("line"), F.col("r1").alias("start"), F.col("r2").alias("stop"))
    rows = across.union(down)
    group = ["workbook_id", "sheet", "way", "line", "fn", "start"]
    n = rows.groupBy(*group, "stop").agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("peers"), F.max("n").alias("most"), F.max_by("stop", "n").alias("usual"))
    rows = rows.join(n.where("peers >= 3 AND most >= 0.6 * peers"), group).where("stop < usual")
    return finding(rows, "T0-OFFBYONE-001", F.format_string("ends at %d, peers at %d", "stop", "usual"))


def aggregate_mismatches(model: Model, most_cells: int = 500, tolerance: float = 1.0) -> DataFrame:
    """Formulas that are one SUM (of up to most_cells) whose cached value is off by more than tolerance."""
    whole = aggregate_ranges(model).where("fn = 'SUM' AND pos = 0 AND end_at = length(formula)").where((F.col("c2") - F.col("c1") + 1) * (F.col("r2") - F.col("r1") + 1) <= most_cells)
    place = ["workbook_id", "sheet", "row", "col"]
    sums = range_sums(whole, numbers(model), place).withColumnRenamed("total", "resum")
    cached = model.cells.where("kind = 'number' AND num IS NOT NULL").select(*place, "addr", F.col("num").alias("cached"))
    return cached.join(sums, place).where(F.abs(F.col("cached") - F.col("resum")) > tolerance).select(*place, "addr", "cached", "resum")


def subtotals_in_range(model: Model) -> DataFrame:
    """Vertical SUMs over at least three rows with a total row inside: the first such row."""
    rows = aggregate_ranges(model).where("fn = 'SUM' AND c1 = c2 AND r2 - r1 >= 2")
    words = model.cells.where(label_text().isNotNull() & (F.length("txt") <= 60)).groupBy("workbook_id", "sheet", "row").agg(F.min_by("txt", "col").alias("label"))
    words = words.where(F.col("label").rlike(r"(?i)\b(total|subtotal|sum)\b")).select("workbook_id", "sheet", "row", F.lit(0).alias("col"), "label")
    inner = rows.withColumns({"c1": F.lit(0), "c2": F.lit(0), "r1": F.col("r1") + 1, "r2": F.col("r2") - 1})
    return covered(inner, words).groupBy("workbook_id", "sheet", "row", "col", "addr").agg(F.min_by(F.struct("cell_row", "label"), "cell_row").alias("first")).select("workbook_id", "sheet", "row", "col", "addr", F.col("first.cell_row").alias("subtotal_row"), F.col("first.label").alias("label"))


def header_years_in_sum(model: Model) -> DataFrame:
    """SUMs down one column whose top cell is a typed year from 1990 to 2100, followed by one up to 5 years later."""
    rows = aggregate_ranges(model).where("fn = 'SUM' AND c1 = c2 AND r1 < r2")
    typed = numbers(model).join(model.formulas.select("workbook_id", "sheet", "row", "col"), ["workbook_id", "sheet", "row", "col"], "left_anti")
    top = typed.select("workbook_id", F.col("sheet").alias("to_sheet"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("year"))
    below = top.withColumn("r1", F.col("r1") - 1).withColumnRenamed("year", "next_year")
    rows = rows.join(top, ["workbook_id", "to_sheet", "r1", "c1"]).where("year = floor(year) AND year BETWEEN 1990 AND 2100").join(below, ["workbook_id", "to_sheet", "r1", "c1"], "left")
    return rows.select("workbook_id", "sheet", "row", "col", "addr", "year", F.coalesce((F.col("next_year") > F.col("year")) & (F.col("next_year") <= F.col("year") + 5), F.lit(False)).alias("corroborated"))


def total_ranges(model: Model) -> DataFrame:
    """SUMs that leave out the start or end of the unbroken block of typed numbers directly above them."""
    sums = aggregate_ranges(model).where("fn = 'SUM' AND c1 = c2 AND c1 = col AND r2 < row")
    typed = numbers(model).join(model.formulas.select("workbook_id", "sheet", "row", "col"), ["workbook_id", "sheet", "row", "col"], "left_anti")
    blocks = islands(typed, ["workbook_id", "sheet", "col"], "row").groupBy("workbook_id", "sheet", "col", "island").agg(F.max("row").alias("block_end"))
    rows = sums.join(blocks, ["workbook_id", "sheet", "col"]).where("block_end = row - 1")
    what = F.when(F.col("r1") > F.col("island"), "start").when(F.col("r2") < F.col("block_end"), "end")
    return rows.withColumn("missing", what).where("missing IS NOT NULL").select("workbook_id", "sheet", "row", "col", "addr", "r1", "r2", F.col("island").alias("block_start"), "block_end", "missing")


def cross_casts(model: Model, span: int = 100, tolerance: float = 0.5) -> DataFrame:
    """Tables whose total row and total column don't agree. The sums of rows and columns are made once for each total."""
    lab = model.cells.where(label_text().rlike(r"(?i)\btotal\b"))
    rows = lab.where("col <= 3").select("workbook_id", "sheet", F.col("row").alias("total_row")).distinct()
    cols = lab.where("row <= 5 AND col > 3").select("workbook_id", "sheet", F.col("col").alias("total_col"), F.col("row").alias("head")).distinct()
    pairs = rows.join(cols, ["workbook_id", "sheet"]).where(f"total_row > head AND total_row - head <= {span}")
    pairs = pairs.select("workbook_id", "sheet", "total_row", "total_col", "head")
    cells, key = numbers(model), F.struct("total_row", "total_col", "head").alias("key")
    rows = sums_up_to(cells, pairs.select("workbook_id", "sheet", F.col("total_row").alias("row"), (F.col("total_col") - 1).alias("at"), key), "row", "col")
    ends = F.explode(F.array(F.struct((F.col("total_row") - 1).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("head").alias("at"), F.lit(-1).alias("sign"))))
    down = sums_up_to(cells, pairs.select("workbook_id", "sheet", F.col("total_col").alias("col"), ends.alias("end"), key).select("workbook_id", "sheet", "col", "end.*", "key"), "col", "row")
    in_row = rows.select("workbook_id", "sheet", "key", F.col("total").cast("double").alias("across"), F.col("n").alias("n_across"))
    in_col = down.groupBy("workbook_id", "sheet", "key").agg(F.sum(F.col("sign") * F.col("total")).cast("double").alias("down"), F.sum(F.col("sign") * F.col("n")).alias("n_down"))
    both = in_row.join(in_col, ["workbook_id", "sheet", "key"]).select("workbook_id", "sheet", "key.*", "across", "n_across", "down", "n_down")
    return both.where((F.col("n_across") >= 2) & (F.col("n_down") >= 2) & (F.abs(F.col("across") - F.col("down")) > tolerance))


def duplicate_calculations(model: Model) -> DataFrame:
    """Aggregates of the same ranges on two or more sheets; own-sheet references are resolved."""
    firsts = model.calls.where(F.col("fn").isin(*AGGREGATES, "SUMIF", "SUMIFS", "AVERAGEIF", "AVERAGEIFS", "COUNTIF", "COUNTIFS", "SUBTOTAL")).groupBy("workbook_id", "sheet", "row", "col").agg(F.min(F.struct("pos", "end_at", "fn")).alias("c"))
    inside = model.refs.join(firsts, ["workbook_id", "sheet", "row", "col"]).where(F.col("pos").between(F.col("c.pos"), F.col("c.end_at")))
    token = F.concat_ws("!", "to_sheet", F.concat_ws(":", F.concat(num_to_col(F.col("c1")), F.col("r1")), F.concat(num_to_col(F.col("c2")), F.col("r2"))))
    keys = inside.groupBy("workbook_id", "sheet", "row", "col", F.col("c.fn").alias("fn")).agg(F.array_join(F.array_sort(F.collect_set(token)), ",").alias("ranges"))
    return keys.groupBy("workbook_id", "fn", "ranges").agg(F.count_distinct("sheet").alias("sheets"), F.count("*").alias("cells")).where("sheets >= 2")


def double_counted(model: Model, most_cells: int = 500) -> DataFrame:
    """Cells that two or more whole-formula SUMs labelled as revenue totals cover; one row for each set of totals."""
    labelled = with_nearby_label(model.cells).select("workbook_id", "sheet", "row", "col", "label")
    sums = aggregate_ranges(model).where("fn = 'SUM' AND pos = 0 AND end_at = length(formula)").where((F.col("c2") - F.col("c1") + 1) * (F.col("r2") - F.col("r1") + 1) <= most_cells)
    totals = sums.join(labelled, ["workbook_id", "sheet", "row", "col"]).where(F.col("label").rlike("(?i)revenue"))
    hit = covered(totals.select("workbook_id", "to_sheet", "r1", "c1", "r2", "c2", F.concat("sheet", F.lit("!"), "addr").alias("owner")), numbers(model))
    owners = hit.groupBy("workbook_id", "to_sheet", "cell_row", "cell_col").agg(F.array_sort(F.collect_set("owner")).alias("owners")).where(F.size("owners") >= 2)
    return owners.groupBy("workbook_id", F.array_join("owners", ",").alias("owners")).agg(F.count("*").alias("cells"))


def blank_references(model: Model, density: float = 0.5) -> DataFrame:
    """Single-cell references to blank cells, by target row. Formulas that allow for blanks and columns less than half
    filled are left out."""
    singles = model.refs.where(F.col("kind") == "cell").where(~F.col("formula").rlike(BLANK_AWARE))
    singles = singles.select("workbook_id", "sheet", "row", "col", "to_sheet", F.col("r1").alias("to_row"), F.col("c1").alias("to_col")).distinct()
    real = model.sheets.select("workbook_id", F.col("sheet").alias("to_sheet"))
    filled = model.cells.where("kind <> 'blank' OR formula IS NOT NULL").select("workbook_id", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    last = filled.groupBy("workbook_id", "to_sheet").agg(F.max("to_row").alias("rows"))
    dense = filled.groupBy("workbook_id", "to_sheet", "to_col").agg(F.count("*").alias("n")).join(last, ["workbook_id", "to_sheet"]).where(F.col("n") >= density * F.col("rows")).select("workbook_id", "to_sheet", "to_col")
    place = ["workbook_id", "to_sheet", "to_row", "to_col"]
    lost = singles.join(real, ["workbook_id", "to_sheet"], "left_semi").join(filled, place, "left_anti").join(dense, ["workbook_id", "to_sheet", "to_col"], "left_semi")
    groups = lost.groupBy("workbook_id", "to_sheet", "to_row").agg(F.count("*").alias("refs"))
    rank = F.row_number().over(W.partitionBy("workbook_id").orderBy(F.desc("refs"), "to_sheet", "to_row"))
    return groups.select("*", F.format_string("T0-BLANKCELLREF-%03d", rank).alias("check_id"), F.when(F.col("refs") >= 10, "medium").otherwise("low").alias("severity"))


def basis_mismatches(model: Model) -> DataFrame:
    """Comparisons of two rounded cells of which one is a bare link and the other computed."""
    pattern = r"(?i)ROUND\(\s*([^,()]+)\s*,\s*\d+\s*\)\s*=\s*ROUND\(\s*([^,()]+)\s*,\s*\d+\s*\)"
    side = lambda k: F.regexp_replace(F.btrim(F.regexp_extract("formula", pattern, k)), r"\$", "")
    rows = model.formulas.where(F.col("formula").rlike(pattern)).select("workbook_id", "sheet", "row", "col", "addr", side(1).alias("a"), side(2).alias("b"))
    f = model.formulas.select("workbook_id", "sheet", F.col("addr").alias("a"), F.col("formula").alias("fa"))
    rows = rows.join(f, ["workbook_id", "sheet", "a"]).join(f.withColumnsRenamed({"a": "b", "fa": "fb"}), ["workbook_id", "sheet", "b"])
    link = lambda c: F.col(c).rlike(r"^[+\-]?\$?(?:'[^']+'!|[A-Za-z0-9_]+!)?\$?[A-Z]{1,3}\$?\d+$")
    made = lambda c: F.col(c).rlike(r"(?i)/|AVERAGE\s*\(")
    return finding(rows.where((link("fa") & made("fb")) | (link("fb") & made("fa"))), "T0-BASISMISMATCH", F.concat_ws(" vs ", "a", "b"))


def irr_ranges(model: Model, most_cells: int = 2000) -> DataFrame:
    """The first argument of each formula's first IRR, if it is a range of its own sheet of up to most_cells."""
    pattern = r"(?i)^\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?$"
    from tallygrid.functions.addresses import col_to_num

    firsts = model.calls.where("fn = 'IRR'").groupBy("workbook_id", "sheet", "row", "col", "addr").agg(F.min_by("args", "pos").alias("args"))
    at = F.try_element_at("args", F.lit(1))
    part = lambda k: F.regexp_extract(at, pattern, k)
    r2, c2 = F.when(part(4) != "", part(4)).otherwise(part(2)).try_cast("int"), F.when(part(3) != "", part(3)).otherwise(part(1))
    rows = firsts.where(at.rlike(pattern)).select("workbook_id", "sheet", "row", "col", "addr", F.col("sheet").alias("to_sheet"), part(2).try_cast("int").alias("ra"), r2.alias("rb"), col_to_num(part(1)).alias("ca"), col_to_num(c2).alias("cb"))
    rows = rows.select("*", F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2"), F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).drop("ra", "rb", "ca", "cb")
    return rows.where((F.col("c2") - F.col("c1") + 1) * (F.col("r2") - F.col("r1") + 1) <= most_cells)


def irr_without_negative(model: Model) -> DataFrame:
    place = ["workbook_id", "sheet", "row", "col", "addr"]
    return finding(covered(irr_ranges(model), numbers(model)).groupBy(*place).agg(F.min("value").alias("least")).where("least >= 0"), "T0-IRRSIGN-001")


def irr_many_signs(model: Model) -> DataFrame:
    from tallygrid.operators.series import sign_changes

    place = ["workbook_id", "sheet", "row", "col", "addr"]
    rows = sign_changes(covered(irr_ranges(model), numbers(model)), place, ["cell_row", "cell_col"], "value")
    return finding(rows.where("values >= 3 AND sign_changes >= 2"), "T0-IRRMULTISIGN-001", F.col("sign_changes"))


def redundant_inputs(model: Model) -> DataFrame:
    """Typed numbers on input sheets that nothing refers to, without the members of 0/1-based index runs.

    References from other sheets count only with a sheet name; own ones count on input sheets.
    """
    titled = model.texts.where("row <= 8").where(F.col("txt").rlike(INPUT_SHEET)).where(~F.col("sheet").rlike("(?i)dashboard")).select("workbook_id", "sheet")
    named = model.sheets.where(F.col("sheet").rlike(INPUT_SHEET)).select("workbook_id", "sheet")
    sheets = named.union(titled).distinct()
    heads = model.texts.where("row <= 10").groupBy("workbook_id", "sheet").agg(F.bool_or(F.col("txt").rlike(r"(?i)\bsource\s*(sheet|cell|range)\b")).alias("s"), F.bool_or(F.col("txt").rlike(r"(?i)\btarget\s*(sheet|cell|range)\b")).alias("t"))
    sheets = sheets.join(heads.where("s AND t"), ["workbook_id", "sheet"], "left_anti")
    inputs = model.cells.where("formula IS NULL AND kind = 'number'").join(sheets, ["workbook_id", "sheet"], "left_semi")
    inputs = with_nearby_label(model.cells).select("workbook_id", "sheet", "row", "col", "label").join(inputs.select("workbook_id", "sheet", "row", "col", "addr", "num"), ["workbook_id", "sheet", "row", "col"])
    runs = islands(inputs.withColumn("step", F.col("num") - F.col("row")), ["workbook_id", "sheet", "col", "step"], "row")
    size = runs.groupBy("workbook_id", "sheet", "col", "step", "island").agg(F.count("*").alias("n"), F.min("num").alias("first"))
    inputs = runs.join(size, ["workbook_id", "sheet", "col", "step", "island"]).where("NOT (n >= 3 AND first IN (0, 1))")
    own = model.refs.where("tgt_sheet IS NULL").join(sheets, ["workbook_id", "sheet"], "left_semi")
    rects = model.refs.where("tgt_sheet IS NOT NULL").unionByName(own).select("workbook_id", "to_sheet", "r1", "c1", "r2", "c2").distinct()
    hit = covered_cells(rects, inputs.select("workbook_id", "sheet", "row", "col"))
    return inputs.join(hit.drop("ranges"), ["workbook_id", "sheet", "row", "col"], "left_anti").select("workbook_id", "sheet", "row", "col", "addr", "num", "label")


def named_range_issues(model: Model) -> DataFrame:
    """Names that lead nowhere (broken), else that no formula uses (unused) or that say nothing (poor)."""
    names = model.names.where(~F.col("name").rlike(r"(?i)^_xlnm\."))
    to = F.regexp_extract(F.col("range"), r"^'?([^'!]+)'?!", 1)
    parts = names.select("workbook_id", "name", F.explode_outer("ranges").alias("range")).withColumn("to_sheet", to)
    real = model.sheets.select("workbook_id", F.col("sheet").alias("to_sheet"), F.lit(True).alias("real"))
    ok = parts.join(real, ["workbook_id", "to_sheet"], "left").groupBy("workbook_id", "name").agg(F.bool_and(F.coalesce("real", F.lit(False)) & ~F.col("range").contains("#REF!")).alias("ok"))
    words = model.formulas.select("workbook_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("formula"), F.lit(r"(?<![a-z0-9_.])([a-z_][a-z0-9_.]*)(?![a-z0-9_(])")))).alias("low")).distinct()
    used = names.withColumn("low", F.lower("name")).join(words, ["workbook_id", "low"], "left_semi").select("workbook_id", "name", F.lit(True).alias("used"))
    rows = ok.join(used, ["workbook_id", "name"], "left")
    poor = F.col("name").rlike(r"(?i)^(range|var|data|temp|tmp|x|y|z|val|value|name|item|list|table)\d*$")
    unused = F.col("used").isNull()
    issue = F.when(~F.coalesce("ok", F.lit(False)), "Broken").when(unused & poor, "Unused + Poorly Named").when(unused, "Unused").when(poor, "Poorly Named")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("workbook_id", "name", "issue")


def error_scan_coverage(model: Model) -> DataFrame:
    """Formulas that scan three or more sheets for errors but stop short of what those sheets use, or miss sheets with
    formulas."""
    scans = model.refs.where(F.col("formula").rlike(r"(?i)ISERROR") & (F.col("kind") == "range") & F.col("tgt_sheet").isNotNull())
    reach = scans.groupBy("workbook_id", "sheet", "row", "col", "to_sheet").agg(F.max("r2").alias("to_row"), F.max("c2").alias("to_col"))
    wide = reach.groupBy("workbook_id", "sheet", "row", "col").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    used = model.formulas.groupBy("workbook_id", F.col("sheet").alias("to_sheet")).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    every = wide.join(used, "workbook_id").where("to_sheet <> sheet")
    rows = every.join(reach, ["workbook_id", "sheet", "row", "col", "to_sheet"], "left")
    gap = F.when(F.col("to_row").isNull(), "not scanned").when((F.col("to_row") < F.col("last_row")) | (F.col("to_col") < F.col("last_col")), "scanned in part")
    return rows.withColumn("gap", gap).where("gap IS NOT NULL").select("workbook_id", "sheet", "row", "col", "to_sheet", "gap")


def gate_coverage(model: Model) -> DataFrame:
    """Release gates that count EXCEPTION or FAIL over part of a column of states: how many states lie outside."""
    pattern = r'(?i)COUNTIF\(\s*(?:\'?[^\'!]+\'?!)?\$?([A-Z]+)\$?(\d+):\$?[A-Z]+\$?(\d+)\s*,\s*"(?:EXCEPTION|FAIL)'
    from tallygrid.functions.addresses import col_to_num

    gates = model.formulas.where(F.col("formula").rlike(pattern)).select("workbook_id", "sheet", "row", "col", col_to_num(F.regexp_extract("formula", pattern, 1)).alias("c"), F.regexp_extract("formula", pattern, 2).try_cast("int").alias("lo"), F.regexp_extract("formula", pattern, 3).try_cast("int").alias("hi"))
    states = model.cells.where("upper(trim(txt)) IN ('PASS', 'FAIL', 'EXCEPTION', 'OK')").select("workbook_id", "sheet", F.col("row").alias("state_row"), F.col("col").alias("c"))
    out = gates.join(states, ["workbook_id", "sheet", "c"]).where("state_row < lo OR state_row > hi")
    return out.groupBy("workbook_id", "sheet", "row", "col").agg(F.count("*").alias("outside"))
