"""Checks that look at one cell: all in a single pass over the cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.functions import scoring, text
from tallygrid.model import Model
from tallygrid.operators.finding import EMITS, URGENCY, finding

#: What the checks look for.
ANY_REF = r"(?:(?:'[^']+'|[A-Za-z_][\w ]*)!)?\$?[A-Z]{1,3}\$?\d+"
WHOLE_REF = r"\$?(?:[A-Z]{1,3}|\d+)\s*:\s*\$?(?:[A-Z]{1,3}|\d+)"
TEXT_BOOLEAN = r'(?i)\bIF\s*\([^"]*,\s*"(?:true|false)"\s*,\s*"(?:true|false)"\s*\)'
TWO_DIGIT_YEAR = r"(?i)VALUE\s*\(\s*RIGHT\s*\([^()]*,\s*2\s*\)\s*\)"
BARE_NPV = r"(?i)(?<![A-Za-z])NPV\s*\("
QUOTED_UNIT = r',+[^"]*"[^"]+"'
BLUE = r"(?i)^(FF0000FF|FF0070C0|FF1F4E78)$"
ZERO_TRUE = r"(?i)IF\s*\(\s*[^,()]*(?:\([^()]*\))?[^,()]*=\s*0\s*,\s*TRUE\s*,"
OR_ZERO_TRUE = r"(?i)OR\s*\(\s*[A-Za-z][\w.]*\$?\d+\s*=\s*0\s*,\s*[A-Za-z][\w.]*\$?\d+\s*>="
COUNTA_TARGET = r"(?i)((?:COUNTA\([^)]+\)\s*\+\s*)*COUNTA\([^)]+\))\s*=\s*(\d+)"


def is_complex(f: Column) -> Column:
    return F.regexp_count(f, F.lit(r"\(")) >= 3


def is_constant(f: Column) -> Column:
    """No reference, but a number and an operation, outside string literals."""
    bare = text.blank_strings(f)
    return ~bare.rlike(ANY_REF) & ~bare.rlike(WHOLE_REF) & bare.rlike(r"\b\d+(?:\.\d+)?\b") & bare.rlike(r"[+\-*/^&]|[A-Za-z_][\w.]*\s*\(")


def unguarded_two_digit_year(f: Column) -> Column:
    at = F.regexp_instr(f, F.lit(TWO_DIGIT_YEAR))
    found = F.regexp_extract(f, TWO_DIGIT_YEAR, 0)
    around = F.substring(f, F.greatest(at - 10, F.lit(1)), F.length(found) + 20)
    return f.rlike(TWO_DIGIT_YEAR) & ~around.rlike(r"(?:19|20)\d{2}\s*\+|\+\s*(?:19|20)\d{2}")


def cell_predicates() -> dict[str, Column]:
    """check -> condition on a cell."""
    f, n = F.col("formula"), F.col("num")
    plain = f.isNull()
    return {
        "T0-COMPLEXFML-001": is_complex(f),
        "T0-CONSTFORMULA-001": is_constant(f),
        "T0-TEXTBOOLFLAG-001": f.rlike(TEXT_BOOLEAN),
        "T0-2DIGITYEAR-001": unguarded_two_digit_year(f),
        "T0-OVERFLOW-001": f.isNotNull() & (F.col("kind") == "date") & (F.col("dt").isNull() | ~F.year("dt").between(1980, 2200)),
        "T0-NUMASTEXT-001": plain & (F.col("kind") == "text") & text.looks_like_number(F.col("txt")),
        "T0-DISPLAYZERO-001": text.hides_decimals_of_percent(F.col("num_fmt")) & (F.abs(n) > 0) & (F.abs(n) < 0.005),
        "T0-UNITHIDE-001": (text.scaling_commas(F.col("num_fmt")) > 0) & ~F.col("num_fmt").rlike(QUOTED_UNIT) & n.isNotNull(),
        "T0-NPV-001": f.rlike(BARE_NPV),
        "T0-INDIRECT-001": f.rlike(scoring.DYNAMIC),
    }


def single_cell_findings(cells: DataFrame) -> DataFrame:
    """Findings of all single-cell checks; each cell is read once."""
    hits = [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in cell_predicates().items()]
    rows = cells.withColumn("check_id", F.explode(F.array_compact(F.array(*hits))))
    severity, confidence, urgency = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in cell_predicates():
        s, c, u = EMITS[k]
        same = F.col("check_id") == k
        severity, confidence, urgency = F.when(same, s).otherwise(severity), F.when(same, c).otherwise(confidence), F.when(same, URGENCY[u]).otherwise(urgency)
    return rows.select("workbook_id", "check_id", "sheet", "row", "col", "addr", severity.alias("severity"), confidence.alias("confidence"), urgency.alias("urgency"), F.coalesce("formula", "txt").alias("detail"))


def mixed_references(model: Model) -> DataFrame:
    """Ranges whose corners differ in what is absolute."""
    rows = model.refs.where("kind = 'range' AND (abs_c1 <> abs_c2 OR abs_r1 <> abs_r2)")
    return finding(rows, "T0-MIXEDREF-001", F.col("raw"))


def sheet_names(model: Model) -> DataFrame:
    """Sheet names with white space at an end."""
    name = F.col("sheet")
    rows = model.sheets.where((name != F.btrim(name, F.lit(" \t\n\r "))) & (F.btrim(name, F.lit(" \t\n\r ")) != ""))
    return finding(rows, "T0-WSSHEETNAME-001", name)


def protected(model: Model) -> DataFrame:
    """Hidden formulas of protected sheets, and locks that go against use (blue inputs locked, formulas open)."""
    cells = model.cells.join(model.sheets.where("protected").select("workbook_id", "sheet"), ["workbook_id", "sheet"], "left_semi")
    hidden = finding(cells.where("formula IS NOT NULL AND formula_hidden"), "T0-HIDDENFORMULA-001", F.col("formula"))
    locked = F.coalesce("locked", F.lit(True))
    wrong = F.when(F.col("formula").isNull() & F.col("num").isNotNull() & F.col("font_argb").rlike(BLUE) & locked, "locked input").when(F.col("formula").isNotNull() & ~locked, "open formula")
    return hidden.union(finding(cells.where(wrong.isNotNull()), "T0-CELLLOCK-001", wrong))


def validation_coverage(model: Model) -> DataFrame:
    """Share of blue numeric inputs with data validation, to 3 places."""
    inputs = model.cells.where(F.col("formula").isNull() & F.col("num").isNotNull() & F.col("font_argb").rlike(BLUE))
    return inputs.groupBy("workbook_id").agg(F.count("*").alias("inputs"), F.round(F.avg(F.coalesce("has_dv", F.lit(False)).cast("int")), 3).alias("coverage"))


def merged_and_hidden(model: Model) -> DataFrame:
    """Sheets with merged cells; hidden rows and columns with formulas (-001) or other contents (-002)."""
    merged = finding(model.sheets.where(F.size(F.coalesce("merges", F.array().cast("array<string>"))) > 0), "T0-MERGE-001", F.array_join(F.slice("merges", 1, 5), ", "))
    cells = model.cells.select("workbook_id", "sheet", "row", "col", "addr", "formula").join(model.sheets.select("workbook_id", "sheet", "hidden_rows", "hidden_cols"), ["workbook_id", "sheet"])
    none = F.array().cast("array<int>")
    cells = cells.where(F.array_contains(F.coalesce("hidden_rows", none), F.col("row")) | F.array_contains(F.coalesce("hidden_cols", none), F.col("col")))
    sheets = cells.groupBy("workbook_id", "sheet").agg(F.count("formula").alias("formulas"), F.count("*").alias("cells"))
    return merged.union(finding(sheets.where("formulas > 0"), "T0-HIDDEN-001", F.col("formulas"))).union(finding(sheets.where("formulas = 0"), "T0-HIDDEN-002", F.col("cells")))


def personal_data(cells: DataFrame) -> DataFrame:
    """One row for each match: place, kind and the redacted text. Tax and branch numbers count only on rows whose label
    speaks of banking."""
    texts = cells.where("formula IS NULL AND txt IS NOT NULL")
    label = F.first(F.when(F.col("kind") == "text", F.col("txt")), ignorenulls=True).over(W.partitionBy("workbook_id", "sheet", "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    texts = texts.withColumn("banking", F.coalesce(label.rlike(text.BANKING), F.lit(False)))
    all_of = lambda pattern: F.regexp_extract_all("txt", F.lit(f"({pattern})"), F.lit(1))
    kinds = {
        "email": all_of(text.EMAIL),
        "ssn": all_of(text.SSN),
        "iban": all_of(text.IBAN),
        "card": F.filter(F.transform(all_of(text.CARD), lambda x: F.regexp_replace(x, "[ -]", "")), lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x)),
        "tax number": F.when(F.col("banking"), all_of(r"\b\d{8,9}\b")).otherwise(F.array().cast("array<string>")),
        "branch number": F.when(F.col("banking"), all_of(r"\b\d{3}-?\d{3}\b")).otherwise(F.array().cast("array<string>")),
    }

    def named(kind: str, matches: Column) -> Column:
        return F.transform(matches, lambda x: F.struct(F.lit(kind).alias("what"), text.redact(x).alias("redacted")))

    found = reduce(lambda a, b: F.concat(a, b), [named(k, v) for k, v in kinds.items()])
    return texts.withColumn("hit", F.explode(found)).select("workbook_id", "sheet", "row", "col", "hit.what", "hit.redacted")


def exception_rows(cells: DataFrame) -> DataFrame:
    """Rows that show EXCEPTION, with how many cells do and the row's first label that is no number."""
    row = W.partitionBy("workbook_id", "sheet", "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    label = F.first(F.when((F.col("kind") == "text") & F.col("formula").isNull() & F.expr("try_cast(txt AS double)").isNull(), F.col("txt")), ignorenulls=True).over(row)
    rows = cells.withColumn("label", label).where("upper(trim(txt)) = 'EXCEPTION'")
    return rows.groupBy("workbook_id", "sheet", "row").agg(F.count("*").alias("cells"), F.min("label").alias("label"))


def degenerate_covenants(cells: DataFrame) -> DataFrame:
    """Rows with formulas that pass a test whenever its basis is zero."""
    rows = cells.where(F.col("formula").rlike(ZERO_TRUE) | F.col("formula").rlike(OR_ZERO_TRUE))
    return rows.groupBy("workbook_id", "sheet", "row").agg(F.count("*").alias("cells"))


def impossible_targets(cells: DataFrame) -> DataFrame:
    """COUNTA sums compared with a number they can't reach. A formula with a range that can't be read is left out."""
    rows = cells.where(F.col("formula").rlike(COUNTA_TARGET))
    chain, target = F.regexp_extract("formula", COUNTA_TARGET, 1), F.regexp_extract("formula", COUNTA_TARGET, 2)
    terms = F.regexp_extract_all(chain, F.lit(r"(?i)COUNTA\(([^)]+)\)"), F.lit(1))

    def size(t: Column) -> Column:
        from tallygrid.functions.addresses import col_to_num

        pattern = r"^\s*(?:.*!)?\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?\s*$"
        part = lambda k: F.regexp_extract(t, pattern, k)
        number = lambda k, other: F.when(part(k) != "", part(k)).otherwise(part(other)).try_cast("int")
        letters = F.when(part(3) != "", part(3)).otherwise(part(1))
        return F.when(t.rlike(pattern), (F.abs(col_to_num(letters) - col_to_num(part(1))) + 1) * (F.abs(number(4, 2) - number(2, 2)) + 1))

    sizes = F.transform(terms, size)
    rows = rows.withColumns({"chain": chain, "target": target.try_cast("long"), "sizes": sizes}).where(~F.exists("sizes", lambda x: x.isNull()))
    rows = rows.withColumn("most", F.aggregate("sizes", F.lit(0), lambda a, x: a + x)).where("most < target")
    return rows.groupBy("workbook_id", "chain", "target", "most").agg(F.count("*").alias("cells"), F.min(F.struct("sheet_idx", "sheet", "row", "col")).alias("first"))


def formula_count_mismatches(cells: DataFrame) -> DataFrame:
    """Texts that state a number of formulas which is off by at least 0.5 % of the larger one; below half of the real
    number they speak of a part."""
    own = cells.groupBy("workbook_id").agg(F.count("formula").alias("own"))
    said = cells.where("formula IS NULL").withColumn("said", F.regexp_replace(F.regexp_extract("txt", r"(?i)([\d,]{3,10})\s*formulas?\b", 1), ",", "").try_cast("long")).where("said IS NOT NULL")
    rows = said.join(own, "workbook_id").where("said >= 0.5 * own AND abs(said - own) / greatest(said, own) * 100 >= 0.5")
    return rows.groupBy("workbook_id", "said", "own").agg(F.count("*").alias("cells"))


def missing_sheet_references(model: Model) -> DataFrame:
    """Sheets that guide sheets name in whole-cell references at least twice and that don't exist."""
    guide = r"(?i)guide|readme|read[\s-]?me|instructions|index|navigation|contents|how[\s-]?to"
    at = F.coalesce(
        F.nullif(F.regexp_extract("txt", r"^([A-Za-z][A-Za-z0-9 &\-]{1,40})!\$?[A-Z]{1,3}\$?\d{1,7}$", 1), F.lit("")),
        F.nullif(F.regexp_extract("txt", r"^'([^']{1,60})'!\$?[A-Z]{1,3}\$?\d{1,7}$", 1), F.lit("")),
    )
    said = model.texts.where(F.col("sheet").rlike(guide)).withColumn("named", at).where("named IS NOT NULL")
    real = model.sheets.select("workbook_id", F.lower("sheet").alias("low"))
    lost = said.withColumn("low", F.lower("named")).join(real, ["workbook_id", "low"], "left_anti")
    return lost.groupBy("workbook_id", "low").agg(F.min("named").alias("named"), F.count("*").alias("cells")).where("cells >= 2").drop("low")


def duplicate_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets named like a backup or copy, with the live sheet of the same base name if there is one."""
    pattern = r"(?i)[\s_]*[\(\[-]?\s*(backup|copy|duplicate|old|archive|v\d+)\s*[\)\]]?\s*$"
    base = F.regexp_replace(F.btrim(F.regexp_replace("sheet", pattern, "")), r"[\s_-]+$", "")
    named = sheets.where(F.col("sheet").rlike(pattern)).select("workbook_id", "sheet", F.lower(F.regexp_extract("sheet", pattern, 1)).alias("suffix"), base.alias("base"))
    live = sheets.select("workbook_id", F.lower("sheet").alias("low")).distinct()
    rows = named.join(live, (named["workbook_id"] == live["workbook_id"]) & (F.lower("base") == live["low"]) & (F.col("base") != ""), "left")
    return rows.select(named["workbook_id"], "sheet", "suffix", F.when(F.col("low").isNotNull(), F.col("base")).alias("live"))


def owner_decisions(cells: DataFrame) -> DataFrame:
    """The items of the first cell of a workbook that lists owner decisions."""
    pattern = r"(?i)^\s*OWNER\s+DECISIONS?\s*(?:[—–-]\s*[^:]*)?\s*:\s*(.+)$"
    firsts = cells.where(F.col("txt").rlike(pattern)).groupBy("workbook_id").agg(F.min_by("txt", F.struct("sheet_idx", "sheet", "row", "col")).alias("txt"))
    listed = F.regexp_extract(F.regexp_extract("txt", pattern, 1), r"^(.*?)(?:\.(?:\s|$)|$)", 1)
    items = F.filter(F.transform(F.split(listed, ";"), lambda x: F.btrim(x)), lambda x: x != "")
    return firsts.select("workbook_id", F.posexplode(items).alias("k", "item"))
