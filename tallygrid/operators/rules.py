"""Declarative rules over sheets and cells: pass, fail or uncertain for each rule, never two of them in one.

A rule is a row of rule_id, type and params (a map of text to text; lists are comma-joined). Handlers take the model and
the rules of their type and give rule_id, id, status and reason. Unknown types give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.model import Model
from tallygrid.operators.labels import label_text

PASS, FAIL, UNCERTAIN = "pass", "fail", "uncertain"


def plain(name: Column) -> Column:
    """A sheet name in lower case without spaces and -_. marks."""
    return F.regexp_replace(F.lower(name), r"[\s\-_.]+", "")


def runs_of_words(words: Column) -> Column:
    """All runs of an array of words, each joined by a space."""
    n = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda m: F.array_join(F.slice(words, k, m), " "))))


def _name_keys(name: Column, whole: str, part: str) -> Column:
    """What a name is found by at each level: as it is, in lower case, without marks, and by its words: all of them as
    `whole`, each run of them as `part`. Names of sheets are short, so runs are few."""
    words = F.btrim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))
    key = lambda level, kind, value: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), value.alias("value"))
    plainly = F.array(key(0, "", name), key(1, "", F.lower(name)), key(2, "", plain(name)), key(3, whole, words))
    return F.array_distinct(F.concat(plainly, F.transform(runs_of_words(F.split(words, " ")), lambda run: key(3, part, run))))


def resolved(rules: DataFrame, sheets: DataFrame, list_param: str = "sheets") -> DataFrame:
    """For each rule, workbook and alias the best sheet: exact, then case-insensitive, then without marks, then by whole
    words either way; the first alias that resolves, and the first sheet in tab order, win."""
    aliases = rules.select("rule_id", F.posexplode(F.split(F.element_at("params", list_param), r"\s*,\s*")).alias("alias_idx", "alias"))
    named = sheets.select("workbook_id", "sheet_idx", "sheet", F.explode(_name_keys(F.col("sheet"), "whole", "part")).alias("at"))
    asked = aliases.select("rule_id", "alias_idx", F.explode(_name_keys(F.col("alias"), "part", "whole")).alias("at"))
    hits = named.join(asked, "at").withColumn("level", F.col("at.level"))
    return hits.groupBy("rule_id", "workbook_id").agg(F.min_by("sheet", F.struct("alias_idx", "level", "sheet_idx")).alias("sheet"))


def _each(model: Model, rules: DataFrame) -> DataFrame:
    """Every rule for every workbook."""
    books = model.sheets.select("workbook_id").distinct()
    return books.join(F.broadcast(rules.select("rule_id", "params")))


def _out(rows: DataFrame, status: Column, reason: Column | None = None) -> DataFrame:
    return rows.select("workbook_id", "rule_id", F.col("rule_id").alias("id"), status.alias("status"), (reason if reason is not None else F.lit(None)).cast("string").alias("reason"))


def sheet_exists(model: Model, rules: DataFrame) -> DataFrame:
    """Passes if any alias resolves."""
    rows = _each(model, rules).join(resolved(rules, model.sheets), ["rule_id", "workbook_id"], "left")
    return _out(rows, F.when(F.col("sheet").isNotNull(), PASS).otherwise(FAIL))


def sheets_by_keyword(model: Model, rules: DataFrame) -> DataFrame:
    """Passes if at least `min` (2) sheets match a keyword; the rule for actuals also if a row holds the flags itself."""
    words = rules.select("rule_id", F.explode(F.split(F.element_at("params", "sheets"), r"\s*,\s*")).alias("keyword"))
    low = F.lower("keyword")
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower("sheet"), r"[^a-z0-9]+", " ")), F.lit(" "))
    match = F.when(F.length("keyword") <= 6, F.contains(spaced, F.concat(F.lit(" "), low, F.lit(" ")))).otherwise(F.contains(F.lower("sheet"), low) | F.contains(low, F.lower("sheet")))
    hits = model.sheets.select("workbook_id", "sheet").join(F.broadcast(words), match).groupBy("rule_id", "workbook_id").agg(F.count_distinct("sheet").alias("n"))
    rows = _each(model, rules).join(hits, ["rule_id", "workbook_id"], "left").join(embedded_flags(model), "workbook_id", "left")
    least = F.coalesce(F.try_element_at("params", F.lit("min")).try_cast("int"), F.lit(2))
    ok = (F.coalesce("n", F.lit(0)) >= least) | (F.coalesce(F.try_element_at("params", F.lit("embedded")), F.lit("")).eqNullSafe("true") & F.coalesce("embedded", F.lit(False)))
    return _out(rows, F.when(ok, PASS).otherwise(FAIL))


def embedded_flags(model: Model) -> DataFrame:
    """Workbooks with a row among the first 30 that has a label for actuals and forecasts and two flag cells."""
    rows = model.texts.where("row <= 30").groupBy("workbook_id", "sheet", "row").agg(
        F.bool_or(F.col("txt").rlike(r"(?i)actuals?\s*[/&,-]*\s*(?:and|or|vs\.?)?\s*forecasts?")).alias("label"),
        F.count_if(F.lower(F.btrim("txt")).isin("actual", "actuals", "forecast", "forecasts")).alias("flags"),
    )
    return rows.where("label AND flags >= 2").select("workbook_id", F.lit(True).alias("embedded")).distinct()


def sheet_empty(model: Model, rules: DataFrame) -> DataFrame:
    """Fails if the sheet is absent or has no row under its header."""
    filled = model.cells.where("row > 1").select("workbook_id", "sheet").distinct().withColumn("filled", F.lit(True))
    rows = _each(model, rules).join(resolved(rules, model.sheets), ["rule_id", "workbook_id"], "left").join(filled, ["workbook_id", "sheet"], "left")
    return _out(rows, F.when(F.col("filled"), PASS).otherwise(FAIL))


def _by_sheet(model: Model, rules: DataFrame, bad: DataFrame) -> DataFrame:
    """One failure for each sheet with bad cells (id: rule and sheet, first five cells listed); a pass without any."""
    sheets = bad.groupBy("workbook_id", "sheet").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row", "col", "addr"))), 1, 5), lambda x: x["addr"]), ", ").alias("cells"))
    rows = _each(model, rules).join(sheets, "workbook_id", "left")
    failed = F.col("sheet").isNotNull()
    return rows.select("workbook_id", "rule_id", F.when(failed, F.concat_ws("-", "rule_id", "sheet")).otherwise(F.col("rule_id")).alias("id"), F.when(failed, FAIL).otherwise(PASS).alias("status"), F.col("cells").alias("reason"))


def no_formula_errors(model: Model, rules: DataFrame) -> DataFrame:
    return _by_sheet(model, rules, model.cells.where("err IS NOT NULL"))


def no_external_links(model: Model, rules: DataFrame) -> DataFrame:
    return _by_sheet(model, rules, model.formulas.where(F.col("formula").contains("[")))


def array_formulas(model: Model, rules: DataFrame) -> DataFrame:
    return _by_sheet(model, rules, model.formulas.where("formula_kind = 'array'"))


def white_text(model: Model, rules: DataFrame) -> DataFrame:
    """Cells that show nothing: an all-empty number format, or a font in the colour of the fill."""
    seen = F.col("num_fmt").rlike(r"^;;;") | (F.col("font_argb") == F.col("fill_argb")) | (F.col("font_argb").rlike("(?i)^FFFFFFFF$") & F.col("fill_argb").isNull())
    return _by_sheet(model, rules, model.cells.where(seen))


def hidden_contents(model: Model, rules: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    cells = model.cells.join(model.sheets.select("workbook_id", "sheet", "hidden_rows", "hidden_cols"), ["workbook_id", "sheet"])
    return _by_sheet(model, rules, cells.where(F.array_contains(F.coalesce("hidden_rows", none), F.col("row")) | F.array_contains(F.coalesce("hidden_cols", none), F.col("col"))))


def worksheet_names(model: Model, rules: DataFrame) -> DataFrame:
    """Fails for each sheet whose name matches a pattern of the rule (patterns parted by ` | `)."""
    rows = _each(model, rules).join(model.sheets.select("workbook_id", "sheet"), "workbook_id")
    bad = F.expr("sheet RLIKE concat('(?i)', replace(element_at(params, 'patterns'), ' | ', '|'))")
    hits = rows.where(bad).groupBy("workbook_id", "rule_id").agg(F.array_join(F.array_sort(F.collect_set("sheet")), ", ").alias("names"))
    rows = _each(model, rules).join(hits, ["workbook_id", "rule_id"], "left")
    return _out(rows, F.when(F.col("names").isNotNull(), FAIL).otherwise(PASS), F.col("names"))


def no_negative_values(model: Model, rules: DataFrame) -> DataFrame:
    """The first negative number on rows whose first label contains the keyword, on the first sheet that resolves;
    uncertain without such a sheet or row."""
    at = resolved(rules, model.sheets).join(rules.select("rule_id", F.lower(F.element_at("params", "keyword")).alias("keyword")), "rule_id")
    label = model.cells.where(label_text().isNotNull() & (F.col("col") == 1)).select("workbook_id", "sheet", "row", F.lower("txt").alias("label"))
    lines = at.join(label, ["workbook_id", "sheet"]).where(F.contains("label", "keyword"))
    numbers = model.cells.where("kind = 'number'").select("workbook_id", "sheet", "row", "col", "addr", "num")
    found = lines.join(numbers, ["workbook_id", "sheet", "row"], "left").groupBy("rule_id", "workbook_id").agg(F.min_by(F.when(F.col("num") < 0, F.col("addr")), F.when(F.col("num") < 0, F.struct("row", "col"))).alias("first"), F.lit(True).alias("seen"))
    rows = _each(model, rules).join(found, ["rule_id", "workbook_id"], "left")
    return _out(rows, F.when(F.col("seen").isNull(), UNCERTAIN).when(F.col("first").isNotNull(), FAIL).otherwise(PASS), F.col("first"))


def data_validation(model: Model, rules: DataFrame) -> DataFrame:
    """Fails if there is an input or assumption sheet and no cell with data validation at all."""
    inputs = model.sheets.where(F.col("sheet").rlike("(?i)input|assumption")).select("workbook_id", F.lit(True).alias("inputs")).distinct()
    n = model.cells.groupBy("workbook_id").agg(F.count_if(F.coalesce("has_dv", F.lit(False))).alias("n"))
    rows = _each(model, rules).join(inputs, "workbook_id", "left").join(n, "workbook_id", "left")
    return _out(rows, F.when(F.coalesce("inputs", F.lit(False)) & (F.coalesce("n", F.lit(0)) == 0), FAIL).otherwise(PASS))


def flags_separate(model: Model, rules: DataFrame) -> DataFrame:
    """Passes if a flag sheet mentions actuals, forecasts or flags in its first 30 rows; uncertain if it doesn't. Without
    such a sheet, a row of flags decides."""
    sheets = resolved(rules, model.sheets)
    said = model.texts.where("row <= 31").where(F.col("txt").rlike("(?i)actual|forecast|flag")).select("workbook_id", "sheet", F.lit(True).alias("said")).distinct()
    rows = _each(model, rules).join(sheets, ["rule_id", "workbook_id"], "left").join(said, ["workbook_id", "sheet"], "left").join(embedded_flags(model), "workbook_id", "left")
    return _out(rows, F.when(F.col("sheet").isNotNull(), F.when(F.col("said"), PASS).otherwise(UNCERTAIN)).when(F.col("embedded"), PASS).otherwise(FAIL))


def always(status: str):
    return lambda model, rules: _out(_each(model, rules), F.lit(status))


HANDLERS = {
    "sheet_exists": sheet_exists, "sheet_exists_flexible": sheets_by_keyword, "sheet_empty": sheet_empty, "no_formula_errors": no_formula_errors, "no_negative_values": no_negative_values,
    "no_external_links": no_external_links, "workbook_opens_clean": always(PASS), "no_circular_references": always(UNCERTAIN), "actuals_forecast_flags_exclusive": always(UNCERTAIN),
    "actuals_forecast_separated": flags_separate, "hidden_rows_columns_present": hidden_contents, "white_text_hidden_content": white_text, "worksheet_naming_check": worksheet_names,
    "array_formula_check": array_formulas, "data_validation_check": data_validation,
}


#: Rules are broadcast; more of them are refused.
MOST_RULES = 10_000


def apply_rules(model: Model, rules: DataFrame) -> DataFrame:
    """All rules of known types; at most MOST_RULES of them."""
    n = rules.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return reduce(DataFrame.union, [handler(model, rules.where(F.col("type") == kind)) for kind, handler in HANDLERS.items()])


def pass_rate(results: DataFrame) -> DataFrame:
    """Whole percent of rules that pass in each workbook."""
    return results.groupBy("workbook_id").agg(F.round(100.0 * F.avg((F.col("status") == PASS).cast("int"))).cast("int").alias("pass_rate"))


def gate(model: Model) -> DataFrame:
    """Whether a workbook can be audited: it has a sheet with a filled cell and speaks of finance; with warnings."""
    finance = r"(?i)revenue|cash|debt|equity|income|expense|balance|tax|asset|liabilit"
    known = r"(?i)input|assumption|debt|tax|cash|balance|income|equity|dashboard|summary"
    cells = model.cells.groupBy("workbook_id").agg(F.count("*").alias("cells"), F.bool_or(F.coalesce(F.col("txt").rlike(finance), F.lit(False))).alias("finance"))
    sheets = model.sheets.groupBy("workbook_id").agg(F.count("*").alias("sheets"), F.count_if(F.col("sheet").rlike(known)).alias("known"))
    rows = sheets.join(cells, "workbook_id", "left")
    ok = (F.col("sheets") > 0) & (F.coalesce("cells", F.lit(0)) > 0) & F.coalesce("finance", F.lit(False))
    return rows.select("workbook_id", ok.alias("passed"), (F.col("known") < 2).alias("few_known_sheets"), (F.col("sheets") == 1).alias("single_sheet"))
