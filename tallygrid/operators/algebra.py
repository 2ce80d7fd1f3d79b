"""What happens to findings: type, priority, risk, roll-up, comparison with earlier runs, gates and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.operators.core import first_of
from tallygrid.operators.graph import cut

#: Hints of key outputs. Risk scores don't look for the first of the two.
KEY_OUTPUT_HINTS = (
    "terminal value", "valuation", "debt", "interest", "liquidity", "funding", "covenant", "dscr", "dsra", "ownership", "dilution", "equity", "tax", "gst", "circular", "external",
    "return", "irr", "investor", "financial statement", "balance sheet", "income statement", "cash flow statement", "revenue", "balancing", "plug",
)
CONFIRMED = ("P1", "P2", "P3", "Critical Query")
DUE_DAYS = {"P1": 7, "Critical Query": 7, "P2": 30}


def _text(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def touches_key_output(haystack: Column, hints: tuple[str, ...] = KEY_OUTPUT_HINTS) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | haystack.contains(h)
    return out


def record_type(severity: Column, confidence: Column, urgency: Column, haystack: Column, given: Column | None = None) -> Column:
    """The kind of a finding; a confidence of null counts as 100."""
    low, sure = F.lower(F.coalesce(severity, F.lit(""))), F.coalesce(confidence, F.lit(100))
    grave = low.isin("fatal", "critical")
    out = (
        F.when(F.lower(F.coalesce(urgency, F.lit(""))) == "informational", "Observation")
        .when((sure < 60) & touches_key_output(haystack), "Critical Query")
        .when(sure < 60, "Query")
        .when(grave & (sure < 80), "Critical Query")
        .when(grave | low.isin("high", "medium", "low"), "Confirmed Finding")
        .otherwise("Observation")
    )
    return out if given is None else F.coalesce(F.nullif(given, F.lit("")), out)


def priority(kind: Column, severity: Column) -> Column:
    low = F.lower(F.coalesce(severity, F.lit("")))
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit("Confirmed Finding"))
    return F.when(kind != "Confirmed Finding", kind).when(low.isin("fatal", "critical"), "P1").when(low.isin("high", "medium"), "P2").otherwise("P3")


def consequence(haystack: Column, key_output: Column) -> Column:
    named = F.lower(F.btrim(F.coalesce(key_output, F.lit(""))))
    return F.least(F.lit(5), 2 + F.when(touches_key_output(haystack, KEY_OUTPUT_HINTS[1:]), 2).otherwise(0) + F.when((named != "") & (named != "unknown"), 1).otherwise(0))


def exposure(occurrences: Column) -> Column:
    n = F.coalesce(occurrences, F.lit(1))
    return F.when(n >= 20, 5).when(n >= 8, 4).when(n >= 3, 3).when(n >= 1, 2).otherwise(1)


def propagation(sheets: Column, cells: Column) -> Column:
    return F.when(sheets >= 5, 5).when(sheets >= 3, 4).when(sheets == 2, 3).when((sheets == 1) & (cells > 1), 2).otherwise(1)


def control_weakness(confidence: Column, needs_retest: Column) -> Column:
    sure = F.coalesce(confidence, F.lit(100))
    return F.least(F.lit(5), 2 + F.when(F.coalesce(needs_retest, F.lit(False)), 1).otherwise(0) + F.when(sure < 70, 2).when(sure < 85, 1).otherwise(0))


def risk_total(consequence: Column, exposure: Column, propagation: Column, weakness: Column) -> Column:
    return 2 * consequence + exposure + propagation + weakness


def scored(findings: DataFrame) -> DataFrame:
    """Adds the risk parts and risk_weighted_total to confirmed findings; null for others. Columns that findings lack
    count as null."""
    col = lambda name, kind="string": F.col(name) if name in findings.columns else F.lit(None).cast(kind)
    haystack = _text(col("issue_type"), col("root_cause"), col("category"))
    count = lambda name: F.coalesce(col(name, "long"), F.lit(0))
    parts = {
        "risk_decision_consequence": consequence(haystack, col("key_output_impact")),
        "risk_exposure": exposure(F.coalesce(col("material_occurrence_count", "int"), col("occurrence_count", "int"))),
        "risk_propagation": propagation(count("sheet_count"), count("cell_count")),
        "risk_control_weakness": control_weakness(col("confidence", "int"), col("needs_retest", "boolean")),
    }
    confirmed = F.col("record_type") == "Confirmed Finding"
    out = findings.withColumns({k: F.when(confirmed, v) for k, v in parts.items()})
    return out.withColumn("risk_weighted_total", risk_total(*(F.col(k) for k in parts)))


#: Affected cells that a root cause shows; all of them are in affected_cells().
SHOWN = 20


def affected_cells(findings: DataFrame) -> DataFrame:
    """The cells of each check of a workbook, one row for each finding with a sheet: position and cell (`sheet!address`)."""
    cell = F.concat("sheet", F.lit("!"), F.coalesce("addr", F.concat(F.lit("Row"), F.col("row").cast("string"))))
    return findings.where("sheet IS NOT NULL").select("workbook_id", "check_id", "sheet", "row", "col", cell.alias("cell"))


def root_causes(findings: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row for each check of a workbook: occurrences, how many cells (repeats counted) and sheets they touch, the
    first `shown` cells and sheets in order, and severity, confidence and urgency of the first finding by position.

    Each task keeps no more than `shown` cells of a check, so a check that fires everywhere is one small row.
    """
    by = ["workbook_id", "check_id"]
    first = F.struct(F.col("sheet").isNull().alias("last"), "sheet", "row", "col", "severity", "confidence", "urgency")
    sums = findings.groupBy(*by).agg(F.count("*").alias("occurrence_count"), F.count_if(F.col("severity") != "low").alias("material_occurrence_count"), F.min(first).alias("first"))
    cells = affected_cells(findings)
    spot = cells.groupBy(*by, "sheet", "row", "col", "cell").agg(F.count("*").alias("n"))
    sheets = spot.groupBy(*by, "sheet").agg(F.sum("n").alias("n"))
    counts = sheets.groupBy(*by).agg(F.sum("n").alias("cell_count"), F.count("*").alias("sheet_count"))
    some = first_of(spot, by, ["sheet", "row", "col", "cell"], shown).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "cell"))), lambda x: x["cell"]).alias("affected_cells"))
    few = first_of(sheets, by, ["sheet"], shown).groupBy(*by).agg(F.array_sort(F.collect_list("sheet")).alias("affected_sheets"))
    out = sums
    for more in (counts, some, few):
        out = out.join(more, by, "left")
    none = F.array().cast("array<string>")
    return out.select(
        *by, "occurrence_count", "material_occurrence_count", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cell_count", "sheet_count")),
        *(F.coalesce(c, none).alias(c) for c in ("affected_cells", "affected_sheets")), "first.severity", "first.confidence", "first.urgency",
    )


def breakdown(findings: DataFrame) -> DataFrame:
    """Counts by priority with the grand total (priority null), and whether a priority is confirmed."""
    return findings.cube("priority").agg(F.count("*").alias("findings"), F.count_if(F.col("priority").isin(*CONFIRMED)).alias("confirmed"))


#: Checks that are broadcast to their cells; more of them meet these by a shuffle.
MOST_BROADCAST = 10_000


def fingerprints(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each check of findings (check_id, label, priority, record_type) and affected cell of cells (check_id,
    cell), or for the check alone if it has no cell; the last of equal ones stays (by label).

    Checks are few and their cells many: checks go to the cells, which are dealt out once, by fingerprint, and never by check.
    """
    checks = cut(findings.groupBy("check_id").agg(F.max(F.struct("label", "priority", "record_type")).alias("last")))
    there = F.broadcast(checks) if checks.count() <= MOST_BROADCAST else checks
    alone = checks.join(cells.select("check_id").distinct(), "check_id", "left_anti").withColumn("cell", F.lit(None).cast("string"))
    rows = cells.select("check_id", "cell").join(there, "check_id").unionByName(alone)
    rows = rows.withColumn("fingerprint", F.when(F.col("cell").isNull(), F.col("check_id")).otherwise(F.concat_ws("::", "check_id", "cell")))
    return rows.groupBy("fingerprint").agg(F.max(F.struct("last.label", "check_id", "cell", "last.priority", "last.record_type")).alias("f")).select("fingerprint", "f.*")


def cross_run(current: DataFrame, history: DataFrame) -> DataFrame:
    """The state of each fingerprint of the current run and of history (fingerprint, status, times_closed): new,
    regressed, still open or closed, with its new status and how often it was closed. Closed ones that stay away are
    left as they are (state null)."""
    now = current.select("fingerprint", F.lit(True).alias("now")).distinct()
    rows = now.join(history.select("fingerprint", "status", "times_closed"), "fingerprint", "full_outer")
    here, old = F.coalesce("now", F.lit(False)), F.col("status")
    state = F.when(here & old.isNull(), "new").when(here & (old == "closed"), "regressed").when(here, "still open").when(old == "open", "closed")
    times = F.coalesce("times_closed", F.lit(0))
    return rows.select("fingerprint", state.alias("state"), F.when(here, "open").otherwise("closed").alias("status"), F.when(state == "closed", times + 1).otherwise(times).alias("times_closed"))


def run_summary(states: DataFrame) -> DataFrame:
    """By state: fingerprints and distinct root causes, those of the rule checks and those of reviews (T2-) apart."""
    root = F.split_part("fingerprint", F.lit("::"), F.lit(1))
    rows = states.where("state IS NOT NULL").withColumns({"root": root, "review": F.startswith(root, F.lit("T2-"))})
    return rows.groupBy("state").agg(F.count("*").alias("fingerprints"), F.count_distinct("root").alias("root_causes"), F.count_distinct(F.when(~F.col("review"), F.col("root"))).alias("rule_causes"), F.count_distinct(F.when(F.col("review"), F.col("root"))).alias("review_causes"))


def merged_history(states: DataFrame) -> DataFrame:
    """History after the run, to be written for the next one."""
    return states.select("fingerprint", "status", "times_closed")


def first_of_tiers(findings: DataFrame, tier: str = "tier") -> DataFrame:
    """Union of tiers without repeats of id (else reason, else label) and sheet in tiers 1 and 2; tier 0 is kept whole."""
    key = F.concat_ws("-", F.coalesce("id", "reason", "label"), F.coalesce("sheet", F.lit("")))
    later = findings.where(F.col(tier) > 0).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(tier, "seq"))).where("k = 1").drop("k")
    return findings.where(F.col(tier) == 0).unionByName(later)


def same_as(findings: DataFrame, hops: int = 10) -> DataFrame:
    """Drops findings whose reason is `Same as X` when the root they lead to exists; the root lists them in also."""
    said = F.nullif(F.regexp_extract("reason", r"(?i)^\s*same as\s+([A-Za-z0-9-]+)", 1), F.lit(""))
    rows = findings.withColumn("next", said)
    links = rows.where("next IS NOT NULL").select(F.col("id").alias("node"), "next").distinct()
    at = links.withColumn("root", F.col("next"))
    for _ in range(hops):
        onward = links.select(F.col("node").alias("root"), F.col("next").alias("further"))
        at = at.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    roots = rows.where("next IS NULL").select(F.col("id").alias("root")).distinct()
    gone = at.join(roots, "root", "left_semi")
    also = gone.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("also")).withColumnRenamed("root", "id")
    return rows.join(gone.select(F.col("node").alias("id")), "id", "left_anti").join(also, "id", "left").drop("next")


def coverage(rules: DataFrame, results: DataFrame) -> DataFrame:
    """State of each rule (rule_id) from results (id, status) whose id is the rule's or begins with it and a dash:
    issue over uncertain over pass, or not run. Ids are cut at their dashes, so the join is on equality."""
    parts = F.split("id", "-")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "-"))
    hits = results.withColumn("rule_id", F.explode(own)).join(rules.select("rule_id").distinct(), "rule_id", "left_semi")
    hits = hits.groupBy("rule_id").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "uncertain").alias("unsure"), F.count("*").alias("results"))
    rows = rules.join(hits, "rule_id", "left")
    return rows.withColumn("state", F.when(F.col("results").isNull(), "not run").when(F.col("fails") > 0, "issue").when(F.col("unsure") > 0, "uncertain").otherwise("pass"))


def conclusive_share(states: DataFrame) -> DataFrame:
    """The share of rules with a pass or an issue, in whole percent (rounded half to even)."""
    return states.agg(F.count("*").alias("rules"), F.bround(100.0 * F.avg(F.col("state").isin("pass", "issue").cast("int"))).cast("int").alias("conclusive"))


def verdict(p1: Column, p2: Column, critical: Column, readiness: Column, approved: Column, blocked: Column | None = None) -> Column:
    """What the model may be relied on for."""
    block = (p1 > 0) | (critical > 0) if blocked is None else (p1 > 0) | (critical > 0) | blocked
    return (
        F.when(block & (readiness >= 60), "internal only").when(block, "not ready")
        .when((readiness >= 95) & approved, "transaction").when(readiness >= 80, "lender").when(readiness >= 60, "management").otherwise("internal only")
    )


def top_blockers(findings: DataFrame, n: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n findings that matter most: P1 and Critical Query first, then risk, key outputs, complexity, id, and the
    columns `ties`."""
    rank = F.when(F.col("priority").isin("P1", "Critical Query"), 0).when(F.col("priority") == "P2", 1).when(F.col("priority") == "P3", 2).otherwise(3)
    return findings.orderBy(rank, F.desc_nulls_last("risk_weighted_total"), F.desc_nulls_last("key_output"), F.desc_nulls_last("fscore"), "check_id", *ties).limit(n)


def due(priority: Column, reported: Column) -> Column:
    """Target dates: 7 days for P1 and Critical Query, 30 for P2, 90 for the rest."""
    days = F.lit(90)
    for k, v in DUE_DAYS.items():
        days = F.when(priority == k, v).otherwise(days)
    return F.date_add(reported, days)


def timing(due_on: Column, today: Column, soon: int = 7) -> Column:
    left = F.datediff(due_on, today)
    return F.when(left < 0, "Overdue").when(left <= soon, "Due Soon").otherwise("On Track")


def with_scores(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings with the complexity score of their cell."""
    return findings.join(index.select("workbook_id", "sheet", "row", "col", "fscore", "band"), ["workbook_id", "sheet", "row", "col"], "left")


#: Review modes that read formulas themselves.
GROUNDED = ("llm_with_partial_formulas", "llm_full_parse", "llm_with_formulas")


def review_depth(findings: DataFrame) -> DataFrame:
    """Of each workbook's review findings (T2-): how many there are, how many read formulas, and their share in whole
    percent (half to even). Without a mode a finding reads labels and values alone."""
    reviews = findings.where(F.startswith("check_id", F.lit("T2-")))
    grounded = F.count_if(F.coalesce(F.col("review_mode"), F.lit("")).isin(*GROUNDED))
    return reviews.groupBy("workbook_id").agg(F.count("*").alias("findings"), grounded.alias("grounded")).withColumn("percent", F.bround(100.0 * F.col("grounded") / F.col("findings")).cast("int"))


def unusable_locations(findings: DataFrame, sheets: DataFrame) -> DataFrame:
    """How many findings of each workbook lead nowhere (cell A1, no sheet, or none that exists whatever its case), and their
    share in whole percent."""
    real = sheets.select("workbook_id", F.lower("sheet").alias("low"), F.lit(True).alias("real")).distinct()
    rows = findings.withColumn("low", F.lower("sheet")).join(real, ["workbook_id", "low"], "left")
    bad = (F.col("addr") == "A1") | F.col("real").isNull()
    return rows.groupBy("workbook_id").agg(F.count("*").alias("findings"), F.count_if(bad).alias("unusable")).withColumn("percent", F.floor(100.0 * F.col("unusable") / F.col("findings") + 0.5).cast("int"))


def completion(stated: Column, rules: Column, open_findings: Column) -> Column:
    """Percent of the audit that is done: what was stated (unless 0), else the share of rules without a finding."""
    return F.coalesce(F.nullif(stated, F.lit(0)), F.floor(100.0 * (rules - open_findings) / rules + 0.5)).cast("int")
