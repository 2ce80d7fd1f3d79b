"""The audit as one plan: all checks of a model, their findings, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.model import Model
from tallygrid.operators import algebra, calls, cross, graph, labels, predicates, ranges, series
from tallygrid.operators.finding import finding

CHECKS: dict[str, Callable[[Model], DataFrame]] = {}


def register_check(name: str, check: Callable[[Model], DataFrame]) -> None:
    """Adds a check: a function from the model to findings (see finding())."""
    CHECKS[name] = check


def _rows(check_id: str, rows: Callable[[Model], DataFrame], detail: str | None = None) -> None:
    register_check(check_id, lambda m: finding(rows(m), check_id, F.col(detail) if detail else None))


register_check("single cells", lambda m: predicates.single_cell_findings(m.cells))
register_check("calls", calls.call_findings)
register_check("mixed references", predicates.mixed_references)
register_check("sheet names", predicates.sheet_names)
register_check("protection", predicates.protected)
register_check("merged and hidden", predicates.merged_and_hidden)
_rows("T0-PII-001", lambda m: predicates.personal_data(m.cells), "redacted")
_rows("T0-EXCEPTIONSTATUS", lambda m: predicates.exception_rows(m.cells), "label")
_rows("T0-COVENANT", lambda m: predicates.degenerate_covenants(m.cells), "cells")
_rows("T0-IMPOSSIBLETARGET", lambda m: predicates.impossible_targets(m.cells).select("*", "first.sheet", "first.row", "first.col"), "chain")
_rows("T0-FORMULACOUNTMISMATCH", lambda m: predicates.formula_count_mismatches(m.cells), "said")
_rows("T0-MISSINGSHEETREF", predicates.missing_sheet_references, "named")
_rows("T0-DUP-001", lambda m: predicates.duplicate_sheets(m.sheets), "live")
register_check("balance plugs", lambda m: labels.balance_plugs(m.cells))
register_check("blank boundaries", labels.blank_boundaries)
register_check("backward-solved equity", labels.backward_solved_equity)
_rows("T0-HARDCHECK-001", lambda m: labels.hardcoded_checks(m.cells).where("confidence = 'high'"), "label")
_rows("T0-MASTERCONTROL", lambda m: labels.failed_controls(m.cells).select("*", "first.sheet", "first.row", "first.col"), "control")
_rows("T0-ZEROBASERATE-001", labels.zero_base_rates, "rates")
_rows("T0-DATEGATE", lambda m: labels.date_gated_ratios(m.cells), "label")
_rows("T0-DSRASIZE-001", lambda m: labels.short_reserve(m.cells), "months")
_rows("T0-RSN-006", lambda m: labels.status_flags(m.cells), "value")
_rows("T0-BALNEG", lambda m: labels.negative_balances(m.cells), "value")
_rows("T0-SIGNCONV", lambda m: labels.sign_conventions(m.cells), "line")
_rows("T0-HARDASSET", lambda m: labels.hardcoded_assets(m.cells), "label")
_rows("T0-FMLPATTERN-001", series.row_patterns, "template")
_rows("T0-COLPATTERN-001", series.column_patterns, "template")
_rows("T0-REGIMECHANGE", series.formula_regimes, "change_at")
_rows("T0-PERIODGAP-001", lambda m: series.period_gaps(m.cells.where("kind = 'date' AND dt IS NOT NULL"), ["workbook_id", "sheet", "row"], "dt"), "gap")
_rows("T0-TERMPERIOD-001", lambda m: series.terminal_drops(m.cells.where("kind = 'number' AND num IS NOT NULL"), ["workbook_id", "sheet", "row"], "col", "num", F.col("formula").isNotNull()), "mean")
register_check("off by one", ranges.off_by_one)
_rows("T0-AGGMISMATCH-001", ranges.aggregate_mismatches, "resum")
_rows("T0-RANGEDUP-001", ranges.subtotals_in_range, "label")
_rows("T0-AUTOSUMHDR-001", ranges.header_years_in_sum, "year")
_rows("T0-TOTALRANGE", ranges.total_ranges, "missing")
_rows("T0-CROSSCAST-001", ranges.cross_casts, "across")
_rows("T0-DUPCALC", ranges.duplicate_calculations, "ranges")
_rows("T0-REVDOUBLE-001", ranges.double_counted, "owners")
_rows("T0-BLANKCELLREF", lambda m: ranges.blank_references(m).withColumnsRenamed({"to_sheet": "sheet", "to_row": "row"}), "refs")
register_check("basis mismatches", ranges.basis_mismatches)
register_check("IRR without a negative", ranges.irr_without_negative)
register_check("IRR with many signs", ranges.irr_many_signs)
_rows("T0-RI-001", ranges.redundant_inputs, "label")
_rows("T0-NR-001", lambda m: ranges.named_range_issues(m).where("issue = 'Broken'"), "name")
_rows("T0-NR-002", lambda m: ranges.named_range_issues(m).where("issue <> 'Broken'"), "name")
_rows("T0-ERRSCANCOVERAGE", ranges.error_scan_coverage, "gap")
_rows("T0-GATECOVERAGE", ranges.gate_coverage, "outside")
_rows("T0-DSCRGATE-001", lambda m: cross.gated_distributions(m.cells), "ratio")
_rows("T0-REVCASH-001", lambda m: cross.revolver_and_cash(m.cells), "what")
_rows("T0-TAXRATE-001", lambda m: cross.effective_tax(m.cells), "effective")
_rows("T0-RSN-001", lambda m: cross.discount_rate_overrides(m.cells), "applied")
_rows("T0-RSN-002", lambda m: cross.terminal_value_share(m.cells), "share")
_rows("T0-RSN-003", lambda m: cross.unreasonable_outputs(m.cells), "metric")
_rows("T0-RSN-004", lambda m: cross.missing_metrics(m.cells).where("check_id = 'T0-RSN-004'"))
_rows("T0-RSN-005", lambda m: cross.missing_metrics(m.cells).where("check_id = 'T0-RSN-005'"))
_rows("T0-RSN-007", lambda m: cross.npv_signs(m.cells), "base")
_rows("T0-RSN-008", lambda m: cross.valuation_divergence(m.cells), "divergence")
_rows("T0-RSN-009", lambda m: cross.negative_debt_yields(m.cells), "value")
_rows("T0-CIRC-001", lambda m: graph.cycles(m).where("distribution"), "cells")
_rows("T0-CIRC-002", lambda m: graph.cycles(m).where("NOT distribution"), "cells")
_rows("T0-CHAIN", graph.key_output_chains, "what")
_rows("T0-DAISYCHAIN-001", graph.daisy_chains, "hops")


def run_checks(model: Model, names: list[str] | None = None) -> DataFrame:
    """Findings of the named checks (all by default) in one frame. Formulas are tokenized once for all of them."""
    out, model = None, model.tokenized()
    for name in names or CHECKS:
        part = CHECKS[name](model)
        out = part if out is None else out.unionByName(part)
    return out


def judged(findings: DataFrame) -> DataFrame:
    """Findings rolled up to one row for each check, with type, priority and risk."""
    rows = algebra.root_causes(findings)
    rows = rows.withColumn("record_type", algebra.record_type(F.col("severity"), F.col("confidence"), F.col("urgency"), F.lower("check_id")))
    return algebra.scored(rows.withColumn("priority", algebra.priority(F.col("record_type"), F.col("severity"))))
