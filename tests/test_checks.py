"""Checks on small grids: what they must find, and what they must leave alone."""

import math
import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import addresses, scoring, text, tokens
from tallygrid.operators import calls, core, cross, graph, labels, predicates, ranges, rules, sampling, series
from tallygrid.plans import audit, report
from tests.grids import model, places


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_relative_forms():
    for formula, row, col, want in (
        ("=A1+B1", 5, 3, "=R[-4]C[-2]+R[-4]C[-1]"), ("=$A$1+B1", 5, 3, "=R1C1+R[-4]C[-1]"), ("=Timing!C7", 10, 3, "=Timing!R[-3]C[0]"),
        ("=Timing!D7", 10, 4, "=Timing!R[-3]C[0]"), ("=SUM(A1:A5)", 10, 3, "=SUM(R[-9]C[-2]:R[-5]C[-2])"),
    ):
        assert tokens.relative_form(formula, row, col) == want


def test_relative_forms_of_cells_are_put_together_in_columns(spark):
    forms = ["A1+$B$2", "SUM($A1:B$9)*'My Sheet'!C3-Other!D4:$E$5", "NOW()", "", 'IF(A1="B2",LOG10(A1),XFD1048576)', "A1:B2:C3", "$A$1", None]
    rows = [(f, r, c, 1) for f in forms for r, c in ((1, 1), (70, 30))]
    got = tokens.with_relative_form(spark.createDataFrame(rows, "formula string, row int, col int, n int"))
    assert got.columns == ["formula", "row", "col", "n", "template"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*r, None if r[0] is None else tokens.relative_form(*r[:3]))) for r in rows)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()



def test_tokens():
    assert [c[2:4] + (c[6],) for c in tokens.calls_of("IF(A1>1,SUM(B1,2),0)")] == [("IF", 0, ["A1>1", "SUM(B1,2)", "0"]), ("SUM", 1, ["B1", "2"])]
    assert tokens.calls_of("SUM(A1") == [] and tokens.top_level_args("a, (b,c) ,") == ["a", "(b,c)"]
    assert [(r[2], r[3], r[4:8]) for r in tokens.refs_of("SUM(A1:B2)+'My S'!$D$4+F:G+\"A9\"+LOG10(2)")] == [("range", None, (1, 1, 2, 2)), ("cell", "My S", (4, 4, 4, 4)), ("wholecol", None, (1, 6, 1048576, 7))]


def test_columns_round_trip(spark):
    n = spark.range(1, 18279).select(F.col("id").cast("int").alias("n"))
    assert n.where(addresses.col_to_num(addresses.num_to_col(F.col("n"))) != F.col("n")).count() == 0
    assert [one(spark, addresses.num_to_col(F.lit(x))) for x in (1, 26, 27, 702, 703, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, addresses.num_to_col(F.lit(0))) is None


def test_scalars(spark):
    assert one(spark, text.blank_strings(F.lit('A&"x,y"&B&"z'))) == 'A&     &B&"z'
    assert one(spark, text.redact(F.lit("abcdef"))) == "ab**ef" and one(spark, text.redact(F.lit("abcd"))) == "****"
    assert one(spark, text.normal_label(F.lit(" Net-Debt  x "))) == "net debt x"
    for name in ("Model v2 (1).xlsx", "model_2026-07-13 final.xlsm", "MODEL - copy.xlsx"):
        assert one(spark, text.model_identity(F.lit(name))) == "model"
    assert one(spark, text.model_identity(F.lit("Final.xlsx"))) == "final.xlsx"
    for name, key, want in (("Construction Timeline", "Cons", False), ("Debt Dashboard", "Debt", True), ("My Cash Flow", "Cash Flow", True)):
        assert one(spark, text.keyword_in_sheet(F.lit(name), key)) is want
    assert one(spark, text.scaling_commas(F.lit("#,##0,,"))) == 2 and one(spark, text.hides_decimals_of_percent(F.lit("0%"))) and not one(spark, text.hides_decimals_of_percent(F.lit("0.0%")))
    assert one(spark, scoring.f_score(F.lit("$AP$33"))) == 1 and not one(spark, F.lit("$AP$33").rlike(scoring.HARD_CODE_COUNTED))
    assert one(spark, scoring.f_score(F.lit(None).cast("string"))) == 0


def test_single_cells(spark):
    m = model(spark, {"S": {
        "A1": "=SUM((A2)*(A3))", "A2": "=5*12", "A3": "=A1*12", "A4": '=IF(A1>0,"true","false")', "A5": "=VALUE(RIGHT(A1,2))", "A6": "=2000+VALUE(RIGHT(A1,2))", "A7": "=XNPV(0.1,A1,B1)", "A8": "=NPV(0.1,B1)",
        "B1": "1,234", "B2": "2024", "B3": "abc", "B4": {"value": 0.004, "num_fmt": "0%"}, "B5": {"value": 5, "num_fmt": "#,##0,"}, "B6": {"value": 5, "num_fmt": '#,##0, "k"'}, "B7": "=OFFSET(A1,1,0)", "C1": ("=A1", datetime(2250, 1, 1)),
    }})
    got = {(r["check_id"], r["row"], r["col"]) for r in predicates.single_cell_findings(m.cells).collect()}
    assert got == {
        ("T0-COMPLEXFML-001", 1, 1), ("T0-CONSTFORMULA-001", 2, 1), ("T0-TEXTBOOLFLAG-001", 4, 1), ("T0-2DIGITYEAR-001", 5, 1), ("T0-NPV-001", 8, 1), ("T0-NUMASTEXT-001", 1, 2),
        ("T0-DISPLAYZERO-001", 4, 2), ("T0-UNITHIDE-001", 5, 2), ("T0-INDIRECT-001", 7, 2), ("T0-OVERFLOW-001", 1, 3),
    }


def test_calls(spark):
    m = model(spark, {"S": {
        "A1": "=IF(B1=0,#N/A,C1)", "A2": "=VLOOKUP(A1,B:C,2,FALSE)", "A3": "=VLOOKUP(A1,B:C,2)", "A4": "=MATCH(A1,B:B,0)", "A5": "=IFERROR(A1,7)", "A6": "=IFERROR(A1,0)", "A7": "=IF(A1,IF(B1,1,2),3)",
        "A8": "=IF(A1,1,2)+IF(B1,1,2)", "A9": "=-NPV(0.1,B1:B5)", "A10": "=NPV(0.1,B1:B5)+B0", "A11": "=PRODUCT(B1/B2,3)", "A12": "=IFERROR(PRODUCT(B1/B2,3),0)", "A13": "=PMT(0.1,12,-B1)", "A14": "=B1+#REF!",
    }})
    got = {(r["check_id"], r["row"]) for r in calls.call_findings(m).collect()}
    assert got == {("T0-IFERRLIT-001", 1), ("T0-LOOKUPMATCH-001", 3), ("T0-ERRMASK-001", 5), ("T0-NESTEDIF-001", 7), ("T0-NPVP0-001", 9), ("T0-FLAGERRMASK-001", 11), ("T0-ERRLITERAL-001", 14)}


def test_protection_and_layout(spark):
    m = model(spark, {"P": {"A1": {"value": "=1+1", "formula_hidden": True}, "A2": {"value": 3, "font_argb": "FF0000FF", "has_dv": True}, "A3": {"value": "=A2", "locked": False}, "B5": 1}, " x": {"A1": 1}}, protected={"P": True}, merges={"P": ["A1:B1"]}, hidden_rows={"P": [1]}, hidden_cols={" x": [1]})
    assert {(r["check_id"], r["row"]) for r in predicates.protected(m).collect()} == {("T0-HIDDENFORMULA-001", 1), ("T0-CELLLOCK-001", 2), ("T0-CELLLOCK-001", 3)}
    assert {(r["check_id"], r["sheet"]) for r in predicates.merged_and_hidden(m).collect()} == {("T0-MERGE-001", "P"), ("T0-HIDDEN-001", "P"), ("T0-HIDDEN-002", " x")}
    assert [r["sheet"] for r in predicates.sheet_names(m).collect()] == [" x"]
    assert predicates.validation_coverage(m).first()["coverage"] == 1.0


def test_texts(spark):
    m = model(spark, {"Guide": {"A1": "Gone!A1", "A2": "Gone!B2", "A3": "Data!A1", "A4": "OWNER DECISIONS - now: keep it; drop that. More."}, "Data": {"A1": "Name", "B1": "a@b.co 4111 1111 1111 1111", "A2": "BSB", "B2": "123-456", "B3": "123-456", "A4": "row", "B4": "EXCEPTION", "C4": "exception"}, "Data_copy": {"A1": "x"}})
    assert [(r["named"], r["cells"]) for r in predicates.missing_sheet_references(m).collect()] == [("Gone", 2)]
    assert sorted((r["what"], r["row"]) for r in predicates.personal_data(m.cells).collect()) == [("branch number", 2), ("card", 1), ("email", 1)]
    assert [(r["row"], r["cells"], r["label"]) for r in predicates.exception_rows(m.cells).collect()] == [(4, 2, "row")]
    assert [(r["sheet"], r["live"]) for r in predicates.duplicate_sheets(m.sheets).collect()] == [("Data_copy", "Data")]
    assert [r["item"] for r in predicates.owner_decisions(m.cells).orderBy("k").collect()] == ["keep it", "drop that"]


def test_labelled_values_and_series(spark):
    m = model(spark, {"S": {"A1": "Closing cash", "C1": 5, "D1": -2, "H1": 9, "A2": "Closing cash", "B2": "note", "C2": 7, "A3": "Status", "B3": "DRAFT only"}, "S backup": {"A1": "Closing cash", "B1": 1}})
    assert [(r["row"], r["value"]) for r in labels.labelled_values(m.cells, ("closing cash",)).collect()] == [(1, 5.0)]
    assert [r["value"] for r in labels.labelled_series(m.cells, ("closing cash",)).orderBy("col").collect()] == [5.0, -2.0]
    assert [r["value"] for r in labels.negative_balances(m.cells).collect()] == [-2.0]
    assert [r["value"] for r in labels.status_flags(m.cells).collect()] == ["DRAFT only"]
    got = {(r["row"], r["col"]): r["label"] for r in labels.with_nearby_label(m.cells.where("sheet = 'S'")).collect()}
    assert got[1, 3] == "Closing cash" and got[1, 1] == "" and got[2, 1] == "note"


def test_label_checks(spark):
    m = model(spark, {"S": {
        "A1": "Balancing item", "B1": "=SUM(C1:C5)-D1", "A2": "Opening balance", "B2": "=Z9", "A3": "Balance check", "B3": "OK", "A4": "Check", "B4": "=A1", "A5": "Gate", "B5": "FAIL", "A6": "Base rate", "B6": 0, "A7": "DSCR", "B7": "=IF(OR(A1<B1,C1),1,0,2)",
        "A8": "Fixed assets", "B8": 1, "C8": 2, "D8": 3, "A9": "Fixed assets", "B9": 1, "C9": "=B9", "D9": 3, "A10": "Capex", "B10": 5, "A11": "Capex", "B11": -5,
        "A12": "DSRA target", "B12": 40, "A13": "Monthly debt service", "B13": 10,
        "A14": "Total assets", "B14": 10, "A15": "Total liabilities", "B15": 4, "A16": "Share capital", "B16": "=B14-B15", "A17": "Other", "B17": "=B14-B15",
    }})
    assert places(labels.balance_plugs(m.cells)) == [("S", 1, 2)]
    assert places(labels.blank_boundaries(m)) == [("S", 2, 2)]
    assert [(r["row"], r["confidence"]) for r in labels.hardcoded_checks(m.cells).collect()] == [(3, "high")]
    assert [(r["control"], r["cells"]) for r in labels.failed_controls(m.cells).collect()] == [("gate", 1)]
    assert labels.zero_base_rates(m).first()["rates"] == 1
    assert [r["row"] for r in labels.date_gated_ratios(m.cells).collect()] == [7]
    assert [(r["row"], r["typed"]) for r in labels.hardcoded_assets(m.cells).collect()] == [(8, 3)]
    assert [r["line"] for r in labels.sign_conventions(m.cells).collect()] == ["Capex"]
    assert [r["months"] for r in labels.short_reserve(m.cells).collect()] == [4.0]
    assert places(labels.backward_solved_equity(m)) == [("S", 16, 2)]


def test_row_patterns_and_regimes(spark):
    row = {f"{c}1": f"={c}5*2" for c in "ABCDE"} | {"F1": "=F5*3", "G1": "=SUM(A1:F1)"}
    change = {f"{c}2": f"={c}5*2" for c in "ABCD"} | {f"{c}2": f"={c}6" for c in "EFGH"}
    m = model(spark, {"S": row | change})
    assert places(series.row_patterns(m)) == [("S", 1, 6)]
    assert [(r["row"], r["before"], r["change_at"]) for r in series.formula_regimes(m).collect()] == [(2, 4, 5)]
    column = {f"A{k}": (f"=B{k}*2", 1.0) for k in range(1, 8)} | {"A8": ("=B8*9", 1.0)}
    assert places(series.column_patterns(model(spark, {"S": column}))) == [("S", 8, 1)]


def test_dates_and_ends(spark):
    days = [datetime(2024, k, 1) for k in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
    m = model(spark, {"S": {f"{'ABCDEFGHI'[k]}1": d for k, d in enumerate(days)}})
    gaps = series.period_gaps(m.cells, ["workbook_id", "sheet", "row"], "dt").collect()
    assert [(r["dt"], r["gap"]) for r in gaps] == [(datetime(2024, 10, 1), 92)]
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([9, 9, 9, 9, 9, 9, 9, 0.1, 0.1])] + [("b", k, 9.0) for k in range(9)], "g string, k int, v double")
    assert [r["g"] for r in series.terminal_drops(rows, ["g"], "k", "v").collect()] == ["a"]


def test_ranges(spark):
    m = model(spark, {"S": {
        "A1": 2020, "A2": 2021, "A3": 7, "A4": ("=SUM(A1:A3)", 9999.0), "B1": 1, "B2": 2, "B3": 3, "B4": ("=SUM(B2:B3)", 5.0), "C1": ("=SUM(C5:C8)", 0.0), "D6": "Subtotal",
        "E1": "=IRR(F1:F4)", "F1": 1, "F2": 2, "F3": 0, "F4": 3, "E2": "=IRR(G1:G4)", "G1": -1, "G2": 2, "G3": -3, "G4": 4,
    }})
    assert {(r["addr"], r["cached"] - r["resum"]) for r in ranges.aggregate_mismatches(m).collect()} == {("A4", 9999.0 - 4048.0)}
    assert [(r["addr"], r["corroborated"]) for r in ranges.header_years_in_sum(m).collect()] == [("A4", True)]
    assert [(r["addr"], r["missing"]) for r in ranges.total_ranges(m).collect()] == [("B4", "start")]
    assert [(r["addr"], r["subtotal_row"]) for r in ranges.subtotals_in_range(m).collect()] == [("C1", 6)]
    assert [r["addr"] for r in ranges.irr_without_negative(m).collect()] == ["E1"]
    assert [r["addr"] for r in ranges.irr_many_signs(m).collect()] == ["E2"]


def test_off_by_one_and_cross_cast(spark):
    peers = {f"Z{k}": f"=SUM(A{k}:M{k})" for k in range(1, 5)} | {"Z5": "=SUM(A5:L5)"}
    assert places(ranges.off_by_one(model(spark, {"S": peers}))) == [("S", 5, 26)]
    table = {"A1": "Head", "F1": "Total", "D2": 1, "E2": 2, "F2": 3, "D3": 1, "E3": 1, "F3": 2, "A4": "Total", "D4": 2, "E4": 3, "F4": 5}
    assert ranges.cross_casts(model(spark, {"S": table})).count() == 0
    assert ranges.cross_casts(model(spark, {"S": table | {"F3": 9}})).first()["down"] == 12.0


def test_references(spark):
    data = {f"A{k}": k for k in range(1, 9)} | {"B1": "=A9", "B2": "=ISBLANK(A9)", "B3": "=SUM(A1:A9)", "B4": "=IF(A9=\"\",1,2)", "C1": "x", "B9": "=C5"}
    m = model(spark, {"S": data})
    assert [(r["to_row"], r["refs"]) for r in ranges.blank_references(m).collect()] == [(9, 1)]
    m = model(spark, {"Inputs": {"A1": "Rate", "B1": 5, "B2": 6, "A3": "n", "B3": 44, "D1": 1, "D2": 2, "D3": 3, "E5": 77}, "Calc": {"A1": "=Inputs!B1", "A2": "=SUM(Inputs!$E:$E)", "A3": "=B2"}})
    assert places(ranges.redundant_inputs(m)) == [("Inputs", 2, 2), ("Inputs", 3, 2)]
    m = model(spark, {"S": {"A1": "=rate*2"}}, names=[("rate", ["S!$A$1"]), ("data1", ["S!$A$2"]), ("gone", ["Lost!$A$1"]), ("plain", ["S!$B$1"]), ("_xlnm.Print_Area", ["S!$A$1"])])
    assert {(r["name"], r["issue"]) for r in ranges.named_range_issues(m).collect()} == {("data1", "Unused + Poorly Named"), ("gone", "Broken"), ("plain", "Unused")}
    m = model(spark, {"S": {"A1": "=B1", "B1": 3, "A2": "=B1/2", "C1": "=ROUND(A1,2)=ROUND(A2,2)", "C2": "=ROUND(A1,2)=ROUND(A1,2)"}})
    assert places(ranges.basis_mismatches(m)) == [("S", 1, 3)]


def test_cross_series(spark):
    m = model(spark, {"S": {"A1": "Distributions paid", "B1": 5, "C1": 5, "A2": "DSCR", "B2": 0.9, "C2": 1.2, "A3": "Revolver balance", "B3": 0, "C3": 2000, "A4": "Cash balance", "B4": -1, "C4": 3000,
                              "A5": "Income tax expense", "B5": 500, "C5": 300, "A6": "Profit before tax", "B6": 1000, "C6": 1000, "A7": "Corporate tax rate", "B7": 30}})
    assert [r["col"] for r in cross.gated_distributions(m.cells).collect()] == [2]
    assert sorted(r["col"] for r in cross.revolver_and_cash(m.cells).collect()) == [2, 3]
    assert [r["col"] for r in cross.effective_tax(m.cells).collect()] == [2]


def test_reasonableness(spark):
    m = model(spark, {"S": {"A1": "WACC (calculated)", "B1": 0.08, "A2": "Applied discount rate", "B2": 0.1, "A3": "PV of terminal value", "B3": 80, "A4": "Project NPV", "B4": 100, "A5": "EBITDA margin", "B5": 55, "A6": "Equity NPV", "B6": 1, "A7": "Equity XNPV", "B7": -1,
                              "A8": "DCF value", "B8": 100, "A9": "Property value", "B9": 10, "A10": "Debt yield", "F10": -0.1, "G10": 0.2}})
    assert cross.discount_rate_overrides(m.cells).count() == 1 and cross.terminal_value_share(m.cells).first()["share"] == 0.8
    assert [(r["metric"], r["value"]) for r in cross.unreasonable_outputs(m.cells).collect()] == [("EBITDA margin", 0.55)]
    assert [r["base"] for r in cross.npv_signs(m.cells).collect()] == ["equity"]
    assert cross.valuation_divergence(m.cells).first()["divergence"] == 0.9
    assert [r["value"] for r in cross.negative_debt_yields(m.cells).collect()] == [-0.1]
    assert {r["check_id"] for r in cross.missing_metrics(m.cells).collect()} == {"T0-RSN-004", "T0-RSN-005"}


def test_daisy_chains(spark):
    m = model(spark, {"Model": {"B10": "=X10*2", "C10": "=B10", "D10": "=C10", "B20": "=X20*2", "C20": "=B20", "D20": "=C20", "E20": "=D20", "B30": "=X30*2", "C30": "=B30", "B40": 42, "C40": "=B40", "C50": "=Timing!B6"}, "Timing": {"A6": "=V6+1", "B6": "=A6"}})
    got = {(r["sheet"], r["row"], r["hops"]) for r in graph.daisy_chains(m).collect()}
    assert got == {("Model", 10, 2), ("Model", 20, 2), ("Model", 20, 3), ("Model", 50, 2)}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (8, 9)], "src int, dst int")
    assert {(r["node"], r["cycle"]) for r in graph.component_of_cycle(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert {(r["node"], r["wave"]) for r in graph.reach(edges, spark.createDataFrame([(7,)], "node int")).collect()} == {(7, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)}
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (501, 500)], "node int, next int")
    ends = {r["node"]: (r["last"], r["hops"]) for r in graph.chain_ends(links).collect()}
    assert ends[0] == (300, 300) and ends[299] == (300, 1) and 500 not in ends
    m = model(spark, {"S": {"A1": "=B1", "B1": "=A1", "C1": "=COLUMNS(C1:D1)", "A2": "Dividend", "B2": "=C2", "C2": "=B2"}})
    assert sorted((r["cells"], r["distribution"]) for r in graph.cycles(m).collect()) == [(2, False), (2, True)]


def test_key_output_chains(spark):
    m = model(spark, {"S": {"A1": "Project IRR", "B1": ("=B2+Z9", 0.1), "B2": ("=B3", 1.0), "B3": ("=C3", 1.0), "C3": "#REF!", "A5": "Equity IRR", "B5": ("=B2", 0.2), "A6": "NPV", "B6": 5}})
    got = {(r["row"], r["col"], r["what"], r["outputs"], r["depth"]) for r in graph.key_output_chains(m).collect()}
    assert got == {(9, 26, "dead end", 1, 1), (3, 3, "error", 2, 3)}
    assert graph.key_output_chains(m, depth=2).where("what = 'error'").count() == 0
    assert [r["row"] for r in graph.key_output_chains(m, most_outputs=1, depth=1).collect()] == [9]


def test_trace_of_many_sources_against_a_plain_walk(spark):
    rng = random.Random(5)
    cells = {f"A{k}": "=" + "+".join(f"A{rng.randint(1, 75)}" for _ in range(rng.randint(1, 3))) for k in range(1, 61)} | {f"A{k}": k for k in range(61, 66)} | {"A66": "#REF!"}
    m = model(spark, {"S": cells})
    starts = rng.sample(range(1, 61), 40)
    frame = spark.createDataFrame([("w", "S", r, 1, k) for k, r in enumerate(starts, 1)], "workbook_id string, sheet string, row int, col int, k int")
    for depth in (2, 15):
        want = {}
        for start in starts:
            steps, wave = {start: 0}, [start]
            for d in range(1, depth + 1):
                wave = sorted({int(x) for a in wave for x in re.findall(r"A(\d+)", str(cells.get(f"A{a}", "")))} - set(steps))
                steps |= dict.fromkeys(wave, d)
            for node, d in steps.items():
                n, least = want.get(node, (0, d))
                want[node] = (n + 1, min(least, d))
        what = lambda a: "formula" if a <= 60 else "input" if a <= 65 else "error" if a == 66 else "dead end"
        got = {r["row"]: (r["outputs"], r["depth"], r["what"]) for r in graph.trace(m, frame, depth).collect()}
        assert got == {a: (*v, what(a)) for a, v in want.items()}


def test_orphans(spark):
    m = model(spark, {"Inputs": {"A1": 1}, "Calc": {"A1": "=Inputs!A1"}, "Balance Sheet": {"A1": "=Calc!A1"}, "Dashboard": {"A1": "='Balance Sheet'!A1"}, "Lost": {"A1": 2}, "Read me": {"A1": "x"}})
    deps = core.sheet_dependencies(m)
    assert {(r["target"], r["precedent"]) for r in deps.collect()} == {("Calc", "Inputs"), ("Balance Sheet", "Calc"), ("Dashboard", "Balance Sheet")}
    assert [r["sheet"] for r in graph.orphan_sheets(m.sheets, deps).collect()] == ["Lost"]
    assert {(r["target"], r["direction"], r["risk"]) for r in core.edges(deps).collect()} == {("Calc", "Normal", "Low"), ("Balance Sheet", "Normal", "Low"), ("Dashboard", "Normal", "Low")}


def test_taint_and_recalculation(spark):
    chain = {"A1": ("=1/0", "#DIV/0!")} | {f"A{k}": (f"=IFERROR(A{k - 1},0)", 1.0) for k in range(2, 8)} | {"A8": ("=SUM(A6:A7)", 100.0), "B1": ("=C1", 5.0), "C1": 50}
    m = model(spark, {"S": chain})
    seeds = m.cells.where("err IS NOT NULL").select(F.struct("workbook_id", "sheet", "row", "col").alias("node"))
    got = graph.taint(graph.cell_edges(m), seeds).select("node.row", "node.col", "wave")
    assert {(r["row"], r["wave"]) for r in got.collect()} == {(k, k - 1) for k in range(1, 7)} | {(7, 6), (8, 6)}
    again = m.formulas.select("workbook_id", "sheet", "row", "col", F.when(F.col("addr") == "A8", F.lit(float("nan"))).otherwise(F.lit(50.0)).alias("value"))
    tainted = graph.taint(graph.cell_edges(m), seeds).select("node.*")
    states = {r["row"]: r["state"] for r in graph.recalculation(m.cells, again, tainted).where("col = 1").collect()}
    assert states[8] == "unresolved" and states[3] == "likely masked"
    assert graph.recalculation(m.cells, again, tainted).where("col = 2").first()["state"] == "mismatch"


def test_rules(spark):
    m = model(spark, {"Debt Inputs": {"A1": "Revenue", "B1": -5, "A2": "x", "B2": ("=1/0", "#DIV/0!"), "C2": "=[1]S!A1"}, "Sheet1": {"A1": "Actual / Forecast", "B1": "Actual", "C1": "Forecast"}})
    types = {"r1": ("sheet_exists", {"sheets": "debt-inputs, None"}), "r2": ("sheet_exists", {"sheets": "Nothing"}), "r3": ("no_formula_errors", {}), "r4": ("no_negative_values", {"sheets": "Debt Inputs", "keyword": "revenue"}), "r5": ("no_negative_values", {"sheets": "Gone", "keyword": "x"}),
             "r6": ("no_external_links", {}), "r7": ("worksheet_naming_check", {"patterns": r"^sheet\d+$"}), "r8": ("sheet_exists_flexible", {"sheets": "None", "embedded": "true"}), "r9": ("workbook_opens_clean", {}), "r10": ("array_formula_check", {}),
             "r11": ("data_validation_check", {}), "r12": ("actuals_forecast_separated", {"sheets": "Flags"}), "r13": ("no_circular_references", {}), "r14": ("unknown", {}), "r15": ("sheet_empty", {"sheets": "Sheet1"})}
    table = spark.createDataFrame([(k, t, p) for k, (t, p) in types.items()], "rule_id string, type string, params map<string,string>")
    got = {r["rule_id"]: r["status"] for r in rules.apply_rules(m, table).collect()}
    assert got == {"r1": "pass", "r2": "fail", "r3": "fail", "r4": "fail", "r5": "uncertain", "r6": "fail", "r7": "fail", "r8": "pass", "r9": "pass", "r10": "pass", "r11": "fail", "r12": "pass", "r13": "uncertain", "r15": "fail"}
    assert rules.pass_rate(rules.apply_rules(m, table)).first()["pass_rate"] == 36
    assert rules.gate(m).first()["passed"]


def test_core_scan(spark):
    m = model(spark, {"S": {"A1": "=B1+2", "A2": "=B2+2", "A3": "=IFERROR(B3,0)", "B1": 5, "B2": "", "C1": ("=1/0", "#DIV/0!")}})
    u = {r["normal"]: (r["ufi"], r["instances"], r["fscore"]) for r in core.unique_formulas(m.cells).collect()}
    assert u["CELL+2"] == ("UF-0001", 2, 1) and u["IFERROR(CELL,0)"][1] == 1
    s = {r["sheet"]: r for r in core.sheet_stats(m.cells).collect()}
    assert s["S"]["formula_count"] == 4 and s["S"]["value_count"] == 1 and s["S"]["hardcode_count"] == 2 and s[None]["formula_count"] == 4
    assert [(r["err"], r["samples"]) for r in core.error_matrix(m.cells).collect()] == [("#DIV/0!", "S!C1")]
    assert core.score_index(m.cells).count() == 4
    assert report.errors_with_guide(core.error_matrix(m.cells)).first()["meaning"] == "a division by zero"


def test_audit_runs_checks(spark):
    m = model(spark, {"Inputs": {"A1": "Rate", "B1": 5, "B2": "1,234"}, "Calc": {"A1": "=Inputs!B1*12", "A2": "=VLOOKUP(A1,B:C,2)"}})
    graphs = {n for n in audit.CHECKS if n.startswith(("T0-CIRC", "T0-DAISY", "T0-CHAIN"))}  # these run as they are made
    shapes = {tuple(audit.CHECKS[n](m).columns) for n in audit.CHECKS if n not in graphs}
    assert len(shapes) == 1
    found = audit.run_checks(m, ["single cells", "calls", "off by one", "T0-RI-001", "T0-RSN-004"])
    assert {r["check_id"] for r in found.collect()} == {"T0-NUMASTEXT-001", "T0-LOOKUPMATCH-001", "T0-RSN-004"}
    assert {r["check_id"] for r in audit.judged(found).where("priority = 'P2'").collect()} == {"T0-NUMASTEXT-001", "T0-LOOKUPMATCH-001"}


def test_samples(spark):
    m = model(spark, {"S": {"A1": "=B1+1", "B10": "=A1*(2+IF(A1,2,3))"}})
    e = sampling.token_estimate(m.cells).first()
    assert e["formula_cells"] == 2 and e["characters"] == (2 + 3 + 4 + 1) + (3 + 3 + 17 + 1) + 5 and e["tokens"] == 13 and e["fits"]
    assert sampling.listing(m.cells).first()["listing"] == "A1=B1+1\nB10=A1*(2+IF(A1,2,3))"
    rows = [("w", "s", k, "debt" if k < 30 else "rate" if k < 40 else "other" if k < 70 else "note", k < 70) for k in range(90)]
    got = sampling.meaningful_rows(spark.createDataFrame(rows, "workbook_id string, sheet string, row int, label string, numeric boolean"), "debt", "rate").groupBy("tier").count().collect()
    assert {r["tier"]: r["count"] for r in got} == {0: 18, 1: 1, 3: 1}
    replies = spark.createDataFrame([('Here: ```json\n{"a": 1,}\n```',), ('{"a": 2}',), ("none",)], "t string")
    assert [r["x"]["a"] if r["x"] else None for r in replies.select(sampling.parsed_reply(F.col("t"), "a int").alias("x")).collect()] == [1, 2, None]
    files = spark.createDataFrame([("w", "h1"), ("v", "h2")], "workbook_id string, sha256 string")
    before = sampling.snapshot(spark.createDataFrame([("w", "c"), ("w", "c")], "workbook_id string, check_id string"), files)
    assert {(r["sha256"], r["n"]) for r in before.collect()} == {("h1", 2), ("h2", 0)}
    after = before.withColumn("n", F.col("n") + 1).where("sha256 = 'h1'")
    assert {(r["sha256"], r["what"]) for r in sampling.snapshot_changes(before, after).collect()} == {("h1", "changed"), ("h2", "gone")}


def test_reach_follows_long_chains(spark):
    """Chains, a side entrance, a loop at the end and a branching, against a plain walk."""
    from tallygrid.operators import graph

    edges = [(k, k + 1) for k in range(200)] + [(500, 150), (500, 501), (501, 502)] + [(k, k + 1) for k in range(502, 540)] + [(540, 500)] + [(600 + k, 600 + (k + 1) % 40) for k in range(40)] + [(200, 900), (200, 901)]
    seeds = [0, 180, 530, 610]
    want, front, wave = dict.fromkeys(seeds, 0), seeds, 0
    while front:
        wave += 1
        front = [x for x in {d for s, d in edges if s in set(front)} if x not in want]
        want |= dict.fromkeys(front, wave)
    got = graph.reach(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(x,) for x in seeds], "node int"))
    assert {r["node"]: r["wave"] for r in got.collect()} == want
    assert len(graph._jumps(spark.createDataFrame(edges, "src int, dst int"))) > 5


def test_explanations(spark):
    from tallygrid.functions import scoring

    rows = [("A1+B1", "Low", "Low complexity — straightforward formula."), ("IF(A1>2,1,0)", "Low", "Low complexity: conditional branching."), (None, "Low", "Low complexity — straightforward formula."), ("IF(A1,IF(A2,IF(A3,OFFSET(A1,1,0),0),0),0)+[B.xlsx]S!A1", "High", "High complexity: 3 nested conditional branches, dynamic reference (OFFSET/INDIRECT) — difficult to trace, external workbook reference — broken-link risk.")]
    df = spark.createDataFrame(rows, "f string, band string, want string")
    assert df.where(scoring.explanation(F.col("f"), F.col("band")) != F.col("want")).count() == 0


def test_report_tabs(spark):
    from tallygrid.plans import report

    found = spark.createDataFrame([("w", "T0-CHAIN", "P1"), ("w", "T0-X", "P2"), ("v", "T0-X", "Query")], "workbook_id string, check_id string, priority string")
    got = {r["workbook_id"]: (r["p1"], r["p2"], r["chain"], r["verdict"]) for r in report.headline(found, 90, False).collect()}
    assert got == {"w": (1, 1, True, "internal only"), "v": (0, 0, False, "lender")}
    unique = spark.createDataFrame([("a", 3), ("b", 9), ("c", 9)], "ufi string, fscore int")
    assert [r["ufi"] for r in report.formula_review(unique, 2).collect()] == ["b", "c"]
    edges = spark.createDataFrame([("w", "S", "T", 5, "Low"), ("w", "S", "U", 900, "High"), ("w", "Z", "A", 901, "High")], "workbook_id string, target string, precedent string, link_count long, risk string")
    assert [r["precedent"] for r in report.dependency_tab(edges, 2).collect()] == ["U", "T"]
    assert report.score_rules(spark).count() == len(report.SCORE_RULES)


def test_masked_errors_spread_over_ranges_and_sheets(spark):
    """A broken cell, six hops on, a SUM over the range that holds the last, a sum over sheets, and what has no part in it."""
    jan = {"A1": "=1/0", "A2": "=A1+1", "A3": "=A2", "A4": "=A3", "A5": "=A4", "A6": "=A5", "A7": "=A6*2", "A8": 5, "B1": "=SUM(A7:A8)", "C1": 3, "C2": "=C1+1", "C3": '=IFERROR(C1,0)', "C4": "=C3+1", "D1": "=SUM(A1:Z900)"}
    m = model(spark, {"Jan": jan, "Feb": {"B1": 4, "C1": "=C2"}, "Mar": {"B1": 6, "E5": "=Dec!B1"}, "Dec": {"B1": "=SUM(Jan:Mar!B1)", "C1": "=SUM(Feb:Mar!B1)"}})
    broken = m.cells.where("sheet = 'Jan' AND addr = 'A1'")
    got = {(r["sheet"], r["row"], r["col"]): r["wave"] for r in graph.likely_masked(m, broken).collect()}
    assert got == {("Jan", 2, 1): 0, ("Jan", 3, 1): 1, ("Jan", 4, 1): 2, ("Jan", 5, 1): 3, ("Jan", 6, 1): 4, ("Jan", 7, 1): 5, ("Jan", 1, 2): 6, ("Dec", 1, 2): 7, ("Mar", 5, 5): 8, ("Jan", 3, 3): 0, ("Jan", 4, 3): 1}
    again = m.cells.select("workbook_id", "sheet", "row", "col").withColumn("value", F.lit(99.0))
    states = {(r["sheet"], r["row"], r["col"]): r["state"] for r in graph.recalculation(m.cells.withColumns({"kind": F.lit("number"), "num": F.lit(1.0)}), again, graph.likely_masked(m, broken)).collect()}
    assert states["Jan", 1, 2] == "likely masked" and states["Jan", 2, 3] == "mismatch"


def slow_cycles(edges):
    """node and smallest node of its cycle, by a search in depth there and back."""
    ahead, back = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    seen, order = set(), []
    for start in {x for e in edges for x in e}:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead.get(start, [])))]
        while stack:
            node, onward = stack[-1]
            new = next((x for x in onward if x not in seen), None)
            if new is None:
                order.append(stack.pop()[0])
            else:
                seen.add(new)
                stack.append((new, iter(ahead.get(new, []))))
    of = {}
    for start in reversed(order):
        if start not in of:
            group, todo = {start}, [start]
            while todo:
                todo += [x for x in back.get(todo.pop(), []) if x not in of and x not in group and not group.add(x)]
            of |= dict.fromkeys(group, min(group))
    size = {c: list(of.values()).count(c) for c in set(of.values())} if len(of) < 1000 else {c: 2 for c in set(of.values())}
    return {(n, c) for n, c in of.items() if size[c] > 1 or (n, n) in edges}


@pytest.mark.parametrize("seed", range(6))
def test_cycles_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice([5, 15, 40, 90])
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice([0.8, 1.2, 1.6, 2.5])))]
    got = {(x["node"], x["cycle"]) for x in graph.component_of_cycle(spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int")).collect()}
    assert got == slow_cycles(edges)


def test_long_rings_and_tails_take_few_rounds(spark):
    n, at = 5000, list(range(15000))
    random.Random(1).shuffle(at)
    ring = [(at[k], at[(k + 1) % n]) for k in range(n)]
    into = [(at[n + k], at[n + k + 1]) for k in range(n - 1)] + [(at[2 * n - 1], at[0])]
    out = [(at[7], at[2 * n])] + [(at[2 * n + k], at[2 * n + k + 1]) for k in range(n - 1)]
    began = time.time()
    got = {(x["node"], x["cycle"]) for x in graph.component_of_cycle(spark.createDataFrame(ring + into + out, "src int, dst int")).collect()}
    assert got == {(x, min(at[:n])) for x in at[:n]} and time.time() - began < 120


def some_ranges(seed):
    r = random.Random(seed)
    cells = [("w", "S", row, col, r.choice([r.uniform(-9, 9), r.uniform(-1e15, 1e15), 3e25])) for row in range(1, 200) for col in range(1, 8) if r.random() < 0.6]
    rects = []
    for k in range(60):
        r1, c1 = r.randrange(1, 210), r.randrange(1, 10)
        rects.append((k, "w", "S", r1, c1, r1 + r.choice([0, 3, 100, 1_048_000]), c1 + r.choice([0, 0, 2, 16_000])))
    return cells, [*rects, (60, "w", "S", 9, 1, 3, 1), (61, "w", "Other", 1, 1, 9, 9), *[(100 + k, *rects[0][1:]) for k in range(3)]]


def test_ranges_by_running_sums(spark):
    """Sums, counts and coverage of overlapping, empty, very high and very wide ranges, with numbers of any size."""
    cells, rects = some_ranges(5)
    inside = lambda q: [c[4] for c in cells if c[1] == q[2] and q[3] <= c[2] <= q[5] and q[4] <= c[3] <= q[6]]
    frame = spark.createDataFrame(cells, "workbook_id string, sheet string, row int, col int, value double")
    boxes = spark.createDataFrame(rects, "k int, workbook_id string, to_sheet string, r1 int, c1 int, r2 int, c2 int")
    got = {r["k"]: (r["total"], r["n"]) for r in ranges.range_sums(boxes, frame, ["k"]).collect()}
    want = {q[0]: (math.fsum(inside(q)), len(inside(q))) for q in rects if inside(q)}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], rel_tol=1e-9, abs_tol=1e-5) for k in want)
    hits = {(r["row"], r["col"]): r["ranges"] for r in ranges.covered_cells(boxes, frame).collect()}
    many = {(c[2], c[3]): sum(q[2] == "S" and q[3] <= c[2] <= q[5] and q[4] <= c[3] <= q[6] for q in rects) for c in cells}
    assert hits == {k: n for k, n in many.items() if n}
    by_place = ranges.range_sums(boxes.withColumns({"row": F.col("k"), "col": F.col("k")}), frame, ["row", "col"]).collect()
    assert {r["row"]: r["n"] for r in by_place} == {k: n for k, (_, n) in got.items()} and all(r["row"] == r["col"] for r in by_place)
    plan = ranges.range_sums(boxes, frame, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2  # one for exact sums, one that finds the large numbers: neither joins ranges with cells


def test_ten_thousand_ranges_over_one_column(spark):
    cells = spark.range(1, 300_001).select(F.lit("w").alias("workbook_id"), F.lit("S").alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), (F.col("id") % 10).cast("double").alias("value"))
    boxes = spark.range(10_000).select("id", F.lit("w").alias("workbook_id"), F.lit("S").alias("to_sheet"), (F.col("id") + 1).cast("int").alias("r1"), F.lit(1).alias("c1"), (300_000 - F.col("id")).cast("int").alias("r2"), F.lit(1).alias("c2"))
    began = time.time()
    r = ranges.range_sums(boxes, cells, ["id"]).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("total").alias("most")).first()
    assert (r["k"], r["n"], r["most"]) == (10_000, sum(300_000 - 2 * k for k in range(10_000)), 1_350_000.0) and time.time() - began < 120
