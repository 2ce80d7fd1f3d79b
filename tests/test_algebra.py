"""Findings: types, risk, history, coverage, verdict."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import algebra
from tallygrid.plans import report


def test_record_types(spark):
    rows = [("critical", 90, "N", "", "Confirmed Finding"), ("critical", 79, "N", "", "Critical Query"), ("high", 59, "N", "debt", "Critical Query"), ("high", 59, "N", "", "Query"), ("low", None, "N", "", "Confirmed Finding"), ("low", 90, "Informational", "", "Observation"), ("info", 90, "N", "", "Observation")]
    df = spark.createDataFrame(rows, "s string, c int, u string, h string, want string")
    assert df.where(algebra.record_type(F.col("s"), F.col("c"), F.col("u"), F.col("h")) != F.col("want")).count() == 0


def test_risk_parts(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert [one(algebra.consequence(F.lit(h), F.lit(k))) for h, k in (("", None), ("debt", None), ("debt", "IRR"), ("", "IRR"), ("terminal value", None))] == [2, 4, 5, 3, 2]
    assert [one(algebra.exposure(F.lit(n))) for n in (0, 1, 5, 10, 50)] == [1, 2, 3, 4, 5]
    assert [one(algebra.propagation(F.lit(s), F.lit(c))) for s, c in ((5, 1), (3, 1), (2, 1), (1, 2), (1, 1))] == [5, 4, 3, 2, 1]
    assert [one(algebra.control_weakness(F.lit(c), F.lit(r))) for c, r in ((90, False), (84, False), (60, True), (None, None))] == [2, 3, 5, 2]


def test_fingerprints_and_runs(spark):
    found = spark.createDataFrame([("A", "l", "P1", "x"), ("B", "l", "P2", "x")], "check_id string, label string, priority string, record_type string")
    prints = algebra.fingerprints(found, spark.createDataFrame([("A", "S!A1"), ("A", "S!B2"), ("A", "S!B2")], "check_id string, cell string"))
    assert {r["fingerprint"] for r in prints.collect()} == {"A::S!A1", "A::S!B2", "B"}
    none = spark.createDataFrame([], "fingerprint string, status string, times_closed int")
    first = algebra.cross_run(prints, none)
    assert {r["state"] for r in first.collect()} == {"new"}
    later = algebra.cross_run(prints.where("check_id = 'B'"), algebra.merged_history(first))
    assert {r["fingerprint"]: (r["state"], r["times_closed"]) for r in later.collect()} == {"A::S!A1": ("closed", 1), "A::S!B2": ("closed", 1), "B": ("still open", 0)}
    again = algebra.cross_run(prints, algebra.merged_history(later))
    assert {r["state"] for r in again.collect()} == {"regressed", "still open"}
    assert {r["state"]: r["root_causes"] for r in algebra.run_summary(again).collect()} == {"regressed": 1, "still open": 1}


@pytest.mark.parametrize("most", [algebra.MOST_BROADCAST, 1])
def test_cells_of_a_check_are_not_dealt_by_check(spark, monkeypatch, most):
    monkeypatch.setattr(algebra, "MOST_BROADCAST", most)
    heads = [("A", "l", "P1", "x"), ("A", "m", "P3", "y"), ("A", "m", "P2", "z"), ("A::b", "n", "P2", "x"), ("B", "l", "P2", "x"), ("C", "k", None, "x"), (None, "l", "P2", "x")]
    cells = [("A", f"S!A{k % 50}") for k in range(200)] + [("A", "b::S!A1"), ("A::b", "S!A1"), ("C", None), ("D", "S!A1"), (None, "S!A1")]
    want: dict = {}
    for check, *rest in heads:
        for cell in {c for k, c in cells if k == check and k is not None} or {None}:
            print_ = check if cell is None else f"{check}::{cell}"
            label, priority, kind = rest
            row = (label, check, cell, priority, kind)
            key = tuple((x is not None, x or "") for x in row)
            want[print_] = max(want.get(print_, (key, row)), (key, row))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = algebra.fingerprints(spark.createDataFrame(heads, "check_id string, label string, priority string, record_type string"), spark.createDataFrame(cells, "check_id string, cell string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r["fingerprint"]: tuple(r)[1:] for r in got.collect()} == {k: row for k, (_, row) in want.items()} and got.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftOuter" not in plan and ("BroadcastHashJoin" in plan) == (most > 1)


def test_verdicts(spark):
    rows = [(1, 0, 0, 90, False, "internal only"), (0, 0, 1, 90, False, "internal only"), (1, 0, 0, 40, False, "not ready"), (0, 0, 1, 40, False, "not ready"), (0, 0, 0, 85, False, "lender"), (0, 0, 0, 65, False, "management"), (0, 0, 0, 30, False, "internal only"), (0, 3, 0, 97, True, "transaction"), (0, 3, 0, 97, False, "lender")]
    df = spark.createDataFrame(rows, "p1 int, p2 int, cq int, r int, a boolean, want string")
    assert df.where(algebra.verdict(F.col("p1"), F.col("p2"), F.col("cq"), F.col("r"), F.col("a")) != F.col("want")).count() == 0


def test_coverage(spark):
    rules = spark.createDataFrame([("T1-1",), ("T1-2",), ("T1",)], "rule_id string")
    results = spark.createDataFrame([("T1-1-Sheet", "fail"), ("T1-1-B", "pass"), ("T1-22", "pass")], "id string, status string")
    got = {r["rule_id"]: r["state"] for r in algebra.coverage(rules, results).collect()}
    assert got == {"T1-1": "issue", "T1-2": "not run", "T1": "issue"}
    assert algebra.conclusive_share(algebra.coverage(rules, results)).first()["conclusive"] == 67
    found = spark.createDataFrame([("T1-1", "S", "A1")], "check_id string, sheet string, addr string")
    assert {r["rule_id"]: r["places"] for r in report.validation_matrix(rules, results, found).collect()}["T1-1"] == "S!A1"


def test_same_as_and_tiers(spark):
    rows = [("A", "Real"), ("B", "Same as A"), ("C", "same as B"), ("D", "Same as Z")]
    out = {r["id"]: r["also"] for r in algebra.same_as(spark.createDataFrame(rows, "id string, reason string")).collect()}
    assert out == {"A": ["B", "C"], "D": None}
    tiers = spark.createDataFrame([(0, 1, "x", "r", "l", "S"), (0, 2, "x", "r", "l", "S"), (1, 3, "y", "r", "l", "S"), (2, 4, "y", "r", "l", "S")], "tier int, seq int, id string, reason string, label string, sheet string")
    assert sorted((r["tier"], r["seq"]) for r in algebra.first_of_tiers(tiers).collect()) == [(0, 1), (0, 2), (1, 3)]


def test_due_dates(spark):
    df = spark.createDataFrame([("P1",), ("P2",), ("Query",)], "priority string")
    log = report.issue_log(df, "2026-01-01")
    assert [str(r["target_date"]) for r in log.collect()] == ["2026-01-08", "2026-01-31", "2026-04-01"]
    assert [r["timing"] for r in report.remediation(log, "2026-01-25").collect()] == ["Overdue", "Due Soon"]


def test_root_causes_are_bounded_and_ordered(spark):
    rows = [("w", "A", "S", k, 1, f"A{k}", "low" if k % 2 else "high", 90 - k, "N") for k in range(1, 60)] + [("w", "A", "R", 7, 2, None, "high", 50, "X"), ("w", "B", None, None, None, None, "info", 10, "I"), ("w", "A", "S", 3, 1, "A3", "high", 1, "N")]
    found = spark.createDataFrame(rows, "workbook_id string, check_id string, sheet string, row int, col int, addr string, severity string, confidence int, urgency string")
    got = {r["check_id"]: r for r in algebra.root_causes(found, shown=4).collect()}
    a, b = got["A"], got["B"]
    assert (a["occurrence_count"], a["material_occurrence_count"], a["cell_count"], a["sheet_count"]) == (61, 31, 61, 2)
    assert a["affected_cells"] == ["R!Row7", "S!A1", "S!A2", "S!A3"] and a["affected_sheets"] == ["R", "S"] and (a["severity"], a["confidence"], a["urgency"]) == ("high", 50, "X")
    assert (b["occurrence_count"], b["cell_count"], b["sheet_count"], b["affected_cells"]) == (1, 0, 0, [])


def test_top_blockers_and_scores(spark):
    rows = [("A", "P2", 20, True, 3, "S", 1, 1), ("B", "P1", 12, False, 9, "S", 1, 2), ("C", "Critical Query", None, True, 1, "S", 2, 1), ("D", "P1", 12, True, 1, "S", 3, 1), ("E", "Query", 30, True, 1, "S", 4, 1)]
    found = spark.createDataFrame(rows, "check_id string, priority string, risk_weighted_total int, key_output boolean, fscore int, sheet string, row int, col int")
    assert [r["check_id"] for r in algebra.top_blockers(found, 4).collect()] == ["D", "B", "C", "A"]
    index = spark.createDataFrame([("w", "S", 1, 2, 14, "Critical")], "workbook_id string, sheet string, row int, col int, fscore int, band string")
    scored = algebra.with_scores(found.drop("fscore").withColumn("workbook_id", F.lit("w")), index).collect()
    assert {r["check_id"]: r["band"] for r in scored} == {"A": None, "B": "Critical", "C": None, "D": None, "E": None}
