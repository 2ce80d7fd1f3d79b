"""Names that are found by their words."""

from pyspark.sql import functions as F

from tallygrid.operators import domains, rules


def slow_level(sheet, alias):
    import re

    plain = lambda x: re.sub(r"[\s\-_.]+", "", x.lower())
    words = lambda x: f" {re.sub(r'[^a-z0-9]+', ' ', x.lower()).strip()} "
    if sheet == alias:
        return 0
    if sheet.lower() == alias.lower():
        return 1
    if plain(sheet) == plain(alias):
        return 2
    return 3 if words(alias) in words(sheet) or words(sheet) in words(alias) else None


def test_aliases_resolve_as_by_trying_all(spark):
    sheets = ["Cash Flow", "cash-flow", "CASHFLOW", "Cash", "P&L", "P & L (annual)", "--", "Debt service 2", "debt", "Balance  Sheet", "flow cash", "x"]
    lists = ["Cash Flow,Debt", "annual", "cash flow statement,Debt", "balance.sheet", "++,x", "nothing", "l annual", "service", "CASH", "Debt Service"]
    model = spark.createDataFrame([("w", k, s) for k, s in enumerate(sheets)] + [("v", k, s) for k, s in enumerate(sheets[::-1])], "workbook_id string, sheet_idx int, sheet string")
    asked = spark.createDataFrame([(f"r{k}", {"sheets": x}) for k, x in enumerate(lists)], "rule_id string, params map<string,string>")
    found = rules.resolved(asked, model)
    got = {(r["rule_id"], r["workbook_id"]): r["sheet"] for r in found.collect()}
    want = {}
    for k, x in enumerate(lists):
        for w, tabs in (("w", sheets), ("v", sheets[::-1])):
            hits = [(a, level, i, s) for a, alias in enumerate(x.split(",")) for i, s in enumerate(tabs) if (level := slow_level(s, alias)) is not None]
            if hits:
                want[f"r{k}", w] = min(hits)[3]
    assert got == want and ("r5", "w") not in got
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_domains(spark):
    cases = {
        "Property": "property", "real  estate": "real  estate", "Real Estate fund": "property", "railways": "railways", "Rail-transport": "infrastructure", "a coal mine": "mining",
        "mixed-use site": "property", "mixed use": "property", "coal and property": "property", "": "", "-": "-", "charcoal": "charcoal", "(Minerals)": "mining",
    }
    rows = spark.createDataFrame([*((x,) for x in cases), (None,), ("Property",)], "label string")
    got = domains.with_domain(rows, "label").collect()
    assert {r["label"]: r["domain"] for r in got} == {**cases, None: None} and len(got) == len(cases) + 2
    assert domains.with_domain(rows.where("false"), "label").count() == 0
    assert rows.where("label = 'Real Estate fund'").select(domains.phrases(F.col("label"), 2)).first()[0] == ["real", "real estate", "estate", "estate fund", "fund"]
