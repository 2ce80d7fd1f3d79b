"""The tokenizer as table functions gives the rows of the DataFrame form."""

from tallygrid.functions import sql
from tests.grids import model


def test_calls_and_references_in_sql(spark):
    m = model(spark, {"S": {"A1": "=IF(SUM(B1:B3)>1,VLOOKUP(A2,'Other sheet'!$A:$C,2),\"A9\")", "A2": "=B$1+Data!C4", "A3": "=5", "A4": "=IF(", "A5": 3}})
    sql.register(spark)
    for name, frame in (("formula_calls", m.calls), ("formula_refs", m.refs)):
        columns = [c.split()[0] for c in (sql.CALLS if name == "formula_calls" else sql.REFS).split(", ")]
        rows = spark.sql(f"SELECT addr, t.* FROM {{cells}} c, LATERAL {name}(c.formula) t", cells=m.cells)
        assert rows.columns[1:] == columns
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, frame.select("addr", *columns).collect())) and rows.count() >= 2
