"""Driver tables as cells, edges, series and findings.

Each projection is SQL that Spark and DuckDB read alike; `{table}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.model import Model

_SHEET = "concat('S', CAST(CAST(floor(o_orderkey / 3000) AS INT) AS STRING))"
_ROW = "CAST(floor((o_orderkey % 3000) / 12) AS INT) + 2"
GRID = f"""SELECT {_SHEET} AS sheet, {_ROW} AS row_no, CAST(o_orderkey % 12 AS INT) + 3 AS col_no,
  o_totalprice AS num, CAST(o_orderdate AS DATE) AS dt, o_orderstatus AS txt FROM {{orders}}"""
LABELS = f"""SELECT DISTINCT {_SHEET} AS sheet, {_ROW} AS row_no, 1 AS col_no,
  CASE CAST(floor((o_orderkey % 3000) / 12) AS INT) % 5 WHEN 0 THEN 'Total revenue' WHEN 1 THEN 'Closing cash'
    WHEN 2 THEN 'Debt balance' WHEN 3 THEN 'Interest expense' ELSE 'Check' END AS txt FROM {{orders}}"""
#: Formula texts by p_partkey % 24; r is the row, s the part's size.
TEMPLATES = (
    "SUM(A[r]:B[r])", "IF(A1>[s],IF(B1>2,1,0),0)", "VLOOKUP(A[r],F1!$A$1:$D$50,2)", "IFERROR(A1/B[r],0)", "OFFSET(A1,[s],0)", "NPV(0.1,C1:C9)", "F2!C[r]", "A[r]*B[r]+$C$3",
    "IFERROR(A1/B1,[s])", "5*12+[s]", 'IF(A1>0,"true","false")', "PRODUCT(A1/B[r],2)", "IF(A1=0,#N/A,B[r])", "VALUE(RIGHT(A[r],2))", "SUM($A1:A$9)", "STDEVA(A1:A9)+VARA(B1:B3)",
    "MATCH(A1,B1:B9,0)+VLOOKUP(A1,B1:C9,2,FALSE)", "TODAY()+[[Book2.xlsx]]Sheet1!A1", "PMT(0.1/12,[s],-A[r])", "PMT(0.1/12,[s],A[r])", "IF(A1=0,TRUE,B1>1.2)", "COUNTA(A1:A5)+COUNTA(B1:B3)=40", "ROUND(A1,2)=ROUND(B1,2)", "SUM(C2:C[r])-XNPV(0.1,A1:A9,B1:B9)",
)


def _template(t: str) -> str:
    r, s = "CAST(p_partkey + 1 AS STRING)", "CAST(p_size AS STRING)"
    parts = t.replace("[[", "\0").replace("]]", "\1").replace("[r]", f"', {r}, '").replace("[s]", f"', {s}, '")
    return "concat('" + parts.replace("\0", "[").replace("\1", "]") + "')"


FORMULAS = (
    "SELECT concat('F', CAST(p_size % 5 AS STRING)) AS sheet, CAST(p_partkey AS INT) + 1 AS row_no, 3 AS col_no, p_retailprice AS num, CAST(p_partkey % 24 AS INT) AS template_no, CAST(p_size AS INT) AS size, CASE p_partkey % 24 "
    + " ".join(f"WHEN {k} THEN {_template(t)}" for k, t in enumerate(TEMPLATES))
    + " END AS formula FROM {part}"
)
EDGES = "SELECT CAST(n_nationkey AS INT) AS src, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS dst, CAST(n_nationkey % 4 AS INT) + 1 AS link_count FROM {nation}"
SERIES = "SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, round(sum(value), 2) AS v FROM {events} GROUP BY user_id, CAST(ts AS DATE)"
FINDINGS = """SELECT concat('T0-', l_returnflag, '-', CAST(l_linenumber AS STRING)) AS check_id, concat('R', CAST(l_orderkey AS STRING)) AS sheet,
  CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'fatal' WHEN 3 THEN 'high' WHEN 4 THEN 'medium' WHEN 5 THEN 'low' WHEN 6 THEN 'high' ELSE 'info' END AS severity,
  CAST(l_quantity * 2 AS INT) AS confidence, CASE WHEN l_linestatus = 'F' THEN 'Debt' ELSE 'Structure' END AS category,
  CASE WHEN l_linenumber = 7 THEN 'Informational' ELSE 'Before next reliance' END AS urgency, count(*) AS n FROM {lineitem} GROUP BY ALL"""
RUNS = """SELECT concat('K', CAST(o_custkey % 40 AS STRING), '::', CAST(o_orderkey AS STRING)) AS fingerprint,
  (o_orderkey % 7 <> 0) AS in_prior, (o_orderkey % 5 <> 0) AS in_current, (o_orderkey % 11 = 0) AS prior_closed FROM {orders}"""
_TABLES = ("orders", "part", "nation", "events", "lineitem", "customer", "supplier", "region", "documents", "conversations", "pages")


def duck(sql: str) -> str:
    """The projection as DuckDB reads it."""
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(df: DataFrame, kind: str, **more) -> DataFrame:
    out = df.withColumnsRenamed({"row_no": "row", "col_no": "col"}).withColumns({"workbook_id": F.lit("w"), "kind": F.lit(kind), "sheet_idx": F.substring("sheet", 2, 9).cast("int")})
    return out.withColumns(more)


def formula_model(spark: SparkSession, sf_dir: str) -> Model:
    """The formulas of `part` as a workbook of five sheets."""
    return Model.of(spark, _cells(project(spark, sf_dir, FORMULAS), "number"))


def grid_model(spark: SparkSession, sf_dir: str) -> Model:
    """The labels and numbers of `orders` as a workbook."""
    numbers = _cells(project(spark, sf_dir, GRID), "number").select("workbook_id", "sheet_idx", "sheet", "row", "col", "kind", "num")
    labels = _cells(project(spark, sf_dir, LABELS), "text").select("workbook_id", "sheet_idx", "sheet", "row", "col", "kind", "txt")
    return Model.of(spark, numbers.unionByName(labels, allowMissingColumns=True))
