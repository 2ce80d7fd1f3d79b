"""Result sets of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallygrid.operators import algebra

#: What each error code means.
ERROR_GUIDE = {
    "#REF!": "a reference to a cell that is gone", "#VALUE!": "an operand of the wrong type", "#DIV/0!": "a division by zero", "#N/A": "a lookup without a match",
    "#NAME?": "an unknown name", "#NULL!": "an empty intersection", "#NUM!": "an impossible number", "#SPILL!": "a result without room",
}
SCORE_RULES = (
    ("Length over 100 / 250 / 500 characters", "+1 / +2 / +3"), ("IF, IFS, CHOOSE, SWITCH", "+1 each"), ("Lookup functions", "+1"), ("OFFSET, INDIRECT", "+3"), ("Volatile functions", "+3"),
    ("External link", "+5"), ("Hard-coded number", "+1"), ("Error suppression", "+1"), ("Other sheets", "+1"), ("Over 5 / 10 operators", "+1 / +2"),
)


def area_register(findings: DataFrame, text: str, areas: dict[str, tuple[str, ...]]) -> DataFrame:
    """How many findings speak of each area; areas without any have 0. Each text is read once."""
    low = F.lower(text)
    hits = []
    for area, words in areas.items():
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        hits.append(F.count_if(F.coalesce(any_of, F.lit(False))).alias(area))
    wide = findings.agg(*hits)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("area"), F.col(f"`{a}`").alias("findings")) for a in areas))).alias("x")).select("x.*")


def issue_log(findings: DataFrame, reported: str) -> DataFrame:
    """Findings with target dates, in the order they are listed."""
    rank = F.when(F.col("priority") == "P1", 0).when(F.col("priority") == "Critical Query", 1).when(F.col("priority") == "P2", 2).when(F.col("priority") == "P3", 3).otherwise(4)
    return findings.withColumns({"target_date": algebra.due(F.col("priority"), F.to_date(F.lit(reported))), "rank": rank})


def remediation(log: DataFrame, today: str) -> DataFrame:
    """What is to be mended, with how its date stands."""
    return log.where(F.col("priority").isin("P1", "P2", "Critical Query")).withColumn("timing", algebra.timing(F.col("target_date"), F.to_date(F.lit(today))))


def validation_matrix(rules: DataFrame, results: DataFrame, findings: DataFrame) -> DataFrame:
    """Each rule with its state, its number of findings and the first four of their places."""
    states = algebra.coverage(rules, results)
    place = F.concat_ws("!", "sheet", "addr")
    some = findings.groupBy(F.col("check_id").alias("rule_id")).agg(F.count("*").alias("findings"), F.array_join(F.slice(F.array_sort(F.collect_set(place)), 1, 4), ", ").alias("places"))
    return states.join(some, "rule_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def formula_review(unique: DataFrame, n: int = 200) -> DataFrame:
    """The n most complex unique formulas."""
    return unique.orderBy(F.desc("fscore"), "ufi").limit(n)


def errors_with_guide(matrix: DataFrame) -> DataFrame:
    guide = F.create_map(*(F.lit(x) for kv in ERROR_GUIDE.items() for x in kv))
    return matrix.withColumn("meaning", F.coalesce(F.try_element_at(guide, F.col("err")), F.lit("unknown"))).orderBy(F.desc("cells"), "err")


def dependency_tab(edges: DataFrame, n: int = 100) -> DataFrame:
    """The first n edges by sheet names, then by risk and links."""
    first = edges.withColumn("k", F.row_number().over(W.partitionBy("workbook_id").orderBy("target", "precedent"))).where(F.col("k") <= n).drop("k")
    rank = F.when(F.col("risk") == "High", 1).when(F.col("risk") == "Moderate", 2).otherwise(3)
    return first.orderBy(rank, F.desc("link_count"), "target", "precedent")


def score_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(SCORE_RULES), "rule string, points string")


def headline(findings: DataFrame, readiness: int, approved: bool) -> DataFrame:
    """Counts by priority and the verdict of each workbook."""
    n = findings.groupBy("workbook_id").agg(*(F.count_if(F.col("priority") == p).alias(a) for p, a in (("P1", "p1"), ("P2", "p2"), ("P3", "p3"), ("Critical Query", "critical_queries"))), F.bool_or(F.startswith("check_id", F.lit("T0-CHAIN"))).alias("chain"))
    return n.withColumn("verdict", algebra.verdict(F.col("p1"), F.col("p2"), F.col("critical_queries"), F.lit(readiness), F.lit(approved), F.col("chain")))
