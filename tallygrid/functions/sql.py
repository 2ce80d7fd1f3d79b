"""The formula tokenizer for SQL: table functions to use with LATERAL.

    register(spark)
    spark.sql("SELECT c.fn, count(*) FROM cells, LATERAL formula_calls(cells.formula) c GROUP BY c.fn")

They read one formula to a row; where formulas repeat, take distinct ones first and join back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallygrid.functions import tokens

#: The tokenizer's tables without the formula, which the outer row has.
CALLS, REFS = (columns.split(", ", 1)[1] for columns in (tokens.CALLS, tokens.REFS))


class FormulaCalls:
    """The calls of a formula; a null one has none."""

    def eval(self, formula: str) -> Iterator[tuple]:
        for call in tokens.calls_of(formula or ""):
            yield call[1:]


class FormulaRefs:
    """The references of a formula; a null one has none."""

    def eval(self, formula: str) -> Iterator[tuple]:
        for ref in tokens.refs_of(formula or ""):
            yield ref[1:]


def register(spark: SparkSession) -> None:
    """Adds formula_calls(formula) and formula_refs(formula) to the session."""
    spark.udtf.register("formula_calls", udtf(FormulaCalls, returnType=CALLS))
    spark.udtf.register("formula_refs", udtf(FormulaRefs, returnType=REFS))
