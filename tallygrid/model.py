"""The cell model: one row for each populated cell of a workbook, and what is derived from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions import tokens
from tallygrid.functions.addresses import address

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}


def schema(text: str) -> T.StructType:
    """A schema from `name type, ...`; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


CELL = schema(
    "workbook_id string, sheet_idx int, sheet string, row int, col int, kind string, num double, txt string, bool boolean, dt timestamp, err string, "
    "formula string, formula_kind string, num_fmt string, font_argb string, fill_argb string, locked boolean, formula_hidden boolean, has_dv boolean, merged boolean"
)
SHEET = schema("workbook_id string, sheet_idx int, sheet string, protected boolean, merges array<string>, hidden_rows array<int>, hidden_cols array<int>")
NAME = schema("workbook_id string, name string, ranges array<string>")
PLACE = ["workbook_id", "sheet", "row", "col"]


def conform(df: DataFrame, columns: T.StructType) -> DataFrame:
    """df's columns of the schema, cast; missing ones are null, others are left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns))


@dataclass
class Model:
    """The tables that checks read. calls and refs are frames, made again for each check; tokenized() writes them once."""

    cells: DataFrame
    sheets: DataFrame
    names: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, cells: DataFrame, sheets: DataFrame | None = None, names: DataFrame | None = None) -> Model:
        cells = conform(cells, CELL).withColumn("addr", address(F.col("row"), F.col("col")))
        if sheets is None:
            sheets = cells.groupBy("workbook_id", "sheet").agg(F.min("sheet_idx").alias("sheet_idx"))
        return cls(cells, conform(sheets, SHEET), conform(names, NAME) if names is not None else spark.createDataFrame([], NAME))

    @cached_property
    def formulas(self) -> DataFrame:
        return self.cells.where("formula IS NOT NULL")

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with the place of their cell."""
        return self.formulas.select(*PLACE, "sheet_idx", "addr", "formula").join(tokens.calls(self.formulas), "formula")

    @cached_property
    def refs(self) -> DataFrame:
        """References with the place of their cell; to_sheet is the sheet they lead to."""
        return self.formulas.select(*PLACE, "sheet_idx", "addr", "formula").join(tokens.refs(self.formulas), "formula").withColumn("to_sheet", F.coalesce("tgt_sheet", "sheet"))

    def tokenized(self) -> Model:
        """The model with its calls and references written once to the shared folder, for audits of several checks."""
        from tallygrid.operators.graph import cut  # which reads models itself

        out = Model(self.cells, self.sheets, self.names)
        out.__dict__.update(calls=cut(self.calls), refs=cut(self.refs))
        return out

    @cached_property
    def texts(self) -> DataFrame:
        """Literal text cells."""
        return self.cells.where("kind = 'text' AND formula IS NULL AND txt IS NOT NULL")
