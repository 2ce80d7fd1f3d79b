"""What checks emit: findings with fixed severity, confidence and urgency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URGENCY = {"N": "Before next reliance", "S": "Next scheduled review", "I": "Informational", "X": "Before external circulation", "W": "When convenient", "!": "Immediate"}
#: Check -> (severity, confidence, urgency).
EMITS = {
    "T0-COMPLEXFML-001": ("low", 30, "I"), "T0-CONSTFORMULA-001": ("low", 40, "S"), "T0-TEXTBOOLFLAG-001": ("low", 80, "N"), "T0-FLAGERRMASK-001": ("medium", 75, "N"),
    "T0-IFERRLIT-001": ("medium", 80, "N"), "T0-ERRLITERAL-001": ("high", 75, "N"), "T0-2DIGITYEAR-001": ("medium", 45, "S"), "T0-OVERFLOW-001": ("low", 35, "S"),
    "T0-MIXEDREF-001": ("low", 35, "S"), "T0-WSSHEETNAME-001": ("low", 60, "S"), "T0-HIDDENFORMULA-001": ("medium", 65, "N"), "T0-NUMASTEXT-001": ("medium", 70, "N"),
    "T0-LOOKUPMATCH-001": ("medium", 75, "N"), "T0-DISPLAYZERO-001": ("low", 60, "S"), "T0-UNITHIDE-001": ("low", 40, "S"), "T0-STDEVA-001": ("low", 65, "S"),
    "T0-CELLLOCK-001": ("low", 55, "S"), "T0-DATAVALID-001": ("low", 40, "I"), "T0-NPV-001": ("medium", 90, "N"), "T0-NESTEDIF-001": ("medium", 95, "N"),
    "T0-MERGE-001": ("low", 100, "W"), "T0-HIDDEN-001": ("high", 100, "N"), "T0-HIDDEN-002": ("low", 100, "I"), "T0-ERRMASK-001": ("medium", 65, "W"),
    "T0-PII-001": ("high", 85, "X"), "T0-INDIRECT-001": ("medium", 100, "N"), "T0-DUP-001": ("medium", 90, "N"), "T0-NPVP0-001": ("medium", 70, "N"),
    "T0-PMTSIGN-001": ("medium", 70, "N"), "T0-IMPOSSIBLETARGET": ("high", 99, "N"), "T0-COVENANT": ("high", 92, "N"), "T0-EXCEPTIONSTATUS": ("medium", 90, "N"),
    "T0-FORMULACOUNTMISMATCH": ("low", 80, "I"), "T0-MISSINGSHEETREF": ("medium", 85, "N"), "T0-BSPLUG-001": ("medium", 55, "N"), "T0-BLANKBOUND-001": ("low", 55, "S"),
    "T0-EQPLUG": ("high", 85, "N"), "T0-HARDCHECK-001": ("high", 85, "N"), "T0-MASTERCONTROL": ("critical", 98, "!"), "T0-ZEROBASERATE-001": ("medium", 80, "N"),
    "T0-DATEGATE": ("medium", 88, "N"), "T0-DSRASIZE-001": ("medium", 55, "N"), "T0-RSN-001": ("high", 90, "X"), "T0-RSN-002": ("high", 85, "X"), "T0-RSN-003": ("high", 75, "X"),
    "T0-RSN-004": ("medium", 40, "S"), "T0-RSN-005": ("medium", 40, "X"), "T0-RSN-006": ("high", 95, "X"), "T0-RSN-007": ("high", 90, "N"), "T0-RSN-008": ("high", 75, "N"), "T0-RSN-009": ("high", 85, "N"),
    "T0-FMLPATTERN-001": ("medium", 60, "N"), "T0-COLPATTERN-001": ("medium", 55, "N"), "T0-REGIMECHANGE": ("medium", 55, "N"), "T0-PERIODGAP-001": ("medium", 60, "N"),
    "T0-TERMPERIOD-001": ("medium", 55, "N"), "T0-HARDASSET": ("high", 75, "N"), "T0-BALNEG": ("high", 75, "N"), "T0-SIGNCONV": ("medium", 75, "N"),
    "T0-AUTOSUMHDR-001": ("medium", 65, "N"), "T0-TOTALRANGE": ("medium", 85, "N"), "T0-OFFBYONE-001": ("medium", 70, "N"), "T0-AGGMISMATCH-001": ("high", 90, "N"),
    "T0-RANGEDUP-001": ("high", 80, "N"), "T0-CROSSCAST-001": ("high", 65, "N"), "T0-DUPCALC": ("medium", 70, "S"), "T0-REVDOUBLE-001": ("high", 50, "N"),
    "T0-ERRSCANCOVERAGE": ("high", 90, "N"), "T0-GATECOVERAGE": ("high", 90, "N"), "T0-IRRSIGN-001": ("medium", 80, "N"), "T0-IRRMULTISIGN-001": ("medium", 75, "N"),
    "T0-BLANKCELLREF": ("low", 40, "S"), "T0-BASISMISMATCH": ("medium", 70, "N"), "T0-RI-001": ("medium", 95, "N"), "T0-NR-001": ("critical", 95, "N"), "T0-NR-002": ("high", 85, "N"),
    "T0-DSCRGATE-001": ("critical", 65, "N"), "T0-REVCASH-001": ("medium", 50, "N"), "T0-TAXRATE-001": ("medium", 45, "N"), "T0-LINK-001": ("critical", 90, "N"),
    "T0-CIRC-001": ("high", 80, "N"), "T0-CIRC-002": ("low", 75, "W"), "T0-CHAIN": ("medium", 70, "N"), "T0-DAISYCHAIN-001": ("low", 50, "S"), "T0-RECALC-001": ("high", 95, "N"), "T0-RECALC-002": ("high", 90, "N"),
    "T0-VBA-001": ("medium", 100, "N"), "T0-VBA-002": ("high", 100, "N"), "T0-VBA-003": ("medium", 95, "N"), "T0-VBA-004": ("high", 95, "N"), "T0-VBA-005": ("high", 90, "N"),
}


def emits(check_id: str) -> tuple[Column, Column, Column]:
    severity, confidence, urgency = EMITS[check_id]
    return F.lit(severity), F.lit(confidence), F.lit(URGENCY[urgency])


def finding(df: DataFrame, check_id: str, detail: Column | None = None) -> DataFrame:
    """Rows of a check as findings. df needs workbook_id and sheet; row, col and addr are null where it has none."""
    col = lambda name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
    severity, confidence, urgency = emits(check_id)
    return df.select(
        "workbook_id", F.lit(check_id).alias("check_id"), col("sheet", "string"), col("row", "int"), col("col", "int"), col("addr", "string"),
        severity.alias("severity"), confidence.alias("confidence"), urgency.alias("urgency"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )
