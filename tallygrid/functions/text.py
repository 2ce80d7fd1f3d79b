"""Text helpers: labels, numbers as text, personal data, sheet and model names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of personal data and of numbers stored as text.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
BANKING = r"(?i)\b(BSB|bank account|account number|TFN|tax file number|bank details|payee|payroll|super(annuation)?|salary)\b"
NUMBER_LIKE = r"^\s*(-?\$?[\d,]+\.?\d*%?|\(\$?[\d,]+\.?\d*%?\))\s*$"
BACKUP_SHEET = r"(?i)\b(backup|copy|duplicate|old|archive)\b"


def normal_label(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(label), r"[-\s]+", " "))


def looks_like_number(text: Column) -> Column:
    """Text that holds a number but no bare year from 1990 to 2100."""
    year = F.when(text.rlike(r"^\s*\d{4}\s*$"), F.btrim(text, F.lit(" \t\n\r")).try_cast("int"))
    return text.rlike(NUMBER_LIKE) & text.rlike(r"\d") & ~F.coalesce(year.between(1990, 2100), F.lit(False))


def redact(text: Column) -> Column:
    """All but the first and last two characters as stars; all of them up to four."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))


def blank_strings(formula: Column) -> Column:
    """String literals with their quotes as spaces of the same length; an unclosed one stays."""
    parts = F.split(formula, '"')
    n = F.size(parts)
    last_open = (n % 2) == 0
    kept = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & ~((i == n - 1) & last_open), F.concat(F.lit(" "), F.repeat(F.lit(" "), F.length(p)), F.lit(" "))).when((i == n - 1) & last_open, F.concat(F.lit('"'), p)).otherwise(p))
    return F.array_join(kept, "")


def keyword_in_sheet(sheet: Column, keyword: str) -> Column:
    """A whole word for keywords of up to 6 characters, else containment either way."""
    low = keyword.lower()
    if len(low) <= 6:
        return sheet.rlike("(?i)(?<![a-z0-9])" + re.escape(low) + "(?![a-z0-9])")
    return F.lower(sheet).contains(low) | F.lit(low).contains(F.lower(sheet))


def any_keyword(sheet: Column, keywords: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | keyword_in_sheet(sheet, k)
    return out


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms, in their order, that the lower-cased text contains; else null."""
    out = F.lit(None).cast("string")
    for t in reversed(terms):
        out = F.when(F.lower(text).contains(t), t).otherwise(out)
    return out


#: What is taken from a file name, in this order, and what stands for it.
NOT_IDENTITY = (
    (r"(?i)\.(xlsx|xlsm|xls|csv)$", ""),
    (r"\(\d+\)", " "),
    (r"[_\-.()]+", " "),
    (r"\b\d{1,4} \d{1,2} \d{1,4}\b", " "),
    (r"(?i)\bv\d+\b", " "),
    (r"(?i)\b(ready|version|ver|rev|revision|release|draft|build)\s+\d+\b", "$1"),
    (r"(?i)\b(audited|validated|draft|final|reviewed|approved|updated|revised|checked|copy|backup|old|new|latest|fixed|corrected|amended)\b", " "),
    (r"\s+", " "),
)


def model_identity(file_name: Column) -> Column:
    """The name that versions, dates and revisions of one file share; never empty."""
    left = reduce(lambda name, row: F.regexp_replace(name, *row), NOT_IDENTITY, file_name)
    return F.coalesce(F.nullif(F.lower(F.btrim(left)), F.lit("")), F.lower(file_name))


def scaling_commas(num_fmt: Column) -> Column:
    """How many commas scale the number that a format shows."""
    return F.length(F.regexp_extract(num_fmt, r"[0#](,+)(?![0#])", 1))


def hides_decimals_of_percent(num_fmt: Column) -> Column:
    before = F.substring_index(num_fmt, "%", 1)
    return num_fmt.contains("%") & ~before.contains(".")


def value_type(v: Column) -> Column:
    return (
        F.when(v.isNull(), "Other").when(v == 0, "Zero").when(v < 0, "Negative").when(F.abs(v) <= 1, "Percentage-like").when(v == F.floor(v), "Whole").otherwise("Decimal")
    )


def safe_file_name(path: Column) -> Column:
    """name and ext of a file name without folders or unusual characters: name up to 100 of letters, digits, spaces and
    -_(), `file` if nothing is left; ext up to 10 with its dot."""
    base = F.regexp_extract(F.coalesce(F.nullif(path, F.lit("")), F.lit("file")), r"([^/]*)/*$", 1)
    ext = F.regexp_extract(base, r"^.+?(\.[^.]*)$", 1)
    name = F.btrim(F.regexp_replace(F.left(base, F.length(base) - F.length(ext)), r"[^a-zA-Z0-9 _\-()]", ""))
    return F.struct(F.left(F.when(name == "", "file").otherwise(name), F.lit(100)).alias("name"), F.regexp_replace(F.left(ext, F.lit(10)), r"[^a-zA-Z0-9.]", "").alias("ext"))


def percent_text(share: Column) -> Column:
    return _shown("%.1f%%", share * 100)


def money_text(value: Column) -> Column:
    """In millions; what would show as nothing is taken to be in millions already."""
    return millions_text(F.when((value != 0) & (F.abs(value / 1e6) < 0.05), value).otherwise(value / 1e6))


def millions_text(millions: Column) -> Column:
    """An amount that is known to be in millions, as it is."""
    return _shown("$%.1fM", millions)


def _shown(form: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string(form, value))  # a form would spell out null
