"""A1 addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_to_num(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27; null stays null."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda acc, c: acc * 26 + c - 64)


def num_to_col(n: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters, null beyond or below 1."""
    letter = lambda x: F.char(F.lit(65) + x)
    one = letter(n - 1)
    two = F.concat(letter(F.floor((n - 27) / 26)), letter((n - 1) % 26))
    three = F.concat(letter(F.floor((n - 703) / 676)), letter(F.floor((n - 703) / 26) % 26), letter((n - 1) % 26))
    return F.when((n >= 1) & (n <= 26), one).when((n > 26) & (n <= 702), two).when((n > 702) & (n <= 18278), three)


def address(row: Column, col: Column) -> Column:
    return F.concat(num_to_col(col), row.cast("string"))


def address_part(addr: Column, part: str) -> Column:
    """'col' letters, 'row' number; null if addr is no address of up to 3 letters and 7 digits."""
    pattern = r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})$"
    found = F.regexp_extract(addr, pattern, 1 if part == "col" else 2)
    return F.when(found != "", found if part == "col" else found.try_cast("int"))
