"""Cell addresses: letters, A1 text, citations and rectangles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROW, MAX_COL = 1_048_575, 16_383
#: A sheet that is made of a table has as many rows as the table: formulas may name rows up to this one. MAX_ROW is where a file's sheet ends, and whole columns do.
LAST_ROW = 999_999_998


def letters(col: int) -> str:
    out, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_of(text: str) -> int | None:
    n = 0
    for c in text.upper():
        n = n * 26 + ord(c) - 64
    return n - 1 if text and n - 1 <= MAX_COL else None


CELL_LIKE = re.compile(r"^[A-Za-z]{1,3}[0-9]+$")


def quoted(sheet: str) -> str:
    """A sheet name as a formula spells it."""
    plain = sheet and not sheet[0].isdigit() and all(c.isalnum() or c in "_." for c in sheet) and not CELL_LIKE.match(sheet)
    return sheet if plain else "'" + sheet.replace("'", "''") + "'"


@dataclass(frozen=True)
class Range:
    """An inclusive rectangle; corners are put in order."""

    top: int
    left: int
    bottom: int
    right: int

    @staticmethod
    def of(r1: int, c1: int, r2: int, c2: int) -> Range:
        return Range(min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2))

    def offset(self, rows: int, cols: int) -> Range | None:
        """The rectangle moved, or None where it would leave the sheet."""
        moved = Range(self.top + rows, self.left + cols, self.bottom + rows, self.right + cols)
        return moved if moved.top >= 0 and moved.left >= 0 and moved.bottom <= MAX_ROW and moved.right <= MAX_COL else None

    @property
    def cells(self) -> int:
        return (self.bottom - self.top + 1) * (self.right - self.left + 1)

    def contains(self, row: int, col: int) -> bool:
        return self.top <= row <= self.bottom and self.left <= col <= self.right

    def holds(self, o: Range) -> bool:
        return self.contains(o.top, o.left) and self.contains(o.bottom, o.right)

    def intersects(self, o: Range) -> bool:
        return self.top <= o.bottom and o.top <= self.bottom and self.left <= o.right and o.left <= self.right

    def intersection(self, o: Range) -> Range | None:
        return Range(max(self.top, o.top), max(self.left, o.left), min(self.bottom, o.bottom), min(self.right, o.right)) if self.intersects(o) else None

    def union(self, o: Range) -> Range:
        return Range(min(self.top, o.top), min(self.left, o.left), max(self.bottom, o.bottom), max(self.right, o.right))

    def a1(self) -> str:
        first = f"{letters(self.left)}{self.top + 1}"
        return first if self.cells == 1 else f"{first}:{letters(self.right)}{self.bottom + 1}"


def cite(sheet: str, where: Range) -> str:
    return f"{quoted(sheet)}!{where.a1()}"


PART = re.compile(r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$")


def parse_a1(text: str) -> tuple[str | None, Range] | None:
    """(sheet or None, rectangle) of `A1`, `$A$1:B2`, `A:C`, `3:5` with or without a sheet; else None."""
    sheet, body = None, text.strip()
    if "!" in body:
        sheet, body = body.rsplit("!", 1)
        if sheet.startswith("'") and sheet.endswith("'") and len(sheet) > 1:
            sheet = sheet[1:-1].replace("''", "'")
        if not sheet or "[" in sheet:
            return None
    first, colon, second = body.partition(":")
    second = second if colon else first
    a, b = PART.match(first), PART.match(second)
    if a and b:
        c1, c2, r1, r2 = column_of(a[1]), column_of(b[1]), int(a[2]) - 1, int(b[2]) - 1
        fits = c1 is not None and c2 is not None and 0 <= min(r1, r2) and max(r1, r2) <= MAX_ROW
        return (sheet, Range.of(r1, c1, r2, c2)) if fits else None
    first, second = first.replace("$", ""), second.replace("$", "")
    if colon and first.isalpha() and second.isalpha() and None not in (column_of(first), column_of(second)):
        return sheet, Range.of(0, column_of(first), MAX_ROW, column_of(second))
    if colon and first.isdigit() and second.isdigit() and 1 <= min(int(first), int(second)) and max(int(first), int(second)) <= MAX_ROW + 1:
        return sheet, Range.of(int(first) - 1, 0, int(second) - 1, MAX_COL)
    return None


# --- columns -----------------------------------------------------------------------------------
def letters_column(col: Column) -> Column:
    """Letters of a zero-based column number, by arithmetic on its at most three digits."""
    n = col.cast("int")
    last = F.chr(65 + n % 26)
    middle = F.when(n >= 26, F.chr(65 + (F.floor(n / 26) - 1).cast("int") % 26)).otherwise("")
    first = F.when(n >= 702, F.chr(65 + (F.floor((n - 702) / 676)).cast("int"))).otherwise("")
    return F.concat(first, middle, last)


def quoted_column(sheet: Column) -> Column:
    plain = sheet.rlike(r"^[\p{L}\p{N}_.]+$") & ~sheet.rlike(r"^\p{Nd}") & ~sheet.rlike(r"^[A-Za-z]{1,3}[0-9]+$")
    return F.when(plain, sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'")))


def a1_column(row: Column, col: Column) -> Column:
    return F.concat(letters_column(col), (row + 1).cast("string"))


def cite_column(sheet: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    one = (top == bottom) & (left == right)
    return F.concat(quoted_column(sheet), F.lit("!"), a1_column(top, left), F.when(one, "").otherwise(F.concat(F.lit(":"), a1_column(bottom, right))))


def overlaps(a: str, b: str) -> Column:
    """Do the rectangles with these column prefixes meet?"""
    c = F.col
    return (c(f"{a}top") <= c(f"{b}bottom")) & (c(f"{b}top") <= c(f"{a}bottom")) & (c(f"{a}left") <= c(f"{b}right")) & (c(f"{b}left") <= c(f"{a}right"))
