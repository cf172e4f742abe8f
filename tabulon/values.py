"""Cell values: one type of number, fifteen significant digits, typed equality.

A cell's value is empty, a number, a text, a bool or an error. As a column it is a struct
(kind, num, txt, flag, err); plain number, text and bool columns are read as if they were one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The errors of a spreadsheet.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA", "#SPILL!", "#CALC!")
KINDS = ("empty", "number", "text", "bool", "error")
CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("txt", T.StringType()), T.StructField("flag", T.BooleanType()), T.StructField("err", T.StringType())])


def shown(x: float) -> float:
    """The number that fifteen significant digits give."""
    return float(f"{x:.14e}") if math.isfinite(x) else x


def shown_array(x: np.ndarray) -> np.ndarray:
    """`shown` of many; numbers of few decimals are their own nearest value already."""
    with np.errstate(all="ignore"):
        scaled = np.rint(x * 1e4)
        same = (scaled / 1e4 == x) & (np.abs(scaled) < 1e15) | ~np.isfinite(x)
    if same.all():
        return x
    out = x.copy()
    out[~same] = [float(f"{v:.14e}") for v in x[~same].tolist()]
    return out


@F.pandas_udf(T.DoubleType())
def shown_column(x: pd.Series) -> pd.Series:
    return pd.Series(shown_array(x.to_numpy(dtype=float, na_value=np.nan)), index=x.index).where(x.notna())


def shown_bounds(n: float) -> tuple[float, float]:
    """The least and the greatest double that show as `n` does, so comparisons need no rounding."""
    n = shown(n)

    def edge(toward: float) -> float:
        inside, step = n, math.ulp(n)
        while shown(inside + math.copysign(step, toward)) == n:
            step *= 2
        outside = inside + math.copysign(step, toward)
        while math.nextafter(inside, toward) != outside and inside != outside:
            middle = inside + (outside - inside) / 2
            if middle in (inside, outside):
                break
            inside, outside = (middle, outside) if shown(middle) == n else (inside, middle)
        return inside

    return edge(-math.inf), edge(math.inf)


def display(value: object) -> str:
    """A value as text: whole numbers bare below 1e15, others by fifteen digits."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        n = shown(value)
        if n == int(n) and abs(n) < 1e15 if math.isfinite(n) else False:
            return str(int(n))
        return repr(n)
    return str(value)


@F.pandas_udf(T.StringType())
def display_number(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else display(float(v)))


# --- columns -----------------------------------------------------------------------------------
def is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names[:1] == ["kind"]


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


class Cell:
    """A column read as a cell value, whatever its type."""

    def __init__(self, df: DataFrame, name: str):
        self.type = df.schema[name].dataType
        self.column = F.col(f"`{name}`")
        self.tagged = is_cell(self.type)

    @property
    def kind(self) -> Column:
        if self.tagged:
            return F.coalesce(self.column["kind"], F.lit("empty"))
        kind = "number" if is_number(self.type) or isinstance(self.type, (T.TimestampType, T.DateType)) else "bool" if isinstance(self.type, T.BooleanType) else "text"
        return F.when(self.column.isNull(), "empty").otherwise(kind)

    @property
    def num(self) -> Column:
        if self.tagged:
            return self.column["num"]
        if isinstance(self.type, (T.TimestampType, T.DateType)):
            return serial(self.column)
        return self.column.cast("double") if is_number(self.type) else F.lit(None).cast("double")

    @property
    def txt(self) -> Column:
        return self.column["txt"] if self.tagged else self.column if isinstance(self.type, T.StringType) else F.lit(None).cast("string")

    @property
    def flag(self) -> Column:
        return self.column["flag"] if self.tagged else self.column if isinstance(self.type, T.BooleanType) else F.lit(None).cast("boolean")

    @property
    def err(self) -> Column:
        return self.column["err"] if self.tagged else F.lit(None).cast("string")

    @property
    def number_like(self) -> Column:
        """Numbers, and bools as 1 and 0."""
        return self.num if not self.tagged and not isinstance(self.type, T.BooleanType) else F.coalesce(self.num, self.flag.cast("double"))

    @property
    def failed(self) -> Column:
        return self.kind == "error" if self.tagged else F.lit(False)

    @property
    def blank(self) -> Column:
        """Empty, or a text without a character."""
        if self.tagged:
            return (self.kind == "empty") | F.coalesce(self.txt == "", F.lit(False))
        return self.column.isNull() | (self.column == "") if isinstance(self.type, T.StringType) else self.column.isNull()

    @property
    def canon(self) -> Column:
        """What typed equality compares: the kind, and the value in its canonical form."""
        return F.concat_ws(":", self.kind, self.canon_value)

    @property
    def canon_value(self) -> Column:
        parts = []
        if self.tagged or is_number(self.type):
            number = self.num if isinstance(self.type, T.IntegralType) else shown_column(self.num)
            parts.append((number + F.lit(0.0)).cast("string"))
        if self.tagged or isinstance(self.type, T.StringType):
            parts.append(F.lower(self.txt))
        if self.tagged or isinstance(self.type, T.BooleanType):
            parts.append(self.flag.cast("string"))
        if isinstance(self.type, (T.TimestampType, T.DateType)):
            parts.append(shown_column(self.num).cast("string"))
        return F.coalesce(*parts, self.err, F.lit(""))


def serial(moment: Column) -> Column:
    """Days since 1899-12-30, as spreadsheets count."""
    return (F.unix_micros(moment.cast("timestamp")) / F.lit(86_400_000_000.0)) + F.lit(25_569.0)


def cell(kind: str, value: Column) -> Column:
    """A tagged cell of one kind; a null value is an empty cell."""
    null = F.lit(None)
    fields = {"num": null.cast("double"), "txt": null.cast("string"), "flag": null.cast("boolean"), "err": null.cast("string")}
    name, to = {"number": ("num", "double"), "text": ("txt", "string"), "bool": ("flag", "boolean"), "error": ("err", "string")}[kind]
    fields[name] = value.cast(to)
    return F.struct(F.when(value.isNull(), "empty").otherwise(kind).alias("kind"), *[c.alias(n) for n, c in fields.items()])


def error(code: str) -> Column:
    return cell("error", F.lit(code))


def empty() -> Column:
    return cell("number", F.lit(None).cast("double"))


def tagged(df: DataFrame, name: str) -> Column:
    """Any column as a tagged cell."""
    c = Cell(df, name)
    if c.tagged:
        return c.column
    kind = "number" if is_number(c.type) or isinstance(c.type, (T.TimestampType, T.DateType)) else "bool" if isinstance(c.type, T.BooleanType) else "text"
    return cell(kind, {"number": c.num, "text": c.txt, "bool": c.flag}[kind])
