"""Flat tables as sheets: wide (typed columns, at full speed) or long (cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.query import Table
from tabulon.values import CELL, is_cell, tagged


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, row: str | None = None, labels: tuple[str, ...] = ()) -> Table:
    """A declared table over its stored columns; `row` is the column that orders its rows."""
    return Table(read(spark, sf_dir, name), name, labels, row)


def long(df: DataFrame, row: str, columns: list[str] | None = None, sheet_id: int = 0, first_row: int = 0) -> DataFrame:
    """Cells (sheet_id, row, col, kind, num, txt, flag, err, is_date, formula) of a table; absent values are no cells."""
    names = columns or df.columns
    dates = {f.name for f in df.schema if f.dataType.typeName() in ("timestamp", "date", "timestamp_ntz")}
    items = [F.struct(F.lit(i).alias("col"), F.lit(n in dates).alias("is_date"), (F.col(f"`{n}`") if is_cell(df.schema[n].dataType) else tagged(df, n)).cast(CELL).alias("v")) for i, n in enumerate(names)]
    cells = df.select((F.col(row) + first_row).cast("int").alias("row"), F.explode(F.array(*items)).alias("c"))
    return cells.filter(F.col("c.v.kind") != "empty").select(F.lit(sheet_id).alias("sheet_id"), "row", "c.col", "c.v.kind", "c.v.num", "c.v.txt", "c.v.flag", "c.v.err", "c.is_date", F.lit(None).cast("string").alias("formula"))


def cells_in(cells: DataFrame, sheet_id: int, top: int, left: int, bottom: int, right: int, limit: int | None = None) -> DataFrame:
    """Populated cells of a rectangle in row order; one more than `limit` tells that it was capped."""
    out = cells.filter((F.col("sheet_id") == sheet_id) & F.col("row").between(top, bottom) & F.col("col").between(left, right)).orderBy("row", "col")
    return out if limit is None else out.limit(limit + 1)


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_id").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count("*").alias("cells"))


def pivoted(cells: DataFrame, top: int, bottom: int, columns: dict[int, str]) -> DataFrame:
    """Dense rows of a region: every row from top to bottom, blanks filled in, one column a header."""
    spark = cells.sparkSession
    rows = spark.range(top, bottom + 1).select(F.col("id").cast("int").alias("row"))
    value = F.struct("kind", "num", "txt", "flag", "err")
    picked = cells.filter(F.col("row").between(top, bottom) & F.col("col").isin(list(columns))).groupBy("row").agg(*[F.max(F.when(F.col("col") == c, value)).alias(n) for c, n in columns.items()])
    return rows.join(picked, "row", "left")
