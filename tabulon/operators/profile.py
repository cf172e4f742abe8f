"""Column kinds, profiles and reading a region as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.query import Table
from tabulon.values import Cell, display_number

KEPT, KNOWN, CUT = 64, 1024, 64


def kind_of(populated: Column, **counts: Column) -> Column:
    """The kind that a strict majority of populated cells have; `mixed` if none, `empty` without any."""
    out = F.when(populated == 0, "empty")
    for name, count in counts.items():
        out = out.when(count > F.floor(populated / 2), name)
    return out.otherwise("mixed")


def shown_value(cell: Cell) -> Column:
    """A value as a profile lists it: case kept, numbers at fifteen digits, errors by their code."""
    number = display_number(cell.num)
    return F.when(cell.kind == "number", number).when(cell.kind == "text", cell.txt).when(cell.kind == "bool", F.upper(cell.flag.cast("string"))).when(cell.kind == "error", cell.err)


def long_cells(table: Table, labels: bool = False) -> DataFrame:
    """(position, name, kind, num, value) of each body cell: one scan, every column an array element."""
    names = [c for c in table.df.columns if c != table.row and (labels or c not in table.labels)]
    items = []
    for i, n in enumerate(names):
        c = Cell(table.df, n)
        items.append(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), c.kind.alias("kind"), c.num.alias("num"), shown_value(c).alias("value")))
    return table.df.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def profile(table: Table) -> DataFrame:
    """One row a body column: populated, empty, errors, distinct count (null past KNOWN), kept values, number summary.

    Values are counted first (a partial sum, so the shuffle carries distinct values), and the columns'
    figures come from those counts."""
    cells = long_cells(table).withColumn("value", F.when(F.col("kind") != "empty", F.col("value")))
    counted = cells.groupBy("position", "name", "kind", "value").agg(F.count("*").alias("n"), F.min("num").alias("low"), F.max("num").alias("high"), F.sum("num").alias("total"), F.count("num").alias("numbers"))
    full = F.col("kind") != "empty"
    n = F.col("n")
    sums = counted.groupBy("position", "name").agg(
        F.coalesce(F.sum(F.when(full, n)), F.lit(0)).alias("populated"),
        F.coalesce(F.sum(F.when(~full, n)), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.col("kind") == "error", n)), F.lit(0)).alias("errors"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(k + "s") for k in ("number", "text", "bool")],
        F.count(F.when(full, 1)).alias("kinds"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.sum("total").alias("sum"),
        F.sum("numbers").alias("n_numbers"),
    )
    few = sums.filter(F.col("kinds") <= KEPT).select("position")
    value = F.struct((-n).alias("order"), F.substring("value", 1, CUT).alias("value"), n.alias("count"), (F.char_length("value") > CUT).alias("truncated"))
    lists = counted.filter(full).join(few, "position", "left_semi").groupBy("position").agg(F.transform(F.sort_array(F.collect_list(value)), lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"), v["truncated"].alias("truncated"))).alias("values"))
    kind = kind_of(F.col("populated"), number=F.col("numbers"), text=F.col("texts"), bool=F.col("bools"), error=F.col("errors"))
    joined = sums.join(lists, "position", "left")
    return joined.select(
        "position",
        "name",
        kind.alias("kind"),
        "populated",
        "empty",
        "errors",
        F.when(F.col("kinds") <= KNOWN, F.col("kinds")).alias("distinct"),
        "values",
        ((F.col("kinds") <= KEPT) & (F.col("kinds") > 0) & (F.col("populated") >= 2 * F.col("kinds"))).alias("categorical"),
        "min",
        "max",
        "sum",
        F.try_divide("sum", "n_numbers").alias("mean"),
    )


def tally(table: Table) -> DataFrame:
    """Kinds and populated counts of all columns, labels too, in one pass without a shuffle of cells."""
    names = [c for c in table.df.columns if c != table.row]
    sums = []
    for i, n in enumerate(names):
        c = Cell(table.df, n)
        counts = [F.count(F.when(c.kind == k, 1)) for k in ("number", "text", "bool", "error")]
        sums.append(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), reduce(lambda a, b: a + b, counts).alias("populated"), kind_of(reduce(lambda a, b: a + b, counts), number=counts[0], text=counts[1], bool=counts[2], error=counts[3]).alias("kind")))
    return table.df.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("c")).select("c.*")
