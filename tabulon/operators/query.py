"""query_table: filter, group and aggregate one table by spreadsheet rules; refuse rather than guess.

Filters are conjunctive and tested in order. A row whose cell is an error at a filter that meets it
(every filter but `failed`) is dropped and counted. Group keys are typed: number 1 is not text "1";
text ignores case; numbers compare at fifteen digits. Groups come in the order of their first row,
and a limit keeps the earliest. No matching row gives no group, grouped or not.

Everything is one scan: filters become predicates on the stored columns (fifteen-digit comparisons
become plain bounds, which reach the scan), groups one partially aggregated shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.values import Cell, is_number, shown_bounds, shown_column


class Refused(ValueError):
    """A named reason why a question has no answer."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


@dataclass(frozen=True)
class Table:
    """A typed table: its rows, which columns are row labels, and the column that orders its rows."""

    df: DataFrame
    name: str = "table"
    labels: tuple[str, ...] = ()
    row: str | None = None

    def resolve(self, header: str) -> str:
        """Body columns first, labels only if none; two that match are refused."""
        fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
        body = [c for c in self.df.columns if c not in self.labels]
        for part in (body, list(self.labels)):
            found = [c for c in part if fold(c) == fold(header)]
            if len(found) > 1:
                raise Refused("AmbiguousColumn", header)
            if found:
                return found[0]
        raise Refused("NoSuchColumn", header)


@dataclass(frozen=True)
class Filter:
    column: str
    test: str
    value: object = None


@dataclass(frozen=True)
class Aggregate:
    what: str
    column: str | None = None

    @property
    def label(self) -> str:
        """As in "sum of X", "distinct X", "count"."""
        if self.what == "count":
            return "count"
        return {"count_values": "values", "count_distinct": "distinct"}.get(self.what, f"{self.what} of") + f" {self.column}"


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    limit: int | None = None
    names: tuple[str, ...] = field(default=())


TESTS = ("is", "is_not", "contains", "one_of", "above", "at_least", "below", "at_most", "blank", "not_blank", "failed")


def spellings(text: str) -> list[str] | None:
    """Every text that lower-cases to this one, if they are few; then equality can reach the scan."""
    letters = sum(c.isalpha() for c in text)
    if not text.isascii() or letters > 4 or "k" in text.lower():  # the Kelvin sign is a k too
        return None
    return ["".join(p) for p in product(*[sorted({c.lower(), c.upper()}) for c in text])]


def equals(cell: Cell, value: object) -> Column:
    """Typed equality; null where the cell is of another kind."""
    if value is None:
        out = cell.kind == "empty"
    elif isinstance(value, bool):
        out = cell.flag == value
    elif isinstance(value, (int, float)):
        low, high = shown_bounds(float(value))
        out = cell.num.between(low, high)
    else:
        few = spellings(value)
        out = cell.txt.isin(few) if few else F.lower(cell.txt) == F.lower(F.lit(value))
    return out


def certain(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def passes(cell: Cell, f: Filter) -> Column:
    """What a filter lets through, error cells aside; null is no. Bare comparisons, so they reach the scan."""
    if f.test not in TESTS:
        raise Refused("NoSuchTest", f.test)
    if f.test == "is":
        return equals(cell, f.value)
    if f.test == "is_not":
        return ~certain(equals(cell, f.value))
    if f.test == "one_of":
        return reduce(lambda a, b: a | b, [equals(cell, v) for v in f.value], F.lit(False))
    if f.test == "contains":
        return F.contains(F.lower(cell.txt), F.lower(F.lit(f.value)))
    if f.test == "blank":
        return cell.blank
    if f.test == "not_blank":
        return ~cell.blank
    if f.test == "failed":
        return cell.failed
    low, high = shown_bounds(float(f.value))
    n = cell.number_like
    return {"above": n > high, "at_least": n >= low, "below": n < low, "at_most": n <= high}[f.test]


def matching(table: Table, filters: tuple[Filter, ...]) -> DataFrame:
    """Rows that pass every filter; an error cell passes `failed` alone."""
    out = table.df
    for f in filters:
        cell = Cell(table.df, table.resolve(f.column))
        test = passes(cell, f)
        out = out.filter(test & ~cell.failed if cell.tagged and f.test != "failed" else test)
    return out


def scan_counts(table: Table, filters: tuple[Filter, ...]) -> DataFrame:
    """One row: rows scanned, matched, and dropped for an error at the first filter that met one."""
    alive, dropped = F.lit(True), F.lit(False)
    for f in filters:
        cell = Cell(table.df, table.resolve(f.column))
        if f.test != "failed":
            dropped = dropped | (alive & cell.failed)
            alive = alive & ~cell.failed
        alive = alive & certain(passes(cell, f))
    return table.df.agg(F.count("*").alias("rows_scanned"), F.count(F.when(alive, 1)).alias("rows_matched"), F.count(F.when(dropped, 1)).alias("rows_with_errors"))


def measure(table: Table, a: Aggregate) -> list[Column]:
    """The aggregate's columns before its result is shown: value, and where an extreme is."""
    if a.what == "count":
        return [F.count(F.lit(1)).alias("value")]
    name = table.resolve(a.column)
    cell = Cell(table.df, name)
    if a.what == "count_values":
        return [F.count(F.when(~cell.blank & ~cell.failed, 1)).alias("value")]
    if a.what == "count_distinct":
        return [F.count_distinct(F.when(~cell.blank & ~cell.failed, cell.canon)).alias("value")]
    if name in table.labels and a.what in ("sum", "mean"):
        raise Refused("LabelColumn", a.column)
    if not (cell.tagged or is_number(cell.type)):
        raise Refused("NotNumeric", a.column)
    if a.what in ("sum", "mean"):
        return [(F.sum if a.what == "sum" else F.avg)(cell.num).alias("value")]
    if a.what in ("min", "max"):
        best = [(F.min if a.what == "min" else F.max)(cell.num).alias("value")]
        if table.row:
            order = F.struct(cell.num if a.what == "min" else -cell.num, F.col(table.row))
            best.append(F.min(F.when(cell.num.isNotNull(), order))[table.row].alias("at"))
        return best
    raise Refused("NoSuchAggregate", a.what)


def in_two_steps(table: Table, q: Query, names: list[str], keys: list[str], rows: DataFrame) -> DataFrame:
    """Groups by the stored keys first, then by what typed equality makes of them.

    The first step is a hash aggregation of fixed-width values over the rows; case folding, number
    rounding and the choice of the key to show meet only the distinct stored keys."""
    first, second = [], []
    for i, (a, name) in enumerate(zip(q.aggregates, names, strict=True)):
        (value,) = measure(Table(table.df, table.name, table.labels), a)
        c = F.col(f"part {i}")
        if a.what == "mean":
            cell = Cell(table.df, table.resolve(a.column))
            first += [F.sum(cell.num).alias(f"part {i}"), F.count(cell.num).alias(f"times {i}")]
            second.append(F.try_divide(F.sum(c), F.sum(F.col(f"times {i}")).cast("double")).alias(name))
        else:
            first.append(value.alias(f"part {i}"))
            second.append({"min": F.min, "max": F.max}.get(a.what, F.sum)(c).alias(name))
    raw = [F.col(f"`{k}`").alias(f"raw {i}") for i, k in enumerate(keys)]
    if table.row:
        first.append(F.min(table.row).alias("first_row"))
        second.append(F.min("first_row").alias("first_row"))
    stored = rows.groupBy(*raw).agg(*first)
    cells = [Cell(stored, f"raw {i}") for i in range(len(keys))]
    canon = [F.struct(c.kind.alias("kind"), c.canon_value.alias("value")).alias(f"key {i}") for i, c in enumerate(cells)]
    seen = [(F.min_by(c.column, "first_row") if table.row else F.min(c.column)).alias(k) for c, k in zip(cells, keys, strict=True)]
    return stored.groupBy(*canon).agg(*seen, *second).drop(*[f"key {i}" for i in range(len(keys))])


def errors_in(table: Table, aggregates: tuple[Aggregate, ...]) -> Column | None:
    """Error cells, counted once for each aggregate that meets them."""
    cells = [Cell(table.df, table.resolve(a.column)) for a in aggregates if a.column]
    parts = [F.count(F.when(c.failed, 1)) for c in cells if c.tagged]
    return reduce(lambda x, y: x + y, parts).alias("errors") if parts else None


def query(table: Table, q: Query) -> DataFrame:
    """One row a group: its keys as first seen, then each aggregate; `at` columns for extremes if rows have numbers."""
    if not q.aggregates:
        raise Refused("NothingAsked")
    if q.limit is not None and q.limit <= 0:
        raise Refused("NoLimit")
    keys = [table.resolve(g) for g in q.group_by]
    names = list(q.names) or [a.label for a in q.aggregates]
    columns: list[Column] = []
    floats: list[str] = []
    for a, name in zip(q.aggregates, names, strict=True):
        value, *at = measure(table, a)
        columns.append(value.alias(name))
        columns += [c.alias(f"{name} at") for c in at]
        if a.what in ("sum", "mean"):
            floats.append(name)
    if (errors := errors_in(table, q.aggregates)) is not None:
        columns.append(errors)
    rows = matching(table, q.filters)
    cells = [Cell(table.df, k) for k in keys]
    first = F.min(table.row).alias("first_row") if table.row else None
    plain = all(isinstance(c.type, (T.IntegralType, T.BooleanType)) for c in cells)
    if not keys:
        out = rows.agg(F.count(F.lit(1)).alias("rows"), *columns).filter("rows > 0").drop("rows")
    elif plain and not any(c.tagged for c in cells):
        out = rows.groupBy(*[c.column.alias(k) for c, k in zip(cells, keys, strict=True)]).agg(*columns, *([first] if first is not None else []))
    elif not any(c.tagged for c in cells) and errors is None and all(a.what != "count_distinct" and (a.what not in ("min", "max") or not table.row) for a in q.aggregates):
        out = in_two_steps(table, q, names, keys, rows)
    else:
        shown_keys = [(F.min_by(c.column, table.row) if table.row else F.min(c.column)).alias(k) for c, k in zip(cells, keys, strict=True)]
        canon = [F.struct(c.kind.alias("kind"), c.canon_value.alias("value")).alias(f"key {i}") for i, c in enumerate(cells)]
        out = rows.groupBy(*canon).agg(*shown_keys, *columns, *([first] if first is not None else [])).drop(*[f"key {i}" for i in range(len(keys))])
    for name in floats:
        out = out.withColumn(name, shown_column(f"`{name}`"))
    if keys and table.row:
        out = out.orderBy("first_row")
        out = out.limit(q.limit) if q.limit is not None else out
        out = out.drop("first_row")
    elif keys and q.limit is not None:
        raise Refused("NoRowOrder", "a limit keeps the earliest groups")
    return out


def groups_not_listed(table: Table, q: Query) -> DataFrame:
    """How many groups a limit leaves out."""
    whole = query(table, Query(q.filters, q.group_by, (Aggregate("count"),), None, ("n",)))
    return whole.agg(F.greatest(F.count("*") - F.lit(q.limit or 0), F.lit(0)).alias("groups_not_listed"))

