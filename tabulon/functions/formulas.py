"""Spreadsheet functions as column expressions over tagged cells.

An argument is a cell (a tagged struct column) or a Spread (an array column of cells, as a range
gives). Inside a range, aggregates pass over texts and bools; written as cells, they are coerced.
The left-most error wins. Lookups are joins (operators/lookup.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.values import CELL, cell, display_number, error, shown_column


@dataclass(frozen=True)
class Spread:
    """The cells of a range, in address order, absent ones as empty cells."""

    cells: Column


Arg = Column | Spread


def no(kind) -> Column:
    return F.lit(None).cast(kind)


CATALOGUE: dict[str, Callable[..., Column]] = {}


def function(*names: str):
    def keep(f):
        for n in names:
            CATALOGUE[n] = f
        return f

    return keep


def call(name: str, *args: Arg) -> Column:
    """The function's result as a tagged cell; a function that isn't modelled is refused."""
    if name.upper() not in CATALOGUE:
        raise NotImplementedError(f"function {name}")
    if not args and name.upper() not in ("TRUE", "FALSE", "NA"):
        return error("#VALUE!")
    return CATALOGUE[name.upper()](*args)


# --- coercion ----------------------------------------------------------------------------------
def number_of(v: Column) -> Column:
    """The number a cell stands for, null if none: bools are 1 and 0, blanks 0, numeric texts parse."""
    text = F.trim(v["txt"])
    parsed = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(v["kind"] == "number", v["num"]).when(v["kind"] == "bool", v["flag"].cast("double")).when(v["kind"] == "empty", 0.0).when(v["kind"] == "text", parsed)


def number_error(v: Column) -> Column:
    return F.when(v["kind"] == "error", v["err"]).when((v["kind"] == "text") & number_of(v).isNull(), "#VALUE!")


def text_of(v: Column) -> Column:
    return F.when(v["kind"] == "text", v["txt"]).when(v["kind"] == "number", display_number(v["num"])).when(v["kind"] == "bool", F.upper(v["flag"].cast("string"))).when(v["kind"] == "empty", "")


def truth_of(v: Column) -> Column:
    word = F.upper(v["txt"])
    return F.when(v["kind"] == "bool", v["flag"]).when(v["kind"] == "number", v["num"] != 0).when(v["kind"] == "empty", F.lit(False)).when(word == "TRUE", F.lit(True)).when(word == "FALSE", F.lit(False))


def own_error(v: Column) -> Column:
    return F.when(v["kind"] == "error", v["err"])


def failing(err: Column, value: Column) -> Column:
    """`value`, unless there is an error code."""
    return F.when(err.isNotNull(), cell("error", err)).otherwise(value)


def finite(x: Column) -> Column:
    """A number cell; infinity and what is no number are #NUM!."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, error("#NUM!")).otherwise(cell("number", x))


def numeric(*args: Column, of: Callable[..., Column]) -> Column:
    """A number function of numbers; `of` returns a tagged cell."""
    return failing(F.coalesce(*[number_error(a) for a in args], no("string")), of(*[number_of(a) for a in args]))


def textual(*args: Column, of: Callable[..., Column]) -> Column:
    return failing(F.coalesce(*[own_error(a) for a in args], no("string")), of(*[text_of(a) for a in args]))


# --- operators ---------------------------------------------------------------------------------
def plus(a: Column, b: Column) -> Column:
    def add(x, y):
        total = x + y
        return finite(F.when((total != 0) & (shown_column(x) == shown_column(-y)), 0.0).otherwise(total))

    return numeric(a, b, of=add)


def minus(a: Column, b: Column) -> Column:
    return numeric(a, b, of=lambda x, y: finite(F.when(shown_column(x) == shown_column(y), 0.0).otherwise(x - y)))


def times(a: Column, b: Column) -> Column:
    return numeric(a, b, of=lambda x, y: finite(x * y))


def divide(a: Column, b: Column) -> Column:
    return numeric(a, b, of=lambda x, y: F.when(y == 0, error("#DIV/0!")).otherwise(finite(F.try_divide(x, y))))


def power(a: Column, b: Column) -> Column:
    return numeric(a, b, of=lambda x, y: finite(F.pow(x, y)))


def negate(a: Column) -> Column:
    return numeric(a, of=lambda x: finite(-x))


def percent(a: Column) -> Column:
    return numeric(a, of=lambda x: finite(x / 100.0))


def join_text(a: Column, b: Column) -> Column:
    return textual(a, b, of=lambda x, y: cell("text", F.concat(x, y)))


def ranked(v: Column, other: Column) -> Column:
    """What comparisons order: numbers before texts before bools; a blank is the other side's zero."""
    kind = F.when(v["kind"] != "empty", v["kind"]).when(other["kind"] == "empty", "number").otherwise(other["kind"])
    rank = F.when(kind == "number", 0).when(kind == "text", 1).otherwise(2)
    num = F.when(kind == "number", shown_column(F.coalesce(v["num"], F.lit(0.0)))).when(kind == "bool", F.coalesce(v["flag"].cast("double"), F.lit(0.0))).otherwise(0.0)
    return F.struct(rank.alias("rank"), num.alias("num"), F.when(kind == "text", F.upper(F.coalesce(v["txt"], F.lit("")))).otherwise("").alias("txt"))


def compare(a: Column, sign: str, b: Column) -> Column:
    x, y = ranked(a, b), ranked(b, a)
    test = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
    return failing(F.coalesce(own_error(a), own_error(b)), cell("bool", test))


# --- logic -------------------------------------------------------------------------------------
@function("IF")
def if_(condition: Column, then: Column, other: Column | None = None) -> Column:
    truth = truth_of(condition)
    other = cell("bool", F.lit(False)) if other is None else other
    return F.when(condition["kind"] == "error", condition).when(truth.isNull(), error("#VALUE!")).when(truth, then).otherwise(other)


@function("IFERROR")
def if_error(value: Column, other: Column | None = None) -> Column:
    return error("#VALUE!") if other is None else F.when(value["kind"] == "error", other).otherwise(value)


@function("IFNA")
def if_na(value: Column, other: Column | None = None) -> Column:
    return error("#VALUE!") if other is None else F.when((value["kind"] == "error") & (value["err"] == "#N/A"), other).otherwise(value)


def junction(every: bool):
    def of(*args: Arg) -> Column:
        seen = flat(args, lambda v: F.when(v["kind"].isin("number", "bool"), cell("bool", truth_of(v))).when(v["kind"] == "error", v), lambda v: F.when(v["kind"] == "error", v).when(v["kind"] == "empty", no(CELL)).when(truth_of(v).isNull(), error("#VALUE!")).otherwise(cell("bool", truth_of(v))))
        truths = F.transform(seen, lambda v: v["flag"])
        result = F.forall(truths, lambda t: t) if every else F.exists(truths, lambda t: t)
        return failing(first_error(seen), F.when(F.size(seen) == 0, error("#VALUE!")).otherwise(cell("bool", result)))

    return of


CATALOGUE["AND"], CATALOGUE["OR"] = junction(True), junction(False)


@function("NOT")
def not_(v: Column) -> Column:
    return failing(own_error(v), F.when(truth_of(v).isNull(), error("#VALUE!")).otherwise(cell("bool", ~truth_of(v))))


CATALOGUE["TRUE"] = lambda: cell("bool", F.lit(True))
CATALOGUE["FALSE"] = lambda: cell("bool", F.lit(False))
CATALOGUE["NA"] = lambda: error("#N/A")

# --- kinds -------------------------------------------------------------------------------------
for _name, _test in {
    "ISBLANK": lambda v: v["kind"] == "empty",
    "ISNUMBER": lambda v: v["kind"] == "number",
    "ISTEXT": lambda v: v["kind"] == "text",
    "ISNONTEXT": lambda v: v["kind"] != "text",
    "ISLOGICAL": lambda v: v["kind"] == "bool",
    "ISERROR": lambda v: v["kind"] == "error",
    "ISERR": lambda v: (v["kind"] == "error") & (v["err"] != "#N/A"),
    "ISNA": lambda v: F.coalesce(v["err"] == "#N/A", F.lit(False)),
}.items():
    CATALOGUE[_name] = lambda v, test=_test: cell("bool", test(v))


# --- aggregates over arguments -----------------------------------------------------------------
def flat(args: tuple[Arg, ...], inside: Callable, written: Callable) -> Column:
    """One array of cells: those of ranges as `inside` sees them, written ones as `written` does; nulls go."""
    parts = [F.transform(a.cells, inside) if isinstance(a, Spread) else F.array(written(a)) for a in args]
    return F.filter(F.concat(*parts), lambda v: v.isNotNull())


def first_error(cells: Column) -> Column:
    return F.get(F.filter(cells, lambda v: v["kind"] == "error"), F.lit(0))["err"]


def numbers(args: tuple[Arg, ...]) -> Column:
    return flat(args, lambda v: F.when(v["kind"].isin("number", "error"), v), lambda v: failing(number_error(v), cell("number", number_of(v))))


def over_numbers(of: Callable[[Column], Column]):
    def run(*args: Arg) -> Column:
        seen = numbers(args)
        return failing(first_error(seen), of(F.transform(seen, lambda v: v["num"])))

    return run


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


CATALOGUE["SUM"] = over_numbers(lambda xs: finite(total(xs)))
CATALOGUE["PRODUCT"] = over_numbers(lambda xs: F.when(F.size(xs) == 0, cell("number", F.lit(0.0))).otherwise(finite(F.aggregate(xs, F.lit(1.0), lambda a, x: a * x))))
CATALOGUE["AVERAGE"] = over_numbers(lambda xs: F.when(F.size(xs) == 0, error("#DIV/0!")).otherwise(finite(F.try_divide(total(xs), F.size(xs).cast("double")))))
CATALOGUE["MIN"] = over_numbers(lambda xs: cell("number", F.coalesce(F.array_min(xs), F.lit(0.0))))
CATALOGUE["MAX"] = over_numbers(lambda xs: cell("number", F.coalesce(F.array_max(xs), F.lit(0.0))))


def counting(inside: Callable, written: Callable):
    def run(*args: Arg) -> Column:
        return cell("number", reduce(lambda a, b: a + b, [F.size(F.filter(a.cells, inside)) if isinstance(a, Spread) else written(a).cast("int") for a in args]))

    return run


CATALOGUE["COUNT"] = counting(lambda v: v["kind"] == "number", lambda v: (v["kind"] != "error") & number_of(v).isNotNull())
CATALOGUE["COUNTA"] = counting(lambda v: v["kind"] != "empty", lambda v: v["kind"] != "empty")
CATALOGUE["COUNTBLANK"] = counting(lambda v: (v["kind"] == "empty") | F.coalesce(v["txt"] == "", F.lit(False)), lambda v: (v["kind"] == "empty") | F.coalesce(v["txt"] == "", F.lit(False)))

# --- arithmetic --------------------------------------------------------------------------------
CATALOGUE["ABS"] = lambda a: numeric(a, of=lambda x: cell("number", F.abs(x)))
CATALOGUE["INT"] = lambda a: numeric(a, of=lambda x: cell("number", F.floor(x).cast("double")))
CATALOGUE["SIGN"] = lambda a: numeric(a, of=lambda x: cell("number", F.signum(x)))
CATALOGUE["SQRT"] = lambda a: numeric(a, of=lambda x: F.when(x < 0, error("#NUM!")).otherwise(finite(F.sqrt(x))))
CATALOGUE["EXP"] = lambda a: numeric(a, of=lambda x: finite(F.exp(x)))
CATALOGUE["LN"] = lambda a: numeric(a, of=lambda x: F.when(x <= 0, error("#NUM!")).otherwise(finite(F.log(x))))
CATALOGUE["LOG10"] = lambda a: numeric(a, of=lambda x: F.when(x <= 0, error("#NUM!")).otherwise(finite(F.log10(x))))
CATALOGUE["POWER"] = power


@function("MOD")
def mod(a: Column, b: Column) -> Column:
    return numeric(a, b, of=lambda x, y: F.when(y == 0, error("#DIV/0!")).otherwise(finite(x - y * F.floor(F.try_divide(x, y)))))


@function("LOG")
def log(a: Column, base: Column | None = None) -> Column:
    base = cell("number", F.lit(10.0)) if base is None else base
    return numeric(a, base, of=lambda x, b: F.when((x <= 0) | (b <= 0) | (b == 1), error("#NUM!")).otherwise(finite(F.try_divide(F.log(x), F.log(b)))))


def rounding(step: Callable[[Column], Column]):
    def run(a: Column, digits: Column | None = None) -> Column:
        digits = cell("number", F.lit(0.0)) if digits is None else digits

        def of(x, d):
            scale = F.pow(F.lit(10.0), F.abs(F.signum(d) * F.floor(F.abs(d))))
            up = d >= 0
            size = step(shown_column(F.when(up, F.abs(x) * scale).otherwise(F.abs(x) / scale)))
            return finite(F.signum(x) * F.when(up, size / scale).otherwise(size * scale))

        return numeric(a, digits, of=of)

    return run


CATALOGUE["ROUND"] = rounding(lambda s: F.floor(s + 0.5).cast("double"))
CATALOGUE["ROUNDUP"] = rounding(lambda s: F.ceil(s).cast("double"))
CATALOGUE["ROUNDDOWN"] = CATALOGUE["TRUNC"] = rounding(lambda s: F.floor(s).cast("double"))


@function("PV")
def present_value(rate: Column, periods: Column, payment: Column, future: Column | None = None, due: Column | None = None) -> Column:
    """The annuity identity solved for the present value, with its sign turned."""
    future = cell("number", F.lit(0.0)) if future is None else future
    due = cell("number", F.lit(0.0)) if due is None else due

    def of(r, n, p, f, t):
        growth = F.pow(1.0 + r, n)
        annuity = F.try_divide((1.0 + r * t) * (growth - 1.0), r)
        value = F.when(r == 0, -(f + p * n)).otherwise(-F.try_divide(f + p * annuity, growth))
        return F.when(~t.isin(0.0, 1.0), error("#NUM!")).otherwise(finite(value))

    return numeric(rate, periods, payment, future, due, of=of)


# --- texts -------------------------------------------------------------------------------------
CATALOGUE["LEN"] = lambda a: textual(a, of=lambda x: cell("number", F.char_length(x)))
CATALOGUE["TRIM"] = lambda a: textual(a, of=lambda x: cell("text", F.trim(F.regexp_replace(x, r"\s+", " "))))
CATALOGUE["UPPER"] = lambda a: textual(a, of=lambda x: cell("text", F.upper(x)))
CATALOGUE["LOWER"] = lambda a: textual(a, of=lambda x: cell("text", F.lower(x)))


def edge(cut: Callable[[Column, Column], Column]):
    def run(a: Column, count: Column | None = None) -> Column:
        count = cell("number", F.lit(1.0)) if count is None else count
        n = F.floor(number_of(count)).cast("int")
        err = F.coalesce(own_error(a), number_error(count))
        return failing(err, F.when(n < 0, error("#VALUE!")).otherwise(cell("text", cut(text_of(a), n))))

    return run


CATALOGUE["LEFT"] = edge(lambda x, n: F.left(x, n))
CATALOGUE["RIGHT"] = edge(lambda x, n: F.right(x, n))


@function("MID")
def mid(a: Column, start: Column, count: Column) -> Column:
    s, n = F.floor(number_of(start)).cast("int"), F.floor(number_of(count)).cast("int")
    err = F.coalesce(own_error(a), number_error(start), number_error(count))
    return failing(err, F.when((s < 1) | (n < 0), error("#VALUE!")).otherwise(cell("text", F.substr(text_of(a), s, n))))


@function("CONCATENATE", "CONCAT")
def concatenate(*args: Arg) -> Column:
    cells = F.concat(*[a.cells if isinstance(a, Spread) else F.array(a) for a in args])
    plain = all(not isinstance(a, Spread) for a in args)
    # a range's numbers are shown without a Python call: it may not run inside a lambda
    shown = F.concat(*[text_of(a) for a in args]) if plain else F.array_join(F.transform(cells, _text_inside), "")
    return failing(first_error(cells), cell("text", shown))


def _text_inside(v: Column) -> Column:
    whole = (v["num"] == F.floor(v["num"])) & (F.abs(v["num"]) < 1e15)
    number = F.when(whole, v["num"].cast("bigint").cast("string")).otherwise(v["num"].cast("string"))
    return F.when(v["kind"] == "text", v["txt"]).when(v["kind"] == "number", number).when(v["kind"] == "bool", F.upper(v["flag"].cast("string"))).otherwise("")


@function("EXACT")
def exact(a: Column, b: Column | None = None) -> Column:
    return error("#VALUE!") if b is None else textual(a, b, of=lambda x, y: cell("bool", x == y))
