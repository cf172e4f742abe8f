"""Formulas compiled by shape: one column expression for all cells that a formula was filled to.

Formulas of one relative shape differ in the places they read and in nothing else. The shape of each
cell is worked out by column expressions, the most frequent shapes are parsed once each, and a shape
becomes a Program: which places it reads, as offsets, and a tree of column expressions over them.

* Places that move are requests joined with the stored cells. Places that don't (and ranges that
  don't) are few, as there are few shapes; they are fetched once and are literals of the plan.
* A range in an aggregate is cut into the dyadic blocks of rows that cover it, O(log n) of them. Each
  block's figures (count, sum, least, greatest, first error) are worked out once, so filled running
  sums cost n log n, and no formula and no task meets a whole range. Blocks that many ranges ask for
  are laid out under several salts.
* A lookup table that doesn't move is an index of the first row of each key, shared by all formulas
  that look into it; probes are joined with it, salted as well. An approximate lookup takes few
  thresholds as literals, and merges many with the probes by ranges of the key.

Fifteen-digit rules are decided in the JVM wherever digits past the fifteenth can't matter. Where they
can (two computed numbers that nearly tie), and where something isn't modelled here (wildcards, a
number shown as text), a value is in *doubt*: that formula goes to the interpreter, as do shapes that
don't compile.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.address import LAST_ROW, MAX_COL
from tabulon.functions.evaluate import Err, Unsupported, Value, parse
from tabulon.functions.text import AXIS, CELL, SHEET, Reference, corner
from tabulon.plans.keep import written
from tabulon.values import shown_bounds

#: Shapes that are compiled, the most frequent first; columns of a range; salts; thresholds of a plan; radix and levels of blocks.
MOST_SHAPES, MOST_COLUMNS, SALTS, LITERALS, RADIX, LEVELS = 128, 64, 16, 256, 4, 11
PLACE = ["sheet_id", "row", "col"]


# --- shapes ------------------------------------------------------------------------------------
# The scanner's words in the order it tries them; calls take their bracket, so that none looks like a reference.
# Letters are those of a pattern's flags: ASCII ones are looked for much faster, and most formulas have no others.
_CELLS = rf"{CELL}(?![\w.(])(?::{CELL}(?![\w.(]))?"
_WORDS = rf"""{CELL}(?![\w.(!:])|"(?:[^"]|"")*"|#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA|SPILL!|CALC!)|[^\W\d][\w.]*\(|(?:{SHEET})?(?:(?:{AXIS})(?![\w.(])|{_CELLS})|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?:{SHEET})?[^\W\d][\w.\\?]*\(?"""
_END = rf"{CELL}(?::{CELL})?$"
_AXIS = rf"(?:^|!)(?:{AXIS})$"
_MARK = "\x01"
_ASCII = "^[\x02-\x7f]*$"


def shape_of(formula: Column, row: Column, col: Column) -> Column:
    """The formula relative to its cell, as functions.text.shape gives it; null if it names whole rows or columns."""

    def place(text: Column) -> Column:
        letters = F.upper(F.regexp_replace(text, "[$0-9]", ""))
        line = F.regexp_replace(text, "^.*[^0-9]", "").cast("int")
        letter = lambda i: F.ascii(F.substring(letters, i, 1)) - 64
        n = F.length(letters)
        number = F.when(n == 1, letter(1)).when(n == 2, letter(1) * 26 + letter(2)).otherwise((letter(1) * 26 + letter(2)) * 26 + letter(3))
        step = lambda sign, fixed, at, own: F.when(fixed, F.concat(F.lit(sign), at.cast("string"))).when(at == own + 1, F.lit(sign)).otherwise(F.concat(F.lit(f"{sign}["), (at - own - 1).cast("string"), F.lit("]")))
        sound = (line >= 1) & (line <= LAST_ROW + 1) & (number <= MAX_COL + 1)
        return F.when(sound, F.concat(step("R", F.contains(F.substring(text, 2, 4), F.lit("$")), line, row), step("C", F.startswith(text, F.lit("$")), number, col)))

    def word(text: Column) -> Column:
        # Texts in quotes don't end like a reference, and nothing else that does isn't one.
        ends = F.regexp_extract(text, _END, 0)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(ends))
        moved = F.transform(F.split(ends, ":"), place)
        return F.when((ends != "") & ((head == "") | F.endswith(head, F.lit("!"))), F.concat(head, F.when(~F.exists(moved, lambda e: e.isNull()), F.array_join(moved, ":")).otherwise(ends))).otherwise(text)

    def whole(pattern: str) -> Column:
        words, rest = F.regexp_extract_all(formula, F.lit(pattern), F.lit(0)), F.split(F.regexp_replace(formula, pattern, _MARK), _MARK)
        pieces = F.zip_with(rest, F.transform(words, word), lambda r, w: F.concat(r, F.coalesce(w, F.lit(""))))
        return F.when(~F.exists(words, lambda w: F.contains(w, F.lit(":")) & F.regexp_like(w, F.lit(_AXIS))), F.array_join(pieces, ""))

    return F.when(F.regexp_like(formula, F.lit(_ASCII)), whole(_WORDS)).when(~F.contains(formula, F.lit(_MARK)), whole("(?U)" + _WORDS))


# --- values ------------------------------------------------------------------------------------
# Expressions are SQL text, which is parsed once for each plan.
_KINDS = {"num": "double", "txt": "string", "flag": "boolean", "err": "string"}
_FIELD = {"number": "num", "text": "txt", "bool": "flag", "error": "err"}
VALUE = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(n, k) for n, k in (("num", T.DoubleType()), ("txt", T.StringType()), ("flag", T.BooleanType()), ("err", T.StringType()))], T.StructField("doubt", T.BooleanType())])
_fresh = itertools.count()


def lit(v: bool | int | float | str) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"


def any_of(*tests: str) -> str:
    told = [t for t in tests if t != "false"]
    return "(" + " OR ".join(told) + ")" if told else "false"


def first_of(*texts: str) -> str:
    """The first that isn't null."""
    told = [t for t in texts if t != "NULL"]
    return f"coalesce({', '.join(told)})" if len(told) > 1 else told[0] if told else "NULL"


@dataclass(frozen=True)
class V:
    """A value's expression. An atom is a path (a column or a bound name) whose fields may be read; a static one is of a known kind."""

    text: str
    atom: bool = False
    static: str | None = None
    sure: bool = False

    @property
    def kind(self) -> str:
        return lit(self.static) if self.static else f"{self.text}.kind"

    def field(self, name: str) -> str:
        if self.static and _FIELD.get(self.static) != name:
            return f"CAST(NULL AS {_KINDS[name]})"
        return f"{self.text}.{name}"

    @property
    def doubt(self) -> str:
        return "false" if self.sure else f"{self.text}.doubt"

    def is_(self, *kinds: str) -> str:
        if self.static:
            return lit(self.static in kinds)
        return f"({self.text}.kind = {lit(kinds[0])})" if len(kinds) == 1 else f"({self.text}.kind IN ({', '.join(map(lit, kinds))}))"

    @property
    def err(self) -> str:
        return "NULL" if self.static and self.static != "error" else f"CASE WHEN {self.is_('error')} THEN {self.field('err')} END"

    @property
    def number(self) -> str:
        """The number that a value stands for, null if none."""
        if self.static == "number":
            return self.field("num")
        text = self.field("txt")
        return f"CASE {self.kind} WHEN 'number' THEN {self.field('num')} WHEN 'bool' THEN CAST({self.field('flag')} AS double) WHEN 'empty' THEN 0D WHEN 'text' THEN CASE WHEN trim({text}) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN try_cast(trim({text}) AS double) END END"

    @property
    def truth(self) -> str:
        if self.static == "bool":
            return self.field("flag")
        word = f"upper({self.field('txt')})"
        return f"CASE {self.kind} WHEN 'bool' THEN {self.field('flag')} WHEN 'number' THEN {self.field('num')} <> 0 WHEN 'empty' THEN false WHEN 'text' THEN CASE {word} WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END END"


def val(kind: str, value: str | None = None, doubt: str = "false") -> V:
    held = {n: f"CAST({value} AS {k})" if _FIELD.get(kind) == n else f"CAST(NULL AS {k})" for n, k in _KINDS.items()}
    fields = ", ".join(f"'{n}', {v}" for n, v in held.items())
    return V(f"named_struct('kind', {lit(kind)}, {fields}, 'doubt', {doubt})", static=kind, sure=doubt == "false")


def literal(v: Value) -> V:
    if v is None:
        return val("empty")
    kind = "error" if isinstance(v, Err) else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "text"
    return val(kind, lit(str(v) if kind == "error" else v))


#: A stored cell as a value; null is an empty one.
def of_cell(path: str) -> V:
    fields = ", ".join(f"'{n}', {path}.{n}" for n in _KINDS)
    return V(f"named_struct('kind', coalesce({path}.kind, 'empty'), {fields}, 'doubt', false)", sure=True)


def pick(*branches: tuple[str, V], other: V) -> V:
    """A value by cases."""
    every = [v for _, v in branches] + [other]
    kinds = {v.static for v in every}
    return V(case(*[(c, v.text) for c, v in branches], other=other.text), static=kinds.pop() if len(kinds) == 1 else None, sure=all(v.sure for v in every))


def let(f: Callable[..., V], *values: V) -> V:
    """f of values that are worked out once each: what isn't an atom is bound to a name."""
    bound = [v for v in values if not v.atom]
    if not bound:
        return f(*values)
    name = f"x{next(_fresh)}"
    fields = ", ".join(f"'a{i}', {v.text}" for i, v in enumerate(bound))
    at = iter(range(len(bound)))
    inner = f(*[v if v.atom else V(f"{name}.a{next(at)}", True, v.static, v.sure) for v in values])
    return V(f"transform(array(named_struct({fields})), {name} -> {inner.text})[0]", static=inner.static, sure=inner.sure)


def doubtful(v: V, doubt: str) -> V:
    """The value, in further doubt."""
    if doubt == "false":
        return v
    fields = lambda x: ", ".join(f"'{n}', {x.text}.{n}" for n in ("kind", *_KINDS))
    return let(lambda x: V(f"named_struct({fields(x)}, 'doubt', {any_of(x.doubt, doubt)})", static=x.static), v)


def doubts(*values: V) -> str:
    return any_of(*[v.doubt for v in values])


def sound_number(x: str, doubt: str) -> V:
    """A number; what isn't one, or isn't finite, is #NUM!."""
    return with_numbers(lambda n: pick((f"({n} IS NULL OR isnan({n}) OR abs({n}) = double('infinity'))", val("error", "'#NUM!'", doubt)), other=val("number", n, doubt)), x)


def with_numbers(f: Callable[..., V], *numbers: str) -> V:
    """f of numbers that are worked out once each."""
    name = f"x{next(_fresh)}"
    fields = ", ".join(f"'n{i}', {n}" for i, n in enumerate(numbers))
    inner = f(*[f"{name}.n{i}" for i in range(len(numbers))])
    return V(f"transform(array(named_struct({fields})), {name} -> {inner.text})[0]", static=inner.static, sure=inner.sure)


def numeric(values: list[V], of: Callable[..., V]) -> V:
    """`of` (doubt, numbers) where all values stand for numbers; else the first error."""

    def run(*vs: V) -> V:
        def inner(*xs: str) -> V:
            unread = [f"CASE WHEN {v.is_('text')} AND {x} IS NULL THEN '#VALUE!' END" for v, x in zip(vs, xs, strict=True) if v.static != "number"]
            err = first_of(*[v.err for v in vs], *unread)
            good = of(doubts(*vs), *xs)
            return good if err == "NULL" else pick((f"({err}) IS NOT NULL", val("error", err, doubts(*vs))), other=good)

        return with_numbers(inner, *[v.number for v in vs])

    return let(run, *values)


def near(x: str, y: str) -> str:
    """Unequal numbers that fifteen digits may make equal."""
    return f"(({x}) <> ({y}) AND abs(({x}) - ({y})) <= greatest(abs({x}), abs({y})) * 1e-14D)"


def clean(x: str) -> str:
    """Is a number its own fifteen-digit value?"""
    return f"((abs({x}) < 1e15D AND floor({x}) = {x}) OR try_cast(format_string('%.14e', {x}) AS double) = {x})"


def canon(v: V) -> str:
    """What typed equality of lookups compares; null where it is in doubt. A blank key is zero."""
    n = v.field("num")
    return f"CASE {v.kind} WHEN 'number' THEN CASE WHEN {clean(n)} THEN concat('n:', CAST({n} + 0D AS string)) END WHEN 'empty' THEN 'n:0.0' WHEN 'text' THEN concat('t:', upper({v.field('txt')})) WHEN 'bool' THEN concat('b:', CAST({v.field('flag')} AS string)) END"


# --- programs ----------------------------------------------------------------------------------
class Refused(Exception):
    """A shape that isn't compiled."""


@dataclass(frozen=True)
class Spot:
    """A rectangle that a shape reads: each edge as it is, or as an offset from the formula's cell."""

    sheet: int
    top: tuple[bool, int]
    left: tuple[bool, int]
    bottom: tuple[bool, int]
    right: tuple[bool, int]

    @property
    def fixed(self) -> bool:
        return self.top[0] and self.left[0] and self.bottom[0] and self.right[0]

    @property
    def one(self) -> bool:
        return self.top == self.bottom and self.left == self.right

    @property
    def box(self) -> tuple[int, int, int, int, int]:
        (top, bottom), (left, right) = sorted((self.top[1], self.bottom[1])), sorted((self.left[1], self.right[1]))
        return self.sheet, top, left, bottom, right


@dataclass(frozen=True)
class Lookup:
    """What a table that doesn't move gives: the value of a column in the found row, or the row's place."""

    sheet: int
    top: int
    bottom: int
    key: int
    value: int | None
    mode: int


@dataclass
class Program:
    sheet: int
    row: int
    col: int
    tree: tuple
    cells: list[Spot] = field(default_factory=list)
    ranges: list[Spot] = field(default_factory=list)
    lookups: list[tuple[Lookup, tuple]] = field(default_factory=list)


def constant_of(node: tuple) -> Value:
    """The value that a node always has; None if it depends."""
    if node[0] == "call" and node[1] in ("TRUE", "FALSE"):
        return node[1] == "TRUE"
    if node[0] == "unary" and node[1] == "-" and isinstance(v := constant_of(node[2]), float):
        return -v
    return node[1] if node[0] == "literal" else None


class Compiler:
    """Reads a sample formula's tree: what it needs, then its expression over what was fetched."""

    def __init__(self, sheets: list[str], names: dict[str, str]):
        self.sheets = {s.upper(): i for i, s in enumerate(sheets)}
        self.titles = sheets
        self.names = {k.upper(): v for k, v in names.items()}

    def program(self, formula: str, sheet: int, row: int, col: int) -> Program | None:
        try:
            out = Program(sheet, row, col, parse(formula))
            self.need(out, out.tree, inside=False)
            return out
        except (Refused, Unsupported, RecursionError):
            return None

    def spot(self, p: Program, ref: Reference, named: bool = False) -> Spot:
        sheet = p.sheet if ref.sheet is None else self.sheets.get(ref.sheet.upper())
        if sheet is None or ref.book or ref.last_sheet or ref.whole:
            raise Refused
        ends = ref.text.rpartition("!")[2].split(":")
        first, last = corner(ends[0]), corner(ends[-1])
        if named and not (first[2] and first[3] and last[2] and last[3]):
            raise Refused
        edge = lambda fixed, at, own: (True, at) if fixed else (False, at - own)
        # Edges as they are written: which of two is the upper one may differ from cell to cell.
        return Spot(sheet, edge(first[2], first[0], p.row), edge(first[3], first[1], p.col), edge(last[2], last[0], p.row), edge(last[3], last[1], p.col))

    def area(self, p: Program, node: tuple) -> Spot | None:
        if node[0] == "reference":
            return self.spot(p, node[1])
        if node[0] == "name":
            sheet, _, bare = node[1].rpartition("!")
            own_name = f"{sheet.strip(chr(39)) or (self.titles[p.sheet] if p.sheet < len(self.titles) else '')}!{bare}".upper()
            text = self.names.get(own_name) or self.names.get(bare.upper())
            inner = parse(text) if text else None
            if inner is None or inner[0] != "reference":
                raise Refused
            return self.spot(p, inner[1], named=True)
        return None

    def need(self, p: Program, node: tuple, inside: bool) -> None:
        """Collect what a node reads; refuse what isn't modelled. `inside`: in a lookup's key, which holds no lookup."""
        kind = node[0]
        if kind == "literal":
            return
        if kind in ("reference", "name"):
            spot = self.area(p, node)
            if not spot.one:
                raise Refused
            self.add(p.cells, spot)
        elif kind == "unary":
            self.need(p, node[2], inside)
        elif kind == "binary":
            self.need(p, node[2], inside)
            self.need(p, node[3], inside)
        elif node[1] in AGGREGATES:
            if not node[2]:
                raise Refused
            for a in node[2]:
                spot = self.area(p, a)
                if spot is None:
                    self.need(p, a, inside)
                elif spot.one:
                    self.add(p.cells, spot)
                else:
                    if spot.left[0] != spot.right[0] or abs(spot.right[1] - spot.left[1]) >= MOST_COLUMNS:
                        raise Refused
                    self.add(p.ranges, spot)
        elif node[1] in ("VLOOKUP", "MATCH", "INDEX"):
            if inside:
                raise Refused
            found, key = self.lookup(p, node)
            self.need(p, key, True)
            if (found, key) not in p.lookups:
                p.lookups.append((found, key))
        elif node[1] in CALLS:
            low, high, _ = CALLS[node[1]]
            if not low <= len(node[2]) <= high:
                raise Refused
            for a in node[2]:
                self.need(p, a, inside)
        else:
            raise Refused

    @staticmethod
    def add(kept: list, spot: Spot) -> None:
        if spot not in kept:
            kept.append(spot)

    def lookup(self, p: Program, node: tuple) -> tuple[Lookup, tuple]:
        name, args = node[1], node[2]
        constant = lambda i, default: constant_of(args[i]) if len(args) > i else default
        if name == "INDEX":
            if len(args) != 2 or args[1][0] != "call" or args[1][1] != "MATCH":
                raise Refused
            line = self.area(p, args[0])
            found, key = self.lookup(p, args[1])
            if line is None or not line.fixed or line.left != line.right or line.sheet != found.sheet or (line.box[1], line.box[3]) != (found.top, found.bottom):
                raise Refused
            return Lookup(found.sheet, found.top, found.bottom, found.key, line.left[1], found.mode), key
        table = self.area(p, args[1]) if len(args) > 1 else None
        if table is None or not table.fixed or table.top == table.bottom:
            raise Refused
        sheet, top, left, bottom, right = table.box
        if name == "MATCH":
            mode = constant(2, 1.0)
            if left != right or not isinstance(mode, float) or len(args) > 3:
                raise Refused
            return Lookup(sheet, top, bottom, left, None, int(math.copysign(1, mode)) if mode else 0), args[0]
        column, loose = constant(2, None), constant(3, True)
        if not isinstance(column, float) or not isinstance(loose, (bool, float)) or len(args) > 4 or not 1 <= math.floor(column) <= right - left + 1:
            raise Refused
        return Lookup(sheet, top, bottom, left, left + math.floor(column) - 1, 1 if loose else 0), args[0]

    # --- expressions ---
    def value(self, p: Program, node: tuple, at: Fetched) -> V:
        kind = node[0]
        if kind == "literal":
            return literal(node[1])
        if kind in ("reference", "name"):
            return at.cell(self.area(p, node))
        if kind == "unary":
            v = self.value(p, node[2], at)
            if node[1] == "+":
                return v
            return numeric([v], lambda d, x: sound_number(f"(-{x})" if node[1] == "-" else f"({x} / 100D)", d))
        if kind == "binary":
            return operate(node[1], self.value(p, node[2], at), self.value(p, node[3], at))
        name, args = node[1], node[2]
        if name in AGGREGATES:
            return self.aggregate(p, name, args, at)
        if name in ("VLOOKUP", "MATCH", "INDEX"):
            found, key = self.lookup(p, node)
            return at.lookup(p.lookups.index((found, key)))
        values = [self.value(p, a, at) for a in args]
        if name in ("AND", "OR"):  # a text that is read from a cell has no say
            values = [v if a[0] not in ("reference", "name") else let(lambda x: pick((x.is_("text"), val("empty")), other=x), v) for a, v in zip(args, values, strict=True)]
        return CALLS[name][2](*values)

    def aggregate(self, p: Program, name: str, args: tuple, at: Fetched) -> V:
        parts = []
        for a in args:
            spot = self.area(p, a)
            parts.append(scalar_figures(self.value(p, a, at)) if spot is None else cell_figures(at.cell(spot)) if spot.one else at.figures(spot))
        return let(lambda *fs: AGGREGATES[name]([f.text for f in fs]), *parts)


def operate(op: str, a: V, b: V) -> V:
    if op == "&":
        return joined(a, b)
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return let(lambda x, y: compared(op, x, y), a, b)
    if op in "+-":

        def add(d: str, x: str, y: str) -> V:
            y = y if op == "+" else f"(-{y})"
            return sound_number(f"({x} + {y})", any_of(d, near(x, f"(-{y})")))

        return numeric([a, b], add)
    if op == "*":
        return numeric([a, b], lambda d, x, y: sound_number(f"({x} * {y})", d))
    if op == "/":
        return numeric([a, b], lambda d, x, y: pick((f"{y} = 0", val("error", "'#DIV/0!'", d)), other=sound_number(f"try_divide({x}, {y})", d)))
    return numeric([a, b], lambda d, x, y: sound_number(f"power({x}, {y})", d))


def compared(op: str, a: V, b: V) -> V:
    """Numbers before texts before bools; a blank takes the other side's zero."""

    def rank(v: V, o: V) -> str:
        of = lambda x: "1" if x.static == "text" else "2" if x.static == "bool" else "0" if x.static else f"CASE {x.kind} WHEN 'text' THEN 1 WHEN 'bool' THEN 2 ELSE 0 END"
        return of(v) if v.static and v.static != "empty" else f"CASE WHEN {v.is_('empty')} THEN {of(o)} ELSE {of(v)} END"

    sign = lambda m, n: f"CASE WHEN {m} < {n} THEN -1 WHEN {m} > {n} THEN 1 ELSE 0 END"
    x, y = (f"coalesce({v.field('num')}, 0D)" for v in (a, b))
    s, t = (f"upper(coalesce({v.field('txt')}, ''))" for v in (a, b))
    f, g = (f"CAST(coalesce({v.field('flag')}, false) AS int)" for v in (a, b))
    ra, rb = rank(a, b), rank(b, a)
    order = f"CASE WHEN ({ra}) <> ({rb}) THEN {sign(f'({ra})', f'({rb})')} WHEN ({ra}) = 0 THEN {sign(x, y)} WHEN ({ra}) = 1 THEN {sign(s, t)} ELSE {sign(f, g)} END"
    err, d = first_of(a.err, b.err), any_of(doubts(a, b), f"(({ra}) = 0 AND ({rb}) = 0 AND {near(x, y)})")
    result = val("bool", f"({order}) {op} 0", d)
    return result if err == "NULL" else pick((f"({err}) IS NOT NULL", val("error", err, d)), other=result)


def shown_text(v: V) -> tuple[str, str]:
    """A value as text, and whether that is in doubt."""
    n = v.field("num")
    whole = f"(floor({n}) = {n} AND abs({n}) < 1e15D)"
    text = f"CASE {v.kind} WHEN 'text' THEN {v.field('txt')} WHEN 'number' THEN CASE WHEN {whole} THEN CAST(try_cast({n} AS bigint) AS string) ELSE '' END WHEN 'bool' THEN upper(CAST({v.field('flag')} AS string)) ELSE '' END"
    return text, any_of(v.doubt, "false" if v.static and v.static != "number" else f"({v.is_('number')} AND NOT {whole})")


def textual(of: Callable[..., V]) -> Callable[..., V]:
    """`of` (doubt, texts) of values as texts, or the first error."""

    def run(*values: V) -> V:
        def inner(*vs: V) -> V:
            err, told = first_of(*[v.err for v in vs]), [shown_text(v) for v in vs]
            d = any_of(*[more for _, more in told])
            result = of(d, *[t for t, _ in told])
            return result if err == "NULL" else pick((f"({err}) IS NOT NULL", val("error", err, d)), other=result)

        return let(inner, *values)

    return run


joined = textual(lambda d, *ts: val("text", f"concat({', '.join(ts)})", d))


def choose(condition: V, then: V | None = None, other: V | None = None) -> V:
    then, other = val("empty") if then is None else then, val("bool", "false") if other is None else other

    def run(c: V) -> V:
        err = first_of(c.err, f"CASE WHEN ({c.truth}) IS NULL THEN '#VALUE!' END")
        return doubtful(pick((f"({err}) IS NOT NULL", val("error", err)), (c.truth, then), other=other), c.doubt)

    return let(run, condition)


def if_error(only: str | None) -> Callable[[V, V], V]:
    def run(v: V, other: V) -> V:
        wanted = lambda x: f"{x.is_('error')}" + (f" AND {x.field('err')} = {lit(only)}" if only else "")
        return let(lambda x: doubtful(pick((wanted(x), other), other=x), x.doubt), v)

    return run


def junction(every: bool) -> Callable[..., V]:
    def run(*values: V) -> V:
        def inner(*vs: V) -> V:
            told = [f"CASE WHEN NOT {v.is_('empty')} THEN {v.truth} END" for v in vs]
            err = first_of(*[f"CASE WHEN {v.is_('error')} THEN {v.field('err')} WHEN NOT {v.is_('empty')} AND ({v.truth}) IS NULL THEN '#VALUE!' END" for v in vs])
            result = (" AND " if every else " OR ").join(f"coalesce({t}, {lit(every)})" for t in told)
            none = " AND ".join(f"({t}) IS NULL" for t in told)
            return pick((f"({err}) IS NOT NULL", val("error", err, doubts(*vs))), (f"({none})", val("error", "'#VALUE!'", doubts(*vs))), other=val("bool", f"({result})", doubts(*vs)))

        return let(inner, *values)

    return run


def negate(v: V) -> V:
    def run(x: V) -> V:
        err = first_of(x.err, f"CASE WHEN ({x.truth}) IS NULL THEN '#VALUE!' END")
        return pick((f"({err}) IS NOT NULL", val("error", err, x.doubt)), other=val("bool", f"NOT ({x.truth})", x.doubt))

    return let(run, v)


def test(of: Callable[[V], str]) -> tuple:
    return 1, 1, lambda v: let(lambda x: val("bool", of(x), x.doubt), v)


def plain(of: Callable[[str], str]) -> tuple:
    return 1, 1, lambda v: numeric([v], lambda d, x: sound_number(of(x), d))


#: Calls of scalar arguments: least and most of them, and the expression.
CALLS: dict[str, tuple[int, int, Callable[..., V]]] = {
    "IF": (1, 3, choose), "IFERROR": (2, 2, if_error(None)), "IFNA": (2, 2, if_error("#N/A")), "AND": (1, 30, junction(True)), "OR": (1, 30, junction(False)),
    "NOT": (1, 1, negate), "TRUE": (0, 0, lambda: literal(True)), "FALSE": (0, 0, lambda: literal(False)), "NA": (0, 0, lambda: literal(Err("#N/A"))),
    "ISBLANK": test(lambda v: v.is_("empty")), "ISNUMBER": test(lambda v: v.is_("number")), "ISTEXT": test(lambda v: v.is_("text")), "ISNONTEXT": test(lambda v: f"NOT {v.is_('text')}"),
    "ISLOGICAL": test(lambda v: v.is_("bool")), "ISERROR": test(lambda v: v.is_("error")), "ISERR": test(lambda v: f"({v.is_('error')} AND {v.field('err')} <> '#N/A')"), "ISNA": test(lambda v: f"({v.is_('error')} AND {v.field('err')} = '#N/A')"),
    "ABS": plain(lambda x: f"abs({x})"), "INT": plain(lambda x: f"CASE WHEN abs({x}) < 4e18D THEN CAST(floor({x}) AS double) ELSE {x} END"), "SIGN": plain(lambda x: f"signum({x})"), "SQRT": plain(lambda x: f"sqrt({x})"),
    "LEN": (1, 1, textual(lambda d, t: val("number", f"char_length({t})", d))), "UPPER": (1, 1, textual(lambda d, t: val("text", f"upper({t})", d))), "LOWER": (1, 1, textual(lambda d, t: val("text", f"lower({t})", d))),
    "EXACT": (2, 2, textual(lambda d, s, t: val("bool", f"({s}) = ({t})", d))), "CONCATENATE": (1, 30, joined), "CONCAT": (1, 30, joined),
}


# --- figures of ranges -------------------------------------------------------------------------
FIGURES = {"numbers": "bigint", "filled": "bigint", "blank_texts": "bigint", "cells": "bigint", "total": "double", "least": "double", "most": "double", "err": "string", "doubt": "boolean"}


def figures(**given: str) -> V:
    """Counts, sum, extremes and first error as a struct; an atom of it has its fields read by name."""
    missing = {"numbers": "0", "filled": "0", "blank_texts": "0", "cells": "0", "doubt": "false"}
    return V("named_struct(" + ", ".join(f"'{n}', CAST({given.get(n, missing.get(n, 'NULL'))} AS {k})" for n, k in FIGURES.items()) + ")")


def cell_figures(v: V) -> V:
    """A cell that is written as a reference: texts and bools are passed over."""
    one = lambda t: f"CASE WHEN {t} THEN 1 ELSE 0 END"
    return let(lambda x: figures(numbers=one(x.is_("number")), filled=one(f"NOT {x.is_('empty')}"), blank_texts=one(f"{x.field('txt')} = ''"), cells="1", total=x.field("num"), least=x.field("num"), most=x.field("num"), err=x.err, doubt=x.doubt), v)


def scalar_figures(v: V) -> V:
    """A value that is written out: it is coerced."""

    def run(x: V) -> V:
        n, one = x.number, lambda t: f"CASE WHEN {t} THEN 1 ELSE 0 END"
        err = first_of(x.err, f"CASE WHEN ({n}) IS NULL THEN '#VALUE!' END")
        return figures(numbers=one(f"NOT {x.is_('error')} AND ({n}) IS NOT NULL"), filled=one(f"NOT {x.is_('empty')}"), blank_texts=one(f"{x.field('txt')} = ''"), cells="1", total=n, least=n, most=n, err=err, doubt=x.doubt)

    return let(run, v)


def over(of: Callable[[list[str]], V]) -> Callable[[list[str]], V]:
    """An aggregate of numbers: the first error of its arguments, else `of` them."""

    def run(fs: list[str]) -> V:
        err, d = first_of(*[f"{f}.err" for f in fs]), any_of(*[f"{f}.doubt" for f in fs])
        return pick((f"({err}) IS NOT NULL", val("error", err, d)), other=doubtful(of(fs), d))

    return run


def summed(fs: list[str], name: str) -> str:
    return "(" + " + ".join(f"coalesce({f}.{name}, 0)" for f in fs) + ")"


def extreme(fs: list[str], name: str) -> str:
    them = [f"{f}.{name}" for f in fs]
    return f"coalesce({('least' if name == 'least' else 'greatest') + '(' + ', '.join(them) + ')' if len(fs) > 1 else them[0]}, 0D)"


def counted(of: Callable[[list[str]], str]) -> Callable[[list[str]], V]:
    return lambda fs: val("number", of(fs), any_of(*[f"{f}.doubt" for f in fs]))


AGGREGATES: dict[str, Callable[[list[str]], V]] = {
    "SUM": over(lambda fs: sound_number(summed(fs, "total"), "false")),
    "AVERAGE": over(lambda fs: pick((f"{summed(fs, 'numbers')} = 0", val("error", "'#DIV/0!'")), other=sound_number(f"try_divide({summed(fs, 'total')}, {summed(fs, 'numbers')})", "false"))),
    "MIN": over(lambda fs: val("number", extreme(fs, "least"))),
    "MAX": over(lambda fs: val("number", extreme(fs, "most"))),
    "COUNT": counted(lambda fs: summed(fs, "numbers")),
    "COUNTA": counted(lambda fs: summed(fs, "filled")),
    "COUNTBLANK": counted(lambda fs: f"{summed(fs, 'cells')} - {summed(fs, 'filled')} + {summed(fs, 'blank_texts')}"),
}


def cover(top: str, bottom: str) -> Column:
    """The blocks (level, block) of RADIX**level rows that make the rows from top to bottom."""
    size = f"CAST(power({RADIX}, {{l}}) AS INT)"
    lo = lambda level: f"CAST(ceil({top} / {size.format(l=level)}) AS INT)"
    hi = lambda level: f"CAST(floor(({bottom} + 1) / {size.format(l=level)}) AS INT)"
    span = lambda a, b: f"CASE WHEN {a} < {b} THEN transform(sequence({a}, {b} - 1), b -> named_struct('level', l, 'block', b)) ELSE cast(array() as array<struct<level: int, block: int>>) END"
    inner = f"l < {LEVELS - 1} AND {lo('l + 1')} < {hi('l + 1')}"
    parts = f"CASE WHEN {inner} THEN concat({span(lo('l'), f'{RADIX} * ' + lo('l + 1'))}, {span(f'{RADIX} * ' + hi('l + 1'), hi('l'))}) ELSE {span(lo('l'), hi('l'))} END"
    reached = f"l = 0 OR {lo('l')} < {hi('l')}"
    return F.expr(f"flatten(transform(filter(sequence(0, {LEVELS - 1}), l -> {reached}), l -> {parts}))")


def blocks_of(row: str, levels: list[int] | None = None) -> Column:
    """The blocks that a row lies in, one of each level (or of the levels that are asked for)."""
    asked = f"sequence(0, {LEVELS - 1})" if levels is None else f"cast(array({', '.join(map(str, levels))}) as array<int>)"
    return F.expr(f"transform({asked}, l -> named_struct('level', l, 'block', CAST(floor({row} / power({RADIX}, l)) AS INT)))")


BOX = ["target", "top", "left", "bottom", "right"]


def range_figures(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(target, top, left, bottom, right, figures) of distinct ranges: covers joined with the figures of blocks."""
    c = F.col
    wanted = ranges.select(*BOX).distinct().withColumn("column", F.explode(F.sequence("left", "right"))).withColumn("part", F.explode(cover("top", "bottom")))
    salted = F.when(c("level") >= 3, F.pmod(F.hash(*BOX), F.lit(SALTS))).otherwise(0)
    wanted = wanted.select(*BOX, "column", "part.level", "part.block").withColumn("salt", salted)
    columns = ranges.select("target", F.explode(F.sequence("left", "right")).alias("column")).distinct()
    stored = cells.filter("kind <> 'empty'").withColumnRenamed("sheet_id", "target").withColumnRenamed("col", "column").join(columns, ["target", "column"], "left_semi")
    first = F.when(c("kind") == "error", F.struct("row", "column", "err"))
    # A task sums what it has of a block before it is sent, so higher levels add little.
    rows = stored.select("target", "column", "row", (c("kind") == "number").cast("long").alias("numbers"), F.lit(1).cast("long").alias("filled"), F.coalesce((c("txt") == "").cast("long"), F.lit(0).cast("long")).alias("blank_texts"), "num", first.alias("first"))
    level = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("block", F.floor(c("row") / F.pow(F.lit(float(RADIX)), c("level"))).cast("int"))
    blocks = level.groupBy("target", "column", "level", "block").agg(F.sum("numbers").alias("numbers"), F.sum("filled").alias("filled"), F.sum("blank_texts").alias("blank_texts"), F.sum("num").alias("total"), F.min("num").alias("least"), F.max("num").alias("most"), F.min("first").alias("first"))
    blocks = blocks.withColumn("salt", F.explode(F.when(c("level") >= 3, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = wanted.join(blocks, ["target", "column", "level", "block", "salt"], "left")
    found = met.groupBy(*BOX).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("numbers", "filled", "blank_texts")], F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("first")["err"].alias("err"))
    cells_in = (c("bottom") - c("top") + 1).cast("long") * (c("right") - c("left") + 1)
    given = {n: n for n in FIGURES if n != "doubt"} | {"cells": "cells_in"}
    return found.withColumn("cells_in", cells_in).select(*BOX, F.expr(figures(**given).text).alias("figures"))


# --- plans -------------------------------------------------------------------------------------
class Fetched:
    """Where a program's expression finds what was fetched: literals, or columns of the row."""

    def __init__(self, p: Program, cells: dict, ranges: dict):
        self.p, self.cells, self.ranges = p, cells, ranges

    def cell(self, spot: Spot) -> V:
        return literal(self.cells.get(spot.box[:3])) if spot.fixed else V(f"c{self.p.cells.index(spot)}", atom=True, sure=True)

    def figures(self, spot: Spot) -> V:
        if spot.fixed:
            f = self.ranges[spot.box]
            return figures(**{n: lit(f[n]) for n in FIGURES if f[n] is not None})
        return V(f"s{self.p.ranges.index(spot)}", atom=True)

    def lookup(self, i: int) -> V:
        return V(f"found{i}", atom=True)


def value_of(r) -> Value:
    return {"number": lambda: float(r["num"]), "text": lambda: r["txt"], "bool": lambda: bool(r["flag"]), "error": lambda: Err(r["err"])}.get(r["kind"], lambda: None)()


def requests(spots: list[Spot]) -> str:
    """An array of the places that move which one program reads, by their numbers."""
    edge = lambda e, own: str(e[1]) if e[0] else f"{own} + {e[1]}"
    # A range whose edges cross as it is filled is the same rectangle with its edges in order.
    pair = lambda first, last, a, b, own: f"'{first}', least({edge(a, own)}, {edge(b, own)}), '{last}', greatest({edge(a, own)}, {edge(b, own)})"
    one = lambda i, s: f"named_struct('slot', {i}, 'target', {s.sheet}, {pair('top', 'bottom', s.top, s.bottom, '`row`')}, {pair('left', 'right', s.left, s.right, '`col`')})"
    return f"array({', '.join(one(i, s) for i, s in enumerate(spots) if not s.fixed)})"


def by_program(programs: list[Program], of: Callable[[Program], str | None]) -> Column | None:
    told = [(i, text) for i, p in enumerate(programs) if (text := of(p)) is not None]
    return F.expr("CASE program " + " ".join(f"WHEN {i} THEN {text}" for i, text in told) + " END") if told else None


def shaped(formulas: DataFrame) -> DataFrame:
    return formulas.withColumn("shape", shape_of(F.col("formula"), F.col("row"), F.col("col")))


def programs_of(formulas: DataFrame, compiler: Compiler) -> tuple[list[Program], DataFrame]:
    """The programs of the most frequent shapes, and their keys (sheet_id, shape, program)."""
    sample = F.min_by(F.struct("row", "col", "formula"), F.struct("row", "col")).alias("sample")
    common = formulas.filter("shape is not null").groupBy("sheet_id", "shape").agg(F.count("*").alias("n"), sample).orderBy(F.desc("n"), "sheet_id", "shape").limit(MOST_SHAPES).collect()
    programs, keys = [], []
    for r in common:
        p = compiler.program(r["sample"]["formula"], r["sheet_id"], r["sample"]["row"], r["sample"]["col"])
        if p is not None:
            keys.append((r["sheet_id"], r["shape"], len(programs)))
            programs.append(p)
    return programs, formulas.sparkSession.createDataFrame(keys, "sheet_id int, shape string, program int")


def fixed_cells(cells: DataFrame, programs: list[Program]) -> dict[tuple, Value]:
    """The places that don't move: at most those that MOST_SHAPES shapes name."""
    places = sorted({s.box[:3] for p in programs for s in p.cells if s.fixed})
    if not places:
        return {}
    asked = cells.sparkSession.createDataFrame(places, "sheet_id int, row int, col int")
    return {(r["sheet_id"], r["row"], r["col"]): value_of(r) for r in cells.join(F.broadcast(asked), PLACE, "left_semi").collect()}


def fixed_ranges(cells: DataFrame, programs: list[Program]) -> dict[tuple, dict]:
    boxes = sorted({s.box for p in programs for s in p.ranges if s.fixed})
    if not boxes:
        return {}
    asked = cells.sparkSession.createDataFrame(boxes, ", ".join(f"{n} int" for n in BOX))
    return {tuple(r[n] for n in BOX): r["figures"].asDict() for r in range_figures(cells, asked).collect()}


def lookup_rows(cells: DataFrame, tables: list[Lookup]) -> DataFrame:
    """(table, place, key, value): the rows of lookup tables; a row without a key is none."""
    spark = cells.sparkSession
    asked = F.broadcast(spark.createDataFrame([(i, t.sheet, t.top, t.bottom, t.key, -1 if t.value is None else t.value) for i, t in enumerate(tables)], "table int, sheet_id int, top int, bottom int, key_col int, value_col int"))
    stored = cells.filter("kind <> 'empty'").select(*PLACE, F.struct(*[F.col(n) for n in ("kind", *_KINDS)]).alias("cell"))
    c = F.col
    inside = c("row").between(c("top"), c("bottom"))
    keys = stored.join(asked, "sheet_id").filter(inside & (c("col") == c("key_col"))).select("table", "row", (c("row") - c("top")).alias("place"), c("cell").alias("key"))
    values = stored.join(asked, "sheet_id").filter(inside & (c("col") == c("value_col"))).select("table", "row", c("cell").alias("value"))
    return keys.join(values, ["table", "row"], "left").select("table", "place", "key", "value")


def looked_up(rows: DataFrame, cells: DataFrame, programs: list[Program], fetched: list[Fetched], compiler: Compiler) -> DataFrame:
    """Rows of programs with lookups, with found0, found1, .."""
    tables = sorted({t for p in programs for t, _ in p.lookups}, key=lambda t: (t.sheet, t.top, t.bottom, t.key, -1 if t.value is None else t.value, t.mode))
    held = written(lookup_rows(cells, tables))  # read for the index, for thresholds and for what is in doubt
    exact, loose = [i for i, t in enumerate(tables) if t.mode == 0], [i for i, t in enumerate(tables) if t.mode != 0]
    unclean = F.expr(f"key.kind = 'number' AND NOT {clean('key.num')}")
    messy = [r["table"] for r in held.filter(unclean).select("table").distinct().collect()]
    among = lambda of: f"`table` IN ({', '.join(map(str, of))})" if of else "false"
    key = V("`key`", atom=True)
    hit = pick((among([i for i, t in enumerate(tables) if t.value is None]), val("number", "place + 1")), other=of_cell("`value`")).text
    index = held.filter(F.expr(among(exact))).withColumn("canon", F.expr(canon(V("`key`", atom=True)))).filter("canon IS NOT NULL")
    index = index.groupBy("table", "canon").agg(F.min_by(F.struct("place", "value"), "place").alias("first")).select("table", "canon", "first.*").select("table", "canon", F.expr(hit).alias("hit"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for j in range(max(len(p.lookups) for p in programs)):
        mine = [(i, tables.index(p.lookups[j][0]), compiler.value(p, p.lookups[j][1], fetched[i])) for i, p in enumerate(programs) if len(p.lookups) > j]
        choose_ = lambda texts: "CASE program " + " ".join(f"WHEN {i} THEN {t}" for (i, _, _), t in zip(mine, texts, strict=True)) + " END"  # noqa: E731, B023
        rows = rows.withColumn("table", F.expr(choose_([str(t) for _, t, _ in mine]))).withColumn("key", F.expr(choose_([k.text for _, _, k in mine])))
        pattern = f"({among(exact)} AND key.kind = 'text' AND key.txt RLIKE '[*?~]')"
        by_order = f"({among(loose)} AND key.kind NOT IN ('number', 'empty', 'error'))"
        fuzzy = f"(key.kind = 'number' AND NOT {clean('key.num')})"
        rows = rows.withColumn("doubt", F.expr(f"coalesce(key.doubt OR {pattern} OR {by_order} OR {fuzzy} OR {among(messy)}, false)"))
        # Rows without this lookup, and rows in doubt, have no key to be dealt by; they are spread by their salt.
        rows = rows.withColumn("canon", F.expr(f"CASE WHEN NOT doubt AND {among(exact)} THEN {canon(key)} END")).withColumn("salt", F.pmod(F.hash(*PLACE), F.lit(SALTS)))
        # Salted copies are many times what Spark takes the index for, so it is not left to be broadcast.
        rows = rows.join(index.hint("merge"), ["table", "canon", "salt"], "left") if exact else rows.withColumn("hit", F.lit(None).cast(VALUE))
        for t in sorted({t for _, t, _ in mine if t in loose}):
            rows = approximately(rows, held.filter(F.col("table") == t), t, tables[t])
        miss = pick(("key.kind = 'error'", val("error", "key.err")), other=val("error", "'#N/A'")).text
        found = f"CASE WHEN `table` IS NULL THEN NULL WHEN doubt THEN {V(val('empty', doubt='true').text).text} WHEN key.kind <> 'error' THEN coalesce(hit, {miss}) ELSE {miss} END"
        rows = rows.withColumn(f"found{j}", F.expr(found)).drop("table", "key", "doubt", "canon", "salt", "hit")
    return rows


def approximately(rows: DataFrame, held: DataFrame, number: int, table: Lookup) -> DataFrame:
    """`hit` of the rows that look into one table by order: the last place whose number is at most (at least) the key."""
    steps = held.filter("key.kind = 'number'").groupBy(F.col("key.num").alias("num")).agg(F.max("place").alias("place"))
    few = steps.limit(LITERALS + 1).collect()
    below, mine = table.mode > 0, F.expr(f"coalesce(`table` = {number} AND NOT doubt AND key.kind <> 'error', false)")
    probe = F.expr("coalesce(key.num, 0D)")
    if len(few) <= LITERALS:
        at, top = "CAST(NULL AS int)", -1
        for num, place in sorted(((r["num"], r["place"]) for r in few), reverse=not below):
            if place > top:
                top, (low, high) = place, shown_bounds(num)
                at = f"CASE WHEN coalesce(key.num, 0D) {f'>= {lit(low)}' if below else f'<= {lit(high)}'} THEN {place} ELSE {at} END"
        rows = rows.withColumn("place", F.when(mine, F.expr(at)))
    else:
        from tabulon.operators.lookup import _as_of

        others = rows.filter(~mine).withColumn("place", F.lit(None).cast("int"))
        rows = others.unionByName(_as_of(rows.filter(mine), probe, steps.select("num", F.col("place").cast("long").alias("place")), below).withColumn("place", F.col("place").cast("int")))
    value = (val("number", "place + 1") if table.value is None else of_cell("`value`")).text
    hits = held.select("place", F.expr(value).alias("near_hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("mine", mine).join(hits.hint("merge"), ["place", "salt"], "left")
    return met.withColumn("hit", F.coalesce(F.when(F.col("mine"), F.col("near_hit")), F.col("hit"))).drop("place", "near_hit", "mine")


def evaluated(cells: DataFrame, formulas: DataFrame, sheets: list[str], names: dict[str, str]) -> DataFrame | None:
    """(sheet_id, row, col, value) of the formulas whose shapes compile; null if no shape does.

    formulas: sheet_id, row, col, formula. A value in doubt says so."""
    compiler = Compiler(sheets, names)
    # A stated number of partitions is not merged by size: shapes cost more than their bytes tell.
    dealt = formulas.select(*PLACE, "formula").repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)
    every = written(shaped(dealt))  # scanned once: its rows are read for the programs, and for what each reads
    programs, keys = programs_of(every, compiler)
    if not programs:
        return None
    rows = every.join(F.broadcast(keys), ["sheet_id", "shape"]).select(*PLACE, "program")
    stored = cells.filter("kind <> 'empty'")
    literals, totals = fixed_cells(stored, programs), fixed_ranges(stored, programs)
    fetched = [Fetched(p, literals, totals) for p in programs]
    moving = by_program(programs, lambda p: requests(p.cells) if any(not s.fixed for s in p.cells) else None)
    if moving is not None:
        asked = rows.withColumn("r", F.explode(moving)).select(*PLACE, F.col("r.slot").alias("slot"), F.col("r.target").alias("target"), F.col("r.top").alias("at_row"), F.col("r.left").alias("at_col"))
        there = stored.select(F.col("sheet_id").alias("target"), F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.struct(*[F.col(n) for n in ("kind", *_KINDS)]).alias("cell"))
        got = asked.join(there.hint("merge"), ["target", "at_row", "at_col"], "left").groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("slot", "cell"))).alias("got"))
        most = max(len(p.cells) for p in programs)
        rows = rows.join(got.hint("merge"), PLACE, "left").select(*PLACE, "program", *[F.expr(of_cell(f"got[{i}]").text).alias(f"c{i}") for i in range(most)])
    spans = by_program(programs, lambda p: requests(p.ranges) if any(not s.fixed for s in p.ranges) else None)
    if spans is not None:
        asked = rows.withColumn("r", F.explode(spans)).select(*PLACE, F.col("r.slot").alias("slot"), *[F.col(f"r.{n}").alias(n) for n in BOX])
        sums = asked.join(range_figures(stored, asked), BOX).groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("slot", "figures"))).alias("sums"))
        most = max(len(p.ranges) for p in programs)
        rows = rows.join(sums.hint("merge"), PLACE, "left").select("*", *[F.col("sums")[i].alias(f"s{i}") for i in range(most)]).drop("sums")
    top = lambda v: let(lambda x: pick((x.is_("empty"), val("number", "0D", x.doubt)), other=x), v).text
    result = lambda which: by_program(programs, lambda p: top(compiler.value(p, p.tree, fetched[programs.index(p)])) if bool(p.lookups) == which else None)
    with_lookups = [i for i, p in enumerate(programs) if p.lookups]
    out = None
    if len(with_lookups) < len(programs):
        out = rows.filter(~F.col("program").isin(with_lookups)).select(*PLACE, result(False).alias("value"))
    if with_lookups:
        found = looked_up(rows.filter(F.col("program").isin(with_lookups)), stored, programs, fetched, compiler).select(*PLACE, result(True).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def same_as(stored: Column, v: Column) -> Column:
    """Does a value agree with a stored one? Blanks and empty texts are alike, and blanks are zero."""
    nothing = lambda x: (x["kind"] == "empty") | ((x["kind"] == "text") & (x["txt"] == ""))
    kind = F.when(stored["kind"] == "empty", "number").otherwise(stored["kind"])
    a, b = F.coalesce(stored["num"], F.lit(0.0)), F.coalesce(v["num"], F.lit(0.0))
    close = F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * 1e-9
    equal = F.when(kind == "number", close).when(kind == "text", stored["txt"] == v["txt"]).when(kind == "bool", stored["flag"] == v["flag"]).otherwise(stored["err"] == v["err"])
    return (nothing(stored) & nothing(v)) | ((kind == v["kind"]) & F.coalesce(equal, F.lit(False)))
