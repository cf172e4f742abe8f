"""Formulas that read their own row alone, settled a row at a time.

A formula that was filled down is one text but for the number of its row. That number is cut out of each
text. Rows that hold the same skeletons and the same substituted columns have one signature; the skeletons
of the most frequent ones are parsed once each. Where their references all lie in the formula's own row, a
signature says all but the values: what is reached at which level, in which order, and what reads in a
circle. It is one column expression over the cells of a row, and a row is settled in one task, with no
join and no round.

Rows that hold another formula, that have a rare signature or a value in doubt are not settled here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.address import LAST_ROW
from tabulon.functions.text import scan_references, shape
from tabulon.operators.compiled import PLACE, VALUE, Compiler, Program, V, let, lit, of_cell, pick, same_as, val
from tabulon.plans.keep import written

#: Signatures that become expressions, the most frequent first; formulas of a row that has one.
MOST_SIGNATURES, MOST_FORMULAS = 128, 64
#: A row's number in a skeleton; what parts a signature's formulas, a column from its skeleton, and formulas from substituted columns; a formula without a skeleton.
_OWN, _NEXT, _AT, _GIVEN, _UNTOLD = "\x01", "\x02", "\x03", "|\x02", "\x04"
#: Rows whose numbers have one to nine digits.
_PROBES = [int("246813579"[:n]) for n in range(1, 10)]
_CELL = ["kind", "num", "txt", "flag", "err"]


def skeleton_of(formula: Column, row: Column) -> Column:
    """A formula's text without the number of its row; null where it can't be told."""
    sound = row.between(0, LAST_ROW) & ~F.regexp_like(formula, F.lit("[\x01-\x04]"))
    return F.when(sound, F.replace(formula, (row + 1).cast("string"), F.lit(_OWN)))


def at_row(skeleton: str, row: int) -> str:
    return skeleton.replace(_OWN, str(row + 1))


def shape_of_skeleton(skeleton: str, col: int) -> str | None:
    """The shape of all formulas of a skeleton in a column; None if they may differ.

    A shape keeps what is no reference as it is written, so a number that isn't a row's own differs from row to row."""
    told = {shape(at_row(skeleton, r), r, col) for r in _PROBES}
    return told.pop() if len(told) == 1 else None


def column_of(p: Program, spot) -> int:
    fixed, at = spot.left
    return at if fixed else p.col + at


def own_row(skeleton: str, sheet: int, col: int, compiler: Compiler) -> Program | None:
    """The program of a skeleton that reads single cells of its own row, and nothing else."""
    if shape_of_skeleton(skeleton, col) is None:
        return None
    row = _PROBES[2]
    p = compiler.program(at_row(skeleton, row), sheet, row, col)
    if p is None or p.ranges or p.lookups or any(s.sheet != sheet or s.top != (False, 0) or not s.one for s in p.cells):
        return None
    scanned = {(r.left, r.right) for r in scan_references(at_row(skeleton, row))}
    return p if scanned == {(column_of(p, s),) * 2 for s in p.cells} else None


@dataclass
class Signature:
    """What a row's formulas and substituted columns say of it."""

    level: dict[int, int]
    reason: dict[int, str]
    order: list[int]


def signature(programs: dict[int, Program], substituted: set[int]) -> Signature:
    from tabulon.operators.trace import strongly

    reads = {c: {column_of(p, s) for s in p.cells} for c, p in programs.items()}
    level: dict[int, int] = {}
    frontier, n = set(substituted), 0
    while frontier:
        n += 1
        frontier = {c for c, r in reads.items() if c not in level and r & frontier}
        level |= dict.fromkeys(frontier, n)
    reason = dict.fromkeys(strongly(set(level), reads), "circular reference")
    order: list[int] = []
    waiting = set(level) - set(reason)
    while waiting:
        ready = sorted(c for c in waiting if not reads[c] & waiting)
        for c in ready:
            if reads[c] & set(reason):
                reason[c] = "reads a blocked cell"
            else:
                order.append(c)
        waiting -= set(ready)
    return Signature(level, reason, order)


class Values:
    """Where a program's expression finds the cells of its row."""

    def __init__(self, p: Program, of: dict[int, V]):
        self.p, self.of = p, of

    def cell(self, spot) -> V:
        return self.of[column_of(self.p, spot)]


def settling(programs: dict[int, Program], keys: dict[int, int], substituted: set[int], sig: Signature, compiler: Compiler) -> str:
    """An array of what becomes of the reached formulas of a row: col, key, level, reason, before, after, again (its value before the change); null in doubt.

    Where all cells that are read hold numbers, as most do, the kinds are left out of the expression."""
    inputs = sorted({column_of(p, s) for c in sig.order for p in [programs[c]] for s in p.cells})
    top = lambda v: v if v.static not in (None, "empty") else let(lambda x: pick((x.is_("empty"), val("number", "0D", x.doubt)), other=x), v)
    none = f"CAST(NULL AS {VALUE.simpleString()})"

    def one(c: int, after: str, again: str) -> str:
        return f"named_struct('col', {c}, 'key', {keys[c]}, 'level', {sig.level[c]}, 'reason', {lit(sig.reason[c]) if c in sig.reason else 'CAST(NULL AS string)'}, 'before', cells[{c}], 'after', CAST({after} AS {VALUE.simpleString()}), 'again', CAST({again} AS {VALUE.simpleString()}))"

    def build(rest: list[int], stored: dict[int, V], of: dict[int, V], told: list[str], doubts: list[str]) -> V:
        if not rest:
            array = "array(" + ", ".join([*told, *[one(c, none, none) for c in sorted(sig.reason)]]) + ")"
            return V(array if not doubts else f"CASE WHEN NOT ({' OR '.join(doubts)}) THEN {array} END")
        c, p = rest[0], programs[rest[0]]
        before, after = (top(compiler.value(p, p.tree, Values(p, values))) for values in (stored, of))
        more = lambda x, y: build(rest[1:], stored, of | {c: x}, [*told, one(c, x.text, y.text)], doubts + [v.doubt for v in (x, y) if not v.sure])
        return let(more, after, before)

    def whole(kind: str | None) -> str:
        value = lambda path: val(kind, f"{path}.num") if kind else of_cell(path)
        had, new = [value(f"cells[{c}]") for c in inputs], {c: value(f"given[{c}]") for c in inputs if c in substituted}

        def run(*xs: V) -> V:
            stored = dict(zip(inputs, xs, strict=False))
            return build(sig.order, stored, stored | dict(zip(new, xs[len(inputs) :], strict=True)), [], [])

        return let(run, *had, *new.values()).text

    if not sig.order:
        return build([], {}, {}, [], []).text
    numbers = " AND ".join([f"coalesce(cells[{c}].kind = 'number', false)" for c in inputs] + [f"coalesce(given[{c}].kind = 'number', false)" for c in inputs if c in substituted])
    return f"CASE WHEN {numbers} THEN {whole('number')} ELSE {whole(None)} END"


@dataclass
class Settled:
    """What becomes of the reached formulas of rows that read themselves alone, the rows that aren't settled so, and how many formulas are at each level."""

    told: DataFrame
    rest: DataFrame
    count: int
    levels: dict[int, int]


def settled_rows(cells: DataFrame, sheets: list[str], changed: DataFrame, names: dict[str, str], few: int) -> Settled | None:
    """The what-if of rows that read nothing but themselves; null if there are few formulas or no such rows.

    told: sheet_id, row, col, level, formula, verdict, reason, before, after, was_stale. rest: sheet_id, row, gone (the substituted columns)."""
    spark, compiler = cells.sparkSession, Compiler(sheets, names)
    mine = cells.select(*PLACE, F.lit(False).alias("new"), *_CELL, "formula")
    new = changed.select(*PLACE, F.lit(True).alias("new"), *_CELL, F.lit(None).cast("string").alias("formula"))
    # Dealt out before they are grouped: groups within the scan's tasks would be as many as its rows.
    dealt = mine.unionByName(new).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sheet_id", "row")
    of = lambda which: F.map_from_entries(F.collect_list(F.when(which, F.struct("col", F.struct(*_CELL)))))
    listed = lambda which: F.array_join(F.sort_array(F.collect_list(which)), _NEXT)
    formula = F.when(F.col("formula").isNotNull(), F.concat(F.col("col").cast("string"), F.lit(_AT), F.coalesce(skeleton_of(F.col("formula"), F.col("row")), F.lit(_UNTOLD))))
    text = F.concat(listed(formula), F.lit(_GIVEN), listed(F.when(F.col("new"), F.col("col").cast("string"))))
    rows = written(dealt.groupBy("sheet_id", "row").agg(of(~F.col("new")).alias("cells"), of(F.col("new")).alias("given"), text.alias("signature")))
    counts = rows.groupBy("sheet_id", "signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sheet_id", "signature").limit(MOST_SIGNATURES).collect()
    known: dict[tuple, tuple[int, Program | None]] = {}
    sizes = [r["n"] * r["signature"].count(_AT) for r in counts]
    if sum(sizes) <= few:
        return None
    numbers, texts, sigs = [], [], []
    for r in counts:
        fs, gone = (part.split(_NEXT) if part else [] for part in r["signature"].split(_GIVEN))
        substituted = {int(x) for x in gone}
        held = [(r["sheet_id"], int(f.split(_AT)[0]), f.split(_AT)[1]) for f in fs]
        held = [f for f in held if f[1] not in substituted]
        if len(held) > MOST_FORMULAS or any(f[2] == _UNTOLD for f in held):
            continue
        for f in held:
            if f not in known:
                known[f] = len(known), own_row(f[2], f[0], f[1], compiler)
        programs, keys = {f[1]: known[f][1] for f in held}, {f[1]: known[f][0] for f in held}
        if any(p is None for p in programs.values()):
            continue
        sig = signature(programs, substituted)
        numbers.append((r["sheet_id"], r["signature"], len(sigs)))
        texts.append(settling(programs, keys, substituted, sig, compiler) if sig.level else "array()")
        sigs.append((sig, r["n"]))
    if not any(sig.level for sig, _ in sigs):
        return None
    rows = rows.join(F.broadcast(spark.createDataFrame(numbers, "sheet_id int, signature string, program int")), ["sheet_id", "signature"], "left")
    # A row's number may stand for something else too, as the 2 of B2*2; then a signature is told by what it gives for the row.
    array = ", ".join(f"named_struct('s', {s}, 'text', {lit(t)}, 'i', {i})" for s, t, i in numbers)
    given = lambda t: f"replace({t}, {lit(_OWN)}, CAST(`row` + 1 AS string))"
    rare = f"get(filter(array({array}), x -> x.s = sheet_id AND {given('x.text')} = {given('signature')}), 0).i"
    rows = rows.withColumn("program", F.expr(f"coalesce(program, {rare})"))
    # What is inside a lambda is evaluated node by node; generated code of all signatures is a method too large for the JVM to compile.
    told = F.expr("transform(array(0), z -> CASE program " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts) if t != "array()") + " END)[0]")
    # Rows of a program that reach nothing have nothing to tell; what is in doubt or has no program has a null.
    idle = [i for i, t in enumerate(texts) if t == "array()"]
    busy = rows.filter(F.coalesce(~F.col("program").isin(idle), F.lit(True))) if idle else rows

    def judged(x: Column) -> Column:
        verdict = lambda: F.when(x["reason"].isNotNull(), "blocked").when(same_as(x["before"], x["after"]), "unchanged").otherwise("moved")
        stale = F.when((verdict() == "moved"), ~same_as(x["before"], x["again"]))
        shown = F.struct(*[x["after"][n].alias(n) for n in _CELL])
        return F.struct(*[x[n].alias(n) for n in ("col", "key", "level", "reason", "before")], verdict().alias("verdict"), shown.alias("after"), F.coalesce(stale, F.lit(False)).alias("was_stale"))

    one = busy.select("sheet_id", "row", "program", "given", F.explode_outer(F.transform(told, judged)).alias("x"))
    kept = written(one.select("sheet_id", "row", "program", F.when(F.col("x").isNull(), F.map_keys("given")).alias("gone"), "x.*"))
    rest = kept.filter("col IS NULL").select("sheet_id", "row", "gone", "program")
    lost = {r["program"]: r["n"] for r in rest.groupBy("program").agg(F.count("*").alias("n")).collect()}
    levels: dict[int, int] = {}
    for i, (sig, n) in enumerate(sigs):
        for at in sig.level.values():
            levels[at] = levels.get(at, 0) + n - lost.get(i, 0)
    line = F.expr("replace(element_at(array(" + ", ".join(lit(k) for _, _, k in known) + f"), key + 1), {lit(_OWN)}, CAST(`row` + 1 AS string))")
    out = kept.filter("col IS NOT NULL").withColumn("formula", line).select(*PLACE, "level", "formula", "verdict", "reason", "before", "after", "was_stale")
    return Settled(out, rest.drop("program"), sum(lost.values()), {at: n for at, n in levels.items() if n})
