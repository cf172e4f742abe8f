"""Compiled shapes against the interpreter, and shapes by columns against the scanner."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions.text import shape
from tabulon.operators import compiled, trace

CELLS = "sheet_id int, row int, col int, kind string, num double, txt string, flag boolean, err string, is_date boolean, formula string"
SHEETS, NAMES = ["Main", "Side table"], {"rate": "Main!$A$3", "Main!local": "$B$4"}

# Filled down from row {r}; other rows are {r} with an offset.
FORMULAS = [
    "A{r}*2", "A{r}+B{r}", "A{r}-B{r}", "A{r}/B{r}", "A{r}^2", "-A{r}%", "A{r}&B{r}", '"x"&A{r}', "A{r}=B{r}", "A{r}<>B{r}", "A{r}<B{r}", "A{r}>=3", 'A{r}="word"', "0.1+0.2-0.3", "A{r}+0.1-A{r}",
    'IF(A{r}>2,"high","low")', "IF(A{r},B{r})", "IFERROR(A{r}/B{r},-1)", "IFNA(A{r},0)", "AND(A{r},B{r}>1)", "OR(A{r}>1,B{r}>1)", "NOT(A{r})", "ISBLANK(A{r})", "ISNUMBER(A{r})", "ISTEXT(A{r})", "ISERROR(B{r})", "ISNA(B{r})", "ISNONTEXT(A{r})", "ISLOGICAL(A{r})",
    "SUM(A$1:A{r})", "SUM(A{r}:B{s})", "AVERAGE($A$1:$A$30)", "MIN(A$1:B{r})", "MAX(A{r}:A{s})", "COUNT(A$1:B{r})", "COUNTA(A$1:A{r},B{r},7)", "COUNTBLANK(A$1:B{r})", "SUM(A{r},1,B{r})", "SUM($A$1:$B$5,A{r})", "SUM(A$20:A{r})", "COUNT(1,A{r},\"3\")", "AVERAGE(A{r}:A{r})",
    "VLOOKUP(A{r},'Side table'!$A$1:$C$40,3,FALSE)", "VLOOKUP(A{r},'Side table'!$A$1:$C$40,2)", "VLOOKUP(A{r},'Side table'!$A$1:$C$40,2,TRUE)+1", "MATCH(A{r},'Side table'!$A$1:$A$40,0)", "MATCH(A{r},'Side table'!$A$1:$A$40)", "MATCH(A{r},'Side table'!$A$1:$A$40,-1)", "INDEX('Side table'!$C$1:$C$40,MATCH(A{r},'Side table'!$A$1:$A$40,0))",
    "IFERROR(VLOOKUP(B{r},'Side table'!$A$1:$C$40,2,0),VLOOKUP(A{r},'Side table'!$A$1:$C$40,2,0))", "VLOOKUP(A{r}+0,'Side table'!$A$1:$B$40,2,FALSE)&\"!\"",
    "A{r}*rate", "A{r}+local", "$A$2+A{r}", "LEN(A{r})", "UPPER(A{r})", "EXACT(A{r},B{r})", "ABS(A{r})", "INT(A{r})", "SIGN(A{r})", "SQRT(A{r})", "ROUND(A{r},1)", "PV(0.1,A{r},B{r})", "RAND()", "UNKNOWN(A{r})", "A{r}:B{r}", "[book.xlsx]S!A{r}", "SUM(A:A)", "A{r}+", "VLOOKUP(A{r},'Side table'!$A{r}:$C$40,2,FALSE)",
]


@pytest.fixture(scope="module")
def workbook(spark):
    rng = random.Random(4)

    def some(numbers=(0.0, 1.0, 2.5, -3.0, 4.0, 7.25, 1e15, 0.1 + 0.2, 123456.789)):
        kind = rng.choice(["number"] * 5 + ["text", "text", "bool", "error", "none"])
        return {"number": ("number", rng.choice(numbers), None, None, None), "text": ("text", None, rng.choice(["word", "Word", "5", " 2.5 ", "", "ß", "TRUE", "wo*d"]), None, None), "bool": ("bool", None, None, rng.random() < 0.5, None), "error": ("error", None, None, None, rng.choice(["#N/A", "#DIV/0!"])), "none": None}[kind]

    rows = []
    for r in range(34):
        for c in (0, 1):
            if (v := some()) is not None:
                rows.append((0, r, c, *v, False, None))
    for r in range(38):
        for c in (0, 1, 2):
            # Keys with more than fifteen digits would leave all lookups in doubt.
            if (v := some((0.0, 1.0, 2.5, -3.0, 4.0, 123456.789)) if c == 0 else some()) is not None and rng.random() < 0.9:
                rows.append((1, r, c, *v, False, None))
    for i, f in enumerate(FORMULAS):
        for r in range(0, 32, 1 + i % 3):
            stored = ("number", float(rng.randrange(3)), None, None, None)
            rows.append((0, r, 3 + i, *stored, False, f.format(r=r + 1, s=r + 3)))
    return spark.createDataFrame(rows, CELLS).repartition(4).cache()


def told(df):
    return {(r["sheet_id"], r["row"], r["col"]): (r["formula"], r["outcome"], r["reason"], r["kind"], r["num"], r["txt"], r["flag"], r["err"]) for r in df.collect()}


def alike(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-12 * max(1, abs(x)) for x, y in zip(a, b, strict=True))


def test_compiled_equals_interpreted(spark, workbook, monkeypatch):
    monkeypatch.setattr(trace, "FEW", 0)
    formulas = workbook.filter("formula is not null")
    want = told(trace.interpreted(workbook, formulas, SHEETS, NAMES))
    got = told(trace.recompute(workbook, SHEETS, NAMES))
    assert set(got) == set(want)
    bad = [(got[k], want[k]) for k in want if not alike(got[k], want[k])]
    assert not bad, bad[:5]


def test_most_shapes_compile(workbook):
    """What goes to the interpreter is what isn't modelled, and values in doubt."""
    values = compiled.evaluated(workbook, workbook.filter("formula is not null"), SHEETS, NAMES)
    known = {c for (c,) in values.filter("NOT value.doubt").select("col").distinct().collect()}
    left = {f for i, f in enumerate(FORMULAS) if 3 + i not in known}
    assert left == {f for f in FORMULAS if f.startswith(("ROUND", "PV", "RAND", "UNKNOWN", "[book", "A{r}:B", "SUM(A:A", "VLOOKUP(A{r},'Side table'!$A{r}"))} | {"A{r}+", "0.1+0.2-0.3"}


def test_shapes_by_columns(spark):
    rng = random.Random(2)
    bits = ["A1", "$A1", "A$1", "$A$1", "XFD1048576", "XFE1", "A0", "A1048577", "B2:C3", "$B$2:C3", "Sheet1!A1", "'My Sheet'!$B2:$C$4", "[b.xlsx]S!A1", "S1:S3!B2", "SUM(", "LOG10(", "(", ")", "+", "-", '"A1 ""x"" B2"', "#N/A", "1.5", "2e3", "A:A", "1:3", "foo", "TRUE", "A1B", "A1.x", " ", ",", "<=", "é1", "Ä1!A1", "_x", "'it''s'!A1"]
    made = [("".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))), rng.randrange(50), rng.randrange(30)) for _ in range(1500)]
    got = spark.createDataFrame(made, "f string, row int, col int").withColumn("s", compiled.shape_of(F.col("f"), F.col("row"), F.col("col"))).collect()
    assert sum(r["s"] is not None for r in got) > 1000
    assert [(r["f"], r["s"]) for r in got if r["s"] not in (None, shape(r["f"], r["row"], r["col"]))] == []


def test_covers(spark):
    rng = random.Random(1)
    spans = [(0, 0), (0, 1048575), (5, 5), (3, 70), (63, 64)] + [tuple(sorted((rng.randrange(3000), rng.randrange(3000)))) for _ in range(60)]
    for r in spark.createDataFrame(spans, "top int, bottom int").withColumn("c", compiled.cover("top", "bottom")).collect():
        rows = sorted((b["block"] * 4 ** b["level"], 4 ** b["level"]) for b in r["c"])
        assert rows[0][0] == r["top"] and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(rows[-1]) == r["bottom"] + 1 and len(rows) <= 6 * 11
