"""A debtors workbook of any size, made by expressions: values come from closed forms, formulas are text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.values import shown_column

SHEETS = ["Debtors", "Rates", "Summary"]
NAMES = {"Tax_Rate": "Rates!$B$11"}
TYPES = [("Retail", 0.085), ("Business", 0.115), ("Wholesale", 0.02), ("Internal", 0.05)]
BANDS = [(0, 0.02), (31, 0.10), (61, 0.25), (91, 0.50), (121, 0.85)]
TERRITORIES = ["Kingsford", "Northgate", "Stonebridge", "Eastwick", "Palm Grove", "Ironwood"]
HEADERS = ["Account", "Territory", "Debt Type", "Balance", "Days Overdue", "Ageing Bucket", "Discount Rate", "Provision Percent", "Provision", "Present Value", "Impairment", "Days per Unit"]


def _cell(col: int, kind: str | Column, num=None, txt=None, err=None, formula=None) -> Column:
    none = F.lit(None)
    c = lambda v, t: (none if v is None else v).cast(t)
    return F.struct(F.lit(col).alias("col"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), c(num, "double").alias("num"), c(txt, "string").alias("txt"), c(err, "string").alias("err"), c(formula, "string").alias("formula"))


def half_up(x: Column, digits: int) -> Column:
    return F.floor(shown_column(x * 10**digits) + 0.5) / 10**digits


def debtors(spark: SparkSession, rows: int) -> DataFrame:
    """Cells of the Debtors sheet: a header row and `rows` rows of twelve columns."""
    i = F.col("id")
    h = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    line = (i + 2).cast("string")
    f = lambda text: F.concat(*[line if p == "#" else F.lit(p) for p in text.replace("#", "\0#\0").split("\0") if p])
    kind, days = h(1, 4), h(2, 400)
    balance = F.when(i % 47 == 0, 0.0).otherwise((h(3, 4_500_000) + 5000) / 100.0)
    rate = pick([r for _, r in TYPES], kind)
    share = F.lit(BANDS[0][1])
    for start, value in BANDS[1:]:
        share = F.when(days >= start, value).otherwise(share)
    provision = half_up(balance * share, 2)
    # PV(r/12, d/30, 0, -b): no payment, so the balance over the growth
    present = balance / F.pow(1 + rate / 12, days / 30.0)
    bucket = F.when(days > 120, "120+").when(days > 90, "91-120").when(days > 60, "61-90").when(days > 30, "31-60").otherwise("0-30")
    per = F.when(balance != 0, days / F.when(balance != 0, balance))
    items = F.array(
        _cell(0, "text", txt=F.concat(F.lit("RB-"), F.lpad((i + 100_000).cast("string"), 6, "0"))),
        _cell(1, "text", txt=pick(TERRITORIES, h(4, 6))),
        _cell(2, "text", txt=pick([t for t, _ in TYPES], kind)),
        _cell(3, "number", balance),
        _cell(4, "number", days),
        _cell(5, "text", txt=bucket, formula=f('IF(E#>120,"120+",IF(E#>90,"91-120",IF(E#>60,"61-90",IF(E#>30,"31-60","0-30"))))')),
        _cell(6, "number", rate, formula=f("VLOOKUP(C#,Rates!$A$4:$B$7,2,FALSE())")),
        _cell(7, "number", share, formula=f("VLOOKUP(E#,Rates!$D$4:$E$8,2)")),
        _cell(8, "number", provision, formula=F.when(i != 5, f("ROUND(D#*H#,2)"))),
        _cell(9, "number", present, formula=f("PV(G#/12,E#/30,0,-D#)")),
        _cell(10, "number", F.signum(balance - present) * half_up(F.abs(balance - present), 2), formula=f("ROUND(D#-J#,2)")),
        _cell(11, F.when(balance == 0, "error").otherwise("number"), per, err=F.when(balance == 0, "#DIV/0!"), formula=f("E#/D#")),
    )
    body = spark.range(rows).select((i + 1).cast("int").alias("row"), F.explode(items).alias("c"))
    head = spark.range(1).select(F.lit(0).alias("row"), F.explode(F.array(*[_cell(n, "text", txt=F.lit(t)) for n, t in enumerate(HEADERS)])).alias("c"))
    return _flat(head.unionByName(body), 0)


def _flat(df: DataFrame, sheet_id: int) -> DataFrame:
    return df.select(F.lit(sheet_id).alias("sheet_id"), "row", "c.col", "c.kind", "c.num", "c.txt", F.lit(None).cast("boolean").alias("flag"), "c.err", F.lit(False).alias("is_date"), "c.formula")


def workbook(spark: SparkSession, rows: int = 2000) -> DataFrame:
    """All cells: debtors, rates, and a summary of totals over the debtors' columns."""
    d = debtors(spark, rows)
    grid = [(2, 0, "Debt Type"), (2, 1, "Discount Rate"), (2, 3, "Days Overdue From"), (2, 4, "Provision Percent"), (10, 0, "Tax Rate"), (10, 1, 0.15), (0, 0, "Rates")]
    grid += [(3 + n, 0, t) for n, (t, _) in enumerate(TYPES)] + [(3 + n, 1, r) for n, (_, r) in enumerate(TYPES)]
    grid += [(3 + n, 3, float(s)) for n, (s, _) in enumerate(BANDS)] + [(3 + n, 4, p) for n, (_, p) in enumerate(BANDS)]
    rates = spark.createDataFrame([(r, c, "text" if isinstance(v, str) else "number", None if isinstance(v, str) else v, v if isinstance(v, str) else None) for r, c, v in grid], "row int, col int, kind string, num double, txt string")
    rates = rates.select(F.lit(1).alias("sheet_id"), "row", "col", "kind", "num", "txt", F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("err"), F.lit(False).alias("is_date"), F.lit(None).cast("string").alias("formula"))
    last = rows + 1
    col = lambda c: F.when((F.col("col") == c) & (F.col("row") > 0), F.col("num"))
    sums = d.agg(F.sum(col(3)).alias("b"), F.sum(col(8)).alias("p"), F.sum(col(10)).alias("i"), F.avg(col(3)).alias("a"), F.max(col(3)).alias("m"), F.count(col(3)).alias("n"))
    measures = [("Balance", "b", f"SUM(Debtors!D2:D{last})"), ("Provision", "p", f"SUM(Debtors!I2:I{last})"), ("Impairment", "i", f"SUM(Debtors!K2:K{last})"), ("Average", "a", f"AVERAGE(Debtors!D2:D{last})"), ("Largest", "m", f"MAX(Debtors!D2:D{last})"), ("Accounts", "n", f"COUNT(Debtors!D2:D{last})")]
    rows_ = [F.array(F.struct(F.lit(n + 1).alias("row"), _cell(0, "text", txt=F.lit(t)).alias("c")), F.struct(F.lit(n + 1).alias("row"), _cell(1, "number", F.col(v), formula=F.lit(f)).alias("c"))) for n, (t, v, f) in enumerate(measures)]
    more = F.array(F.struct(F.lit(7).alias("row"), _cell(1, "number", half_up(F.col("p") * 0.15, 2), formula=F.lit("ROUND(B3*Tax_Rate,2)")).alias("c")), F.struct(F.lit(8).alias("row"), _cell(1, "number", F.lit(0.0), formula=F.lit("SUMPRODUCT(B2:B3)/B2")).alias("c")))
    summary = sums.select(F.explode(F.concat(*rows_, more)).alias("x")).select("x.row", "x.c")
    return d.unionByName(rates).unionByName(_flat(summary, 2))
