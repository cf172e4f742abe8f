"""One query a spreadsheet function, over part rows with planted blanks, texts, bools and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import formulas as fx
from tabulon.functions.formulas import CATALOGUE, Spread, call
from tabulon.operators import lookup
from tabulon.queries import query
from tabulon.queries.tables import shown
from tabulon.sources.tables import read
from tabulon.values import cell, error

#: The same rows in SQL: mk, mn are the kind and number of the mixed cell.
ROWS = """(SELECT p_partkey, p_name, p_brand, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(p_size - 25 AS DOUBLE) AS low,
  CASE WHEN p_partkey % 7 = 0 THEN 'empty' WHEN p_partkey % 5 = 0 THEN 'text' WHEN p_partkey % 3 = 0 THEN 'error' WHEN p_partkey % 2 = 0 THEN 'bool' ELSE 'number' END AS mk,
  CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 1 ELSE CAST(p_size AS DOUBLE) END AS mn FROM part) t"""


def rows(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    mixed = F.when(k % 7 == 0, cell("number", F.lit(None).cast("double"))).when(k % 5 == 0, cell("text", F.lit("x"))).when(k % 3 == 0, error("#N/A")).when(k % 2 == 0, cell("bool", F.lit(True))).otherwise(cell("number", size))
    text = lambda c: cell("text", F.col(c))
    base = read(spark, sf_dir, "part").select("p_partkey", cell("number", size).alias("size"), cell("number", F.col("p_retailprice")).alias("price"), cell("number", size - 25).alias("low"), text("p_name").alias("name"), text("p_brand").alias("brand"), mixed.alias("m"))
    # Inner calls are columns of their own: a column expression has no variables, so nesting would repeat them.
    return base.withColumns({k: make(ROW) for k, make in STAGED.items()})


def num(x: float):
    return cell("number", F.lit(float(x)))


def txt(x: str):
    return cell("text", F.lit(x))


class Columns:
    """The cells of a row by short names; columns need a session, so they are made when asked for."""

    S = property(lambda self: F.col("size"))
    P = property(lambda self: F.col("price"))
    L = property(lambda self: F.col("low"))
    N = property(lambda self: F.col("name"))
    B = property(lambda self: F.col("brand"))
    M = property(lambda self: F.col("m"))
    R = property(lambda self: Spread(F.array("size", "m", "price")))


ROW = Columns()
NA = "CASE WHEN mk = 'error' THEN '#N/A' END"
VALUE = "CASE WHEN mk = 'error' THEN '#N/A' WHEN mk = 'text' THEN '#VALUE!' END"
INSIDE = "CASE WHEN mk = 'number' THEN mn END"


def half_up(x: str, d: int) -> str:
    return f"sign({x}) * floor({shown(f'abs({x}) * {10 ** d}')} + 0.5) / {10 ** d}"


STAGED = {
    "m1": lambda c: fx.plus(c.M, num(1)),
    "big": lambda c: fx.compare(c.S, ">", num(20)),
    "s10": lambda c: fx.compare(c.S, ">", num(10)),
    "l20": lambda c: fx.compare(c.L, "<", num(20)),
    "s40": lambda c: fx.compare(c.S, ">", num(40)),
    "l_20": lambda c: fx.compare(c.L, "<", num(-20)),
    "quarter": lambda c: fx.divide(c.L, num(4)),
    "seventh": lambda c: fx.divide(c.P, num(7)),
    "minus7": lambda c: fx.divide(c.P, num(-7)),
    "rate": lambda c: fx.divide(c.S, num(1000)),
    "count": lambda c: fx.minus(c.L, num(-20)),
    "padded": lambda c: call("CONCAT", txt("  "), c.N, txt("  "), c.B),
    "small": lambda c: call("LOWER", c.B),
    "third": lambda c: fx.plus(num(0.1), num(0.2)),
    "tenth": lambda c: fx.times(c.L, num(0.1)),
    "by10": lambda c: fx.divide(c.L, num(10)),
}

#: name: (the call, what it gives in SQL as (field, expression, error expression)).
CASES = {
    "IF": (lambda c: call("IF", F.col("big"), c.P, c.L), ("num", "CASE WHEN size > 20 THEN price ELSE low END", None)),
    "IFERROR": (lambda c: call("IFERROR", F.col("m1"), num(-1)), ("num", "CASE WHEN mk IN ('error', 'text') THEN -1 ELSE mn + 1 END", None)),
    "IFNA": (lambda c: call("IFNA", F.col("m1"), num(-1)), ("num", "CASE WHEN mk = 'error' THEN -1 WHEN mk <> 'text' THEN mn + 1 END", "CASE WHEN mk = 'text' THEN '#VALUE!' END")),
    "SUM": (lambda c: call("SUM", c.R, num(1)), ("num", f"size + coalesce({INSIDE}, 0) + price + 1", NA)),
    "PRODUCT": (lambda c: call("PRODUCT", c.R), ("num", f"size * coalesce({INSIDE}, 1) * price", NA)),
    "AVERAGE": (lambda c: call("AVERAGE", c.R), ("num", f"(size + coalesce({INSIDE}, 0) + price) / CASE WHEN mk = 'number' THEN 3 ELSE 2 END", NA)),
    "MIN": (lambda c: call("MIN", c.R), ("num", f"least(size, price, {INSIDE})", NA)),
    "MAX": (lambda c: call("MAX", c.R, c.L), ("num", f"greatest(size, price, low, {INSIDE})", NA)),
    "COUNT": (lambda c: call("COUNT", c.R, txt("7"), txt("x")), ("num", "3 + CASE WHEN mk = 'number' THEN 1 ELSE 0 END", None)),
    "COUNTA": (lambda c: call("COUNTA", c.R), ("num", "2 + CASE WHEN mk = 'empty' THEN 0 ELSE 1 END", None)),
    "COUNTBLANK": (lambda c: call("COUNTBLANK", c.R), ("num", "CASE WHEN mk = 'empty' THEN 1 ELSE 0 END", None)),
    "AND": (lambda c: call("AND", F.col("s10"), F.col("l20")), ("flag", "size > 10 AND low < 20", None)),
    "OR": (lambda c: call("OR", F.col("s40"), F.col("l_20")), ("flag", "size > 40 OR low < -20", None)),
    "NOT": (lambda c: call("NOT", c.M), ("flag", "CASE WHEN mk NOT IN ('text', 'error') THEN mn = 0 END", VALUE)),
    "TRUE": (lambda c: call("TRUE"), ("flag", "true", None)),
    "FALSE": (lambda c: call("FALSE"), ("flag", "false", None)),
    "NA": (lambda c: call("NA"), ("num", "NULL", "'#N/A'")),
    "ISBLANK": (lambda c: call("ISBLANK", c.M), ("flag", "mk = 'empty'", None)),
    "ISNUMBER": (lambda c: call("ISNUMBER", c.M), ("flag", "mk = 'number'", None)),
    "ISTEXT": (lambda c: call("ISTEXT", c.M), ("flag", "mk = 'text'", None)),
    "ISNONTEXT": (lambda c: call("ISNONTEXT", c.M), ("flag", "mk <> 'text'", None)),
    "ISLOGICAL": (lambda c: call("ISLOGICAL", c.M), ("flag", "mk = 'bool'", None)),
    "ISERROR": (lambda c: call("ISERROR", c.M), ("flag", "mk = 'error'", None)),
    "ISERR": (lambda c: call("ISERR", F.col("m1")), ("flag", "mk = 'text'", None)),
    "ISNA": (lambda c: call("ISNA", c.M), ("flag", "mk = 'error'", None)),
    "ABS": (lambda c: call("ABS", c.L), ("num", "abs(low)", None)),
    "INT": (lambda c: call("INT", F.col("quarter")), ("num", "floor(low / 4)", None)),
    "SIGN": (lambda c: call("SIGN", c.L), ("num", "sign(low)", None)),
    "SQRT": (lambda c: call("SQRT", c.L), ("num", "CASE WHEN low >= 0 THEN sqrt(greatest(low, 0)) END", "CASE WHEN low < 0 THEN '#NUM!' END")),
    "EXP": (lambda c: call("EXP", c.L), ("num", "exp(low)", None)),
    "LN": (lambda c: call("LN", c.L), ("num", "CASE WHEN low > 0 THEN ln(greatest(low, 1)) END", "CASE WHEN low <= 0 THEN '#NUM!' END")),
    "LOG10": (lambda c: call("LOG10", c.S), ("num", "log10(size)", None)),
    "ROUND": (lambda c: call("ROUND", F.col("minus7"), num(2)), ("num", half_up("price / -7", 2), None)),
    "ROUNDUP": (lambda c: call("ROUNDUP", F.col("seventh"), num(1)), ("num", f"ceil({shown('price / 7 * 10')}) / 10", None)),
    "ROUNDDOWN": (lambda c: call("ROUNDDOWN", F.col("seventh"), num(-1)), ("num", f"floor({shown('price / 7 / 10')}) * 10", None)),
    "TRUNC": (lambda c: call("TRUNC", F.col("quarter")), ("num", "trunc(low / 4)", None)),
    "MOD": (lambda c: call("MOD", c.S, c.L), ("num", "CASE WHEN low <> 0 THEN size - low * floor(size / low) END", "CASE WHEN low = 0 THEN '#DIV/0!' END")),
    "POWER": (lambda c: call("POWER", c.S, num(0.5)), ("num", "pow(size, 0.5)", None)),
    "LOG": (lambda c: call("LOG", c.P, num(2)), ("num", "ln(price) / ln(2)", None)),
    "PV": (lambda c: call("PV", F.col("rate"), num(12), num(-100), c.P), ("num", "-(price + -100 * (pow(1 + size / 1000, 12) - 1) / (size / 1000)) / pow(1 + size / 1000, 12)", None)),
    "LEN": (lambda c: call("LEN", c.N), ("num", "length(p_name)", None)),
    "TRIM": (lambda c: call("TRIM", F.col("padded")), ("txt", "p_name || ' ' || p_brand", None)),
    "UPPER": (lambda c: call("UPPER", c.N), ("txt", "upper(p_name)", None)),
    "LOWER": (lambda c: call("LOWER", c.B), ("txt", "lower(p_brand)", None)),
    "LEFT": (lambda c: call("LEFT", c.N, F.col("count")), ("txt", "CASE WHEN low + 20 >= 0 THEN left(p_name, CAST(greatest(low + 20, 0) AS BIGINT)) END", "CASE WHEN low + 20 < 0 THEN '#VALUE!' END")),
    "RIGHT": (lambda c: call("RIGHT", c.N, num(3)), ("txt", "right(p_name, 3)", None)),
    "MID": (lambda c: call("MID", c.N, num(2), c.S), ("txt", "substring(p_name, 2, CAST(size AS BIGINT))", None)),
    "CONCATENATE": (lambda c: call("CONCATENATE", c.B, txt("/"), c.S), ("txt", "p_brand || '/' || CAST(CAST(size AS BIGINT) AS VARCHAR)", None)),
    "CONCAT": (lambda c: call("CONCAT", Spread(F.array("brand", "size")), c.N), ("txt", "p_brand || CAST(CAST(size AS BIGINT) AS VARCHAR) || p_name", None)),
    "EXACT": (lambda c: call("EXACT", c.B, F.col("small")), ("flag", "p_brand = lower(p_brand)", None)),
}


def shown_result(df, out, field, errs):
    f = F.col("out")
    value = F.round(f["num"], 6) if field == "num" else f[field]
    return df.withColumn("out", out).select("p_partkey", f["kind"].alias("kind"), value.alias(field), *([f["err"].alias("err")] if errs else []))


def oracle(field: str, value: str, err: str | None) -> str:
    e = f"({err})" if err else "CAST(NULL AS VARCHAR)"
    kind = {"num": "number", "txt": "text", "flag": "bool"}[field]
    value = f"CASE WHEN {e} IS NULL THEN {'round(CAST(' + value + ' AS DOUBLE), 6)' if field == 'num' else value} END"
    return f"SELECT p_partkey, CASE WHEN {e} IS NOT NULL THEN 'error' ELSE '{kind}' END AS kind, {value} AS {field}{', ' + e + ' AS err' if err else ''} FROM {ROWS}"


for _name, (_make, _sql) in CASES.items():
    query(f"fn_{_name.lower()}", oracle(*_sql))(lambda spark, sf_dir, make=_make, sql=_sql: shown_result(rows(spark, sf_dir), make(ROW), sql[0], sql[2]))

# --- the four lookups, as the joins they are ---------------------------------------------------
PARTS = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part)"


def _bands(spark):
    return spark.createDataFrame([(0, 1.0, "small"), (1, 10.0, "middle"), (2, 40.0, "large")], "position long, start double, name string")


@query("fn_vlookup", f"SELECT p_partkey, CASE WHEN size >= 40 THEN 'large' WHEN size >= 10 THEN 'middle' WHEN size >= 1 THEN 'small' END AS found FROM {PARTS}")
def vlookup(spark, sf_dir):
    probes = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lookup.approximate(probes, "p_size", _bands(spark), "start", "name", "position").select("p_partkey", F.col("found.txt").alias("found"))


@query("fn_match", f"SELECT p_partkey, CASE WHEN size IN (1, 10, 40) THEN CAST(CASE size WHEN 1 THEN 1 WHEN 10 THEN 2 ELSE 3 END AS VARCHAR) ELSE '#N/A' END AS place FROM {PARTS}")
def match(spark, sf_dir):
    out = lookup.match_exact(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", _bands(spark).withColumn("start", F.col("start").cast("int")), "start", "position")
    return out.select("p_partkey", F.coalesce(F.col("place.num").cast("int").cast("string"), "place.err").alias("place"))


@query("fn_index", f"SELECT p_partkey, CASE WHEN size <= 3 THEN CASE size WHEN 1 THEN 'small' WHEN 2 THEN 'middle' ELSE 'large' END ELSE '#REF!' END AS found FROM {PARTS}")
def index(spark, sf_dir):
    table = _bands(spark).withColumn("place_key", F.col("position") + 1)
    out = lookup.index(read(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size"), table, "place_key", "name", 3)
    return out.select("p_partkey", F.coalesce("found.txt", "found.err").alias("found"))


@query("fn_hlookup", "SELECT n_nationkey, n_regionkey AS found FROM nation")
def hlookup(spark, sf_dir):
    t = lookup.transposed(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").withColumn("position", F.lit(0)), "n_nationkey", "position")
    return t.filter("header = 'n_regionkey'").select(F.col("row_key").alias("n_nationkey"), F.col("value.num").cast("int").alias("found"))


# --- operators ---------------------------------------------------------------------------------
OPERATORS = {
    "plus": (lambda c: fx.plus(c.P, c.L), ("num", "price + low", None)),
    "minus_cancels": (lambda c: fx.minus(F.col("third"), num(0.3)), ("num", "0", None)),
    "times": (lambda c: fx.times(c.P, c.M), ("num", "price * mn", VALUE)),
    "divide": (lambda c: fx.divide(c.P, c.L), ("num", "CASE WHEN low <> 0 THEN price / low END", "CASE WHEN low = 0 THEN '#DIV/0!' END")),
    "power": (lambda c: fx.power(c.S, num(2)), ("num", "size * size", None)),
    "negate": (lambda c: fx.negate(c.P), ("num", "-price", None)),
    "percent": (lambda c: fx.percent(c.S), ("num", "size / 100", None)),
    "join": (lambda c: fx.join_text(c.B, c.S), ("txt", "p_brand || CAST(CAST(size AS BIGINT) AS VARCHAR)", None)),
    "compare_kinds": (lambda c: fx.compare(c.M, "<", txt("w")), ("flag", "CASE WHEN mk = 'bool' THEN false WHEN mk = 'text' THEN 'X' < 'W' WHEN mk IN ('number', 'empty') THEN true END", NA)),
    "compare_equal": (lambda c: fx.compare(F.col("tenth"), "=", F.col("by10")), ("flag", "true", None)),
}
for _name, (_make, _sql) in OPERATORS.items():
    query(f"ex_{_name}", oracle(*_sql))(lambda spark, sf_dir, make=_make, sql=_sql: shown_result(rows(spark, sf_dir), make(ROW), sql[0], sql[2]))

assert set(CASES) | {"VLOOKUP", "HLOOKUP", "MATCH", "INDEX"} >= set(CATALOGUE)
