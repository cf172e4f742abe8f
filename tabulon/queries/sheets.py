"""Queries over sheets: cells, formulas, structure, the graph, provenance.

The formula sheet is made of orders: row = o_orderkey, from 0; column A the key, B the price, C
`B*2` (edited to `B*3` on every 97th key, typed over on every 89th), D `IF(C>200000,...)`.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.address import MAX_ROW, a1_column, cite_column
from tabulon.functions.text import formula_cells, redact_column, references_of
from tabulon.operators import graph, report, structure, trace
from tabulon.queries import query
from tabulon.sources import demo
from tabulon.sources.tables import cells_in, long, pivoted, read, used_range
from tabulon.streaming.watch import diff


def key_cells(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", "c_nationkey")
    return long(c, "c_custkey")


KEYED = "(SELECT CAST(c_custkey AS INT) AS \"row\", 0 AS col, 'number' AS kind, CAST(c_custkey AS DOUBLE) AS num, NULL AS txt FROM customer UNION ALL SELECT CAST(c_custkey AS INT), 1, 'text', NULL, c_name FROM customer UNION ALL SELECT CAST(c_custkey AS INT), 2, 'number', CAST(c_nationkey AS DOUBLE), NULL FROM customer) c"


@query("cells_in", f'SELECT "row", col, kind, num, txt FROM {KEYED} WHERE "row" BETWEEN 3 AND 9 AND col BETWEEN 1 AND 2')
def rectangle(spark, sf_dir):
    return cells_in(key_cells(spark, sf_dir), 0, 3, 1, 9, 2).select("row", "col", "kind", "num", "txt")


@query("count_in", f'SELECT count(*) AS n FROM {KEYED} WHERE "row" BETWEEN 3 AND 9 AND col BETWEEN 1 AND 2')
def count_in(spark, sf_dir):
    return cells_in(key_cells(spark, sf_dir), 0, 3, 1, 9, 2).agg(F.count("*").alias("n"))


@query("used_range", f'SELECT 0 AS sheet_id, min("row") AS top, min(col) AS "left", max("row") AS bottom, max(col) AS "right", count(*) AS cells FROM {KEYED}')
def used(spark, sf_dir):
    return used_range(key_cells(spark, sf_dir))


@query("find_value", f"SELECT \"row\", col FROM {KEYED} WHERE kind = 'number' AND num = 3")
def find_value(spark, sf_dir):
    return trace.find_value(key_cells(spark, sf_dir), 3.0).select("row", "col")


@query("read_rows", "SELECT CAST(i AS INT) AS \"row\", c_name AS name, CAST(c_nationkey AS DOUBLE) AS nation FROM range(0, 200000) r(i) LEFT JOIN customer ON c_custkey = i")
def read_rows(spark, sf_dir):
    out = pivoted(key_cells(spark, sf_dir), 0, 199_999, {1: "name", 2: "nation"})
    return out.select("row", F.col("name.txt").alias("name"), F.col("nation.num").alias("nation"))


@query("citations", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[\\p{L}\\p{N}_.]+$') AND NOT regexp_matches(p_brand, '^[0-9]') AND NOT regexp_matches(p_brand, '^[A-Za-z]{1,3}[0-9]+$') THEN p_brand ELSE '''' || replace(p_brand, '''', '''''') || '''' END || '!' || CASE WHEN c >= 702 THEN chr(CAST(65 + (c - 702) // 676 AS INT)) ELSE '' END || CASE WHEN c >= 26 THEN chr(CAST(65 + (c // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + c % 26 AS INT)) || (p_partkey + 1) AS cite FROM (SELECT *, (p_partkey * 7) % 16384 AS c FROM part)")
def citations(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", cite_column(F.col("p_brand"), k, k * 7 % 16384, k, k * 7 % 16384).alias("cite"))


# --- the formula sheet -------------------------------------------------------------------------
def sheet(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    row = k.cast("int")
    line = (k + 1).cast("string")
    none, text, flag = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    doubled = price * F.when(k % 97 == 0, 3).otherwise(2)
    stored = doubled + F.when(k % 83 == 0, 1).otherwise(0)
    number = lambda c, v, f: F.struct(F.lit(c).alias("col"), F.lit("number").alias("kind"), v.cast("double").alias("num"), text.alias("txt"), f.alias("formula"))
    c = F.when(k % 89 == 0, none).when(k % 97 == 0, F.concat(F.lit("B"), line, F.lit("*3"))).otherwise(F.concat(F.lit("B"), line, F.lit("*2")))
    d = F.concat(F.lit("IF(C"), line, F.lit('>200000,"high","low")'))
    word = F.struct(F.lit(3).alias("col"), F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.when(stored > 200000, "high").otherwise("low").alias("txt"), d.alias("formula"))
    items = F.array(number(0, k, none), number(1, price, none), number(2, stored, c), word)
    cells = o.select(row.alias("row"), F.explode(items).alias("c"))
    return cells.select(F.lit(0).alias("sheet_id"), "row", "c.col", "c.kind", "c.num", "c.txt", flag.alias("flag"), none.alias("err"), F.lit(False).alias("is_date"), "c.formula")


SHAPES = """(SELECT o_orderkey AS "row", 2 AS col, CASE WHEN o_orderkey % 97 = 0 THEN 'RC[-1]*3' ELSE 'RC[-1]*2' END AS shape FROM orders WHERE o_orderkey % 89 <> 0
  UNION ALL SELECT o_orderkey, 3, 'IF(RC[-1]>200000,"high","low")' FROM orders)"""


@query("formula_shapes", f"SELECT col, shape, count(*) AS cells FROM {SHAPES} GROUP BY 1, 2")
def formula_shapes(spark, sf_dir):
    return formula_cells(sheet(spark, sf_dir)).groupBy("col", "shape").agg(F.count("*").alias("cells"))


@query("formula_references", "SELECT CAST(o_orderkey AS INT) AS \"row\", 2 AS col, 'B' || (o_orderkey + 1) AS text FROM orders WHERE o_orderkey % 89 <> 0 UNION ALL SELECT CAST(o_orderkey AS INT), 3, 'C' || (o_orderkey + 1) FROM orders")
def formula_references(spark, sf_dir):
    return references_of(sheet(spark, sf_dir)).select("row", "col", "text")


RUNS = f"""(SELECT col, shape, min("row") AS top, max("row") AS bottom, count(*) AS cells FROM (SELECT *, "row" - row_number() OVER (PARTITION BY col, shape ORDER BY "row") AS island FROM {SHAPES}) GROUP BY col, shape, island)"""


@query("formula_groups", f"SELECT shape, CAST(top AS INT) AS top, CAST(bottom AS INT) AS bottom, col AS \"left\", col AS \"right\", cells FROM {RUNS}")
def formula_groups(spark, sf_dir):
    return structure.groups(formula_cells(sheet(spark, sf_dir))).select("shape", "top", "bottom", "left", "right", "cells")


@query("formula_group_stats", f"SELECT CAST(sum(cells) AS BIGINT) AS formula_cells, count(*) AS groups, count(*) FILTER (WHERE cells = 1) AS singletons, max(cells) AS largest, sum(cells) / count(*) AS compression FROM {RUNS}")
def formula_group_stats(spark, sf_dir):
    return structure.grouping_stats(structure.groups(formula_cells(sheet(spark, sf_dir))))


@query(
    "formula_exceptions",
    f"""WITH n AS (SELECT *, lag("row") OVER w AS up, lag(shape) OVER w AS above, lead("row") OVER w AS down, lead(shape) OVER w AS below FROM {SHAPES} WINDOW w AS (PARTITION BY col ORDER BY "row"))
    SELECT CAST("row" AS INT) AS "row", col, 'edited' AS what FROM n WHERE up = "row" - 1 AND down = "row" + 1 AND above = below AND shape <> above
    UNION ALL SELECT CAST("row" + 1 AS INT), col, 'missing' FROM n WHERE down = "row" + 2 AND shape = below""",
)
def formula_exceptions(spark, sf_dir):
    return structure.exceptions(formula_cells(sheet(spark, sf_dir))).select("row", "col", "what")


def whole(spark, sf_dir):
    n = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("n"))
    return n.select(F.lit("all").alias("body"), F.lit(0).alias("sheet_id"), F.lit(0).alias("top"), F.lit(0).alias("left"), F.col("n").cast("int").alias("bottom"), F.lit(3).alias("right"))


@query(
    "formula_audit",
    f"""WITH n AS (SELECT col, shape, count(*) AS n FROM {SHAPES} GROUP BY 1, 2), f AS (SELECT col, CAST(sum(n) AS BIGINT) AS formulas, count(*) AS shapes, max(n) AS fill_cells FROM n GROUP BY 1),
    t AS (SELECT col, (SELECT count(*) FROM orders) - formulas AS typed FROM f)
    SELECT col, formulas, shapes, fill_cells, formulas - fill_cells AS deviants, typed, (formulas > fill_cells OR typed > 0) AS broken FROM f JOIN t USING (col)""",
)
def formula_audit(spark, sf_dir):
    return structure.column_audit(sheet(spark, sf_dir), whole(spark, sf_dir)).select("col", "formulas", "shapes", "fill_cells", "deviants", "typed", "broken")


@query("redact_formulas", "SELECT CAST(o_orderkey AS INT) AS \"row\", 'IF(C' || (o_orderkey + 1) || '><number>,<text>,<text>)' AS formula FROM orders")
def redact_formulas(spark, sf_dir):
    return sheet(spark, sf_dir).filter("col = 3").select("row", redact_column("formula").alias("formula"))


@query("recompute_check", "SELECT 'agrees' AS outcome, count(*) FILTER (WHERE o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0) + count(*) AS cells FROM orders UNION ALL SELECT 'differs', count(*) FILTER (WHERE o_orderkey % 89 <> 0 AND o_orderkey % 83 = 0) FROM orders")
def recompute_check(spark, sf_dir):
    return trace.recompute(sheet(spark, sf_dir), ["Orders"]).groupBy("outcome").agg(F.count("*").alias("cells"))


@query("recompute_values", "SELECT CAST(o_orderkey AS INT) AS \"row\", round(o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE 2 END, 6) AS num FROM orders WHERE o_orderkey % 89 <> 0 AND o_orderkey % 83 = 0")
def recompute_values(spark, sf_dir):
    return trace.recompute(sheet(spark, sf_dir), ["Orders"]).filter("outcome = 'differs'").select("row", F.round("num", 6).alias("num"))


def lookup_sheets(spark, sf_dir):
    """Sheet 0, Orders: A the customer's key, B its nation looked up (wrong by one on every 83rd key). Sheet 1, Customers.

    Customers are a lookup table: key in A, nation in B. It ends with a file's sheet, whose last rows are left blank, or with the last of more customers."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    last = c.agg(F.greatest(F.lit(MAX_ROW), F.max("c_custkey")).alias("last"))
    k = F.col("o_orderkey")
    none = F.lit(None)
    number = lambda col, v, f: F.struct(F.lit(col).alias("col"), v.cast("double").alias("num"), f.cast("string").alias("formula"))
    line = F.concat(F.lit("VLOOKUP(A"), (k + 1).cast("string"), F.lit(",Customers!$A$1:$B$"), (F.col("last") + 1).cast("string"), F.lit(",2,FALSE)"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").crossJoin(F.broadcast(last))  # one row
    stored = F.col("c_nationkey") + F.when(k % 83 == 0, 1).otherwise(0)
    one = joined.select(F.lit(0).alias("sheet_id"), k.cast("int").alias("row"), F.explode(F.array(number(0, F.col("o_custkey"), none), number(1, stored, line))).alias("c"))
    two = c.select(F.lit(1).alias("sheet_id"), F.col("c_custkey").cast("int").alias("row"), F.explode(F.array(number(0, F.col("c_custkey"), none), number(1, F.col("c_nationkey"), none))).alias("c"))
    text = lambda n: F.lit(None).cast("string").alias(n)
    return one.unionByName(two).select("sheet_id", "row", "c.col", F.when(F.col("c.num").isNull(), "empty").otherwise("number").alias("kind"), "c.num", text("txt"), F.lit(None).cast("boolean").alias("flag"), text("err"), F.lit(False).alias("is_date"), "c.formula")


@query(
    "recompute_lookups",
    """SELECT CASE WHEN c_custkey IS NULL OR o_orderkey % 83 = 0 THEN 'differs' ELSE 'agrees' END AS outcome, CASE WHEN c_custkey IS NULL THEN 'error' ELSE 'number' END AS kind, count(*) AS cells, CAST(sum(c_nationkey) AS DOUBLE) AS total
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def recompute_lookups(spark, sf_dir):
    """A lookup filled down all orders, into a table of all customers."""
    found = trace.recompute(lookup_sheets(spark, sf_dir), ["Orders", "Customers"])
    return found.groupBy("outcome", "kind").agg(F.count("*").alias("cells"), F.sum("num").alias("total"))


def running_sheet(spark, sf_dir):
    """B whole prices, C their running sum from the first row (doubled on every 83rd key: one more would be within tolerance of a large sum)."""
    o = read(spark, sf_dir, "orders")
    k, whole_price = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    # Blocks of keys are summed first, so no task holds all rows.
    block = F.floor(k / 1024)
    before = o.groupBy(block.alias("block")).agg(F.sum(whole_price).alias("total"))
    before = before.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    so_far = F.sum(whole_price).over(Window.partitionBy("block").orderBy("o_orderkey")) + F.col("before")
    stored = o.withColumn("block", block).join(before, "block").select("o_orderkey", whole_price.alias("price"), (so_far * F.when(k % 83 == 0, 2).otherwise(1)).alias("total"))
    number = lambda col, v, f: F.struct(F.lit(col).alias("col"), v.alias("num"), f.cast("string").alias("formula"))
    line = F.concat(F.lit("SUM(B$1:B"), (k + 1).cast("string"), F.lit(")"))
    cells = stored.select(k.cast("int").alias("row"), F.explode(F.array(number(1, F.col("price"), F.lit(None)), number(2, F.col("total"), line))).alias("c"))
    text = lambda n: F.lit(None).cast("string").alias(n)
    return cells.select(F.lit(0).alias("sheet_id"), "row", "c.col", F.lit("number").alias("kind"), "c.num", text("txt"), F.lit(None).cast("boolean").alias("flag"), text("err"), F.lit(False).alias("is_date"), "c.formula")


@query(
    "recompute_running_sums",
    """SELECT outcome, count(*) AS cells, sum(so_far) AS total FROM (
      SELECT CASE WHEN o_orderkey % 83 = 0 THEN 'differs' ELSE 'agrees' END AS outcome, sum(floor(o_totalprice)) OVER (ORDER BY o_orderkey) AS so_far FROM orders) GROUP BY 1""",
)
def recompute_running_sums(spark, sf_dir):
    """A running sum filled down all orders."""
    found = trace.recompute(running_sheet(spark, sf_dir), ["Orders"])
    return found.groupBy("outcome").agg(F.count("*").alias("cells"), F.sum("num").alias("total"))


@query("dependents_of_price", "SELECT CAST(o_orderkey AS INT) AS \"row\", 2 AS col FROM orders WHERE o_orderkey BETWEEN 100 AND 119 AND o_orderkey % 89 <> 0")
def dependents_of_price(spark, sf_dir):
    from tabulon.address import Range

    cells = sheet(spark, sf_dir)
    refs = graph.resolved(references_of(cells), spark.createDataFrame([(0, "Orders")], "sheet_id int, name string"))
    return trace.dependents(refs, 0, Range(100, 1, 119, 1)).select("row", "col")


@query("whatif_level", "SELECT CAST(o_orderkey AS INT) AS \"row\", 2 AS col FROM orders WHERE o_orderkey % 89 <> 0")
def whatif_level(spark, sf_dir):
    """What reads any of the prices, the first level of a change to all of them."""
    cells = sheet(spark, sf_dir)
    refs = graph.resolved(references_of(cells), spark.createDataFrame([(0, "Orders")], "sheet_id int, name string"))
    frontier = cells.filter("col = 1").select("sheet_id", "row", "col")
    return trace.dependents_of_many(refs, frontier).select("row", "col")


@query(
    "whatif_moved",
    """WITH o AS (SELECT *, o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE 2 END + CASE WHEN o_orderkey % 83 = 0 THEN 1 ELSE 0 END AS stored, 1e6 * CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE 2 END AS fresh FROM orders WHERE o_orderkey % 89 <> 0)
    SELECT CAST(o_orderkey AS INT) AS "row", 2 AS col, 1 AS level, o_orderkey % 83 = 0 AS was_stale, fresh AS num, NULL AS txt FROM o WHERE stored <> fresh
    UNION ALL SELECT CAST(o_orderkey AS INT), 3, 2, false, NULL, CASE WHEN fresh > 200000 THEN 'high' ELSE 'low' END FROM o WHERE (stored > 200000) <> (fresh > 200000)""",
)
def whatif_moved(spark, sf_dir):
    """All prices set to a million: the doubles move, and the words that the doubles cross a limit of."""
    cells = sheet(spark, sf_dir)
    changed = cells.filter("col = 1").select("sheet_id", "row", "col", "kind", F.lit(1e6).alias("num"), "txt", "flag", "err")
    moved, _ = trace.what_if_cells(cells, None, ["Orders"], changed, max_cells=1 << 40)
    return moved.filter("verdict = 'moved'").select("row", "col", "level", "was_stale", "after.num", "after.txt")


def circles(spark, sf_dir):
    """B the price, C and D that read each other on every tenth key (else D reads C alone), E that reads D."""
    o = read(spark, sf_dir, "orders")
    k, line = F.col("o_orderkey"), (F.col("o_orderkey") + 1).cast("string")
    put = lambda col, f: F.struct(F.lit(col).alias("col"), F.col("o_totalprice").alias("num"), f.alias("formula"))
    c = F.when(k % 10 == 0, F.concat(F.lit("B"), line, F.lit("+D"), line)).otherwise(F.concat(F.lit("B"), line, F.lit("+0")))
    cells = o.select(k.cast("int").alias("row"), F.explode(F.array(put(1, F.lit(None).cast("string")), put(2, c), put(3, F.concat(F.lit("C"), line)), put(4, F.concat(F.lit("D"), line, F.lit("*1"))))).alias("c"))
    text = lambda n: F.lit(None).cast("string").alias(n)
    return cells.select(F.lit(0).alias("sheet_id"), "row", "c.col", F.lit("number").alias("kind"), "c.num", text("txt"), F.lit(None).cast("boolean").alias("flag"), text("err"), F.lit(False).alias("is_date"), "c.formula")


@query(
    "whatif_cycle",
    """SELECT col, CASE WHEN o_orderkey % 10 = 0 THEN 'blocked' WHEN o_totalprice = 5 THEN 'unchanged' ELSE 'moved' END AS verdict,
           CASE WHEN o_orderkey % 10 <> 0 THEN NULL WHEN col = 4 THEN 'reads a blocked cell' ELSE 'circular reference' END AS reason, count(*) AS cells, min(col - 1) AS level
    FROM orders, (VALUES (2), (3), (4)) AS t(col) GROUP BY 1, 2, 3""",
)
def whatif_cycle(spark, sf_dir):
    """All prices set to five; circles of two are blocked, and so is what reads them."""
    cells = circles(spark, sf_dir)
    changed = cells.filter("col = 1").select("sheet_id", "row", "col", "kind", F.lit(5.0).alias("num"), "txt", "flag", "err")
    told, _ = trace.what_if_cells(cells, None, ["Orders"], changed, max_cells=1 << 40)
    return told.groupBy("col", "verdict", "reason").agg(F.count("*").alias("cells"), F.min("level").alias("level"))


@query("schema_infer", "SELECT 0 AS key_left, 'Part' AS table_sheet, 2 AS column, false AS approximate, count(*) AS cells FROM orders")
def schema_infer(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.lit(None)
    f = F.concat(F.lit("VLOOKUP(A"), (k + 1).cast("string"), F.lit(",Part!$A$1:$C$9,2,FALSE)"))
    cells = read(spark, sf_dir, "orders").select(F.lit(0).alias("sheet_id"), k.cast("int").alias("row"), F.lit(1).alias("col"), F.lit("number").alias("kind"), F.lit(1.0).alias("num"), none.cast("string").alias("txt"), none.cast("boolean").alias("flag"), none.cast("string").alias("err"), F.lit(False).alias("is_date"), f.alias("formula"))
    return trace.infer_schema(formula_cells(cells)).select("key_left", "table_sheet", "column", "approximate", "cells")


# --- regions -----------------------------------------------------------------------------------
#: Orders dealt to a grid of blocks: 100 rows of two columns, a blank column and ten blank rows between.
BLOCKS = """(SELECT CAST(floor((o_orderkey % 1000) / 100) * 110 + o_orderkey % 100 AS INT) AS "row", CAST(floor(o_orderkey / 1000) * 3 + j AS INT) AS col FROM orders, range(0, 2) s(j))"""


@query("region_partition", f'SELECT min("row") AS top, min(col) AS "left", max("row") AS bottom, max(col) AS "right", count(*) AS cells FROM {BLOCKS} GROUP BY floor("row" / 110), floor(col / 3)')
def region_partition(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = read(spark, sf_dir, "orders").select((F.floor(k % 1000 / 100) * 110 + k % 100).cast("int").alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), k)
    cells = cells.select(F.lit(0).alias("sheet_id"), "row", (F.floor(k / 1000) * 3 + F.col("j")).cast("int").alias("col"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("formula"))
    return structure.bounds(structure.partitioned(cells)).select("top", "left", "bottom", "right", "cells")


@query("region_describe", "SELECT 0 AS top, 0 AS \"left\", CAST(max(c_custkey) + 1 AS INT) AS bottom, 1 AS \"right\", 2 * count(*) + 2 AS cells, CASE WHEN bool_and(c_name IS NOT NULL) AND bool_and(c_nationkey IS NOT NULL) THEN 'table' ELSE 'block' END AS kind, 1 AS header_rows, 1 AS header_cols, 'Nation' AS headers, 2 * count(*) + 2 = 2 * (max(c_custkey) + 2) AS full FROM customer")
def region_describe(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("int").alias("row"), "c_name", "c_nationkey")
    head = spark.createDataFrame([(0, 0, "text", None, "Name"), (0, 1, "text", None, "Nation")], "row int, col int, kind string, num double, txt string")
    cells = long(t, "row", ["c_name", "c_nationkey"])
    top = head.select(F.lit(0).alias("sheet_id"), "row", "col", "kind", "num", "txt", F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("err"), F.lit(False).alias("is_date"), F.lit(None).cast("string").alias("formula"))
    found = structure.density(structure.regions(cells.unionByName(top)))
    return found.select("top", "left", "bottom", "right", "cells", "kind", "header_rows", "header_cols", F.array_join("headers", ",").alias("headers"), (F.col("density") == 1).alias("full"))


@query("merged_cells", "SELECT CAST(c_custkey AS INT) AS \"row\", col, CASE WHEN col < 2 THEN CAST(c_custkey // 4 * 4 AS INT) END AS merge_top, CASE WHEN col < 2 THEN CAST(c_custkey // 4 * 4 + 3 AS INT) END AS merge_bottom FROM customer, (VALUES (0), (1), (2)) t(col)")
def merged_cells(spark, sf_dir):
    """Each four rows of the first two columns are merged."""
    cells = key_cells(spark, sf_dir)
    k = F.col("row")
    merges = cells.filter("col = 0").filter(k % 4 == 0).select("sheet_id", k.alias("top"), F.lit(0).alias("left"), (k + 3).alias("bottom"), F.lit(1).alias("right"))
    return structure.merge_at(cells, merges).select("row", "col", "merge_top", "merge_bottom")


# --- the graph ---------------------------------------------------------------------------------
def keys_graph(spark, sf_dir):
    """Tables as a graph of keys: an edge from each row to what it names, weight the count of references."""
    node = lambda t, c: F.concat(F.lit(f"{t}:"), F.col(c).cast("string"))
    # Edges are counted by their numbers before these become texts; tables have no edge in common.
    counted = lambda table, a, b: read(spark, sf_dir, table).groupBy(a, b).agg(F.count("*").alias("weight"))
    parts = [("customer", "c_nationkey", "c", "n", "c_custkey"), ("orders", "o_custkey", "o", "c", "o_orderkey"), ("nation", "n_regionkey", "n", "r", "n_nationkey")]
    out = None
    for table, to, a, b, key in parts:
        e = counted(table, key, to).select(node(a, key).alias("src"), node(b, to).alias("dst"), F.lit("DEPENDS_ON").alias("kind"), "weight")
        out = e if out is None else out.unionByName(e)
    lines = counted("lineitem", "l_orderkey", "l_suppkey").select(node("o", "l_orderkey").alias("src"), node("s", "l_suppkey").alias("dst"), F.lit("CROSS_SHEET_REF").alias("kind"), "weight")
    return out.unionByName(lines)


KEYS = """(SELECT src, dst, kind, count(*) AS weight FROM (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'DEPENDS_ON' AS kind FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'DEPENDS_ON' FROM orders
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'DEPENDS_ON' FROM nation UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'CROSS_SHEET_REF' FROM lineitem) GROUP BY 1, 2, 3)"""


@query("graph_edges", f"SELECT * FROM {KEYS} e")
def graph_edges(spark, sf_dir):
    return keys_graph(spark, sf_dir)


@query("graph_degrees", f"WITH b AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM {KEYS} UNION ALL SELECT dst, src, 0, 1 FROM {KEYS}) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(DISTINCT other) AS neighbors, CAST(floor(log2(count(*))) AS INT) AS bucket FROM b GROUP BY node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(keys_graph(spark, sf_dir))


@query("graph_lifting", f"SELECT CAST(sum(weight) AS BIGINT) AS \"references\", count(*) AS edges, sum(weight) / count(*) AS ratio FROM {KEYS}")
def graph_lifting(spark, sf_dir):
    return graph.lifting_ratio(keys_graph(spark, sf_dir))


@query("graph_audit", f"SELECT src, dst, kind, weight AS expected, CASE WHEN strlen(src) % 5 = 1 THEN NULL ELSE weight + 1 END AS actual, CASE WHEN strlen(src) % 5 = 1 THEN 'missing' ELSE 'weight' END AS finding FROM {KEYS} WHERE strlen(src) % 5 = 1 OR (strlen(src) % 5 <> 1 AND src LIKE '%77')")
def graph_audit(spark, sf_dir):
    e = keys_graph(spark, sf_dir)
    broken = e.filter(F.octet_length("src") % 5 != 1).withColumn("weight", F.col("weight") + F.when(F.col("src").like("%77"), 1).otherwise(0))
    return graph.audit(e, broken)


@query("graph_reachable", f"WITH RECURSIVE w(node, hops) AS (SELECT 'o:' || o_orderkey, 0 FROM orders WHERE o_orderkey <= 5 UNION SELECT e.dst, w.hops + 1 FROM w JOIN {KEYS} e ON e.src = w.node WHERE w.hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY node")
def graph_reachable(spark, sf_dir):
    seeds = read(spark, sf_dir, "orders").filter("o_orderkey <= 5").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reachable(keys_graph(spark, sf_dir), seeds, 3)


def price_column(spark, sf_dir):
    """The whole column of prices as a region: to the end of a file's sheet, or to the last order of a taller one."""
    last = F.greatest(F.lit(MAX_ROW), F.max("o_orderkey")).cast("int")
    return read(spark, sf_dir, "orders").agg(last.alias("bottom")).select(F.lit(0).alias("sheet_id"), F.lit("price").alias("block"), F.lit(0).alias("top"), F.lit(1).alias("left"), "bottom", F.lit(1).alias("right"))


@query("graph_lifted", "SELECT 'sheet 0' AS src, 'region 0#price' AS dst, 'DEPENDS_ON' AS kind, count(*) FILTER (WHERE o_orderkey % 89 <> 0) AS weight FROM orders")
def graph_lifted(spark, sf_dir):
    cells = sheet(spark, sf_dir)
    names = spark.createDataFrame([(0, "Orders")], "sheet_id int, name string")
    regions = price_column(spark, sf_dir)
    return graph.lifted(cells, names, regions)


@query("graph_accounting", "SELECT count(*) FILTER (WHERE o_orderkey % 89 <> 0) + count(*) AS scanned, count(*) FILTER (WHERE o_orderkey % 89 <> 0) AS lifted, CAST(0 AS BIGINT) AS within, CAST(0 AS BIGINT) AS external, CAST(0 AS BIGINT) AS unknown, count(*) AS unpopulated FROM orders")
def graph_accounting(spark, sf_dir):
    names = spark.createDataFrame([(0, "Orders")], "sheet_id int, name string")
    regions = price_column(spark, sf_dir)
    return graph.reference_report(sheet(spark, sf_dir), names, regions)


@query("region_fit", "WITH q AS (SELECT c_custkey AS q, c_custkey % 40 AS top, c_custkey % 40 + c_custkey % 7 AS bottom FROM customer) SELECT CAST(q AS INT) AS q, CASE WHEN top = 0 AND bottom = 6 THEN 'exact' WHEN bottom <= 6 OR (top >= 20 AND bottom <= 30) THEN 'inside' WHEN top <= 6 OR (top <= 30 AND bottom >= 20) THEN 'overlaps' ELSE 'none' END AS fit FROM q")
def region_fit(spark, sf_dir):
    k = F.col("c_custkey")
    top, bottom = k % 40, k % 40 + k % 7
    q = read(spark, sf_dir, "customer").select(k.cast("int").alias("q"), F.lit(0).alias("sheet_id"), top.cast("int").alias("top"), F.lit(0).alias("left"), bottom.cast("int").alias("bottom"), F.lit(3).alias("right"))
    regions = spark.createDataFrame([(0, "a", 0, 0, 6, 3), (0, "b", 20, 0, 30, 3)], "sheet_id int, block string, top int, left int, bottom int, right int")
    return graph.fit(q, regions).select("q", "fit")


# --- ledgers and snapshots ---------------------------------------------------------------------
@query("watch_diff", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'removed' WHEN o_orderkey % 5 = 0 THEN 'rewritten' END AS change FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def watch_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("hash"))
    later = o.filter("key % 3 <> 0").withColumn("hash", F.when(F.col("key") % 5 == 0, F.lit("new")).otherwise(F.col("hash")))
    return diff(o, later)


@query("call_ledger", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events")
def call_ledger(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("nth"))


@query("a1_addresses", "SELECT c_custkey, CASE WHEN k >= 26 THEN chr(CAST(64 + k // 26 AS INT)) ELSE '' END || chr(CAST(65 + k % 26 AS INT)) || (c_custkey + 1) AS a1 FROM (SELECT c_custkey, c_custkey % 700 AS k FROM customer)")
def a1_addresses(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", a1_column(k, k % 700).alias("a1"))


# --- the demo workbook -------------------------------------------------------------------------
@query("demo_recompute", "SELECT 'agrees' AS outcome, CAST(500 * 7 - 1 + 6 + 1 AS BIGINT) AS cells UNION ALL SELECT 'unsupported', 1")
def demo_recompute(spark, sf_dir):
    """Every formula of the demo workbook recomputed: all agree with closed forms but the one that is refused."""
    return trace.recompute(demo.workbook(spark, 500), demo.SHEETS, demo.NAMES).groupBy("outcome").agg(F.count("*").alias("cells"))


@query("demo_audit", "SELECT col, CAST(formulas AS BIGINT) AS formulas, CAST(typed AS BIGINT) AS typed FROM (VALUES (8, 499, 1), (5, 500, 0), (6, 500, 0), (7, 500, 0), (9, 500, 0), (10, 500, 0), (11, 500, 0)) t(col, formulas, typed)")
def demo_audit(spark, sf_dir):
    cells = demo.debtors(spark, 500)
    body = spark.createDataFrame([("b", 0, 1, 0, 500, 11)], "body string, sheet_id int, top int, left int, bottom int, right int")
    return structure.column_audit(cells, body).select("col", "formulas", "typed")


# --- scores and marks --------------------------------------------------------------------------
@query("retrieval_score", "WITH h AS (SELECT o_custkey AS ask, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), w AS (SELECT o_custkey AS ask, max(o_orderkey) AS doc FROM orders GROUP BY 1), f AS (SELECT w.ask, min(r) AS r FROM w LEFT JOIN h ON h.ask = w.ask AND h.doc = w.doc GROUP BY 1) SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 9) AS hit_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 9) AS hit_5, round(avg(1.0 / r), 9) AS mrr FROM f")
def retrieval_score(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ask"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score"))
    out = report.retrieval_score(o, o.groupBy("ask").agg(F.max("doc").alias("doc")))
    return out.select("questions", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_5", "mrr")])


@query("grounded_marks", "SELECT doc_id, CASE WHEN NOT contains(lower(text), 'the') THEN 'miss' WHEN lang = 'en' THEN 'hit' ELSE 'echo' END AS mark FROM documents")
def grounded_marks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", report.grounded(F.col("text"), F.array(F.lit("the")), F.array(F.when(F.col("lang") == "en", "the total").otherwise("nothing"))).alias("mark"))


@query("history_elision", "SELECT event_id, (row_number() OVER w > 2 AND sum(event_id % 1000) OVER w > 6000) AS stub FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)")
def history_elision(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 1000)
    return report.elided(e, "user_id", "event_id", "tokens").select("event_id", "stub")


@query("reply_citations", "SELECT p_partkey, 'Sheet' || p_size || '!B' || p_partkey || ':C' || (p_partkey + 1) AS cites FROM part WHERE p_partkey > 0")
def reply_citations(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    cite = F.concat(F.lit("Sheet"), F.col("p_size").cast("string"), F.lit("!B"), k, F.lit(":C"), (F.col("p_partkey") + 1).cast("string"))
    reply = F.concat(F.lit("It is in "), cite, F.lit(", see "), cite, F.lit("."))
    return read(spark, sf_dir, "part").filter("p_partkey > 0").select("p_partkey", F.array_join(report.citations_in(reply), " ").alias("cites"))


@query("redact_values", "SELECT c_custkey, '<number>' AS balance, '<text>' AS name FROM customer")
def redact_values(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", report.redacted(F.lit("number"), F.col("c_acctbal").cast("string"), True).alias("balance"), report.redacted(F.lit("text"), F.col("c_name"), True).alias("name"))


@query("canvas_context", "SELECT CAST(c_custkey AS INT) AS node FROM customer WHERE c_nationkey = 1 UNION SELECT DISTINCT CAST(1000000000 + n_nationkey AS INT) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 1")
def canvas_context(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("node"), "c_nationkey")
    sheets_ = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("int").alias("node"), F.lit("sheet").alias("kind"), F.lit(99).alias("sheet_id"))
    nodes = c.select("node", F.lit("region").alias("kind"), F.col("c_nationkey").alias("sheet_id")).unionByName(sheets_)
    edges = c.select(F.col("node").alias("src"), (F.col("c_nationkey") + 1_000_000_000).cast("int").alias("dst"), F.lit("CONTAINS").alias("kind"), F.lit(1).alias("weight"))
    return report.canvas(nodes, edges, ["region", "sheet"], ["CONTAINS"], 1, True)[0].select("node")
