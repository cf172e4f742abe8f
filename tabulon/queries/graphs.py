"""Queries over the layers of a graph: nodes, edges of every kind, the build's report, invariants, documents.

The ledger has two sheets: Orders (row = o_orderkey; B the price, D a formula) in regions of 1,000 rows
under a header row each thousand rows, and Customers (row = c_custkey; B the balance) in regions of 100.
D reads its customer's balance; every fifth one also uses the name Tax, else every seventh one another
workbook, else every eleventh one a sheet that there is not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.text import formula_cells
from tabulon.operators import graph, layers, structure
from tabulon.plans.keep import kept, written
from tabulon.queries import query
from tabulon.queries.sheets import RUNS, sheet
from tabulon.sources.tables import read

SHEETS = [(0, "Orders", True), (1, "Customers", False)]


def ledger(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    k, at = F.col("o_orderkey"), (F.col("o_custkey") + 1).cast("string")
    end = F.when(k % 5 == 0, F.lit("*Tax")).when(k % 7 == 0, F.lit("+[Rates.xlsx]S!A1")).when(k % 11 == 0, F.lit("+Missing!A1")).otherwise(F.lit("*2"))
    none = lambda t: F.lit(None).cast(t)
    cell = lambda col, num, formula: F.struct(F.lit(col).alias("col"), num.cast("double").alias("num"), formula.alias("formula"))
    first = o.select(F.lit(0).alias("sheet_id"), k.cast("int").alias("row"), F.explode(F.array(cell(1, F.col("o_totalprice"), none("string")), cell(3, F.lit(0.0), F.concat(F.lit("Customers!B"), at, end)))).alias("c"))
    second = c.select(F.lit(1).alias("sheet_id"), F.col("c_custkey").cast("int").alias("row"), cell(1, F.col("c_acctbal"), none("string")).alias("c"))
    return first.unionByName(second).select("sheet_id", "row", "c.col", F.lit("number").alias("kind"), "c.num", none("string").alias("txt"), none("boolean").alias("flag"), none("string").alias("err"), F.lit(False).alias("is_date"), "c.formula")


def ledger_regions(spark, sf_dir):
    """The blocks of both sheets, as structure.regions would describe them; every thousand's first row counts as its header."""
    o = read(spark, sf_dir, "orders").select(F.lit(0).alias("sheet_id"), F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 1000).alias("b"), F.lit(1).alias("left"), F.lit(3).alias("right"), F.lit(1000).alias("size"))
    c = read(spark, sf_dir, "customer").select(F.lit(1).alias("sheet_id"), F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 100).alias("b"), F.lit(1).alias("left"), F.lit(1).alias("right"), F.lit(100).alias("size"))
    heads = F.when(F.col("sheet_id") == 0, F.array(F.lit("Price"), F.lit(""), F.lit("Due"))).otherwise(F.array(F.lit("Balance")))
    g = o.unionByName(c).groupBy("sheet_id", "b", "left", "right", "size").agg(F.count("*").alias("n"))
    top = F.col("b") * F.col("size")
    title = F.when(F.col("b") % 2 == 0, F.concat(F.lit("Block "), F.col("b").cast("string")))
    cells = F.col("n") * F.when(F.col("sheet_id") == 0, 2).otherwise(1)
    return g.select("sheet_id", F.col("b").cast("string").alias("block"), top.cast("int").alias("top"), "left", (top + F.col("size") - 1).cast("int").alias("bottom"), "right", cells.alias("cells"), F.lit("table").alias("kind"), title.alias("title"), F.lit(1).alias("header_rows"), F.lit(0).alias("header_cols"), heads.alias("headers"), F.array().cast("array<string>").alias("label_headers"), F.lit(True).alias("declared"), F.lit(0).alias("totals_rows"))


def ledger_graph(spark, sf_dir):
    names = spark.createDataFrame([("Tax", "Rates!$B$1", None), ("tax", "Rates!$B$2", 1)], "name string, refers_to string, scope int")
    sheets = spark.createDataFrame(SHEETS, "sheet_id int, name string, visible boolean")
    return layers.build(ledger(spark, sf_dir), sheets, ledger_regions(spark, sf_dir), names, "ledger.xlsx", groups=False, format="xlsx", cut=written)


REFERENCES = """(SELECT o_orderkey // 1000 AS b, o_custkey // 100 AS c, o_custkey IN (SELECT c_custkey FROM customer) AS known, CASE WHEN o_orderkey % 5 = 0 THEN 'name' WHEN o_orderkey % 7 = 0 THEN 'book' WHEN o_orderkey % 11 = 0 THEN 'lost' ELSE 'plain' END AS what FROM orders)"""
LIFTED = f"""(SELECT 'region 0#' || b AS src, 'region 1#' || c AS dst, 'CROSS_SHEET_REF' AS kind, count(*) AS weight FROM {REFERENCES} JOIN (SELECT DISTINCT c_custkey // 100 AS c FROM customer) USING (c) GROUP BY 1, 2
  UNION ALL SELECT 'region 0#' || b, 'book Rates.xlsx', 'CROSS_WORKBOOK_REF', count(*) FROM {REFERENCES} WHERE what = 'book' GROUP BY 1
  UNION ALL SELECT 'region 0#' || b, 'name *:TAX', 'REFERENCES_NAME', count(*) FROM {REFERENCES} WHERE what = 'name' GROUP BY 1)"""
BLOCKS = """(SELECT 0 AS s, o_orderkey // 1000 AS b, 2 * count(*) AS cells, 1000 AS size FROM orders GROUP BY 2 UNION ALL SELECT 1, c_custkey // 100, count(*), 100 FROM customer GROUP BY 2)"""
COLUMNS = f"(SELECT s, b, cells, size, col, header FROM {BLOCKS} JOIN (VALUES (0, 1, 'Price'), (0, 3, 'Due'), (1, 1, 'Balance')) t(ts, col, header) ON ts = s)"
CONTAINED = f"""(SELECT 'workbook' AS src, 'sheet ' || i AS dst FROM range(0, 2) r(i) UNION ALL SELECT 'workbook', 'name *:TAX' UNION ALL SELECT 'workbook', 'name 1:TAX' UNION ALL SELECT DISTINCT 'workbook', 'book Rates.xlsx' FROM {REFERENCES} WHERE what = 'book'
  UNION ALL SELECT 'sheet ' || s, 'region ' || s || '#' || b FROM {BLOCKS} UNION ALL SELECT 'region ' || s || '#' || b, 'column ' || s || '#' || b || ':' || col FROM {COLUMNS})"""


@query("graph_all_edges", f"SELECT * FROM {LIFTED} UNION ALL SELECT src, dst, 'CONTAINS', 1 FROM {CONTAINED}")
def graph_all_edges(spark, sf_dir):
    return ledger_graph(spark, sf_dir).edges.select("src", "dst", "kind", "weight")


@query(
    "graph_nodes",
    f"""SELECT kind, count(*) AS nodes, CAST(sum(cells) AS BIGINT) AS cells FROM (SELECT 'workbook' AS kind, 0 AS cells UNION ALL SELECT 'sheet', 2 * count(*) FROM orders UNION ALL SELECT 'sheet', count(*) FROM customer UNION ALL SELECT 'region', cells FROM {BLOCKS}
    UNION ALL SELECT 'column', size - 1 FROM {COLUMNS} UNION ALL SELECT 'defined_name', 0 FROM range(0, 2) UNION ALL SELECT DISTINCT 'external_workbook', 0 FROM {REFERENCES} WHERE what = 'book') GROUP BY 1""",
)
def graph_nodes(spark, sf_dir):
    return ledger_graph(spark, sf_dir).nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.sum("cells").alias("cells"))


@query(
    "graph_build_report",
    f"""WITH r AS (SELECT r.*, e.c IS NOT NULL AS hit FROM {REFERENCES} r LEFT JOIN (SELECT DISTINCT c_custkey // 100 AS c FROM customer) e USING (c)),
    e AS (SELECT kind, weight FROM {LIFTED} UNION ALL SELECT 'CONTAINS', 1 FROM {CONTAINED})
    SELECT * FROM (SELECT 'edges' AS what, kind AS key, count(*) AS count FROM e GROUP BY 2 UNION ALL SELECT 'weight', kind, CAST(sum(weight) AS BIGINT) FROM e GROUP BY 2
    UNION ALL SELECT 'references', 'scanned', count(*) + count(*) FILTER (WHERE what IN ('book', 'lost')) FROM r
    UNION ALL SELECT 'references', 'lifted', count(*) FILTER (WHERE hit) FROM r UNION ALL SELECT 'references', 'cross_sheet', count(*) FILTER (WHERE hit) FROM r
    UNION ALL SELECT 'references', 'external', count(*) FILTER (WHERE what = 'book') FROM r UNION ALL SELECT 'references', 'dangling', count(*) FILTER (WHERE what = 'lost') FROM r
    UNION ALL SELECT 'references', 'unpopulated_target', count(*) FILTER (WHERE NOT hit) FROM r
    UNION ALL SELECT 'names', 'resolved', count(*) FILTER (WHERE what = 'name') FROM r
    UNION ALL SELECT 'unknown sheet', 'Missing', count(*) FROM r WHERE what = 'lost') WHERE count > 0""",
)
def graph_build_report(spark, sf_dir):
    """Counters that are not zero, without the nodes, which graph_nodes has."""
    return layers.report(ledger_graph(spark, sf_dir).keep(kept)).filter("what <> 'nodes' and count > 0")


@query("graph_dangling", "SELECT 0 AS sheet_id, CAST(o_orderkey AS INT) AS \"row\", 3 AS col, 'Missing!A1' AS text, 'unknown sheet' AS reason FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 ORDER BY o_orderkey LIMIT 32")
def graph_dangling(spark, sf_dir):
    return layers.dangling(ledger_graph(spark, sf_dir))


@query("graph_invariants", f"SELECT 'one CONTAINS parent per contained node' AS invariant, count(*) AS violations FROM {BLOCKS} WHERE b % 3 = 0 UNION ALL SELECT 'every edge stands for at least one reference', count(*) FROM {LIFTED} WHERE kind = 'CROSS_SHEET_REF' AND weight % 2 = 0 HAVING count(*) > 0")
def graph_invariants(spark, sf_dir):
    """A graph spoilt on purpose: regions of every third block hang on the workbook too, every even weight of a sheet crossing is 0."""
    g = ledger_graph(spark, sf_dir).keep(kept)
    more = g.nodes.filter("kind = 'region'").filter(F.substring_index("node", "#", -1).try_cast("int") % 3 == 0).select(F.lit("workbook").alias("src"), F.col("node").alias("dst"), F.lit("CONTAINS").alias("kind"), F.lit(1).cast("long").alias("weight"))
    spoilt = F.when((F.col("kind") == "CROSS_SHEET_REF") & (F.col("weight") % 2 == 0), 0).otherwise(F.col("weight")).cast("long")
    g.edges = g.edges.select("src", "dst", "kind", spoilt.alias("weight")).unionByName(more.select("src", "dst", "kind", "weight"))
    return layers.check(g).filter("invariant not like 'every lifted%'")


@query(
    "graph_findings",
    f"""WITH e AS (SELECT * FROM {LIFTED} WHERE kind = 'CROSS_SHEET_REF'), n AS (SELECT *, CAST(split_part(dst, '#', 2) AS INT) % 4 AS q FROM e)
    SELECT 'missing edge' AS finding, src, dst, weight AS expected, NULL AS actual FROM n WHERE q = 1 UNION ALL SELECT 'weight disagrees', src, dst, weight, weight + 1 FROM n WHERE q = 2
    UNION ALL SELECT 'weight disagrees', src, dst, weight, 2 * weight FROM n WHERE q = 3 UNION ALL SELECT 'parallel edges', src, dst, NULL, 2 FROM n WHERE q = 3""",
)
def graph_findings(spark, sf_dir):
    """An audit of edges that are dropped, heavier by one, or there twice, by the number of the block that they reach."""
    g = ledger_graph(spark, sf_dir)
    q = F.when(F.col("kind") == "CROSS_SHEET_REF", F.substring_index("dst", "#", -1).try_cast("int") % 4).otherwise(0)
    g.edges = g.edges.withColumn("q", q).filter("q <> 1").withColumn("weight", F.col("weight") + F.when(F.col("q") == 2, 1).otherwise(0)).withColumn("twice", F.explode(F.when(F.col("q") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("src", "dst", "kind", "weight")
    return layers.audit(ledger(spark, sf_dir), g).select("finding", "src", "dst", "expected", "actual")


@query("graph_header_of", f"SELECT 'column 0#all:2' AS src, 'group 0:' || top || ':2:' || bottom || ':2' AS dst, 'HEADER_OF' AS kind, 1 AS weight FROM {RUNS} WHERE col = 2 UNION ALL SELECT 'column 0#all:3', 'group 0:' || top || ':3:' || bottom || ':3', 'HEADER_OF', 1 FROM {RUNS} WHERE col = 3")
def graph_header_of(spark, sf_dir):
    """Columns over the formula groups of the formula sheet."""
    n = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").cast("int").alias("n"))
    text = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    regions = n.select(F.lit(0).alias("sheet_id"), F.lit("all").alias("block"), F.lit(0).alias("top"), F.lit(0).alias("left"), F.col("n").alias("bottom"), F.lit(3).alias("right"), F.lit(0).cast("long").alias("cells"), F.lit("table").alias("kind"), F.lit("All").alias("title"), F.lit(0).alias("header_rows"), F.lit(0).alias("header_cols"), text(["Key", "Price", "Double", "Word"]).alias("headers"), text([]).alias("label_headers"), F.lit(True).alias("declared"), F.lit(0).alias("totals_rows"))
    sheets = spark.createDataFrame([(0, "Orders", True)], "sheet_id int, name string, visible boolean")
    return layers.build(sheet(spark, sf_dir), sheets, regions, path="o.xlsx").edges.filter("kind = 'HEADER_OF'")


DOCS = f"""(SELECT 'workbook' AS doc, 'workbook' AS kind, 'ledger.xlsx' AS label, '' AS context, 'xlsx' AS body UNION ALL SELECT 'sheet 0', 'sheet', 'Orders', 'Orders', '' UNION ALL SELECT 'sheet 1', 'sheet', 'Customers', 'Customers', 'hidden'
  UNION ALL SELECT 'name *:TAX', 'defined_name', 'Tax', '', 'Rates!$B$1' UNION ALL SELECT 'name 1:TAX', 'defined_name', 'tax', 'Customers', 'Rates!$B$2' UNION ALL SELECT DISTINCT 'book Rates.xlsx', 'external_workbook', 'Rates.xlsx', '', '' FROM {REFERENCES} WHERE what = 'book'
  UNION ALL SELECT 'region ' || s || '#' || b, 'region', CASE WHEN b % 2 = 0 THEN 'Block ' || b ELSE 'B' || (b * size + 1) || ':' || CASE WHEN s = 0 THEN 'D' ELSE 'B' END || (b * size + size) END, CASE WHEN s = 0 THEN 'Orders' ELSE 'Customers' END, CASE WHEN s = 0 THEN 'table Price Due' ELSE 'table Balance' END FROM {BLOCKS}
  UNION ALL SELECT 'column ' || s || '#' || b || ':' || col, 'column', header, CASE WHEN s = 0 THEN 'Orders' ELSE 'Customers' END || CASE WHEN b % 2 = 0 THEN ' Block ' || b ELSE '' END, '' FROM {COLUMNS})"""


@query("node_documents", f"SELECT * FROM {DOCS} d")
def node_documents(spark, sf_dir):
    return layers.documents(ledger_graph(spark, sf_dir), path="ledger.xlsx").select("doc", "kind", "label", "context", "body")


@query("embedding_texts", f"SELECT doc, kind || ' ' || label || CASE WHEN context <> '' THEN ' in ' || context ELSE '' END || CASE WHEN body <> '' THEN ': ' || body ELSE '' END || CASE WHEN kind = 'column' AND label = 'Balance' THEN ', holding low, high' ELSE '' END AS text FROM {DOCS} d")
def embedding_texts(spark, sf_dir):
    """What an embedder reads of each node; the balances' profiles say they are categorical."""
    g = ledger_graph(spark, sf_dir)
    kept = g.nodes.filter("kind = 'column' and sheet_id = 1").select("sheet_id", "top", "left", "bottom", "right", F.array(F.lit("low"), F.lit("high")).alias("values"), F.lit(None).cast("string").alias("min"), F.lit(None).cast("string").alias("max"), F.lit(True).alias("categorical"))
    docs = layers.embeddable(layers.documents(g, kept))
    return docs.select("doc", layers.embedding_text(docs).alias("text"))


@query("graph_hubs", f"WITH b AS (SELECT src AS node, dst AS other FROM {LIFTED} UNION ALL SELECT dst, src FROM {LIFTED}) SELECT node, count(DISTINCT other) AS neighbors FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def graph_hubs(spark, sf_dir):
    return layers.hubs(ledger_graph(spark, sf_dir).edges.filter("kind not in ('CONTAINS', 'HEADER_OF')")).select("node", "neighbors")


@query("formula_list", "SELECT CAST(o_orderkey AS INT) AS \"row\", 2 AS col, 'B' || (o_orderkey + 1) || CASE WHEN o_orderkey % 97 = 0 THEN '*3' ELSE '*2' END AS formula FROM orders WHERE o_orderkey % 89 <> 0 UNION ALL SELECT CAST(o_orderkey AS INT), 3, 'IF(C' || (o_orderkey + 1) || '>200000,\"high\",\"low\")' FROM orders")
def formula_list(spark, sf_dir):
    return structure.formula_list(sheet(spark, sf_dir)).select("row", "col", "formula")


@query("graph_lifted_columns", "WITH r AS (SELECT o_orderkey // 500 AS b, o_orderkey % 89 = 0 AS typed FROM orders) SELECT 'region 0#c' || b AS src, 'region 0#b' || b AS dst, 'DEPENDS_ON' AS kind, count(*) FILTER (WHERE NOT typed) AS weight FROM r GROUP BY b HAVING count(*) FILTER (WHERE NOT typed) > 0 UNION ALL SELECT 'region 0#d' || b, 'region 0#c' || b, 'DEPENDS_ON', count(*) FROM r GROUP BY b")
def graph_lifted_columns(spark, sf_dir):
    """References of the formula sheet lifted to blocks of 500 rows of one column."""
    b = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("b")).distinct()
    regions = b.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in (("b", 1), ("c", 2), ("d", 3))])).alias("x"))
    regions = regions.select(F.lit(0).alias("sheet_id"), F.concat("x.n", F.col("b").cast("string")).alias("block"), (F.col("b") * 500).cast("int").alias("top"), F.col("x.c").alias("left"), (F.col("b") * 500 + 499).cast("int").alias("bottom"), F.col("x.c").alias("right"))
    return graph.lifted(sheet(spark, sf_dir), spark.createDataFrame([(0, "Orders")], "sheet_id int, name string"), regions)


@query("shape_counts", "SELECT CAST(2 AS BIGINT) AS columns, count(DISTINCT shape) AS shapes, count(*) AS formulas FROM (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'a' ELSE 'b' END AS shape FROM orders WHERE o_orderkey % 89 <> 0 UNION ALL SELECT 'c' FROM orders)")
def shape_counts(spark, sf_dir):
    f = formula_cells(sheet(spark, sf_dir))
    return f.agg(F.count_distinct("col").alias("columns"), F.count_distinct("shape").alias("shapes"), F.count("*").alias("formulas"))
