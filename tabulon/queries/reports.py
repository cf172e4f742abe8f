"""Queries of the diagnostic reports, over sheets made of the flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.text import formula_cells, references_of
from tabulon.operators import graph, layers
from tabulon.plans import reports
from tabulon.plans.keep import written
from tabulon.queries import query
from tabulon.queries.graphs import ledger, ledger_graph, ledger_regions
from tabulon.queries.sheets import KEYED, RUNS, SHAPES, key_cells, price_column, sheet
from tabulon.queries.tables import FOUND, found_sql, part_docs
from tabulon.sources.tables import read

ONE_SHEET = ([(0, "Orders", True)], "sheet_id int, name string, visible boolean")


@query("report_dump_cells", f"SELECT 'Customers!' || chr(CAST(65 + col AS INT)) || (\"row\" + 1) AS cite, kind, coalesce(txt, CAST(CAST(num AS BIGINT) AS VARCHAR)) AS value FROM {KEYED}")
def dump_cells(spark, sf_dir):
    sheets = spark.createDataFrame([(0, "Customers", True)], "sheet_id int, name string, visible boolean")
    return reports.dump_cells(key_cells(spark, sf_dir), sheets).select("cite", "kind", "value")


@query("report_raw_cells", f"SELECT \"row\", col, CASE WHEN kind = 'number' THEN 'num' ELSE 'txt' END AS field, coalesce(txt, CAST(CAST(num AS BIGINT) AS VARCHAR)) AS raw FROM {KEYED}")
def raw_cells(spark, sf_dir):
    r = reports.raw_cells(key_cells(spark, sf_dir))
    return r.select("row", "col", "field", F.when(F.col("field") == "num", F.col("raw").cast("double").cast("bigint").cast("string")).otherwise(F.col("raw")).alias("raw"))


@query("report_ingest_audit", f"SELECT 0 AS sheet_id, 4 * n AS cells, 3 * n AS number, n AS text, f AS formulas, CAST(0 AS BIGINT) AS without_value FROM (SELECT count(*) AS n FROM orders), (SELECT count(*) AS f FROM {SHAPES})")
def ingest_audit(spark, sf_dir):
    return reports.ingest_audit(sheet(spark, sf_dir)).select("sheet_id", "cells", "number", "text", "formulas", "without_value")


@query("report_column_sanity", "SELECT CAST(o_orderkey // 1000 AS VARCHAR) || ':1' AS block, 'Price' AS header, count(*) AS cells, count(DISTINCT k) AS kinds, greatest(count(*) FILTER (WHERE k), count(*) FILTER (WHERE NOT k)) AS of_it FROM (SELECT *, o_orderkey % 3 = 0 AS k FROM orders) WHERE o_orderkey % 1000 > 0 GROUP BY o_orderkey // 1000 HAVING count(DISTINCT k) > 1")
def column_sanity(spark, sf_dir):
    """Every third price of the ledger as a text."""
    text = (F.col("sheet_id") == 0) & (F.col("col") == 1) & (F.col("row") % 3 == 0)
    cells = ledger(spark, sf_dir).withColumn("kind", F.when(text, "text").otherwise(F.col("kind")))
    return reports.column_sanity(cells, ledger_regions(spark, sf_dir)).select("block", "header", "cells", "kinds", "of_it")


@query("report_shared_formulas", f"SELECT count(*) AS runs, CAST(sum(cells) AS BIGINT) AS cells, count(*) FILTER (WHERE shape IS NULL) AS differing FROM {RUNS}")
def shared_formulas(spark, sf_dir):
    return reports.shared_formula_check(sheet(spark, sf_dir))


@query("report_shared_groups", f"SELECT CAST(sum(cells) AS BIGINT) AS formulas, count(*) AS groups, CAST(sum(cells) AS BIGINT) AS covered, count(*) FILTER (WHERE bottom - top + 1 <> cells) AS not_full FROM {RUNS}")
def shared_groups(spark, sf_dir):
    return reports.shared_group_check(sheet(spark, sf_dir))


@query("report_unquoted_sheets", "SELECT p_brand AS sheet, count(*) AS count FROM part WHERE p_partkey % 2 = 0 AND regexp_matches(p_brand, '[^A-Za-z0-9_.]') GROUP BY 1 UNION ALL SELECT 'A' || p_size, count(*) FROM part WHERE p_partkey % 2 = 1 GROUP BY 1")
def unquoted_sheets(spark, sf_dir):
    """Brands and cell-like names as the sheets of references, all without quotes."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("A"), F.col("p_size").cast("string")))
    refs = read(spark, sf_dir, "part").select(name.alias("sheet"), F.concat(name, F.lit("!A1")).alias("text"))
    return reports.unquoted_sheets(refs).select("sheet", "count")


@query("report_check_regions", "SELECT 'cell in no region' AS finding, 0 AS sheet_id, 2 * count(*) AS count FROM orders WHERE o_orderkey // 1000 % 3 = 1 HAVING count(*) > 0 UNION ALL SELECT 'cell in no region', 1, count(*) FROM customer WHERE c_custkey // 100 % 3 = 1 HAVING count(*) > 0 UNION ALL SELECT 'cell in several regions', 0, 2 * count(*) FROM orders WHERE o_orderkey // 1000 % 3 = 2 HAVING count(*) > 0 UNION ALL SELECT 'overlapping regions', 0, count(DISTINCT o_orderkey // 1000) FROM orders WHERE o_orderkey // 1000 % 3 = 2 HAVING count(*) > 0")
def check_regions(spark, sf_dir):
    """Of every three blocks one is dropped, and one of the orders is there twice."""
    r = ledger_regions(spark, sf_dir)
    b = F.col("block").cast("int") % 3
    again = r.filter((b == 2) & (F.col("sheet_id") == 0)).withColumn("block", F.concat("block", F.lit(" again")))
    return reports.check_regions(ledger(spark, sf_dir), r.filter(b != 1).unionByName(again))


@query("report_missed_headers", "SELECT 1 AS sheet_id, CAST(c_custkey // 100 AS VARCHAR) AS block, CAST(c_custkey // 100 * 100 AS INT) AS top FROM customer GROUP BY c_custkey // 100 HAVING count(*) FILTER (WHERE c_custkey % 100 = 1) > 0 AND c_custkey // 100 % 2 = 0")
def missed_headers(spark, sf_dir):
    """Blocks of balances, twice side by side; the first row of every other block is text."""
    text = (F.col("row") % 100 == 0) & (F.floor(F.col("row") / 100) % 2 == 0)
    one = ledger(spark, sf_dir).filter("sheet_id = 1").withColumn("kind", F.when(text, "text").otherwise(F.col("kind")))
    regions = ledger_regions(spark, sf_dir).filter("sheet_id = 1").withColumn("header_rows", F.lit(0)).withColumn("right", F.lit(2))
    return reports.missed_headers(one.unionByName(one.withColumn("col", F.lit(2))), regions).select("sheet_id", "block", "top")


@query("report_why_not_grouped", f"SELECT CAST(r.top AS INT) AS \"row\", r.col, CASE WHEN EXISTS (SELECT 1 FROM {SHAPES} s WHERE s.col = r.col AND s.\"row\" IN (r.top - 1, r.top + 1)) THEN 'neighbours have other shapes' ELSE 'no formula next to it' END AS reason FROM {RUNS} r WHERE cells = 1")
def why_not_grouped(spark, sf_dir):
    return reports.why_not_grouped(sheet(spark, sf_dir)).select("row", "col", "reason")


@query("report_why_unpopulated", "SELECT 'C' || (o_orderkey + 1) AS text, CAST(1 AS BIGINT) AS count, CAST(o_orderkey AS INT) AS first_row FROM orders")
def why_unpopulated(spark, sf_dir):
    """Only the prices are a region, so every reference to a double lands in none."""
    regions = price_column(spark, sf_dir)
    cells = sheet(spark, sf_dir)
    refs = graph.accounted(cells, spark.createDataFrame(*ONE_SHEET), regions)
    none = spark.createDataFrame([], "node string")
    return reports.why_unpopulated(layers.Graph(none, none, refs, none, none, none)).select("text", "count", "first_row")


@query("report_search", "WITH h AS (" + found_sql().replace("LIMIT 25", "LIMIT 10") + ") SELECT '" + " ".join(FOUND) + "' AS question, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INT) AS rank, doc FROM h")
def search_report(spark, sf_dir):
    return reports.lexical_report(part_docs(spark, sf_dir), [" ".join(FOUND)]).select("question", "rank", "doc")


@query("report_formulas", "WITH h AS (" + found_sql().replace("FROM part)", "FROM part WHERE p_size % 2 = 0)").replace("LIMIT 25", "LIMIT 10") + ") SELECT CAST(row_number() OVER (ORDER BY score DESC, doc) AS INT) AS rank, doc FROM h")
def formula_search(spark, sf_dir):
    """Parts of even size stand for formula groups."""
    docs = part_docs(spark, sf_dir).withColumn("kind", F.when(F.col("cells") % 2 == 0, "formula_group").otherwise("column"))
    return reports.formula_report(docs, [" ".join(FOUND)]).select("rank", "doc")


@query("report_semantic", None)
def semantic_search(spark, sf_dir):
    from tabulon.operators.search import hashing_embedder

    docs = part_docs(spark, sf_dir).withColumn("context", F.col("sheet")).withColumn("values", F.array().cast("array<string>")).withColumn("categorical", F.lit(False))
    return reports.semantic_report(docs, ["red ring"], hashing_embedder()).select("question", "rank", "doc")


@query("report_retrieve", "SELECT 'region 0#0' AS node, 'seed' AS role, 0 AS hops UNION ALL SELECT 'sheet 0', 'ancestor', 0 UNION ALL SELECT 'workbook', 'ancestor', 0 UNION ALL SELECT * FROM (SELECT DISTINCT 'region 1#' || (o_custkey // 100), 'input', 1 FROM orders WHERE o_orderkey < 1000) UNION ALL SELECT 'name *:TAX', 'input', 1 UNION ALL SELECT 'sheet 1', 'ancestor', 1")
def retrieve_report(spark, sf_dir):
    """One hop from the first block of orders: what it reads, and what that stands in."""
    g = ledger_graph(spark, sf_dir)
    g.nodes, g.edges = written(g.nodes), written(g.edges)  # the walk reads no others
    return reports.retrieve_report(g, ["region 0#0"], hops=1, budget=2000).select("node", "role", "hops")


@query("report_trace", f"SELECT 0 AS sheet_id, 0 AS target, CAST(sum(cells) AS BIGINT) AS cells, count(*) AS groups FROM {RUNS}")
def trace_report(spark, sf_dir):
    cells = sheet(spark, sf_dir)
    refs = graph.resolved(references_of(cells), spark.createDataFrame(*ONE_SHEET).select("sheet_id", "name"))
    return reports.trace_report(formula_cells(cells), refs)
