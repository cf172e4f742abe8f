"""The layers of a graph, declared tables, hybrid search, scopes and large ranges on small workbooks."""

import pytest
from pyspark.sql import functions as F
from test_workbook import ODS, XLSX, grid, packed

from tabulon.address import Range
from tabulon.functions.stem import stem
from tabulon.operators import layers, retrieve, search, structure, trace
from tabulon.operators.query import Refused
from tabulon.plans import reports
from tabulon.plans.tools import Workbook, Workbooks, stored_path
from tabulon.sources import demo
from tabulon.sources.corpus import Corpus
from tabulon.sources.workbook import LIMITATIONS, limitations, load

assert ODS


def cells_of(spark, *sheets):
    return spark.createDataFrame([(i, *c[1:]) for i, text in enumerate(sheets) for c in grid(text)], structure.CELLS)


@pytest.fixture(scope="module")
def debtors(spark):
    return Workbook(demo.workbook(spark, 60), demo.SHEETS, demo.NAMES, "demo.xlsx")


# --- words -------------------------------------------------------------------------------------
@pytest.mark.parametrize(("word", "want"), [("relational", "relat"), ("consistency", "consist"), ("knightly", "knight"), ("running", "run"), ("hoping", "hope"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("generously", "generous"), ("luxuriated", "luxuri"), ("balances", "balanc"), ("agreed", "agre"), ("boys", "boy"), ("analogy", "analog"), ("by", "by"), ("Äpfel", "Äpfel")])
def test_english_stems(word, want):
    assert stem(word) == want


def test_frame_words():
    assert len(search.FRAME) == 59 and {"about", "into", "would", "then"} <= search.FRAME and not {"list", "find", "tell", "please"} & search.FRAME


# --- regions -----------------------------------------------------------------------------------
def test_declared_tables_are_regions_as_they_stand(spark):
    # a table at B2:C4 of a sheet whose cells run around it without a blank line
    cells = cells_of(spark, "t t t t\n1 h k 1\n1 2 3 1\n1 4 5 1\n1 1 1 1")
    tables = spark.createDataFrame([(0, "T", 1, 1, 3, 2, ["h", "k"], 1, 1)], "sheet_id int, name string, top int, left int, bottom int, right int, headers array<string>, header_rows int, totals_rows int")
    found = structure.regions(cells, declared=tables)
    boxes = {(r.top, r.left, r.bottom, r.right): r for r in found.collect()}
    assert set(boxes) == {(1, 1, 3, 2), (0, 0, 0, 3), (1, 0, 3, 0), (1, 3, 3, 3), (4, 0, 4, 3)}
    t = boxes[1, 1, 3, 2]
    assert (t.title, t.kind, t.header_rows, t.totals_rows, t.cells, t.headers, t.declared) == ("T", "table", 1, 1, 6, ["h", "k"], True)
    body = structure.bodies(found).filter("declared").first()
    assert (body.body_top, body.body_left, body.body_bottom) == (2, 1, 2)
    assert structure.density(found).filter("declared").first().density == 1.0
    assert reports.check_regions(cells, found).count() == 0


def test_blocks_by_hand(spark):
    """Gaps of more than one line, and runs that lean on one another."""
    cells = cells_of(spark, "a . b\n. . .\na b .\n. b c\n. . c\n\n\nz")
    got = {(r.top, r.left, r.bottom, r.right, r.cells) for r in structure.bounds(structure.partitioned(cells)).collect()}
    assert got == {(0, 0, 0, 0, 1), (0, 2, 0, 2, 1), (2, 0, 4, 2, 5), (7, 0, 7, 0, 1)}
    wide = {(r.top, r.left, r.bottom, r.right) for r in structure.bounds(structure.partitioned(cells, row_gap=2, col_gap=2)).collect()}
    assert wide == {(0, 0, 4, 2), (7, 0, 7, 0)}
    assert structure.bounds(structure.partitioned(cells.limit(0))).count() == 0


def test_merged_ranges(spark):
    w = Workbook(cells_of(spark, "a b\nc d"), ["S"], merges=spark.createDataFrame([(0, 0, 0, 1, 0)], "sheet_id int, top int, left int, bottom int, right int"))
    assert w.merge_at("A2") == Range(0, 0, 1, 0) and w.merge_at("B1") is None


def test_a_file_with_its_tables(spark, tmp_path):
    w = Workbook.of(spark, load("a.xlsx", packed(XLSX)))
    assert w.sheet_names == ["One", "Hid"] and w.hidden == ("Hid",) and w.cells.count() > 3
    assert {r.kind for r in w.layers.nodes.select("kind").distinct().collect()} >= {"workbook", "sheet", "region"}
    w.close()


# --- the graph ---------------------------------------------------------------------------------
def test_layers_of_the_demo(debtors):
    g = debtors.layers
    kinds = {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    assert kinds["workbook"] == 1 and kinds["sheet"] == 3 and kinds["column"] >= 12 and kinds["formula_group"] >= 8 and kinds["defined_name"] == 1
    edges = {r.kind: (r["count"], r.weight) for r in g.edges.groupBy("kind").agg(F.count("*").alias("count"), F.sum("weight").alias("weight")).collect()}
    assert edges["REFERENCES_NAME"] == (1, 1) and edges["HEADER_OF"][0] >= 7 and edges["CROSS_SHEET_REF"][1] >= 120
    assert layers.check(g).count() == 0 and debtors.audit_graph().count() == 0
    said = {(r.what, r.key): r["count"] for r in layers.report(g).collect()}
    assert said["references", "scanned"] == sum(said["references", k] for k in ("lifted", "within_source_region", "external", "dangling", "unpopulated_target"))
    assert said["formulas", "cells_outside_any_region"] == 0 and said["names", "resolved"] == 1
    pruned = layers.without_groups(g)
    assert pruned.nodes.filter("kind = 'formula_group'").count() == 0 and pruned.edges.filter("kind = 'HEADER_OF'").count() == 0 and layers.check(pruned).count() == 0
    assert [tuple(r) for r in layers.ordered(g.edges).select("src", "dst", "kind").limit(5).collect()] == sorted(tuple(r) for r in g.edges.select("src", "dst", "kind").collect())[:5]


def test_names_of_a_sheet_come_first(spark):
    cells = cells_of(spark, "1 =Rate|5 =Other!Rate|7\n5 7", "3 =Rate|7")
    w = Workbook(cells, ["One", "Other"], {"Rate": "One!$A$2", "Other!Rate": "One!$B$2"})
    out = {(r.sheet_id, r.col): (r.outcome, r.num) for r in trace.recompute(cells, w.sheet_names, w.names).collect()}
    assert out == {(0, 1): ("agrees", 5.0), (0, 2): ("agrees", 7.0), (1, 1): ("agrees", 7.0)}
    got = {(r.src, r.dst): r.weight for r in w.layers.edges.filter("kind = 'REFERENCES_NAME'").collect()}
    assert sorted(got.values()) == [1, 1, 1] and {d for _, d in got} == {"name *:RATE", "name 1:RATE"}
    lost = Workbook(cells_of(spark, "1 =Gone+Nowhere!Rate|1"), ["One"], {"Rate": "One!$A$1"})
    assert lost.layers.names.filter("target is null").count() == 2


# --- documents and search ----------------------------------------------------------------------
QUESTIONS = (
    ("what is the balance", "Balance"), ("days overdue", "Days Overdue"), ("the discount rates", "Discount Rate"), ("provision percentage", "Provision Percent"), ("impairments", "Impairment"), ("days per unit", "Days per Unit"),
)


@pytest.mark.parametrize("embed", [None, search.hashing_embedder()], ids=["words", "both"])
def test_questions_find_their_columns(debtors, embed):
    debtors.embed = embed
    total, both = 0.0, 0
    for question, want in QUESTIONS:
        hits, cover = debtors.search(question, 5, kinds=["column"])
        labels = [r.label for r in hits.collect()]
        total += 1 / (labels.index(want) + 1) if want in labels else 0
        both += cover["both_halves"]  # a question may be like no text of a hashing embedder
        assert cover["verdict"] in ("Full", "Partial")
    assert total / len(QUESTIONS) >= 0.8 and both >= (4 if embed else 0) and (embed or not both)
    assert {r.sheet for r in debtors.search("rate", 20, sheet="Rates")[0].collect()} == {"Rates"}
    assert debtors.search("what is the")[1]["verdict"] == "NoContentWords"
    debtors.embed = None


def test_an_embedder_that_fails_leaves_the_words(debtors):
    def broken(_):
        raise RuntimeError("no model")

    hits, cover = search.find(debtors.docs, "balance", embed=broken)
    assert not cover["both_halves"] and hits.count() > 0 and cover["corroborated"] == 0


def test_values_of_profiles(spark):
    w = Workbook(cells_of(spark, "Kind Size\na 1\nb 2\na 9"), ["S"], path="s.xlsx")
    box = w.layers.nodes.filter("kind = 'column'").select("sheet_id", "top", "left", "bottom", "right", "label")
    listed = F.col("label") == "Kind"
    w.profiles = box.select("sheet_id", "top", "left", "bottom", "right", F.when(listed, F.array(F.lit("a"), F.lit("b"))).alias("values"), F.when(~listed, "1").alias("min"), F.when(~listed, "9").alias("max"), listed.alias("categorical"))
    docs = {r.label: r for r in w.docs.withColumn("text", layers.embedding_text(w.docs)).filter("kind = 'column'").collect()}
    assert docs["Kind"]["values"] == ["a", "b"] and docs["Kind"].text == "column Kind in S, holding a, b"
    assert docs["Size"]["values"] == ["1", "9"] and docs["Size"].text == "column Size in S"
    assert w.search("b", kinds=["column"])[0].first().label == "Kind"


# --- scopes and large ranges -------------------------------------------------------------------
def test_scopes(debtors):
    whole = sum(r.cells for r in debtors.check().collect())
    one = sum(r.cells for r in debtors.check(sheet="summary").collect())
    some = sum(r.cells for r in debtors.check("Summary!B2:B3").collect())
    assert (whole - one, one, some) == (60 * 7 - 1, 8, 2)
    assert debtors.disagreements().count() == 0
    # a provision is typed over, and a quotient fails where a balance is 0
    assert debtors.audit_formulas().count() == 2 and debtors.audit_formulas(sheet="Debtors").count() == 7 and debtors.audit_formulas(citation="Debtors!I5").count() >= 1
    assert "typed over" in debtors.audit_text() and "Debtors!I" in debtors.audit_text()
    for bad in ({"citation": "A1", "sheet": "Rates"}, {"sheet": "Nowhere"}):
        with pytest.raises(Refused):
            debtors.check(**bad)


def test_several_large_ranges_in_one_formula(spark):
    i = F.col("id")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("txt", "string"), ("flag", "boolean"), ("err", "string"))]
    body = spark.range(5000).select(F.lit(0).alias("sheet_id"), i.cast("int").alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"), i).select("sheet_id", "row", "col", F.lit("number").alias("kind"), (F.col("id") * (F.col("col") + 1)).cast("double").alias("num"), *none, F.lit(False).alias("is_date"), F.lit(None).cast("string").alias("formula"))
    total = 4999 * 5000 / 2
    more = spark.createDataFrame([(0, 0, 3, "number", 3 * total, None, None, None, False, "SUM(A1:A5000)+SUM(B1:B5000)"), (0, 1, 3, "number", 0.0, None, None, None, False, "SUM(B1:B5000)-SUM(A1:A5000)"), (0, 2, 3, "number", 4999.0, None, None, None, False, "MAX(A1:A5000)")], structure.CELLS)
    cells = body.unionByName(more)
    out = {r.row: (r.outcome, r.num) for r in trace.recompute(cells, ["S"]).collect()}
    assert out == {0: ("agrees", 3 * total), 1: ("differs", total), 2: ("agrees", 4999.0)}
    w = Workbook(cells, ["S"])
    impact = w.what_if("A5000=0")
    assert {m["cell"][1]: m["after"] for m in impact.moved} == {0: 3 * total - 4999, 2: 4998.0} or {m["cell"][1] for m in impact.moved} == {0, 1, 2}
    assert impact.verdicts() == {"moved": 3, "unchanged": 0, "blocked": 0} and impact.stopped == "done"


def test_what_if_says_why(spark):
    w = Workbook(cells_of(spark, "1 =A1+C1|2 =B1|2 =C1+1|3 =A1*2|2"), ["S"])
    impact = w.what_if("A1=5")
    assert impact.verdicts() == {"moved": 1, "unchanged": 0, "blocked": 3} and impact.reasons() == [("circular reference", 2), ("reads a blocked cell", 1)]


def test_parts_of_what_was_asked_about(spark):
    nodes = spark.createDataFrame([("w", "workbook", 0), ("s", "sheet", 9), ("a", "region", 4), ("b", "region", 5), ("c1", "column", 1), ("c2", "column", 3), ("g", "formula_group", 7), ("x", "region", 2)], "node string, kind string, cells long")
    rows = [("w", "s", "CONTAINS", 1), ("s", "a", "CONTAINS", 1), ("s", "b", "CONTAINS", 1), ("a", "c1", "CONTAINS", 1), ("a", "c2", "CONTAINS", 1), ("a", "g", "CONTAINS", 1), ("a", "x", "CROSS_SHEET_REF", 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, weight long")
    walk = retrieve.expand(nodes, edges, ["s"], hops=1)
    assert [(e.node, e.role, e.hops, e.via) for e in walk.entries] == [("s", "seed", 0, None), ("a", "child", 0, "s"), ("w", "ancestor", 0, "s"), ("x", "input", 1, "a")]
    assert [e.node for e in retrieve.expand(nodes, edges, ["x"], hops=0, children=5).entries] == ["x"]
    listed = [e.node for e in retrieve.expand(nodes, edges, ["a"], hops=0, children=2).entries if e.role == "child"]
    assert listed == ["c2", "c1", "b"]  # columns of most cells first; of the sheet its other region, of the workbook nothing
    loop = edges.unionByName(spark.createDataFrame([("a", "w", "CONTAINS", 1)], edges.schema))
    assert {e.node for e in retrieve.expand(nodes, loop, ["a"], hops=0).entries} == {"a", "s", "w"}


def test_cells_moves_and_limits(debtors):
    assert debtors.cell("Rates!A11") == {"cite": "Rates!A11", "kind": "text", "value": "Tax Rate", "formula": None} and debtors.cell("Rates!Z90") is None
    assert debtors.cell("Debtors!G2")["formula"].startswith("VLOOKUP")
    assert Range(0, 0, 1, 1).offset(2, 3) == Range(2, 3, 3, 4) and Range(0, 0, 0, 0).offset(-1, 0) is None and Range(0, 16_383, 0, 16_383).offset(0, 1) is None
    assert limitations("xlsx") == [LIMITATIONS["styling"], LIMITATIONS["external_links"]] and len(limitations("ods")) == 5


# --- many workbooks and reports ----------------------------------------------------------------
def test_several_workbooks(spark):
    books = Workbooks({"h1": Workbook(cells_of(spark, "Name Size\na 5\nb 6"), ["S"], path="a.xlsx"), "h2": Workbook(cells_of(spark, "Name Weight\nc 5\nd 7"), ["T"], path="b.xlsx")})
    assert [(r.workbook_hash, r.path, r.cells) for r in books.workbooks().orderBy("workbook_hash").collect()] == [("h1", "a.xlsx", 6), ("h2", "b.xlsx", 6)]
    found = books.find_value("5")
    assert found == {"cells": [("h1", "S!B2"), ("h2", "T!B2")], "total": 2, "workbooks": 2}
    assert [(r.label, r.workbook_hash) for r in books.search("name", kinds=["column"]).collect()] == [("Name", "h1"), ("Name", "h2")]
    assert {r.workbook_hash for r in books.search("name", workbook="h2").collect()} == {"h2"}
    there = {"/c/a.xlsx", "/b.xlsx"}
    assert [stored_path(p, "/c", there.__contains__) for p in ("/c/a.xlsx", "/old/a.xlsx", "/old/b.xlsx", "/old/z.xlsx")] == ["/c/a.xlsx", "/c/a.xlsx", "/b.xlsx", None]


def test_reports(debtors, spark, tmp_path):
    g = debtors.layers
    audit = {r.sheet_id: r for r in reports.ingest_audit(debtors.cells).collect()}
    assert audit[0].formulas == 60 * 7 - 1 and audit[0].without_value == 0
    assert reports.column_sanity(debtors.cells, debtors.regions).filter("sheet_id = 0").count() == 0
    assert reports.shared_formula_check(debtors.cells).first().differing == 0
    assert reports.missed_headers(debtors.cells, debtors.regions).count() == 0
    assert [r["place"] for r in reports.retrieve_report(g, ["sheet 2"], hops=1).collect()][0] == 0
    ranked = reports.semantic_report(debtors.docs, ["balance"], search.hashing_embedder(), 3)
    ranks = [r["rank"] for r in ranked.orderBy("rank").collect()]
    assert ranks and ranks == list(range(1, len(ranks) + 1))
    assert reports.formula_report(debtors.docs, ["vlookup rates"]).count() > 0
    assert {r.what for r in reports.graph_report(g).select("what").distinct().collect()} >= {"nodes", "edges", "degrees", "degree bucket", "references"}
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    corpus.put("h", "demo.xlsx", cells=debtors.cells, nodes=g.nodes, edges=g.edges)
    (row,) = reports.corpus_report(corpus).collect()
    assert row["cells"] == debtors.cells.count() and row["edges"] == g.edges.count()
    assert reports.dump_cells(debtors.cells, debtors.sheet_table, 1).first()["cite"] == "Debtors!A1"


def test_lone_formulas_are_not_broadcast(spark):
    """Explosions are left out of Spark's estimates: what looks small may not fit the driver."""
    text = F.when(F.col("id") == 2, "B3*3").when(F.col("id") != 4, F.concat(F.lit("B"), (F.col("id") + 1).cast("string"), F.lit("*2")))
    cells = spark.range(6).select(F.lit(0).alias("sheet_id"), F.col("id").cast("int").alias("row"), F.lit(2).alias("col"), text.alias("formula"))
    got = reports.why_not_grouped(cells)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row, r.reason) for r in got.collect()) == [(2, "neighbours have other shapes"), (3, "neighbours have other shapes"), (5, "no formula next to it")]
