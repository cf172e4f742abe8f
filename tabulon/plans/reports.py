"""Diagnostic reports over one workbook's tables: each is a DataFrame that says where something looks wrong.

cells, regions and references are as in operators/; every report is one plan, ordered where it lists examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.address import a1_column, cite_column
from tabulon.functions.text import formula_cells
from tabulon.operators import graph, layers, retrieve, search, structure
from tabulon.operators.graph import contained, touched
from tabulon.values import display_number

shown = lambda: F.coalesce("txt", display_number("num"), F.upper(F.col("flag").cast("string")), "err", F.lit(""))


# --- ingestion ---------------------------------------------------------------------------------
def dump_cells(cells: DataFrame, sheets: DataFrame, limit: int | None = None) -> DataFrame:
    """(cite, kind, value, formula) of every cell, in sheet and row order."""
    c = F.col
    out = cells.join(sheets.select("sheet_id", "name"), "sheet_id").orderBy("sheet_id", "row", "col")
    out = out.select(cite_column(c("name"), c("row"), c("col"), c("row"), c("col")).alias("cite"), "kind", shown().alias("value"), "formula")
    return out if limit is None else out.limit(limit)


def raw_cells(cells: DataFrame) -> DataFrame:
    """What was stored of each cell, untouched: a row for every field that is set."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("raw")) for n in ("num", "txt", "flag", "err", "formula")])
    return cells.select("sheet_id", "row", "col", "kind", F.explode(F.filter(fields, lambda x: x["raw"].isNotNull())).alias("f")).select("sheet_id", "row", "col", "kind", "f.field", "f.raw")


def ingest_audit(cells: DataFrame) -> DataFrame:
    """A row a sheet: cells by kind, formulas, dates, formulas without a stored value, errors that no formula made."""
    n = lambda test: F.count(F.when(F.expr(test), 1))
    kinds = [n(f"kind = '{k}'").alias(k) for k in ("number", "text", "bool", "error", "empty")]
    return cells.groupBy("sheet_id").agg(F.count("*").alias("cells"), *kinds, n("formula is not null").alias("formulas"), n("is_date").alias("dates"), n("formula is not null and kind = 'empty'").alias("without_value"), n("kind = 'error' and formula is null").alias("typed_errors"))


def column_sanity(cells: DataFrame, regions: DataFrame, share: float = 0.9) -> DataFrame:
    """Columns of region bodies that hold more than one kind of value, none of them `share` of the cells."""
    columns = layers.column_boxes(regions).select("sheet_id", F.concat_ws(":", "block", F.col("col").cast("string")).alias("block"), "header", "top", F.col("col").alias("left"), "bottom", F.col("col").alias("right"))
    inside = contained(cells.filter("kind <> 'empty'"), columns, "inner")
    kinds = inside.groupBy("sheet_id", "region", "kind").agg(F.count("*").alias("n"))
    of = kinds.groupBy("sheet_id", F.col("region").alias("block")).agg(F.sum("n").alias("cells"), F.count("*").alias("kinds"), F.max(F.struct("n", "kind")).alias("most"))
    mixed = of.filter((F.col("kinds") > 1) & (F.col("most.n") < share * F.col("cells")))
    return mixed.join(columns.select("sheet_id", "block", "header"), ["sheet_id", "block"]).select("sheet_id", "block", "header", "cells", "kinds", F.col("most.kind").alias("most"), F.col("most.n").alias("of_it"))


def shared_formula_check(cells: DataFrame) -> DataFrame:
    """One row: runs of one shape, their cells, and runs whose last cell has another shape than the first when both are worked out anew."""
    shaped = formula_cells(cells)
    runs = structure.runs(shaped)
    ends = shaped.select("sheet_id", "col", F.col("row").alias("bottom"), F.col("shape").alias("last_shape"))
    return runs.join(ends, ["sheet_id", "col", "bottom"]).agg(F.count("*").alias("runs"), F.sum("cells").alias("cells"), F.count(F.when(F.col("shape") != F.col("last_shape"), 1)).alias("differing"))


def shared_group_check(cells: DataFrame) -> DataFrame:
    """One row: formula cells, the cells that groups cover, and groups whose rectangle is not full."""
    shaped = formula_cells(cells)
    area = (F.col("bottom") - F.col("top") + 1).cast("long") * (F.col("right") - F.col("left") + 1)
    g = structure.groups(shaped).agg(F.count("*").alias("groups"), F.coalesce(F.sum("cells"), F.lit(0)).alias("covered"), F.count(F.when(area != F.col("cells"), 1)).alias("not_full"))
    return shaped.agg(F.count("*").alias("formulas")).crossJoin(g)  # one row each


NEEDS_QUOTES = r"[^\p{L}\p{N}_.]|^[0-9]|^[A-Za-z]{1,3}[0-9]+$"


def unquoted_sheets(references: DataFrame) -> DataFrame:
    """(sheet, count): sheets that references name without the quotes that the name needs. references: with text and sheet."""
    bare = F.col("sheet").isNotNull() & ~F.col("text").startswith("'")
    return references.filter(bare & F.col("sheet").rlike(NEEDS_QUOTES)).groupBy("sheet").count().orderBy(F.desc("count"), "sheet")


# --- structure ---------------------------------------------------------------------------------
def check_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(finding, sheet_id, count): populated cells in no region or in several, regions that overlap."""
    populated = cells.filter("kind <> 'empty' or formula is not null").select("sheet_id", "row", "col")
    owners = contained(populated, regions).groupBy("sheet_id", "row", "col").agg(F.count("region").alias("n"))
    pairs = touched(regions.select("sheet_id", F.col("block").alias("own"), "top", "left", "bottom", "right"), regions, "sheet_id").filter("own < region")
    row = lambda df, what: df.groupBy("sheet_id").count().select(F.lit(what).alias("finding"), "sheet_id", "count")
    return layers.union([row(owners.filter("n = 0"), "cell in no region"), row(owners.filter("n > 1"), "cell in several regions"), row(pairs, "overlapping regions")])


def missed_headers(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions without headers whose first row is all text over a row that is not."""
    plain = regions.filter("header_rows = 0 and bottom > top and right > left")
    rows = contained(cells.filter("kind <> 'empty'"), plain, "inner").filter("row <= rt + 1")
    by_row = rows.groupBy("sheet_id", "region", "rt").agg(*[F.count(F.when(F.expr(t), 1)).alias(n) for n, t in (("first", "row = rt"), ("first_text", "row = rt and kind = 'text'"), ("second_other", "row = rt + 1 and kind <> 'text'"))])
    return by_row.filter("first > 1 and first = first_text and second_other > 0").select("sheet_id", F.col("region").alias("block"), F.col("rt").alias("top"), "first", "second_other")


def why_not_grouped(cells: DataFrame) -> DataFrame:
    """Formula cells alone in their group, with the shapes above and below: why nothing joins them."""
    shaped = formula_cells(cells)
    w = Window.partitionBy("sheet_id", "col").orderBy("row")
    near = shaped.select("*", *[f("shape").over(w).alias(n) for n, f in (("above", F.lag), ("below", F.lead))], *[f("row").over(w).alias(n) for n, f in (("up", F.lag), ("down", F.lead))])
    single = structure.groups(shaped).filter("cells = 1").select("sheet_id", F.col("top").alias("row"), F.col("left").alias("col"))
    next_to = (F.col("up") == F.col("row") - 1) | (F.col("down") == F.col("row") + 1)
    reason = F.when(~F.coalesce(next_to, F.lit(False)), "no formula next to it").otherwise("neighbours have other shapes")
    # Cells exploded from a table's rows are many times what Spark takes them for, so neither side is left to be broadcast.
    return near.join(single.hint("merge"), ["sheet_id", "row", "col"]).select("sheet_id", "row", "col", "formula", "shape", "above", "below", reason.alias("reason"))


# --- the graph ---------------------------------------------------------------------------------
def why_unpopulated(g: layers.Graph) -> DataFrame:
    """(text, count, first row): what references that land in no region name, the most frequent first."""
    lost = g.references.filter("bucket = 'unpopulated'")
    return lost.groupBy("sheet_id", "text").agg(F.count("*").alias("count"), F.min("row").alias("first_row")).orderBy(F.desc("count"), "sheet_id", "text")


def corpus_report(corpus) -> DataFrame:
    """The manifest with the rows that each stored layer has for a workbook."""
    entries = corpus.entries()
    counts = None
    for name in ("cells", "regions", "nodes", "edges", "groups", "docs", "vectors"):
        if corpus._exists(name):
            rows = corpus.get(name).groupBy("workbook_hash").agg(F.count("*").alias(name))
            counts = rows if counts is None else counts.join(rows, "workbook_hash", "full_outer")
    return (entries if counts is None else entries.join(counts, "workbook_hash", "left")).orderBy("path", "workbook_hash")


# --- search ------------------------------------------------------------------------------------
def lexical_report(docs: DataFrame, questions: list[str], k: int = 10) -> DataFrame:
    """(question, rank, doc, label, score) of the lexical half."""
    return _ranked([(q, search.lexical(docs, q, k)) for q in questions])


def semantic_report(docs: DataFrame, questions: list[str], embed, k: int = 10) -> DataFrame:
    """(question, rank, doc, label, score) of the vectors alone."""
    return _ranked([(q, search.semantic(docs, q, embed, k).join(docs, "doc")) for q in questions])


def formula_report(docs: DataFrame, questions: list[str], k: int = 10) -> DataFrame:
    """(question, rank, doc, label, score) among formula groups alone."""
    return lexical_report(search.filtered(docs, ["formula_group"]), questions, k)


def _ranked(hits: list[tuple[str, DataFrame]]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc"))
    return layers.union([h.select(F.lit(q).alias("question"), "doc", "label", "score") for q, h in hits]).select("question", rank.alias("rank"), "doc", "label", "score")


def retrieve_report(g: layers.Graph, seeds: list[str], **options) -> DataFrame:
    """(place, node, role, hops, via) of the walk from some seeds, in the order in which it came to them."""
    walk = retrieve.expand(g.nodes.select("node", "kind", "cells"), g.edges, seeds, **options)
    rows = [(i, e.node, e.role, e.hops, e.via) for i, e in enumerate(walk.entries)]
    return g.nodes.sparkSession.createDataFrame(rows, "place int, node string, role string, hops int, via string").orderBy("place")


def trace_report(shaped: DataFrame, references: DataFrame) -> DataFrame:
    """(sheet_id, target, cells, groups): how many formula cells read each sheet, and in how many groups they stand."""
    reading = references.filter("outcome = 'cells'").select("sheet_id", "row", "col", "target").distinct()
    g = structure.groups(shaped).select("sheet_id", "top", "left", "bottom", "right").withColumn("block", a1_column(F.col("top"), F.col("left")))
    owned = contained(reading, g, "inner")
    return owned.groupBy("sheet_id", "target").agg(F.count("*").alias("cells"), F.count_distinct("region").alias("groups"))


def graph_report(g: layers.Graph) -> DataFrame:
    """Counts of nodes, edges and references, degrees and their largest, as (what, key, count)."""
    d = layers.degree_summary(g.edges)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("count")) for c in d.columns])
    buckets = graph.degrees(g.edges).groupBy("bucket").count()
    return layers.union([layers.report(g), d.select(F.explode(pairs).alias("x")).select(F.lit("degrees").alias("what"), "x.key", "x.count"), buckets.select(F.lit("degree bucket").alias("what"), F.col("bucket").cast("string").alias("key"), "count")])
