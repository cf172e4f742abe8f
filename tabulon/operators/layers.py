"""The whole graph of a workbook: every layer of nodes, every kind of edge, its report and its invariants.

Nodes: workbook, sheet, region, column, formula_group, defined_name, external_workbook. Edges: CONTAINS
and HEADER_OF are structure; DEPENDS_ON, CROSS_SHEET_REF, CROSS_WORKBOOK_REF and REFERENCES_NAME are
references lifted to the regions that own the cells, with their count as weight. A node's id tells its
place, so that ids need no numbering over the whole table.

sheets: (sheet_id, name, visible); regions: what structure.regions returns; names: (name, refers_to, scope).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.address import a1_column
from tabulon.functions.text import formula_cells, names_column, references_of
from tabulon.operators import graph, structure
from tabulon.operators.graph import contained, region_node, sheet_node, sourced

# Kinds of nodes and of edges.
NODES = ("workbook", "sheet", "region", "column", "formula_group", "defined_name", "external_workbook")
EDGES = ("CONTAINS", "HEADER_OF", "DEPENDS_ON", "CROSS_SHEET_REF", "CROSS_WORKBOOK_REF", "REFERENCES_NAME")
EXAMPLES = 32
ROOT = "workbook"

union = lambda parts: reduce(DataFrame.unionByName, parts)


@dataclass
class Graph:
    nodes: DataFrame  # node, kind, parent, sheet_id, top, left, bottom, right, label, detail, title, cells
    edges: DataFrame  # src, dst, kind, weight
    references: DataFrame  # of graph.accounted
    names: DataFrame  # source, name, target: what each name of a formula resolves to, or null
    formulas: DataFrame  # sheet_id, row, col, formula, source, owned
    groups: DataFrame  # formula groups with the region that owns their first cell

    def keep(self, cut) -> Graph:
        """The same tables after `cut` (a checkpoint, a table written and read again), so that plans over them are short."""
        return Graph(*[cut(getattr(self, x)) for x in ("nodes", "edges", "references", "names", "formulas", "groups")])


def _node(kind: str, node: Column, parent: Column | None, sheet: Column | None = None, box: tuple | None = None, label: Column | None = None, detail: Column | None = None, title: Column | None = None, cells: Column | None = None) -> list[Column]:
    c = lambda v, t: (F.lit(None) if v is None else v).cast(t)
    place = [c(b, "int").alias(n) for b, n in zip(box or (None,) * 4, ("top", "left", "bottom", "right"), strict=True)]
    return [node.alias("node"), F.lit(kind).alias("kind"), c(parent, "string").alias("parent"), c(sheet, "int").alias("sheet_id"), *place, c(label, "string").alias("label"), c(detail, "string").alias("detail"), c(title, "string").alias("title"), F.coalesce(c(cells, "long"), F.lit(0).cast("long")).alias("cells")]


def column_boxes(regions: DataFrame) -> DataFrame:
    """(sheet_id, block, col, header, top, bottom): a row for each non-empty header of a region that has a body, labels first."""
    r = structure.bodies(regions)
    heads = F.concat(F.transform("label_headers", lambda h, i: F.struct(h.alias("header"), (F.col("left") + i).cast("int").alias("col"))), F.transform("headers", lambda h, i: F.struct(h.alias("header"), (F.col("body_left") + i).cast("int").alias("col"))))
    out = r.select("sheet_id", "block", "title", "right", F.col("body_top").alias("top"), F.col("body_bottom").alias("bottom"), F.explode(heads).alias("h"))
    return out.select("sheet_id", "block", "title", "h.col", "h.header", "top", "bottom").filter(F.col("header") != "").filter("col <= right")


def column_node(sheet: Column, block: Column, col: Column) -> Column:
    return F.concat(F.lit("column "), sheet.cast("string"), F.lit("#"), block, F.lit(":"), col.cast("string"))


def group_node(sheet: Column) -> Column:
    return F.concat(F.lit("group "), F.concat_ws(":", sheet.cast("string"), *[F.col(x).cast("string") for x in ("top", "left", "bottom", "right")]))


def name_node(scope: Column, key: Column) -> Column:
    return F.concat(F.lit("name "), F.coalesce(scope.cast("string"), F.lit("*")), F.lit(":"), key)


def build(cells: DataFrame, sheets: DataFrame, regions: DataFrame, names: DataFrame | None = None, path: str = "", groups: bool = True, format: str = "", cut=None) -> Graph:
    """All layers of one workbook; without `groups` no formula groups. `cut` (a table written and read again) keeps what is read from formulas, so that each is scanned once."""
    spark, c = cells.sparkSession, F.col
    populated = cells.filter("kind <> 'empty' or formula is not null")
    of_sheet = populated.groupBy("sheet_id").agg(F.count("*").alias("cells"))
    nodes = [spark.range(1).select(*_node(ROOT, F.lit(ROOT), None, label=F.lit(path), detail=F.lit(format)))]
    nodes.append(sheets.join(of_sheet, "sheet_id", "left").select(*_node("sheet", sheet_node(c("sheet_id")), F.lit(ROOT), c("sheet_id"), label=c("name"), detail=F.when(c("visible"), "").otherwise("hidden"), cells=c("cells"))))
    box = (c("top"), c("left"), c("bottom"), c("right"))
    a1 = F.concat_ws(":", a1_column(c("top"), c("left")), F.when((c("top") != c("bottom")) | (c("left") != c("right")), a1_column(c("bottom"), c("right"))))
    nodes.append(regions.select(*_node("region", region_node(c("sheet_id"), c("block")), sheet_node(c("sheet_id")), c("sheet_id"), box, F.coalesce("title", a1), c("kind"), c("title"), c("cells"))))
    columns = column_boxes(regions)
    column = column_node(c("sheet_id"), c("block"), c("col"))
    nodes.append(columns.select(*_node("column", column, region_node(c("sheet_id"), c("block")), c("sheet_id"), (c("top"), c("col"), c("bottom"), c("col")), c("header"), title=c("title"), cells=c("bottom") - c("top") + 1)))
    names = spark.createDataFrame([], "name string, refers_to string, scope int") if names is None else names
    names = names.withColumn("key", F.upper("name")).withColumn("node", name_node(c("scope"), c("key")))
    nodes.append(names.select(*_node("defined_name", c("node"), F.lit(ROOT), c("scope"), label=c("name"), detail=c("refers_to"))))

    formulas = sourced(cells, regions).select("sheet_id", "row", "col", "formula", "source", "owned")
    cut = cut or (lambda df: df)
    refs = cut(graph.resolved(references_of(cells), sheets))
    references = graph.accounted(cells, sheets, regions, refs)
    external = references.filter("bucket = 'external'").join(formulas.select("sheet_id", "row", "col", "source"), ["sheet_id", "row", "col"])
    book = F.concat(F.lit("book "), c("book"))
    nodes.append(external.select("book").distinct().select(*_node("external_workbook", book, F.lit(ROOT), label=c("book"))))
    resolved_names = cut(names_of(formulas, sheets, names))
    edges = [graph.lifted(cells, sheets, regions, refs)]
    edges.append(external.groupBy(c("source").alias("src"), book.alias("dst")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("CROSS_WORKBOOK_REF")))
    edges.append(resolved_names.filter("target is not null").groupBy(c("source").alias("src"), c("target").alias("dst")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("REFERENCES_NAME")))

    found = structure.groups(formula_cells(cells)) if groups else None
    if found is not None:
        first = found.select(c("top").alias("row"), c("left").alias("col"), *found.columns)
        found = contained(first, regions).select(*found.columns, c("region").alias("block"), ((c("bottom") > c("rb")) | (c("right") > c("rr"))).alias("spans"), c("region").isNull().alias("outside"))
        parent = F.when(c("block").isNull(), sheet_node(c("sheet_id"))).otherwise(region_node(c("sheet_id"), c("block")))
        titled = found.join(regions.select("sheet_id", "block", "title"), ["sheet_id", "block"], "left")
        nodes.append(titled.select(*_node("formula_group", group_node(c("sheet_id")), parent, c("sheet_id"), box, c("formula"), c("shape"), c("title"), c("cells"))))
        over = found.alias("g").join(columns.alias("k"), (c("g.sheet_id") == c("k.sheet_id")) & (c("g.block") == c("k.block")) & c("k.col").between(c("g.left"), c("g.right")))
        over = over.select(column_node(c("k.sheet_id"), c("k.block"), c("k.col")).alias("src"), *[c(f"g.{x}").alias(x) for x in ("sheet_id", "top", "left", "bottom", "right")])
        edges.append(over.select("src", group_node(c("sheet_id")).alias("dst"), F.lit("HEADER_OF").alias("kind"), F.lit(1).cast("long").alias("weight")))
    else:
        found = spark.createDataFrame([], "sheet_id int, spans boolean, outside boolean")
    nodes = union(nodes)
    inside = nodes.filter("parent is not null").select(c("parent").alias("src"), c("node").alias("dst"), F.lit("CONTAINS").alias("kind"), F.lit(1).cast("long").alias("weight"))
    return Graph(nodes, union([inside, *edges]), references, resolved_names, formulas, found)


def names_of(formulas: DataFrame, sheets: DataFrame, names: DataFrame) -> DataFrame:
    """(sheet_id, row, col, source, name, target): each name of each formula: that of its sheet (or the sheet it names) before that of the workbook."""
    c = F.col
    found = formulas.select("sheet_id", "row", "col", "source", F.explode(names_column("formula")).alias("name"))
    bang = F.locate("!", c("name"))
    on = F.when(bang > 0, F.upper(F.regexp_replace(F.regexp_replace(F.substring_index("name", "!", 1), "^'|'$", ""), "''", "'")))
    found = found.select("*", on.alias("on"), F.upper(F.substring_index("name", "!", -1)).alias("key"))
    known = sheets.select(c("sheet_id").alias("on_id"), F.upper("name").alias("on_key"))
    found = found.join(known, c("on") == c("on_key"), "left")
    scope = F.when(c("on").isNull(), c("sheet_id")).otherwise(c("on_id"))
    lost = c("on").isNotNull() & c("on_id").isNull()
    own = names.filter("scope is not null").select(c("key").alias("own_key"), c("scope").alias("own_scope"), c("node").alias("own"))
    whole = names.filter("scope is null").select(c("key").alias("all_key"), c("node").alias("all"))
    j = found.withColumn("scope", scope).join(own, (c("key") == c("own_key")) & (c("scope") == c("own_scope")), "left").join(whole, c("key") == c("all_key"), "left")
    return j.select("sheet_id", "row", "col", "source", "name", F.when(~lost, F.coalesce("own", "all")).alias("target"))


def without_groups(g: Graph) -> Graph:
    """The same graph without its layer of formula groups."""
    gone = g.nodes.filter("kind = 'formula_group'").select("node")
    edges = g.edges.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return Graph(g.nodes.filter("kind <> 'formula_group'"), edges.select("src", "dst", "kind", "weight"), g.references, g.names, g.formulas, g.groups.limit(0))


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", "kind")


def report(g: Graph) -> DataFrame:
    """(what, key, count): nodes and edges by kind, weights by kind, the ten reference and name counters, unknown sheets."""
    row = lambda df, what, key, count="count": df.select(F.lit(what).alias("what"), key.alias("key"), F.col(count).cast("long").alias("count"))
    counts = lambda df, **tests: df.agg(*[F.count(F.when(F.expr(t), 1)).alias(n) for n, t in tests.items()])

    def stacked(one: DataFrame, what: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("count")) for c in one.columns])
        return one.select(F.explode(pairs).alias("x")).select(F.lit(what).alias("what"), "x.key", F.col("x.count").cast("long").alias("count"))

    by_kind = g.edges.groupBy("kind").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))
    return union([
        row(g.nodes.groupBy("kind").count(), "nodes", F.col("kind")),
        row(by_kind, "edges", F.col("kind")),
        row(by_kind, "weight", F.col("kind"), "weight"),
        stacked(counts(g.references, scanned="true", lifted="bucket = 'lifted'", within_source_region="bucket = 'within'", cross_sheet="cross", external="bucket = 'external'", dangling="bucket = 'unknown'", unpopulated_target="bucket = 'unpopulated'"), "references"),
        stacked(counts(g.names, resolved="target is not null", not_defined="target is null"), "names"),
        stacked(counts(g.formulas, cells_outside_any_region="not owned"), "formulas"),
        stacked(counts(g.groups, outside_any_region="outside", spanning_regions="spans"), "groups"),
        row(g.references.filter("bucket = 'unknown'").groupBy("sheet").count(), "unknown sheet", F.coalesce("sheet", F.lit(""))),
    ])


def dangling(g: Graph, limit: int = EXAMPLES) -> DataFrame:
    """The first references that reach nothing, in the order of their cells."""
    return g.references.filter("bucket in ('unknown', 'unpopulated')").orderBy("sheet_id", "row", "col", "seq").select("sheet_id", "row", "col", "text", F.when(F.col("bucket") == "unknown", "unknown sheet").otherwise("unpopulated target").alias("reason")).limit(limit)


# The invariants of a graph.
INVARIANTS = (
    "one workbook root", "root belongs to the graph", "every node reachable from the root", "one CONTAINS parent per contained node", "every edge stands for at least one reference",
    "same-sheet edges stay on one sheet", "CROSS_SHEET_REF actually crosses a sheet", "every formula cell falls in a region", "every reference is accounted for",
    "lifted weight equals the references behind it", "every lifted reference carries at least one edge",
)


def check(g: Graph) -> DataFrame:
    """(invariant, violations): every invariant that is broken, with how often. One row of counts from each table."""
    c, e = F.col, g.edges
    n = g.nodes.select("node", c("kind").alias("node_kind"), "sheet_id")
    ends = lambda side: n.select(c("node").alias(side), c("node_kind").alias(side + "_kind"), c("sheet_id").alias(side + "_sheet"))
    count = lambda test, name: F.count(F.when(test if not isinstance(test, str) else F.expr(test), 1)).alias(name)
    contains = e.filter("kind = 'CONTAINS'")
    # A node is three steps from the root at most: sheet, region, column or group. A contained node's parents are counted with it.
    step = lambda at: contains.select(c("src").alias("node"), "dst").join(at, "node", "left_semi").select(c("dst").alias("node")).distinct()
    one = step(n.filter(c("node") == ROOT).select("node"))
    two = step(one)
    reached = union([one, two, step(two)]).distinct().withColumn("reached", F.lit(True))
    parents = contains.groupBy(c("dst").alias("node")).agg(F.count("*").alias("parents"))
    placed = n.join(reached, "node", "left").join(parents, "node", "left").agg(
        F.abs(count(f"node_kind = '{ROOT}'", "x") - 1).alias("i0"),
        F.when(count(c("node") == ROOT, "x") > 0, 0).otherwise(1).alias("i1"),
        count((c("node") != ROOT) & c("reached").isNull(), "i2"),
        count(c("node_kind").isin("region", "column", "formula_group") & (F.coalesce("parents", F.lit(0)) != 1), "i3"),
    )
    one_sheet = "kind in ('DEPENDS_ON', 'HEADER_OF') or (kind = 'CONTAINS' and src_kind = 'region' and dst_kind in ('column', 'formula_group'))"
    same = "src_sheet <=> dst_sheet"
    weight = [F.coalesce(F.sum(F.when(c("kind") == k, c("weight"))), F.lit(0)).alias(k) for k in EDGES[2:]]
    lines = e.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left").agg(count("weight < 1", "i4"), count(f"({one_sheet}) and not ({same})", "i5"), count(f"kind = 'CROSS_SHEET_REF' and {same}", "i6"), *weight)
    formulas = g.formulas.agg(count("not owned", "i7"))
    refs = g.references.agg(count("bucket is null", "i8"), count("bucket = 'lifted'", "lifted"), count("cross", "crossing"), count("bucket = 'external'", "external"))
    off = lambda test: F.when(F.expr(test), 1).otherwise(0)
    row = placed.crossJoin(lines).crossJoin(formulas).crossJoin(refs).crossJoin(g.names.agg(F.count("target").alias("resolved")))  # one row each
    row = row.withColumn("i9", off("CROSS_WORKBOOK_REF <> external") + off("REFERENCES_NAME <> resolved")).withColumn("i10", off("DEPENDS_ON + CROSS_SHEET_REF < lifted") + off("CROSS_SHEET_REF < crossing"))
    found = F.array(*[F.struct(F.lit(x).alias("invariant"), c(f"i{i}").cast("long").alias("violations")) for i, x in enumerate(INVARIANTS)])
    return row.select(F.explode(found).alias("x")).select("x.invariant", "x.violations").filter("violations > 0")


def audit(cells: DataFrame, g: Graph) -> DataFrame:
    """(finding, src, dst, kind, expected, actual): the references of cells read again, lifted by the nodes of the graph alone, against its edges.

    Findings: missing edge, unaccounted edge, weight disagrees, parallel edges, ambiguous containment (a formula cell in several regions)."""
    c = F.col
    sheets = g.nodes.filter("kind = 'sheet'").select("sheet_id", c("label").alias("name"))
    boxes = g.nodes.filter("kind = 'region'").select("sheet_id", F.substring_index("node", "#", -1).alias("block"), "top", "left", "bottom", "right")
    expected = graph.lifted(cells, sheets, boxes)
    actual = g.edges.filter("kind in ('DEPENDS_ON', 'CROSS_SHEET_REF')").groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    found = graph.audit(expected, actual)
    named = F.when(c("finding") == "missing", "missing edge").when(c("finding") == "unexpected", "unaccounted edge").otherwise("weight disagrees")
    none = F.lit(None).cast("long")
    parts = [
        found.select(named.alias("finding"), "src", "dst", "kind", "expected", "actual"),
        actual.filter("n > 1").select(F.lit("parallel edges").alias("finding"), "src", "dst", "kind", none.alias("expected"), c("n").alias("actual")),
    ]
    owners = contained(cells.filter(c("formula").isNotNull()), boxes, "inner").groupBy("sheet_id", "row", "col").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.concat_ws(":", *[c(x).cast("string") for x in ("sheet_id", "row", "col")])
    parts.append(owners.select(F.lit("ambiguous containment").alias("finding"), place.alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("kind"), F.lit(1).cast("long").alias("expected"), c("n").alias("actual")))
    return union(parts)


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The nodes with the most neighbours, ties to the smaller node."""
    return graph.degrees(edges).orderBy(F.desc("neighbors"), "node").limit(k)


def degree_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes with edges, the largest in- and out-degrees."""
    d = graph.degrees(edges)
    return d.agg(F.count("*").alias("nodes"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in"), F.coalesce(F.max("neighbors"), F.lit(0)).alias("max_neighbors"))


# --- documents ---------------------------------------------------------------------------------
EMBEDDED = 12


def documents(g: Graph, profiles: DataFrame | None = None, path: str = "") -> DataFrame:
    """(doc, kind, sheet, label, context, body, values, categorical, cells, path): a document for every node.

    profiles: (sheet_id, top, left, bottom, right, values, min, max, categorical) of columns, matched by range. A column's
    values are those that its profile kept, else the least and the greatest number."""
    c = F.col
    sheets = g.nodes.filter("kind = 'sheet'").select(c("sheet_id").alias("s"), c("label").alias("sheet"))
    heads = g.nodes.filter("kind = 'column'").groupBy(c("parent").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "label"))), lambda x: x["label"]), " ").alias("heads"))
    d = g.nodes.join(sheets, c("sheet_id") == c("s"), "left").join(heads, "node", "left")
    own_title = F.when(c("kind").isin("column", "formula_group"), c("title"))
    body = F.when(c("kind") == "region", F.concat_ws(" ", "detail", "heads")).otherwise(F.coalesce("detail", F.lit("")))
    if profiles is None:
        d = d.withColumn("values", F.array().cast("array<string>")).withColumn("categorical", F.lit(False))
    else:
        box = ["sheet_id", "top", "left", "bottom", "right"]
        p = profiles.select(*box, F.lit("column").alias("kind"), F.when(c("values").isNotNull(), c("values")).when(c("min").isNotNull(), F.array("min", "max")).otherwise(F.array().cast("array<string>")).alias("values"), "categorical")
        d = d.join(p, [*box, "kind"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>"))).withColumn("categorical", F.coalesce("categorical", F.lit(False)))
    return d.select(c("node").alias("doc"), "kind", "sheet", F.coalesce("label", F.lit("")).alias("label"), F.concat_ws(" ", "sheet", own_title).alias("context"), body.alias("body"), "values", "categorical", "cells", F.lit(path).alias("path"))


def embeddable(docs: DataFrame) -> DataFrame:
    """All but formula groups: their texts are formulas."""
    return docs.filter("kind <> 'formula_group'")


def embedding_text(docs: DataFrame) -> Column:
    """kind, label, context, body and the first values of a categorical column, as a sentence."""
    c = F.col
    held = F.when(c("categorical") & (F.size("values") > 0), F.concat(F.lit(", holding "), F.array_join(F.slice("values", 1, EMBEDDED), ", ")))
    some = lambda lead, x: F.when(c(x) != "", F.concat(F.lit(lead), c(x)))
    return F.concat(c("kind"), F.lit(" "), c("label"), F.coalesce(some(" in ", "context"), F.lit("")), F.coalesce(some(": ", "body"), F.lit("")), F.coalesce(held, F.lit("")))
