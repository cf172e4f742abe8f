"""The fifteen tools over one workbook, with strict arguments."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.address import MAX_COL, MAX_ROW, Range, cite, parse_a1
from tabulon.functions.evaluate import Err, Value
from tabulon.functions.text import formula_cells, references_of
from tabulon.operators import graph, layers, retrieve, search, structure, trace
from tabulon.operators.profile import profile, tally
from tabulon.operators.query import Query, Refused, Table, groups_not_listed, query, scan_counts
from tabulon.plans.keep import kept
from tabulon.sources.tables import cells_in, pivoted, used_range
from tabulon.values import ERRORS, display


def literal(text: str) -> Value:
    """A typed value from words: a number, TRUE, FALSE, an error code, quoted or plain text, nothing."""
    t = text.strip()
    if not t:
        return None
    if t.upper() in ("TRUE", "FALSE"):
        return t.upper() == "TRUE"
    if t.upper() in ERRORS:
        return Err(t.upper())
    if re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z", t):
        return float(t)
    return t[1:-1].replace('""', '"') if len(t) > 1 and t[0] == t[-1] == '"' else t


def assignment(text: str) -> tuple[str, Value]:
    """`Sheet!A1=value`, split at the first `=` outside a quoted sheet name."""
    m = re.match(r"((?:'(?:[^']|'')*'|[^=])*)=(.*)\Z", text, re.S)
    if not m:
        raise Refused("BadAssignment", text)
    return m[1].strip(), literal(m[2])


class Workbook:
    """cells, the sheets' names in tab order, and defined names; what else is needed is derived once. `close` lets go of the cells.

    A name of one sheet is given as `Sheet!Name`. declared: tables that the file states (sheet_id, name, top, left,
    bottom, right, headers, header_rows, totals_rows); merges: (sheet_id, top, left, bottom, right); embed: a function of
    a text column that gives vectors, for the semantic half of search."""

    def __init__(self, cells: DataFrame, sheets: list[str], names: dict[str, str] | None = None, path: str = "", hidden: tuple[str, ...] = (), declared: DataFrame | None = None, merges: DataFrame | None = None, embed=None, profiles: DataFrame | None = None):
        self.cells, self.sheet_names, self.names, self.path, self.hidden = cells.persist(), sheets, names or {}, path, hidden
        self.declared, self.merges, self.embed, self.profiles = declared, merges, embed, profiles
        self.spark = cells.sparkSession

    @classmethod
    def of(cls, spark, loaded, embed=None) -> Workbook:
        """The workbook of a file that was read: its cells, names, declared tables and merges."""
        rows = [(c[2], *c[5:]) for c in loaded.cells]
        cells = spark.createDataFrame(rows, structure.CELLS)
        sheets = [n for n, _ in loaded.sheets]
        names = {(n if scope is None else f"{sheets[scope]}!{n}"): text for n, text, scope in loaded.names}
        tables = [(i, n, r.top, r.left, r.bottom, r.right, heads, 1, 0) for i, n, r, heads in loaded.tables]
        declared = spark.createDataFrame(tables, "sheet_id int, name string, top int, left int, bottom int, right int, headers array<string>, header_rows int, totals_rows int") if tables else None
        merged = [(i, r.top, r.left, r.bottom, r.right) for i, r in loaded.merges]
        merges = spark.createDataFrame(merged, "sheet_id int, top int, left int, bottom int, right int") if merged else None
        return cls(cells, sheets, names, loaded.path, tuple(n for n, visible in loaded.sheets if not visible), declared, merges, embed)

    def _keep(self, df: DataFrame) -> DataFrame:
        """Derived tables are checkpointed: what builds on them starts from their rows."""
        return kept(df)

    def close(self) -> None:
        """Let go of what is cached."""
        self.cells.unpersist()

    @cached_property
    def sheet_table(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n, n not in self.hidden) for i, n in enumerate(self.sheet_names)], "sheet_id int, name string, visible boolean")

    @cached_property
    def shaped(self) -> DataFrame:
        return self._keep(formula_cells(self.cells))

    @cached_property
    def refs(self) -> DataFrame:
        return self._keep(graph.resolved(references_of(self.cells), self.sheet_table))

    @cached_property
    def regions(self) -> DataFrame:
        return self._keep(structure.regions(self.cells, declared=self.declared))

    @cached_property
    def region_rows(self) -> list:
        return self.regions.orderBy("sheet_id", "top", "left").collect()

    def locate(self, citation: str, gate: bool = False) -> tuple[int, Range]:
        """A defined name, or A1 with a sheet (optional if there is one sheet); a gated range must touch a region."""
        text = next((v for k, v in self.names.items() if k.upper() == citation.strip().upper()), citation)
        got = parse_a1(text)
        if got is None:
            raise Refused("BadReference", citation)
        sheet, where = got
        if sheet is None and len(self.sheet_names) > 1:
            raise Refused("NoSheet", citation)
        ids = [i for i, n in enumerate(self.sheet_names) if sheet is None or n.upper() == sheet.upper()]
        if not ids:
            raise Refused("UnknownSheet", f"{sheet}; there are {', '.join(self.sheet_names)}")
        if where.top == 0 and where.bottom == MAX_ROW or where.left == 0 and where.right == MAX_COL:
            raise Refused("WholeAxis", citation)
        if gate and where.cells > 1 and not any(r.sheet_id == ids[0] and where.intersects(Range(r.top, r.left, r.bottom, r.right)) for r in self.region_rows):
            raise Refused("NoRegion", citation)
        return ids[0], where

    # --- the tools ---
    def workbooks(self) -> DataFrame:
        return self.cells.agg(F.lit(self.path).alias("path"), F.lit(len(self.sheet_names)).alias("sheets"), F.count("*").alias("cells"), F.count("formula").alias("formulas"))

    def sheets(self) -> DataFrame:
        used = used_range(self.cells)
        return self.sheet_table.join(used, "sheet_id", "left").fillna(0, ["cells"]).orderBy("sheet_id")

    def tables(self) -> DataFrame:
        return self.regions.orderBy("sheet_id", "top", "left")

    def cell(self, citation: str) -> dict | None:
        """One cell as it is cited: kind, value as shown, formula; None if it is blank."""
        sheet, where = self.locate(citation)
        if where.cells > 1:
            raise Refused("RangeAsCell", citation)
        r = cells_in(self.cells, sheet, where.top, where.left, where.top, where.left).first()
        return r and {"cite": cite(self.sheet_names[sheet], where), "kind": r.kind, "value": display(trace.value_of(r.kind, r.num, r.txt, r.flag, r.err)), "formula": r.formula}

    def read_cells(self, citation: str, limit: int = 200) -> DataFrame:
        sheet, where = self.locate(citation)
        return cells_in(self.cells, sheet, where.top, where.left, where.bottom, where.right, limit)

    def precedents(self, citation: str) -> DataFrame:
        sheet, where = self.locate(citation)
        return trace.precedents(self.refs, sheet, where.top, where.left)

    def dependents(self, citation: str) -> DataFrame:
        sheet, where = self.locate(citation, gate=True)
        return trace.readers(self.shaped, self.refs, sheet, where)

    def graph(self, citation: str, depth: int = 2, limit: int = 200, direction: str = "both") -> DataFrame:
        """(node, hops): cells and ranges around a place; ranges end a walk."""
        if direction not in ("precedents", "dependents", "both"):
            raise Refused("BadDirection", direction)
        sheet, where = self.locate(citation, gate=True)
        place = lambda s, r, c: F.concat_ws(":", s.cast("string"), r.cast("string"), c.cast("string"))
        c = F.col
        one = (c("top") == c("bottom")) & (c("left") == c("right"))
        to = F.when(one, place(c("target"), c("top"), c("left"))).otherwise(F.concat_ws(":", c("target").cast("string"), c("text")))
        reads = self.refs.filter("outcome = 'cells'").select(place(c("sheet_id"), c("row"), c("col")).alias("src"), to.alias("dst"))
        both = {"precedents": reads, "dependents": reads.select(c("dst").alias("src"), c("src").alias("dst"))}
        edges = both.get(direction) if direction in both else both["precedents"].unionByName(both["dependents"])
        seeds = self.spark.createDataFrame([(f"{sheet}:{r}:{k}",) for r in range(where.top, where.bottom + 1) for k in range(where.left, where.right + 1)][:limit], "node string")
        return graph.reachable(edges, seeds, depth).orderBy("hops", "node").limit(limit)

    def find_value(self, value: str | float | bool, limit: int = 50) -> dict:
        probe = literal(value) if isinstance(value, str) else value
        found = trace.find_value(self.cells, probe)
        rows = found.limit(limit).collect()
        return {"cells": [cite(self.sheet_names[r.sheet_id], Range(r.row, r.col, r.row, r.col)) for r in rows], "total": found.count(), "other_kind": trace.other_kind(self.cells, probe).first()[0]}

    def recompute(self, citation: str) -> DataFrame:
        sheet, where = self.locate(citation)
        only = self.cells.filter((F.col("sheet_id") == sheet) & F.col("row").between(where.top, where.bottom) & F.col("col").between(where.left, where.right)).select("sheet_id", "row", "col")
        return trace.recompute(self.cells, self.sheet_names, self.names, only)

    def scope(self, citation: str | None = None, sheet: str | None = None) -> tuple[int | None, Range | None]:
        """The whole workbook, one sheet, or a range; not a sheet and a range at once."""
        if citation is not None and sheet is not None:
            raise Refused("RangeAndSheet", f"{citation}, {sheet}")
        if citation is not None:
            return self.locate(citation)
        if sheet is None:
            return None, None
        ids = [i for i, n in enumerate(self.sheet_names) if n.upper() == sheet.upper()]
        if not ids:
            raise Refused("UnknownSheet", f"{sheet}; there are {', '.join(self.sheet_names)}")
        return ids[0], None

    def _checked(self, citation: str | None, sheet: str | None) -> DataFrame:
        where = self.scope(citation, sheet)
        only = None if where == (None, None) else trace.in_scope(self.cells, *where)
        return trace.recompute(self.cells, self.sheet_names, self.names, only)

    def check(self, citation: str | None = None, sheet: str | None = None) -> DataFrame:
        return trace.check_report(self._checked(citation, sheet))

    def disagreements(self, citation: str | None = None, sheet: str | None = None, limit: int = 50) -> DataFrame:
        return trace.disagreements(self._checked(citation, sheet), self.cells, limit)

    def merge_at(self, citation: str) -> Range | None:
        """The merged range that covers a cell."""
        sheet, where = self.locate(citation)
        if self.merges is None:
            return None
        r = self.merges.filter((F.col("sheet_id") == sheet) & (F.col("top") <= where.top) & (F.col("bottom") >= where.top) & (F.col("left") <= where.left) & (F.col("right") >= where.left)).first()
        return Range(r.top, r.left, r.bottom, r.right) if r else None

    def what_if(self, *changes: str, **options) -> trace.Impact:
        at: dict = {}
        for text in changes:
            place, value = assignment(text)
            sheet, where = self.locate(place)
            if where.cells > 1:
                raise Refused("RangeAsCell", place)
            at[sheet, where.top, where.left] = value
        return trace.what_if(self.cells, self.refs, self.sheet_names, at, self.names, **options)

    def audit_formulas(self, broken_only: bool | None = None, citation: str | None = None, sheet: str | None = None) -> DataFrame:
        """Columns of formulas in the scope; of a whole workbook only the broken ones, unless asked otherwise."""
        at, where = self.scope(citation, sheet)
        r = structure.bodies(self.regions)
        if at is not None:
            r = r.filter(F.col("sheet_id") == at)
        if where is not None:
            r = r.filter((F.col("body_top") <= where.bottom) & (F.col("body_bottom") >= where.top) & (F.col("left") <= where.right) & (F.col("right") >= where.left))
        bodies = r.select(F.concat_ws("#", F.col("sheet_id").cast("string"), "block").alias("body"), "sheet_id", F.col("body_top").alias("top"), "left", F.col("body_bottom").alias("bottom"), "right")
        out = structure.column_audit(self.cells, bodies)
        return out.filter("broken") if (at is None if broken_only is None else broken_only) else out

    def audit_text(self, **scope) -> str:
        """The audit as lines: what a column is filled with and what is not like it."""
        columns = {(f"{r.sheet_id}#{r.block}"): (r.sheet_id, r.top, r.bottom) for r in self.region_rows}
        lines = []
        for r in self.audit_formulas(**scope).orderBy("body", "col").collect():
            sheet, top, bottom = columns[r.body]
            where = cite(self.sheet_names[sheet], Range(top, r.col, bottom, r.col))
            found = [f"{n} {what}" for n, what in ((r.deviants, "other formulas"), (r.typed, "typed over"), (r.errors, "errors"), (r.totals_row, "in the totals row")) if n]
            lines.append(f"{where}: {r.formulas} formulas, {r.shapes} shapes" + (f", filled with ={r.fill} ({r.fill_cells})" if r.fill else ", no fill") + ("; " + ", ".join(found) if found else ""))
        return "\n".join(lines) or "No column of formulas is broken."

    def table(self, citation: str) -> Table:
        """The table that a range or a cell of it names, typed and in row order."""
        sheet, where = self.locate(citation)
        found = [r for r in self.region_rows if r.sheet_id == sheet and where.intersects(Range(r.top, r.left, r.bottom, r.right)) and r.header_rows]
        if len(found) != 1:
            raise Refused("NoTable" if not found else "SeveralTables", citation)
        r = found[0]
        top = r.top + (r.title is not None) + r.header_rows
        heads = [*r.label_headers, *r.headers]
        twice = {h for h in heads if heads.count(h) > 1}
        columns = {r.left + i: (f"{h} {i}" if h in twice or not h else h) for i, h in enumerate(heads)}
        rows = pivoted(self.cells.filter(F.col("sheet_id") == sheet), top, r.bottom, columns)
        labels = tuple(columns[r.left + i] for i in range(len(r.label_headers)))
        return Table(rows, cite(self.sheet_names[sheet], Range(top, r.left, r.bottom, r.right)), labels, "row")

    def query_table(self, citation: str, q: Query) -> DataFrame:
        return query(self.table(citation), q)

    def answer(self, citation: str, q: Query) -> dict:
        """Groups with what they stand on: the range, row counts, groups a limit left out; on no match, the values there are."""
        t = self.table(citation)
        out = {"groups": query(t, q), "over": t.name} | scan_counts(t, q.filters).first().asDict()
        if q.limit is not None:
            out["groups_not_listed"] = groups_not_listed(t, q).first()[0]
        if not out["rows_matched"] and q.filters:
            columns = list(dict.fromkeys(t.resolve(f.column) for f in q.filters))
            kept = profile(Table(t.df.select(*columns))).select("name", "values").collect()
            out["unmatched"] = {r["name"]: [v["value"] for v in r["values"]] if r["values"] is not None else None for r in kept}
        return out

    def schema_hint(self, citation: str) -> DataFrame:
        """Lookups whose keys are in the table: columns that name rows of another one."""
        sheet, where = self.locate(citation)
        inside = (F.col("key_left") >= where.left) & (F.col("key_left") <= where.right) & (F.col("key_top") <= where.bottom) & (F.col("key_bottom") >= where.top)
        return self.schema().filter((F.col("sheet_id") == sheet) & inside & ~F.col("approximate"))

    def table_columns(self, citation: str) -> DataFrame:
        return tally(self.table(citation))

    def schema(self) -> DataFrame:
        return trace.infer_schema(self.shaped)

    # --- search ---
    @cached_property
    def layers(self) -> layers.Graph:
        """The whole graph: nodes of every layer and edges of every kind."""
        scoped = [(k.rpartition("!")[2], v, next((i for i, n in enumerate(self.sheet_names) if "!" in k and n.upper() == k.rpartition("!")[0].upper()), None)) for k, v in self.names.items()]
        names = self.spark.createDataFrame(scoped, "name string, refers_to string, scope int") if scoped else None
        return layers.build(self.cells, self.sheet_table, self.regions, names, self.path, format=self.path.rpartition(".")[2]).keep(self._keep)

    @cached_property
    def graph_tables(self) -> tuple[DataFrame, DataFrame]:
        return self.layers.nodes.select("node", "kind", "sheet_id"), self.layers.edges

    def build_report(self) -> DataFrame:
        return layers.report(self.layers)

    def check_graph(self) -> DataFrame:
        return layers.check(self.layers)

    def audit_graph(self) -> DataFrame:
        return layers.audit(self.cells, self.layers)

    @cached_property
    def docs(self) -> DataFrame:
        """One document a node."""
        return self._keep(layers.documents(self.layers, self.profiles, self.path))

    def search(self, question: str, k: int = 10, kinds: list[str] | None = None, sheet: str | None = None) -> tuple[DataFrame, dict]:
        return search.find(self.docs, question, k, self.embed, kinds=kinds, sheet=sheet)

    def context(self, question: str, **options) -> dict:
        """A cited passage around the best hits."""
        hits, cover = self.search(question, 3)
        nodes, edges = self.layers.nodes.select("node", "kind", "cells"), self.layers.edges
        walk = retrieve.expand(nodes, edges, [r.doc for r in hits.collect()], **options)
        near = [e.node for e in walk.entries]  # the walk's budget bounds them
        placed = self.layers.nodes.filter(F.col("node").isin(near)).select("node", "sheet_id", "top", "left", "bottom", "right", "label").collect()
        cites = {r.node: cite(self.sheet_names[r.sheet_id], Range(r.top, r.left, r.bottom, r.right)) for r in placed if r.top is not None}
        labels = {r.node: r.label for r in placed} | {"workbook": self.path or "workbook"}
        return retrieve.render(walk, labels, cites, self.path or "workbook") | {"coverage": cover}


TOOLS = ("workbooks", "sheets", "search", "context", "read_cells", "precedents", "dependents", "graph", "find_value", "recompute", "what_if", "audit_formulas", "tables", "query_table", "schema")


class Workbooks:
    """Several workbooks at once, by their content hash."""

    def __init__(self, books: dict[str, Workbook]):
        self.books = books

    def workbooks(self) -> DataFrame:
        """A row a workbook: hash, path, sheets, cells, formulas."""
        parts = [b.workbooks().select(F.lit(h).alias("workbook_hash"), "*") for h, b in sorted(self.books.items())]
        return layers.union(parts)

    def cells(self) -> DataFrame:
        return layers.union([b.cells.select(F.lit(h).alias("workbook_hash"), *[f.name for f in structure.CELLS]) for h, b in sorted(self.books.items())])

    def find_value(self, value: str | float | bool, limit: int = 50) -> dict:
        """Where a value stands in any of them: one scan over all cells."""
        probe = literal(value) if isinstance(value, str) else value
        found = self.cells().filter(trace.holds(self.cells(), probe))
        rows = found.orderBy("workbook_hash", "sheet_id", "row", "col").limit(limit).collect()
        at = [(r.workbook_hash, cite(self.books[r.workbook_hash].sheet_names[r.sheet_id], Range(r.row, r.col, r.row, r.col))) for r in rows]
        return {"cells": at, "total": found.count(), "workbooks": found.select("workbook_hash").distinct().count()}

    def search(self, question: str, k: int = 10, **options) -> DataFrame:
        """Hits of all workbooks, best first; ties by label, node and workbook."""
        docs = layers.union([b.docs.withColumn("workbook_hash", F.lit(h)) for h, b in sorted(self.books.items())])
        docs = docs.withColumn("node", F.col("doc")).withColumn("doc", F.concat_ws("/", "workbook_hash", "doc"))
        hits, _ = search.find(docs, question, k, **options)
        return hits.orderBy(F.desc("score"), "label", "node", "workbook_hash")


def stored_path(path: str, corpus: str, exists) -> str | None:
    """Where a workbook's file is now: its own path, else a file of that name beside the corpus, else in the folder above it."""
    name, home = path.rsplit("/", 1)[-1], corpus.rstrip("/")
    above = home.rpartition("/")[0]
    return next((p for p in (path, f"{home}/{name}", f"{above}/{name}") if exists(p)), None)
