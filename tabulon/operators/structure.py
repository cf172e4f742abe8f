"""Structure that a sheet never declares: formula groups, exceptions, column audits, regions.

`cells` is (sheet_id, row, col, kind, num, txt, flag, err, formula); a `shape` column comes from
functions.text.formula_cells. Runs and groups are gaps-and-islands windows keyed by (sheet, column,
shape), so they spread over the cluster by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import TOTALS, formula_cells
from tabulon.operators.graph import contained
from tabulon.plans.keep import kept

W = Window


def runs(shaped: DataFrame) -> DataFrame:
    """(sheet_id, col, shape, top, bottom, cells, formula): consecutive rows of one shape in a column."""
    by = W.partitionBy("sheet_id", "col", "shape").orderBy("row")
    island = shaped.withColumn("island", F.col("row") - F.row_number().over(by))
    return island.groupBy("sheet_id", "col", "shape", "island").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.count("*").alias("cells"), F.min_by("formula", "row").alias("formula")).drop("island")


def groups(shaped: DataFrame) -> DataFrame:
    """Rectangles of one shape: runs of equal height side by side are one group."""
    by = W.partitionBy("sheet_id", "shape", "top", "bottom").orderBy("col")
    r = runs(shaped).withColumn("island", F.col("col") - F.row_number().over(by))
    return r.groupBy("sheet_id", "shape", "top", "bottom", "island").agg(F.min("col").alias("left"), F.max("col").alias("right"), F.sum("cells").alias("cells"), F.min_by("formula", "col").alias("formula")).drop("island")


def grouping_stats(g: DataFrame) -> DataFrame:
    return g.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("formula_cells"), F.count("*").alias("groups"), F.count(F.when(F.col("cells") == 1, 1)).alias("singletons"), F.coalesce(F.max("cells"), F.lit(0)).alias("largest"), F.try_divide(F.sum("cells").cast("double"), F.count("*").cast("double")).alias("compression"))


def exceptions(shaped: DataFrame) -> DataFrame:
    """(sheet_id, row, col, what, expected, found): an edited cell between two of one shape, or a missing one."""
    by = W.partitionBy("sheet_id", "col").orderBy("row")
    near = shaped.select("sheet_id", "row", "col", "shape", F.lag("row").over(by).alias("up"), F.lag("shape").over(by).alias("above"), F.lead("row").over(by).alias("down"), F.lead("shape").over(by).alias("below"))
    edited = near.filter("up = row - 1 and down = row + 1 and above = below and shape <> above").select("sheet_id", "row", "col", F.lit("edited").alias("what"), F.col("above").alias("expected"), F.col("shape").alias("found"))
    missing = near.filter("down = row + 2 and shape = below").select("sheet_id", (F.col("row") + 1).alias("row"), "col", F.lit("missing").alias("what"), F.col("shape").alias("expected"), F.lit(None).cast("string").alias("found"))
    return edited.unionByName(missing)


def column_audit(cells: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row a column of a body that is mostly formulas: its fill, deviants, typed-over cells, errors, totals.

    bodies: (body, sheet_id, top, left, bottom, right). A column needs two formulas and more of them
    than typed values. The fill is the shape of more than half of the formulas."""
    inside = contained(cells, bodies.withColumn("block", F.col("body")), "inner")
    inside = inside.select(F.col("region").alias("body"), F.col("rb").alias("last_row"), *cells.columns)
    shaped = formula_cells(inside)
    shapes = shaped.groupBy("body", "col", "shape").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"), F.min_by("formula", "row").alias("formula"))
    sums = shapes.groupBy("body", "col").agg(F.sum("n").alias("formulas"), F.count("*").alias("shapes"), F.max(F.struct(F.col("n"), (-F.col("first")).alias("order"), F.col("shape"), F.col("first"), F.col("last"), F.col("formula"))).alias("most"))
    total = F.col("formula").rlike(rf"(?i)^\s*(?:{'|'.join(TOTALS)})\s*\(")
    plain = inside.filter(F.col("formula").isNull() & (F.col("kind") != "empty"))
    foot = (F.col("row") == F.col("last_row")) & (F.col("kind") == "text")
    typed = plain.groupBy("body", "col").agg(F.count(F.when(~foot, 1)).alias("typed"), F.count(F.when(foot, 1)).alias("foot"))
    audited = sums.join(typed, ["body", "col"], "left").fillna(0, ["typed", "foot"]).filter("formulas >= 2 and formulas > typed")
    fill = F.when(F.col("most.n") * 2 > F.col("formulas"), F.col("most"))
    audited = audited.withColumn("fill", fill)
    other = shaped.join(audited.select("body", "col", F.col("fill.shape").alias("fill_shape")).filter("fill_shape is not null"), ["body", "col"]).filter("shape <> fill_shape")
    last = (F.col("row") == F.col("last_row")) & total
    deviants = other.groupBy("body", "col").agg(F.count(F.when(~last, 1)).alias("deviants"), F.count(F.when(last, 1)).alias("totals"))
    failed = shaped.filter("kind = 'error'").groupBy("body", "col").agg(F.count("*").alias("errors"))
    out = audited.join(deviants, ["body", "col"], "left").join(failed, ["body", "col"], "left").fillna(0, ["deviants", "totals", "errors"])
    return out.select("body", "col", "formulas", "shapes", F.col("fill.formula").alias("fill"), F.col("fill.n").alias("fill_cells"), F.col("fill.first").alias("fill_top"), F.col("fill.last").alias("fill_bottom"), "deviants", "typed", "errors", (F.col("foot") + F.col("totals")).alias("totals_row"), ((F.col("deviants") > 0) | (F.col("typed") > 0) | (F.col("errors") > 0)).alias("broken"))


# --- regions -----------------------------------------------------------------------------------
DEPTH = 12
SAMPLE, SCANNED, HEADERS, AGREE = 64, 256, 3, 0.5


PLACE = ["sheet_id", "row", "col"]


def _islands(df: DataFrame, by: list[str], axis: str, gap: int) -> DataFrame:
    """A column `island` that grows where `axis` jumps by more than `gap`."""
    w = W.partitionBy(*by).orderBy(axis)
    jump = (F.col(axis) - F.lag(axis).over(w) > gap).cast("int")
    return df.withColumn("jump", F.coalesce(jump, F.lit(0))).withColumn("island", F.sum("jump").over(w)).drop("jump")


def _blocks(top, left, bottom, right, row_gap: int, col_gap: int):
    """The number of each rectangle's block: blank lines cut rows and columns in turn, DEPTH times at most."""
    import numpy as np

    lines = ((top, bottom, row_gap), (left, right, col_gap))
    label, count = np.zeros(len(top), np.int64), 0
    work = [(np.arange(len(top)), 0, 0)]
    while work:
        own, depth, stalled = work.pop()
        low, high, gap = lines[depth % 2]
        if depth == DEPTH or stalled == 2:
            label[own] = count
            count += 1
            continue
        own = own[np.argsort(low[own], kind="stable")]
        reach = np.maximum.accumulate(high[own])
        cuts = np.flatnonzero(low[own][1:] - reach[:-1] > gap) + 1
        work += [(part, depth + 1, 0 if len(cuts) else stalled + 1) for part in np.split(own, cuts)]
    return label


def partitioned(cells: DataFrame, row_gap: int = 1, col_gap: int = 1, cut=None, declared: DataFrame | None = None) -> DataFrame:
    """Populated cells with the id of the block that blank rows and columns, in turn, cut out.

    No cut goes through a run of cells in a row, nor through equal runs in successive rows, so the cuts see
    one rectangle for each of those: a full table is one row of their data. A sheet's rectangles (five
    numbers each, and never more than its cells) are cut in one task. Cells of declared tables (sheet_id, name, top, left, bottom, right) are left out, and blocks are cut clear of them."""
    cells = cells.filter("kind <> 'empty' or formula is not null").select(*PLACE)
    if declared is not None:
        tables = declared.withColumn("block", F.col("name"))
        cells = contained(cells, tables).filter("region is null").select(*PLACE)
    in_run = _islands(cells, ["sheet_id", "row"], "col", col_gap).withColumn("left", F.min("col").over(W.partitionBy("sheet_id", "row", "island"))).drop("island")
    runs_ = in_run.groupBy("sheet_id", "row", "left").agg(F.max("col").alias("right"))
    runs_ = _islands(runs_, ["sheet_id", "left", "right"], "row", row_gap)
    runs_ = cut(runs_) if cut else runs_
    key = ["sheet_id", "left", "right", "island"]
    items = runs_.groupBy(*key).agg(F.min("row").alias("top"), F.max("row").alias("bottom"))

    def cut_up(pdf):
        label = _blocks(*(pdf[x].to_numpy() for x in ("top", "left", "bottom", "right")), row_gap, col_gap)
        return pdf[key].assign(block=label.astype(str))

    items = items.groupBy("sheet_id").applyInPandas(cut_up, "sheet_id int, left int, right int, island long, block string")
    rows = runs_.join(items.select(*key, "block"), key).select("sheet_id", "row", "left", "block")
    blocks = in_run.join(rows, ["sheet_id", "row", "left"]).select(*PLACE, "block")
    return blocks if declared is None else _clear(blocks, declared, cut or kept)


def _clear(blocks: DataFrame, declared: DataFrame, cut) -> DataFrame:
    """Blocks whose bounds meet a declared table are cut at its edges, by rows and by columns in turn."""
    c = F.col
    tables = declared.select(c("sheet_id").alias("s"), *[c(x).alias("t_" + x) for x in ("name", "top", "left", "bottom", "right")])
    blocks, stalled, axis = cut(blocks), 0, "row"
    while stalled < 2:
        meets = (c("sheet_id") == c("s")) & (c("t_top") <= c("bottom")) & (c("t_bottom") >= c("top")) & (c("t_left") <= c("right")) & (c("t_right") >= c("left"))
        clash = bounds(blocks).join(tables, meets).groupBy("sheet_id", "block").agg(F.min(F.struct("t_top", "t_left", "t_bottom", "t_right")).alias("t"))
        low, high = ("t_top", "t_bottom") if axis == "row" else ("t_left", "t_right")
        side = F.when(c(axis) < c("t")[low], 0).when(c(axis) <= c("t")[high], 1).otherwise(2)
        cut_up = blocks.join(clash, ["sheet_id", "block"], "left").withColumn("side", F.when(c("t").isNotNull(), side)).drop("t")
        cut_up = cut(cut_up)
        sides = cut_up.filter("side is not null").groupBy("sheet_id", "block").agg(F.count_distinct("side").alias("n")).agg(F.count("*").alias("clashes"), F.max("n").alias("n")).first()
        if not sides["clashes"]:
            break
        stalled = 0 if sides["n"] > 1 else stalled + 1
        blocks = cut_up.select(*PLACE, F.concat_ws("/", "block", c("side").cast("string")).alias("block"))
        axis = "col" if axis == "row" else "row"
    return blocks


def bounds(blocks: DataFrame) -> DataFrame:
    """(sheet_id, block, top, left, bottom, right, cells) of each block."""
    return blocks.groupBy("sheet_id", "block").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count("*").alias("cells"))


DESCRIBED = "sheet_id int, block string, top int, left int, bottom int, right int, cells long, kind string, title string, header_rows int, header_cols int, headers array<string>, label_headers array<string>"


def dominant(kinds: list[str]) -> str | None:
    """The most frequent kind of a bounded sample; of equal counts the later in the list of kinds."""
    order = ("empty", "number", "text", "bool", "error")
    seen = [k for k in kinds[:SCANNED] if k != "empty"][:SAMPLE]
    return max(order, key=lambda k: (seen.count(k), order.index(k))) if seen else None


def described(key: tuple, rows) -> list[tuple]:
    """One region from the cells of its first rows: title, headers, row labels, kind."""
    sheet, block, top, left, bottom, right, cells, texts = key
    grid = {(r, c): (k, s) for r, c, k, s in zip(rows["row"], rows["col"], rows["kind"], rows["shown"], strict=True)}
    kind = lambda r, c: grid.get((r, c), ("empty", ""))[0]
    title = None
    if bottom > top and right > left:
        first = [grid[top, c] for c in range(left, right + 1) if kind(top, c) != "empty"]
        title = first[0][1] if len(first) == 1 and first[0][0] == "text" and first[0][1].strip() else None
    start = top + (title is not None)
    column = lambda c, r: dominant([kind(x, c) for x in range(r, min(bottom, r + SCANNED - 1) + 1)])
    headers = 0
    while headers < min(HEADERS, bottom - start) and start + headers + 1 <= bottom:
        line = start + headers
        bodies = [(c, b) for c in range(left, right + 1) if (b := column(c, line + 1))]
        if not bodies or sum(kind(line, c) == "text" and b != "text" for c, b in bodies) / len(bodies) < AGREE:
            break
        headers += 1
    labels = 0
    if right > left and start + headers <= bottom and column(left, start + headers) == "text":
        others = [b for c in range(left + 1, right + 1) if (b := column(c, start + headers))]
        labels = int(bool(others) and sum(b != "text" for b in others) / len(others) >= 0.5)

    def names(first: int, last: int) -> list[str]:
        return [".".join(dict.fromkeys(s for r in range(start, start + headers) if (s := grid.get((r, c), ("", ""))[1]))) for c in range(first, last + 1)]

    height, width = bottom - top + 1, right - left + 1
    what = "table" if headers and height - (title is not None) >= 2 and width >= 2 else "note" if (height <= 1 or width == 1 and height <= 3) and texts * 2 > cells else "block"
    return [(sheet, block, top, left, bottom, right, cells, what, title, headers, labels, names(left + labels, right) if headers else [], names(left, left + labels - 1) if headers and labels else [])]


def regions(cells: DataFrame, row_gap: int = 1, col_gap: int = 1, cut=None, declared: DataFrame | None = None) -> DataFrame:
    """Regions of each sheet with what their first rows say; a region's task gets those rows alone.

    Declared tables (sheet_id, name, top, left, bottom, right, headers, header_rows, totals_rows) are regions as they stand."""
    import pandas as pd

    from tabulon.values import display_number

    blocks = partitioned(cells, row_gap, col_gap, cut, declared)
    boxes = bounds(blocks)
    owned = blocks.join(cells, ["sheet_id", "row", "col"])
    texts = owned.groupBy("sheet_id", "block").agg(F.count(F.when(F.col("kind") == "text", 1)).alias("texts"))
    boxes = boxes.join(texts, ["sheet_id", "block"])
    shown = F.coalesce("txt", display_number("num"), F.upper(F.col("flag").cast("string")), "err", F.lit(""))
    head = owned.join(boxes, ["sheet_id", "block"]).filter(F.col("row") < F.col("top") + SCANNED + HEADERS + 2).withColumn("shown", shown)
    keys = ["sheet_id", "block", "top", "left", "bottom", "right", "cells", "texts"]

    def run(key, pdf):
        return pd.DataFrame(described(key, pdf), columns=[x.split()[0] for x in DESCRIBED.split(", ")])

    found = head.groupBy(*keys).applyInPandas(run, DESCRIBED).withColumn("declared", F.lit(False)).withColumn("totals_rows", F.lit(0))
    if declared is None:
        return found
    known = declared.withColumn("block", F.concat(F.lit("table "), F.col("name")))
    held = contained(cells.filter("kind <> 'empty' or formula is not null"), known, "inner").groupBy(F.col("rs").alias("sheet_id"), F.col("region").alias("block")).agg(F.count("*").alias("cells"))
    stated = known.join(held, ["sheet_id", "block"], "left").select("sheet_id", "block", "top", "left", "bottom", "right", F.coalesce("cells", F.lit(0)).alias("cells"), F.lit("table").alias("kind"), F.col("name").alias("title"), "header_rows", F.lit(0).alias("header_cols"), "headers", F.array().cast("array<string>").alias("label_headers"), F.lit(True).alias("declared"), "totals_rows")
    return found.unionByName(stated)


def bodies(regions_: DataFrame) -> DataFrame:
    """Regions with their body: below titles and headers, right of labels, above totals; without one, no row. A declared title costs no row."""
    title = F.when(F.col("title").isNotNull() & ~F.col("declared"), 1).otherwise(0)
    top = (F.col("top") + title + F.col("header_rows")).cast("int")
    out = regions_.withColumn("body_top", top).withColumn("body_left", F.col("left") + F.col("header_cols")).withColumn("body_bottom", F.col("bottom") - F.col("totals_rows"))
    return out.filter("body_top <= body_bottom and body_left <= right")


def density(regions_: DataFrame) -> DataFrame:
    """Regions with the share of their area that is populated."""
    area = (F.col("bottom") - F.col("top") + 1).cast("double") * (F.col("right") - F.col("left") + 1)
    return regions_.withColumn("density", F.col("cells") / area)


def merge_at(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the merged range (sheet_id, top, left, bottom, right) that covers them, as merge_top .. merge_right, or nulls."""
    out = contained(cells, merges.withColumn("block", F.lit("")))
    return out.select(*cells.columns, F.col("rt").alias("merge_top"), F.col("rl").alias("merge_left"), F.col("rb").alias("merge_bottom"), F.col("rr").alias("merge_right"))


def formula_list(cells: DataFrame) -> DataFrame:
    """Formula cells, column by column."""
    return cells.filter(F.col("formula").isNotNull()).orderBy("sheet_id", "col", "row")


def owner(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with the region they are in (regions of a sheet never overlap)."""
    return contained(cells, boxes).withColumnRenamed("region", "block").drop("rs", "rt", "rl", "rb", "rr")


def kind_counts(c: Column) -> list[Column]:
    return [F.count(F.when(c == k, 1)).alias(k) for k in ("number", "text", "bool", "error")]


CELLS = T.StructType([T.StructField("sheet_id", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("txt", T.StringType()), T.StructField("flag", T.BooleanType()), T.StructField("err", T.StringType()), T.StructField("is_date", T.BooleanType()), T.StructField("formula", T.StringType())])
