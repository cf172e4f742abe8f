"""The dependency graph: regions, columns and formula groups as nodes, cell references as edges.

References are scanned once per distinct formula, resolved by joins, and lifted to the regions
they touch; an edge's weight is its count of references. References and regions meet by sheet and
band of rows, an equality join whose smaller side Spark broadcasts only if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import references_of


def resolved(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """References with the sheets they reach: `target` (a row each for a 3-D span), or why they reach none.

    sheets: (sheet_id, name). Outcomes: cells, external, unknown."""
    names = F.broadcast(sheets.select(F.col("sheet_id").alias("id"), F.upper("name").alias("key")))
    a = names.select(F.col("id").alias("first_id"), F.col("key").alias("first_key"))
    b = names.select(F.col("id").alias("last_id"), F.col("key").alias("last_key"))
    j = refs.join(a, F.upper("sheet") == F.col("first_key"), "left").join(b, F.upper("last_sheet") == F.col("last_key"), "left")
    one = F.when(F.col("sheet").isNull(), F.col("sheet_id")).otherwise(F.col("first_id"))
    other = F.when(F.col("last_sheet").isNull(), one).otherwise(F.col("last_id"))
    outcome = F.when(F.col("book").isNotNull(), "external").when(one.isNull() | other.isNull(), "unknown").otherwise("cells")
    span = F.when(outcome == "cells", F.sequence(F.least(one, other), F.greatest(one, other)))
    return j.withColumn("outcome", outcome).withColumn("target", F.explode_outer(span)).drop("first_id", "first_key", "last_id", "last_key")


#: The least height of a band of rows, in which rectangles meet.
BAND = 16


def bands_of(regions: DataFrame) -> DataFrame:
    """(hs, high, last): the height of a sheet's bands and its last one; a row for each sheet with regions.

    It is a power of two, at least the mean height of the regions: they lie in two bands each on average at
    most, and a cell meets the regions of few rows about it, be they many and small or few and tall."""
    mean = F.avg((F.col("bottom") - F.col("top") + 1).cast("double"))
    high = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(float(BAND)), mean)))).cast("long")
    sizes = regions.groupBy(F.col("sheet_id").alias("hs")).agg(high.alias("high"), F.max("bottom").alias("last"))
    return F.broadcast(sizes.select("hs", "high", F.floor(F.col("last") / F.col("high")).alias("last")))


def boxes_of(regions: DataFrame, bands: DataFrame) -> DataFrame:
    """Regions by band of rows: rs, region, rt, rl, rb, rr, band."""
    r = regions.select(F.col("sheet_id").alias("rs"), F.col("block").alias("region"), F.col("top").alias("rt"), F.col("left").alias("rl"), F.col("bottom").alias("rb"), F.col("right").alias("rr"))
    r = r.join(bands, F.col("rs") == F.col("hs"))
    return r.withColumn("band", F.explode(F.sequence(F.floor(F.col("rt") / F.col("high")), F.floor(F.col("rb") / F.col("high"))))).drop("hs", "high", "last")


def contained(cells: DataFrame, regions: DataFrame, how: str = "left") -> DataFrame:
    """Cells with the region they are in, as rs, region, rt, rl, rb, rr: a cell meets the boxes of its band."""
    c, bands = F.col, bands_of(regions)
    own = cells.join(bands, c("sheet_id") == c("hs"), how).withColumn("own_band", F.floor(c("row") / c("high")))
    inside = (c("cell.sheet_id") == c("box.rs")) & (c("cell.own_band") == c("box.band")) & c("cell.row").between(c("box.rt"), c("box.rb")) & c("cell.col").between(c("box.rl"), c("box.rr"))
    return own.alias("cell").join(boxes_of(regions, bands).alias("box"), inside, how).select(*[f"cell.`{x}`" for x in cells.columns], *[f"box.{x}" for x in ("rs", "region", "rt", "rl", "rb", "rr")])


def touched(refs: DataFrame, regions: DataFrame, sheet: str = "target", how: str = "inner") -> DataFrame:
    """Rectangles with each region they touch; a pair meets in the first band that both have."""
    c, bands = F.col, bands_of(regions)
    first, last = F.floor(c("top") / c("high")), F.floor(c("bottom") / c("high"))
    # Below the last region there is nothing to meet; what is only there keeps its first band.
    by_band = refs.join(bands, c(sheet) == c("hs"), how).withColumn("ref_band", F.explode_outer(F.sequence(first, F.greatest(first, F.least(last, c("last"))))))
    meet = (c(f"ref.{sheet}") == c("box.rs")) & (c("ref.ref_band") == c("box.band")) & (c("box.band") == F.greatest(F.floor(c("ref.top") / c("ref.high")), F.floor(c("box.rt") / c("ref.high"))))
    over = (c("ref.top") <= c("box.rb")) & (c("box.rt") <= c("ref.bottom")) & (c("ref.left") <= c("box.rr")) & (c("box.rl") <= c("ref.right"))
    return by_band.alias("ref").join(boxes_of(regions, bands).alias("box"), meet & over, how).select(*[f"ref.`{x}`" for x in refs.columns], *[f"box.{x}" for x in ("rs", "region", "rt", "rl", "rb", "rr")])


def region_node(sheet: Column, block: Column) -> Column:
    return F.concat_ws("#", F.concat(F.lit("region "), sheet.cast("string")), block)


def sheet_node(sheet: Column) -> Column:
    return F.concat(F.lit("sheet "), sheet.cast("string"))


def sourced(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Formula cells with `source`, the node of the region that owns them, else of their sheet."""
    own = contained(cells.filter(F.col("formula").isNotNull()), regions)
    source = F.when(F.col("region").isNull(), sheet_node(F.col("sheet_id"))).otherwise(region_node(F.col("sheet_id"), F.col("region")))
    return own.withColumn("source", source).withColumn("owned", F.col("region").isNotNull()).drop("rs", "region", "rt", "rl", "rb", "rr")


def lifted(cells: DataFrame, sheets: DataFrame, regions: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, weight): edges between regions, a sheet standing in where no region owns the cell.

    A reference to the cell's own region makes no edge. kind: DEPENDS_ON on one sheet, CROSS_SHEET_REF. refs: the resolved references, if they are known."""
    refs = (resolved(references_of(cells), sheets) if refs is None else refs).filter("outcome = 'cells'").select("sheet_id", "row", "col", "target", "top", "left", "bottom", "right")
    # cells of one source with one target count once in the join with the regions
    place = refs.withColumn("formula", F.lit(""))
    by_source = sourced(place, regions).groupBy("sheet_id", "source", "target", "top", "left", "bottom", "right").agg(F.count("*").alias("n"))
    hit = touched(by_source, regions)
    kind = F.when(F.col("sheet_id") == F.col("target"), "DEPENDS_ON").otherwise("CROSS_SHEET_REF")
    edges = hit.select(F.col("source").alias("src"), region_node(F.col("target"), F.col("region")).alias("dst"), kind.alias("kind"), "n")
    return edges.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("n").alias("weight"))


def accounted(cells: DataFrame, sheets: DataFrame, regions: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Each reference (sheet_id, row, col, seq, text, sheet) with the one bucket it is in and whether it is lifted to another sheet."""
    refs = resolved(references_of(cells), sheets) if refs is None else refs
    c = F.col
    lost = refs.filter("outcome <> 'cells'").select("sheet_id", "row", "col", "seq", "text", "sheet", "book", c("outcome").alias("bucket"), F.lit(False).alias("cross"))
    hit = touched(refs.filter("outcome = 'cells'").select("sheet_id", "row", "col", "seq", "text", "sheet", "book", "target", "top", "left", "bottom", "right"), regions, how="left")
    inside = (c("sheet_id") == c("rs")) & c("row").between(c("rt"), c("rb")) & c("col").between(c("rl"), c("rr"))
    met = c("region").isNotNull()
    keys = ["sheet_id", "row", "col", "seq", "text", "sheet", "book"]
    each = hit.groupBy(*keys).agg(F.max(met & ~inside).alias("far"), F.max(met & inside).alias("near"), F.max(met & ~inside & (c("target") != c("sheet_id"))).alias("cross"))
    return each.select(*keys, F.when(c("far"), "lifted").when(c("near"), "within").otherwise("unpopulated").alias("bucket"), F.coalesce("cross", F.lit(False)).alias("cross")).unionByName(lost)


def reference_report(cells: DataFrame, sheets: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: references scanned, and the one bucket each is in: lifted, within its region, external, unknown, unpopulated."""
    counts = [F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("lifted", "within", "external", "unknown", "unpopulated")]
    return accounted(cells, sheets, regions).agg(F.count("*").alias("scanned"), *counts)


def check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(finding, node): structural faults of a graph: nodes (node, kind, sheet_id), edges (src, dst, kind, weight)."""
    n = nodes.select("node", F.col("kind").alias("node_kind"), "sheet_id")
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    contains = edges.filter("kind = 'CONTAINS'")
    parents = contains.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("parents"))
    finding = lambda df, what: df.select(F.lit(what).alias("finding"), F.col("node").cast("string").alias("node"))
    s, d = n.select(F.col("node").alias("src"), F.col("sheet_id").alias("src_sheet")), n.select(F.col("node").alias("dst"), F.col("sheet_id").alias("dst_sheet"))
    crossing = edges.join(s, "src").join(d, "dst").filter("(kind = 'DEPENDS_ON' and src_sheet <> dst_sheet) or (kind = 'CROSS_SHEET_REF' and src_sheet = dst_sheet)")
    parallel = edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).filter("n > 1")
    roots = n.filter("node_kind = 'workbook'")
    parts = [
        finding(ends.join(n, "node", "left_anti"), "edge to no node"),
        finding(parents.filter("parents > 1"), "several parents"),
        finding(n.filter("node_kind <> 'workbook'").join(parents, "node", "left_anti"), "no parent"),
        finding(edges.filter("weight < 1").select(F.col("src").alias("node")), "weight below one"),
        finding(edges.filter("src = dst").select(F.col("src").alias("node")), "loop"),
        finding(crossing.select(F.col("src").alias("node")), "sheet crossing disagrees"),
        finding(parallel.select(F.col("src").alias("node")), "parallel edges"),
        finding(roots.agg(F.count("*").alias("n")).filter("n <> 1").select(F.col("n").alias("node")), "not one root"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(src, dst, kind, expected, actual, finding): edges that two derivations disagree on; a full outer join."""
    e, a = expected.select("src", "dst", "kind", F.col("weight").alias("expected")), actual.select("src", "dst", "kind", F.col("weight").alias("actual"))
    j = e.join(a, ["src", "dst", "kind"], "full_outer")
    finding = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("actual") != F.col("expected"), "weight")
    return j.withColumn("finding", finding).filter("finding is not null")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, neighbors, bucket): the bucket is a power of two."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count_distinct("other").alias("neighbors"))
    return d.withColumn("bucket", F.floor(F.log2((F.col("out_degree") + F.col("in_degree")).cast("double"))).cast("int"))


def lifting_ratio(edges: DataFrame) -> DataFrame:
    dependent = F.col("kind").isin("DEPENDS_ON", "CROSS_SHEET_REF")
    return edges.filter(dependent).agg(F.sum("weight").alias("references"), F.count("*").alias("edges"), F.try_divide(F.sum("weight").cast("double"), F.count("*").cast("double")).alias("ratio"))


def reachable(edges: DataFrame, seeds: DataFrame, hops: int | None = None, limit: int = 1000, cut=None) -> DataFrame:
    """(node, hops) from the seeds (node): a level a round, each an anti-join with what is known.

    `cut` keeps a level (a checkpoint on a cluster); without it levels are cached."""
    edges = edges.select("src", "dst").distinct().persist()  # every level reads them
    known = seeds.select("node", F.lit(0).alias("hops")).distinct()
    level = 0
    while hops is None or level < hops:
        frontier = known.filter(F.col("hops") == level).select(F.col("node").alias("src"))
        fresh = edges.join(frontier, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        known = known.unionByName(fresh.select("node", F.lit(level + 1).alias("hops")))
        known = cut(known) if cut else known.persist()
        level += 1
        if hops is None and (known.filter(F.col("hops") == level).isEmpty() or level >= limit):
            break
    if cut:
        edges.unpersist()  # no kept level reads them again
    return known


def fit(query: DataFrame, regions: DataFrame) -> DataFrame:
    """Each query rectangle (q, sheet_id, top, left, bottom, right) with the best fitting region: exact, inside, overlaps, none."""
    c = F.col
    j = touched(query, regions, "sheet_id", "left")
    exact = (c("top") == c("rt")) & (c("left") == c("rl")) & (c("bottom") == c("rb")) & (c("right") == c("rr"))
    inside = (c("top") >= c("rt")) & (c("left") >= c("rl")) & (c("bottom") <= c("rb")) & (c("right") <= c("rr"))
    place = F.when(c("rs").isNull(), 3).when(exact, 0).when(inside, 1).otherwise(2)
    best = j.withColumn("place", place).groupBy("q").agg(F.min(F.struct("place", "rt", "rl", "region")).alias("best"))
    return best.select("q", F.element_at(F.array(*[F.lit(x) for x in ("exact", "inside", "overlaps", "none")]), c("best.place") + 1).alias("fit"), c("best.region").alias("region"))


def edge_weight_filter(edges: DataFrame, least: int) -> Column:
    return F.col("weight") >= least
