"""Rectangles meet in bands whose height follows the regions: against brute force."""

import random

from tabulon.operators import graph

BOX = "sheet_id int, block string, top int, left int, bottom int, right int"


def test_bands_against_brute_force(spark):
    rng = random.Random(3)
    box = lambda h: (lambda t, c: (t, c, t + rng.randrange(h), c + rng.randrange(3)))(rng.randrange(3000), rng.randrange(6))
    boxes = [(s, f"{s}:{i}", *box(h)) for s, h in ((0, 4), (1, 900)) for i in range(40)] + [(0, "tall", 0, 2, 2_000_000, 2)]
    cells = [(s, rng.randrange(3200), rng.randrange(8)) for s in (0, 1, 2) for _ in range(80)]
    refs = [(i, rng.randrange(3), *box(h)) for i, h in enumerate([1, 5, 4000] * 30)] + [(99, 0, 0, 0, 999_999_998, 0)]
    regions = spark.createDataFrame(boxes, BOX)
    got = graph.contained(spark.createDataFrame(cells, "sheet_id int, row int, col int"), regions).select("sheet_id", "row", "col", "region").collect()
    want = [(s, r, c, b) for s, r, c in cells for b in ([x[1] for x in boxes if x[0] == s and x[2] <= r <= x[4] and x[3] <= c <= x[5]] or [None])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    got = graph.touched(spark.createDataFrame(refs, "q int, target int, top int, left int, bottom int, right int"), regions).select("q", "region").collect()
    want = [(q, x[1]) for q, s, t, a, b, z in refs for x in boxes if x[0] == s and t <= x[4] and x[2] <= b and a <= x[5] and x[3] <= z]
    assert sorted(map(tuple, got)) == sorted(want)


def test_small_regions_share_bands_with_few(spark):
    """Bands of 16,384 rows had 4,096 merges of four rows each, all of which a cell met."""
    merges = spark.range(10_000).selectExpr("0 AS sheet_id", "'' AS block", "CAST(id * 4 AS INT) AS top", "0 AS left", "CAST(id * 4 + 3 AS INT) AS bottom", "1 AS right")
    assert graph.boxes_of(merges, graph.bands_of(merges)).groupBy("rs", "band").count().agg({"count": "max"}).first()[0] == 4
