"""Literal cases of the table operators: kinds, refusals, ties, lookups, profiles, search, retrieval."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.address import Range, cite, column_of, letters, letters_column, parse_a1, quoted
from tabulon.operators import lookup, report, retrieve, search
from tabulon.operators.profile import profile
from tabulon.operators.query import Aggregate, Filter, Query, Refused, Table, groups_not_listed, matching, query, scan_counts
from tabulon.values import CELL, cell, display, error, serial, shown, shown_bounds


@pytest.fixture(scope="module")
def mixed(spark):
    """A column with every kind: 1, "1", TRUE, #N/A, empty, "", "A", "a", 0.1 + 0.2, 0.3."""
    kinds = [("number", 1.0), ("text", "1"), ("bool", True), ("error", "#N/A"), ("empty", None), ("text", ""), ("text", "A"), ("text", "a"), ("number", 0.1 + 0.2), ("number", 0.3)]
    field = {"number": 1, "text": 2, "bool": 3, "error": 4}
    rows = []
    for i, (k, v) in enumerate(kinds):
        c = [k, None, None, None, None]
        if k in field:
            c[field[k]] = v
        rows.append((i, tuple(c), "L" if i < 5 else "M"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("v", CELL), T.StructField("label", T.StringType())])
    return Table(spark.createDataFrame(rows, schema), "t", ("label",), "row")


@pytest.mark.parametrize(
    ("test", "value", "rows"),
    [("is", 0.3, [8, 9]), ("is", "a", [6, 7]), ("is", True, [2]), ("is", None, [4]), ("is_not", "a", [0, 1, 2, 4, 5, 8, 9]), ("contains", "", [1, 5, 6, 7]), ("one_of", [1, "1"], [0, 1]), ("above", 0.3, [0, 2]), ("at_least", 0.3, [0, 2, 8, 9]), ("below", 1, [8, 9]), ("at_most", 0.3, [8, 9]), ("blank", None, [4, 5]), ("not_blank", None, [0, 1, 2, 6, 7, 8, 9]), ("failed", None, [3])],
)
def test_filters_by_kind(mixed, test, value, rows):
    assert [r.row for r in matching(mixed, (Filter("v", test, value),)).orderBy("row").collect()] == rows


def test_typed_groups_in_first_seen_order(mixed):
    out = query(mixed, Query((), ("V",), (Aggregate("count"),), None, ("n",))).collect()
    assert [r.n for r in out] == [1, 1, 1, 1, 1, 1, 2, 2]
    assert out[6].v["txt"] == "A" and out[7].v["num"] == 0.1 + 0.2
    assert query(mixed, Query((), ("v",), (Aggregate("count"),), 2, ("n",))).count() == 2
    assert groups_not_listed(mixed, Query((), ("v",), (Aggregate("count"),), 2)).first()[0] == 6


def test_aggregates_over_kinds(mixed):
    q = Query((), (), (Aggregate("count"), Aggregate("count_values", "v"), Aggregate("count_distinct", "v"), Aggregate("sum", "v"), Aggregate("min", "v")), None, ("n", "values", "distinct", "sum", "low"))
    r = query(mixed, q).first()
    assert (r.n, r["values"], r.distinct, r["sum"], r.low, r["low at"], r.errors) == (10, 7, 5, 1.6, 0.3, 9, 4)
    assert scan_counts(mixed, (Filter("row", "below", 3), Filter("v", "above", 0))).first().asDict() == {"rows_scanned": 10, "rows_matched": 2, "rows_with_errors": 0}
    assert query(mixed, Query((Filter("v", "is", "none"),), (), (Aggregate("count"),))).count() == 0


def test_refusals(spark, mixed):
    twice = Table(spark.createDataFrame([(1, 2)], "Total int, x int").withColumn("total ", F.lit(1)), "t")
    for t, q, reason in (
        (mixed, Query((), (), ()), "NothingAsked"),
        (mixed, Query((), (), (Aggregate("sum", "label"),)), "LabelColumn"),
        (mixed, Query((), ("nope",), (Aggregate("count"),)), "NoSuchColumn"),
        (mixed, Query((Filter("v", "like", 1),), (), (Aggregate("count"),)), "NoSuchTest"),
        (twice, Query((), ("x",), (Aggregate("count"),), 3), "NoRowOrder"),
    ):
        with pytest.raises(Refused) as e:
            query(t, q).collect()
        assert e.value.reason == reason
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(Refused) as e:
            Table(spark.createDataFrame([(1, 2)], "Total int, TOTAL int")).resolve("total")
        assert e.value.reason == "AmbiguousColumn"
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_shown_numbers():
    assert shown(0.1 + 0.2) == 0.3
    for n in (0.3, 1.0, 1e-9, 123456.789, -2.5, 1e10):
        low, high = shown_bounds(n)
        assert shown(low) == shown(high) == shown(n)
        assert shown(math.nextafter(low, -math.inf)) != shown(n) and shown(math.nextafter(high, math.inf)) != shown(n)
    assert [display(v) for v in (None, True, 3.0, 0.1 + 0.2, "x")] == ["", "TRUE", "3", "0.3", "x"]


def test_addresses(spark):
    assert [letters(c) for c in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(column_of(letters(c)) == c for c in range(0, 16384, 7))
    got = [r[0] for r in spark.range(16384).orderBy("id").select(letters_column(F.col("id"))).collect()]
    assert got == [letters(c) for c in range(16384)]
    assert parse_a1("'My ''S'!$B$2:A1") == ("My 'S", Range(0, 0, 1, 1)) and parse_a1("XFE1") is None and parse_a1("A0") is None and parse_a1("[1]x!A1") is None
    assert parse_a1("B:A")[1] == Range(0, 0, 1_048_575, 1) and parse_a1("2:1")[1] == Range(0, 0, 1, 16_383)
    assert [quoted(s) for s in ("Jan", "1st", "A1", "a b", "o'k", "")] == ["Jan", "'1st'", "'A1'", "'a b'", "'o''k'", "''"]
    assert cite("a b", Range(0, 0, 1, 2)) == "'a b'!A1:C2"
    a, b = Range(0, 0, 5, 5), Range(4, 4, 9, 9)
    assert a.intersection(b) == Range(4, 4, 5, 5) and a.union(b) == Range(0, 0, 9, 9) and not a.holds(b) and a.cells == 36


def test_serial_dates(spark):
    r = spark.sql("SELECT timestamp'1900-03-01 12:00:00' AS t").select(serial(F.col("t"))).first()[0]
    assert r == 61.5


def test_lookups_take_the_first_or_the_last(spark):
    table = spark.createDataFrame([(0, "b", 5.0), (1, "B", 1.0), (2, "a*", 9.0), (3, None, 4.0)], "pos int, key string, num double")
    probes = spark.createDataFrame([(1, "B"), (2, "c"), (3, None)], "id int, k string")
    got = {r.id: (r.found["num"], r.found["err"]) for r in lookup.exact(probes, "k", table, "key", "num", "pos").collect()}
    assert got == {1: (5.0, None), 2: (None, "#N/A"), 3: (None, "#N/A")}
    # unsorted keys: the last position at or below wins, not the largest key
    numbers = spark.createDataFrame([(4.5,), (0.5,), (100.0,), (None,)], "x double")
    for literals in (256, 1):
        lookup.LITERALS = literals
        below = {r.x: r.found["num"] for r in lookup.approximate(numbers, "x", table, "num", "pos", "pos").collect()}
        above = {r.x: r.found["num"] for r in lookup.approximate(numbers, "x", table, "num", "pos", "pos", below=False).collect()}
        assert below == {4.5: 3.0, 0.5: None, 100.0: 3.0, None: None}
        assert above == {4.5: 2.0, 0.5: 3.0, 100.0: None, None: None}
    lookup.LITERALS = 256
    assert lookup.wildcard(table, "key", "a~*", "num", "pos").first().found["num"] == 9.0
    assert lookup.wildcard(table, "key", "?", "num", "pos").first().found["num"] == 5.0
    assert lookup.wildcard(table, "key", "z*", "num", "pos").first().found["err"] == "#N/A"


def test_profile_limits(spark):
    rows = [(i, "x" * 70 if i == 0 else f"v{i % 70}", float(i % 3) if i % 5 else None, "A" if i % 2 else "a") for i in range(2000)]
    out = {r.name: r for r in profile(Table(spark.createDataFrame(rows, "id int, many string, few double, cased string"))).collect()}
    assert out["id"].distinct is None and out["id"]["values"] is None and out["id"]["max"] == 1999
    assert out["many"].distinct == 71 and out["many"]["values"] is None and not out["many"].categorical
    assert (out["few"].populated, out["few"].empty, out["few"].distinct, out["few"].categorical) == (1600, 400, 3, True)
    assert [(v["value"], v["count"]) for v in out["cased"]["values"]] == [("A", 1000), ("a", 1000)]


def test_words_and_stems():
    assert search.words("HTTPServer isPaid2024 Äpfel x") == ["httpserver", "http", "server", "ispaid2024", "is", "paid", "2024", "äpfel", "x"]
    assert [search.stem(w) for w in ("balances", "rated", "parties", "stopping", "bus")] == ["balanc", "rate", "parti", "stop", "bus"]
    assert search.content_words("What is the total of Total-Due?") == ["total", "due"]


def test_walk_and_passage(spark):
    nodes = spark.createDataFrame([("w",), ("s",), ("a",), ("b",), ("c",), ("d",)], "node string")
    edges = spark.createDataFrame([("w", "s", "CONTAINS", 1), ("s", "a", "CONTAINS", 1), ("s", "b", "CONTAINS", 1), ("a", "b", "DEPENDS_ON", 5), ("c", "a", "DEPENDS_ON", 2), ("b", "d", "CROSS_SHEET_REF", 1)], "src string, dst string, kind string, weight long")
    walk = retrieve.expand(nodes, edges, ["a", "gone"], hops=1)
    assert {(e.node, e.role, e.hops) for e in walk.entries} == {("a", "seed", 0), ("s", "ancestor", 0), ("w", "ancestor", 0), ("b", "input", 1), ("c", "dependent", 1)}
    assert walk.stale == ["gone"] and not walk.truncated
    assert {e.node for e in retrieve.expand(nodes, edges, ["a"], hops=2).entries} == {"a", "s", "w", "b", "c", "d"}
    assert retrieve.expand(nodes, edges, ["a"], hops=2, budget=3).truncated
    assert {e.node for e in retrieve.expand(nodes, edges, ["a"], hops=1, least=3).entries} == {"a", "s", "w", "b"}
    passage = retrieve.render(walk, {"a": "Alpha"}, {"a": "S!A1", "b": "S!B1"}, "book")
    assert "* Alpha [S!A1]" in passage["text"] and "reads: " in passage["text"] and passage["omitted"] == 0
    short = retrieve.render(walk, {}, {}, "book", most=150)
    assert len(short["text"]) <= 150 and short["omitted"] > 0


def test_notes():
    assert report.numeric_words("between 1,200 and 3.5, or 3.5 and v2") == [1200.0, 3.5]
    assert report.value_note([5.0, 7.0], [7.0]) == "No cell holds 5."
    assert "not" in report.evidence({"verdict": "Partial", "content": ["a", "b"], "covered": ["a"]})


def test_cells_of_columns(spark):
    r = spark.range(1).select(cell("text", F.lit("x")).alias("a"), error("#REF!").alias("b"), cell("number", F.lit(None).cast("double")).alias("c")).first()
    assert (r.a["kind"], r.b["err"], r.c["kind"]) == ("text", "#REF!", "empty")
