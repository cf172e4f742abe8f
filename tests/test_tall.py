"""Sheets made of tables with more rows than a file's sheet has, against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon import queries as registry
from tabulon.functions.text import scan_references, shape
from tabulon.operators.compiled import shape_of
from tests.test_queries import SF, rows

FIRST = 1_048_500


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Orders and customers with keys on both sides of the last row of a file's sheet."""
    at = str(tmp_path_factory.mktemp("tall"))
    for table, keys in (("orders", ("o_orderkey", "o_custkey")), ("customer", ("c_custkey",))):
        t = spark.read.parquet(f"{SF}/{table}.parquet").filter(F.col(keys[0]) < 140)
        t.withColumns({k: F.col(k) + FIRST for k in keys}).write.parquet(f"{at}/{table}.parquet")
    return at


def test_a_row_past_those_of_a_file(spark):
    refs = scan_references("SUM(B$1:B54000000)+C9000001")
    assert [(r.top, r.bottom) for r in refs] == [(0, 53_999_999), (9_000_000, 9_000_000)]
    f = "SUM(B$1:B54000000)+C9000001"
    got = spark.createDataFrame([(f, 9_000_000, 3)], "f string, row int, col int").select(shape_of(F.col("f"), F.col("row"), F.col("col"))).first()[0]
    assert got == shape(f, 9_000_000, 3) == "SUM(R1C[-2]:R[44999999]C[-2])+RC[-1]"


@pytest.mark.parametrize("name", ["formula_shapes", "formula_references", "formula_groups", "formula_group_stats", "formula_exceptions", "formula_audit", "graph_header_of", "graph_lifted", "graph_lifted_columns", "graph_accounting", "recompute_check", "recompute_lookups", "recompute_running_sums", "recompute_values", "report_shared_formulas", "report_why_not_grouped", "report_why_unpopulated", "whatif_level"])
def test_tall_sheets(spark, tall, name):
    registry.load()
    duck = duckdb.connect()
    for t in ("orders", "customer"):
        duck.sql(f"CREATE VIEW {t} AS FROM read_parquet('{os.path.join(tall, t)}.parquet/*.parquet')")
    assert rows(registry.QUERIES[name](spark, tall).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())
