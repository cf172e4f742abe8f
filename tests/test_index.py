"""The stored index against a scan: scores, filters, replaced and forgotten workbooks, one embedding a text."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import search
from tabulon.queries.tables import letters
from tabulon.sources.index import Index

DOCS = "doc string, kind string, sheet string, label string, context string, body string, values array<string>, categorical boolean, cells long, path string"
ONE = [
    ("c1", "column", "Debtors", "Account name", "Debtors Ledger", "text", ["Ann", "Bob"], True, 10, "a.xlsx"),
    ("c2", "column", "Debtors", "Interest rates", "Debtors", "number rates rates", None, False, 500, "a.xlsx"),
    ("r1", "region", "Debtors", "", "Debtors", None, [], False, None, "a.xlsx"),
    ("g1", "formula_group", "Rates", "B2*rate", "Rates", "", [], False, 40, "a.xlsx"),
]
TWO = [("c8", "column", "Rates", "Annual rate", "Rates", "number", ["5", "7"], True, 3, "b.xlsx"), ("c9", "column", "Rates", "Account name", "Debtors Ledger", "text", ["Ann", "Bob"], True, 10, "b.xlsx")]
QUESTIONS = ("which account rates", "ann debtors zebra", "the of")


@pytest.fixture
def index(spark, tmp_path):
    out = Index(spark, f"file://{tmp_path}/index")
    out.put("h1", spark.createDataFrame(ONE, DOCS), letters, "letters")
    return out


def rows(df):
    return [(r["doc"], round(r["score"], 9)) for r in df.collect()]


def test_scores_equal_a_scan(spark, index):
    docs = spark.createDataFrame(ONE, DOCS)
    for q in QUESTIONS:
        (got, told), (want, wanted) = search.find_stored(index, q), search.find(docs, q)
        assert rows(got) == rows(want) and told == wanted
    for where in ({"kinds": ["column"]}, {"kinds": ["region", "formula_group"], "sheet": "Rates"}):
        score = lambda terms: index.scores(terms, **where)  # noqa: E731, B023
        assert rows(search.lexical(index.documents(**where), QUESTIONS[0], scores=score)) == rows(search.lexical(search.filtered(docs, **where), QUESTIONS[0]))
    fused, told = search.find_stored(index, "account rates", embed=letters, model="letters")
    want, wanted = search.find(docs, "account rates", embed=letters)
    assert rows(fused) == rows(want) and told == wanted and told["both_halves"] and told["warning"] is None


def test_replaced_and_forgotten(spark, index):
    index.put("h2", spark.createDataFrame(TWO, DOCS))
    both = spark.createDataFrame(ONE + TWO, DOCS)
    assert sorted(rows(search.find_stored(index, "account rates")[0])) == sorted(rows(search.find(both, "account rates")[0]))
    assert {r["workbook_hash"] for r in search.find_stored(index, "rate", workbook="h2")[0].collect()} == {"h2"}
    index.put("h1", spark.createDataFrame(ONE[:1], DOCS))
    assert [r["doc"] for r in index.documents(workbook="h1").collect()] == ["c1"]
    index.forget("h1")
    assert sorted(rows(search.find_stored(index, "account rates")[0])) == sorted(rows(search.find(spark.createDataFrame(TWO, DOCS), "account rates")[0]))
    # A version whose manifest row was never written is not seen.
    index._append("documents", index.documents().withColumn("doc", F.lit("half")), "lost")
    assert "half" not in {r["doc"] for r in index.documents().collect()}


def test_a_text_is_embedded_once(spark, index):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counting(text):
        asked.add(1)
        return [float(text.count(x)) for x in "aeinorst"]

    index.put("h2", spark.createDataFrame(TWO, DOCS), counting, "letters")
    assert asked.value == 1  # the other text has a vector already, of another workbook
    index.put("h2", spark.createDataFrame(TWO, DOCS), counting, "letters")
    assert asked.value == 1
    index.put("h3", spark.createDataFrame(TWO, DOCS), counting, "other model")
    assert asked.value == 3
    before = asked.value
    assert index.nearest("account", counting, "letters", 5).count() == 5
    assert asked.value == before + 1  # the question alone
    assert {r["workbook_hash"] for r in index.nearest("account", letters, "letters", 50).collect()} == {"h1", "h2"}


def test_a_failing_embedder_is_told(spark, index):
    @F.udf("array<double>")
    def broken(text):
        raise ValueError("no model")

    hits, told = search.find_stored(index, "account", embed=broken, model="letters")
    assert rows(hits) == rows(search.find_stored(index, "account")[0]) and told["warning"].startswith("the semantic half failed") and not told["both_halves"]
    assert search.find_stored(index, "account", embed=letters, model="unknown")[1]["warning"] == "no vector is like the question"


def test_questions_open_their_buckets_only(spark, index):
    plan = index.postings(["rate"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and "term" in plan.split("PushedFilters:")[1].split("\n")[0]
