import io
import zipfile

import pytest

from tabulon.functions.evaluate import Err
from tabulon.operators import graph, structure, trace
from tabulon.operators.query import Aggregate, Filter, Query, Refused
from tabulon.plans.tools import TOOLS, Workbook, assignment, literal
from tabulon.sources.corpus import Corpus
from tabulon.sources.workbook import CAPABILITIES, TooLarge, WorkbookSource, load, shifted
from tabulon.streaming import watch


def grid(text: str, sheet: int = 0, top: int = 0):
    """Rows of tokens: `.` is no cell, `=f` a formula with `|value`, numbers, TRUE, FALSE, errors, else text."""
    out = []
    for r, line in enumerate(text.strip("\n").split("\n")):
        for c, token in enumerate(line.split()):
            if token == ".":
                continue
            formula = None
            if token.startswith("="):
                formula, _, token = token[1:].partition("|")
            kind, *rest = trace.parts_of(literal(token.replace("_", " ")))
            out.append((sheet, top + r, c, kind, *rest, False, formula))
    return out


BOOK = (
    grid("""
Impairment . . . .
Account Type Balance Rate Due
A1 Retail 100 =VLOOKUP(B3,Rates!$A$2:$B$4,2,FALSE)|0.1 =ROUND(C3*D3,2)|10
A2 Business 250 =VLOOKUP(B4,Rates!$A$2:$B$4,2,FALSE)|0.2 =ROUND(C4*D4,2)|50
A3 Retail 40 =VLOOKUP(B5,Rates!$A$2:$B$4,2,FALSE)|0.1 7
A4 Other 10 =VLOOKUP(B6,Rates!$A$2:$B$4,2,FALSE)|0.3 =ROUND(C6*D6,2)|3
""")
    + grid("""
Type Rate
Retail 0.1
Business 0.2
Other 0.3
""", 1)
    + grid("""
Measure Value
Total =SUM(Debtors!E3:E6)|70
Taxed =B2*Tax|10.5
Odd =SUMPRODUCT(Debtors!C3:C6)|400
Loop =B6+1|0
Loop2 =B5|0
After =Rates!B2+B4|400.1
""", 2)
)
SHEETS = ["Debtors", "Rates", "Summary"]


@pytest.fixture(scope="module")
def book(spark):
    cells = spark.createDataFrame(BOOK, structure.CELLS)
    return Workbook(cells, SHEETS, {"Tax": "0.15"}, "demo.xlsx")


def test_regions(book):
    got = {(r.sheet_id, r.top, r.left, r.bottom, r.right): r for r in book.tables().collect()}
    r = got[0, 0, 0, 5, 4]
    assert (r.kind, r.title, r.header_rows, r.header_cols, r.headers, r.label_headers) == ("table", "Impairment", 1, 1, ["Type", "Balance", "Rate", "Due"], ["Account"])
    assert (1, 0, 0, 3, 1) in got and (2, 0, 0, 6, 1) in got


def test_partition_at_gaps(spark):
    cells = spark.createDataFrame(grid("a b . c\n1 2 . 3\n. . . .\nx y . .\n. . . z"), structure.CELLS)
    boxes = {(r.top, r.left, r.bottom, r.right) for r in structure.bounds(structure.partitioned(cells)).collect()}
    assert boxes == {(0, 0, 1, 1), (0, 3, 1, 3), (3, 0, 3, 1), (4, 3, 4, 3)}


def test_query_table(book):
    out = book.query_table("Debtors!C4", Query((Filter("Type", "is", "RETAIL"),), ("type",), (Aggregate("sum", "balance"), Aggregate("max", "Due")), None, ("total", "top"))).collect()
    assert [(r["Type"]["txt"], r["total"], r["top"], r["top at"]) for r in out] == [("Retail", 140.0, 10.0, 2)]
    for q, reason in ((Query(), "NothingAsked"), (Query((), (), (Aggregate("sum", "Account"),)), "LabelColumn"), (Query((), (), (Aggregate("sum", "nope"),)), "NoSuchColumn"), (Query((), (), (Aggregate("count"),), 0), "NoLimit")):
        with pytest.raises(Refused) as e:
            book.query_table("Debtors!A1:E6", q)
        assert e.value.reason == reason


def test_answers_say_what_they_stand_on(book):
    a = book.answer("Debtors!A3", Query((Filter("Balance", "above", 20),), ("Type",), (Aggregate("count"),), 1, ("n",)))
    assert (a["over"], a["rows_scanned"], a["rows_matched"], a["rows_with_errors"], a["groups_not_listed"]) == ("Debtors!A3:E6", 4, 3, 0, 1)
    none = book.answer("Debtors!A3", Query((Filter("Type", "is", "Retial"),), (), (Aggregate("count"),)))
    assert none["groups"].count() == 0 and none["unmatched"] == {"Type": ["Retail", "Business", "Other"]}
    assert [r.table_sheet for r in book.schema_hint("Debtors!A1:E6").collect()] == ["Rates"]
    assert [(r.position, r["name"], r.kind, r.populated) for r in book.table_columns("Debtors!A3").collect()][:3] == [(0, "Account", "text", 4), (1, "Type", "text", 4), (2, "Balance", "number", 4)]


def test_recompute_and_check(book):
    out = {(r.sheet_id, r.row, r.col): (r.outcome, r.reason) for r in trace.recompute(book.cells, SHEETS, book.names).collect()}
    assert out[0, 2, 3] == ("agrees", None) and out[2, 1, 1] == ("agrees", None) and out[2, 2, 1] == ("agrees", None)
    assert out[2, 3, 1] == ("unsupported", "Function:SUMPRODUCT") and out[2, 4, 1] == ("differs", None)
    assert sum(r.cells for r in book.check().collect()) == len(out) == 13


def test_what_if(book):
    impact = book.what_if("Rates!B2=0.5")
    moved = {m["cell"]: (m["before"], m["after"]) for m in impact.moved}
    assert moved[0, 2, 3] == (0.1, 0.5) and moved[0, 2, 4] == (10.0, 50.0) and moved[2, 1, 1] == (70.0, 110.0) and moved[2, 2, 1] == (10.5, 16.5)
    assert moved[2, 6, 1] == (400.1, 400.5) and impact.stopped == "done"
    assert {b["cell"]: b["reason"] for b in impact.blocked} == {}
    blocked = book.what_if("Debtors!C3=1")
    assert {b["cell"]: b["reason"] for b in blocked.blocked} == {(2, 3, 1): "Function:SUMPRODUCT", (2, 6, 1): "reads a blocked cell"}
    loop = book.what_if("Summary!B5=4")
    assert [m["cell"] for m in loop.moved] == [(2, 5, 1)]
    assert book.what_if("Debtors!C3=1", max_levels=1).stopped == "levels"


def test_cycles_are_blocked(spark):
    cells = spark.createDataFrame(grid("1 =A1+C1|2 =B1|2 =C1+1|3"), structure.CELLS)
    w = Workbook(cells, ["S"])
    assert {b["cell"][2]: b["reason"] for b in w.what_if("A1=5").blocked} == {1: "circular reference", 2: "circular reference", 3: "reads a blocked cell"}


def test_provenance(book):
    assert [r.text for r in book.precedents("Debtors!D3").collect()] == ["B3", "Rates!$A$2:$B$4"]
    got = [(r.sheet_id, r.top, r.left, r.bottom, r.right, r.cells) for r in book.dependents("Rates!B2:B3").collect()]
    assert sorted(got) == [(0, 2, 3, 5, 3, 4), (2, 6, 1, 6, 1, 1)]
    found = book.find_value("0.1")
    assert found["cells"] == ["Debtors!D3", "Debtors!D5", "Rates!B2"] and found["total"] == 3
    assert {r.node: r.hops for r in book.graph("Summary!B3", 2, direction="precedents").collect()} == {"2:2:1": 0, "2:1:1": 1, "0:Debtors!E3:E6": 2}
    with pytest.raises(Refused):
        book.dependents("Rates!X50:Z60")
    with pytest.raises(Refused):
        book.read_cells("Nowhere!A1")
    assert [r.txt for r in book.read_cells("Rates!A1:A2").collect()] == ["Type", "Retail"]


def test_audit_and_groups(book):
    rows = {(r.body.split("#")[0], r.col): r for r in book.audit_formulas().collect()}
    due = rows["0", 4]
    assert (due.formulas, due.typed, due.deviants, due.fill_cells) == (3, 1, 0, 3)
    groups = structure.groups(book.shaped).filter("sheet_id = 0").collect()
    assert {(g.top, g.bottom, g.left) for g in groups} == {(2, 5, 3), (2, 3, 4), (5, 5, 4)}
    assert [(e.row, e.col, e.what) for e in structure.exceptions(book.shaped).filter("sheet_id = 0").collect()] == [(4, 4, "missing")]


def test_schema(book):
    (r,) = book.schema().collect()
    assert (r.kind, r.table_sheet, r.key_left, r.column, r.approximate, r.cells) == ("VLOOKUP", "Rates", 1, 2, False, 4)


def test_graph_and_audit(book, spark):
    nodes, edges = book.graph_tables
    assert graph.check(nodes, edges).count() == 0
    kinds = {r.kind: r.weight for r in edges.groupBy("kind").sum("weight").withColumnRenamed("sum(weight)", "weight").collect()}
    assert kinds["CROSS_SHEET_REF"] == 7 and "DEPENDS_ON" not in kinds
    expected = graph.lifted(book.cells, book.sheet_table, book.regions)
    actual = edges.filter("kind in ('DEPENDS_ON', 'CROSS_SHEET_REF')")
    assert graph.audit(expected, actual).count() == 0
    first = actual.orderBy("src", "dst").first()
    broken = actual.filter((actual.src != first.src) | (actual.dst != first.dst)).unionByName(spark.createDataFrame([("sheet 0", "sheet 1", "DEPENDS_ON", 3)], actual.schema))
    assert {r.finding for r in graph.audit(expected, broken).collect()} == {"missing", "unexpected"}
    faults = {r.finding for r in graph.check(nodes, edges.unionByName(spark.createDataFrame([("sheet 0", "nowhere", "CONTAINS", 0), ("sheet 1", "sheet 1", "CONTAINS", 1)], edges.schema))).collect()}
    assert faults == {"edge to no node", "weight below one", "loop", "several parents"}
    report = graph.reference_report(book.cells, book.sheet_table, book.regions).first()
    assert report.scanned == report.lifted + report.within + report.external + report.unknown + report.unpopulated


def test_search_and_context(book):
    hits, cover = book.search("what is the impairment balance")
    assert hits.first().doc.startswith("region 0") and cover["verdict"] == "Full"
    assert book.search("what is the")[1]["verdict"] == "NoContentWords"
    passage = book.context("impairment balance")
    assert "Debtors!A1:E6" in passage["citations"] and len(passage["text"]) <= 8000 and "reads" in passage["text"]
    assert all(hasattr(book, t) for t in TOOLS) and len(TOOLS) == 15


def test_literals():
    assert [literal(x) for x in ("1.5", "true", "#n/a", '"5"', "x", "")] == [1.5, True, Err("#N/A"), "5", "x", None]
    assert assignment("'a=b'!A1=3") == ("'a=b'!A1", 3.0)


XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Hid" sheetId="2" state="hidden" r:id="r2"/></sheets><definedNames><definedName name="Tax">One!$A$1</definedName><definedName name="Bad" localSheetId="9">One!$A$2</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><r Id="r1" Target="worksheets/s1.xml"/><r Id="r2" Target="worksheets/s2.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>hello</t></si></sst>",
    "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>',
    "xl/worksheets/s1.xml": '<w><sheetData><row><c r="A1"><v>2</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" s="1"><v>45000</v></c><c r="ZZZZ1"><v>1</v></c></row><row><c r="A2"><f t="shared" si="0" ref="A2:A3">A1*$A$1</f><v>4</v></c><c r="B2" t="b"><v>1</v></c></row><row><c r="A3"><f t="shared" si="0"/><v>8</v></c><c r="B3" t="e"><v>#DIV/0!</v></c><c r="C3"/></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></w>',
    "xl/worksheets/s2.xml": '<w><c r="A1" t="inlineStr"><is><t>x</t></is></c></w>',
}
ODS = {"content.xml": '<o xmlns:t="t" xmlns:x="x"><t:table t:name="One"><t:table-row><t:table-cell x:value-type="float" x:value="2" t:number-columns-repeated="2"/><t:table-cell x:value-type="string"><x:p>hi</x:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="2"><t:table-cell t:formula="of:=[.A1]*2" x:value-type="float" x:value="4"/></t:table-row></t:table></o>'}


def packed(parts: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbook_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(packed(XLSX))
    (tmp_path / "b.ods").write_bytes(packed(ODS))
    x = load(str(tmp_path / "a.xlsx"))
    cells = {(c[2], c[5], c[6]): c[7:] for c in x.cells}
    assert cells[0, 0, 1] == ("text", None, "hello", None, None, False, None)
    assert cells[0, 0, 2][-2] is True and cells[0, 2, 0][-1] == "A2*$A$1" and cells[0, 2, 1][4] == "#DIV/0!"
    assert len(x.warnings) == 2 and x.names == [("Tax", "One!$A$1", None), ("Bad", "One!$A$2", None)] and len(x.merges) == 1
    assert shifted("A1+$B$2", 1, 1) == "B2+$B$2"
    with pytest.raises(TooLarge):
        load(str(tmp_path / "a.xlsx"), max_cells=2)
    assert CAPABILITIES["ods"]["merges"] is False
    spark.dataSource.register(WorkbookSource)
    read = spark.read.format("workbook").load(str(tmp_path / "*.*s*"))
    assert read.count() == len(x.cells) + 5
    assert [r.formula for r in read.filter("path like '%ods' and formula is not null").collect()] == ["A1*2", "A1*2"]


def test_corpus(spark, tmp_path, book):
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    assert corpus.entries().count() == 0
    for _ in range(2):
        corpus.put("abc123", "/x/demo.xlsx", cells=book.cells, groups=structure.groups(book.shaped))
    corpus.put("def", "/x/other.xlsx", cells=book.cells.limit(3))
    assert corpus.get("cells").count() == len(BOOK) + 3 and corpus.get("cells", "abc123").count() == len(BOOK)
    assert corpus.resolve("abc") == "abc123" and corpus.resolve("other.xlsx") == "def"
    with pytest.raises(LookupError):
        corpus.resolve(None)
    rows = spark.createDataFrame([("n1", [3.0, 4.0]), ("n2", [0.0, 0.0])], "node string, embedding array<float>")
    corpus.put_vectors("abc123", rows, "m", 2)
    assert {r.node: [round(x, 6) for x in r.embedding] for r in corpus.vectors("m", 2).collect()} == {"n1": [0.6, 0.8], "n2": [0.0, 0.0]}
    assert corpus.vectors("other", 2).count() == 0
    with pytest.raises(ValueError):
        corpus.put_vectors("abc123", rows, "m", 3)
    corpus.forget("def")
    assert corpus.entries().count() == 1 and corpus.resolve(None) == "abc123"


def test_watch(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "key string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "key string, hash string")
    assert {tuple(r) for r in watch.diff(a, b).collect()} == {("y", "rewritten"), ("z", "removed"), ("w", "added")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(packed(XLSX))
    seen = []
    for _ in range(2):
        watch.reindex(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r.path for r in df.select("path").collect()), str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 1


def test_large_ranges_are_met_as_groups(spark):
    rows = [(0, r, 0, "number", float(r), None, None, None, False, None) for r in range(5000)]
    rows += [(0, r, 1, "number", total, None, None, None, False, f) for r, f, total in ((0, "SUM(A1:A5000)", 12497500.0), (1, "A2+MAX(A1:A5000)", 5000.0), (2, "SUM(A1:A5000)-SUM(A1:A4999)", 0.0), (3, "A4", 3.0))]
    out = {r.row: (r.outcome, r.num) for r in trace.recompute(spark.createDataFrame(rows, structure.CELLS), ["S"]).collect()}
    assert out == {0: ("agrees", 12497500.0), 1: ("agrees", 5000.0), 2: ("differs", 4999.0), 3: ("agrees", 3.0)}


def test_demo_workbook_recomputes(spark):
    from tabulon.sources import demo

    out = trace.recompute(demo.workbook(spark, 60), demo.SHEETS, demo.NAMES).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in out} == {"agrees": 60 * 7 - 1 + 7, "unsupported": 1}


def test_pivoted_grid_is_typed(book):
    t = book.table("Debtors!A3")
    assert t.labels == ("Account",) and [r.Balance["num"] for r in t.df.orderBy("row").collect()] == [100.0, 250.0, 40.0, 10.0]
