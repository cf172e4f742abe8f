"""Workbook files as cells: a Spark data source for xlsx, xlsm and ods, by the standard library alone.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load("dir/*.xlsx")

One file is one partition. xlsb and xls are refused by name. Cells carry the file's content hash.
"""

from __future__ import annotations

import glob
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.address import Range, letters, parse_a1
from tabulon.functions.text import from_open, kind_of, tokens
from tabulon.values import ERRORS

FIELDS = "workbook_hash string, path string, sheet_id int, sheet string, visible boolean, row int, col int, kind string, num double, txt string, flag boolean, err string, is_date boolean, formula string"
FORMATS = {"xlsx": "xlsx", "xlsm": "xlsm", "xlsb": "xlsb", "xls": "xls", "ods": "ods"}
#: What each format lets a reader see.
CAPABILITIES = {f: {"merges": f in ("xlsx", "xlsm", "xls"), "declared_tables": f in ("xlsx", "xlsm"), "styling": False, "writable": f == "xlsx", "external_links": False} for f in FORMATS}


# What a reader is told of each thing that a format lacks.
LIMITATIONS = {
    "merges": "merged cells are not readable in this format",
    "declared_tables": "declared Excel tables are not readable in this format",
    "styling": "cell styling (bold/fill/borders) is not available",
    "writable": "this format cannot be written back; edits stay in memory",
    "external_links": "links to other workbooks are not readable; external_links is always empty",
}


def limitations(format_: str) -> list[str]:
    """What a workbook of this format can't tell, in words."""
    return [text for what, text in LIMITATIONS.items() if not CAPABILITIES[format_][what]]


class TooLarge(ValueError):
    def __init__(self, found: int, limit: int):
        super().__init__(f"{found} cells, more than {limit}")
        self.found, self.limit = found, limit


@dataclass
class Loaded:
    """A parsed workbook: cells as rows of FIELDS, and what else was readable."""

    hash: str
    path: str
    format: str
    sheets: list[tuple[str, bool]] = field(default_factory=list)
    cells: list[tuple] = field(default_factory=list)
    names: list[tuple[str, str, int | None]] = field(default_factory=list)
    merges: list[tuple[int, Range]] = field(default_factory=list)
    tables: list[tuple[int, str, Range, list[str]]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def format_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"no workbook format: {path}")
    return FORMATS[ending]


def load(path: str, data: bytes | None = None, max_cells: int | None = None, skip_hidden: bool = False) -> Loaded:
    """Hash and parse the same bytes."""
    if data is None:
        with open(path, "rb") as f:
            data = f.read()
    kind = format_of(path)
    out = Loaded(hashlib.sha256(data).hexdigest(), path, kind)
    if kind in ("xlsb", "xls"):
        raise ValueError(f"{kind} files are not read here")
    parse = _ods if kind == "ods" else _xlsx
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parse(z, out, max_cells, skip_hidden)
    return out


def shifted(formula: str, down: int, over: int) -> str:
    """A shared formula as another cell has it: relative parts move."""

    def move(text: str) -> str:
        m = re.match(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)$", text)
        (_, at) = parse_a1(f"{m[2]}{m[4]}")
        col = at.left + (0 if m[1] else over)
        row = at.top + (0 if m[3] else down)
        return f"{m[1]}{letters(col)}{m[3]}{row + 1}"

    out = []
    for t in tokens(formula):
        m = t.match
        if kind_of(t) == "ref" and m["first"]:
            out.append((m["sheet"] or "") + move(m["first"]) + (":" + move(m["second"]) if m["second"] else ""))
        else:
            out.append(t.text)
    return "".join(out)


def value_fields(kind: str, text: str | None) -> tuple:
    """kind, num, txt, flag, err."""
    if text is None:
        return "empty", None, None, None, None
    if kind == "number":
        return "number", float(text), None, None, None
    if kind == "bool":
        return "bool", None, None, text in ("1", "true", "TRUE"), None
    if kind == "error":
        return "error", None, None, None, next((e for e in ERRORS if e == text.strip().upper()), "#VALUE!")
    return "text", None, text, None, None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xlsx(z: zipfile.ZipFile, out: Loaded, max_cells: int | None, skip_hidden: bool) -> None:
    names = set(z.namelist())
    root = lambda n: ElementTree.fromstring(z.read(n))
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t" and True) for si in root("xl/sharedStrings.xml") if _local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    dates = _date_styles(root("xl/styles.xml")) if "xl/styles.xml" in names else set()
    targets = {r.get("Id"): r.get("Target") for r in root("xl/_rels/workbook.xml.rels")}
    book = root("xl/workbook.xml")
    sheets = [s for s in book.iter() if _local(s.tag) == "sheet"]
    for i, s in enumerate(sheets):
        visible = s.get("state", "visible") == "visible"
        out.sheets.append((s.get("name"), visible))
        if skip_hidden and not visible:
            continue
        target = targets[next(v for k, v in s.attrib.items() if _local(k) == "id")]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        _sheet(z, root(part), part, i, s.get("name"), visible, shared, dates, out, max_cells)
    for n in book.iter():
        if _local(n.tag) == "definedName" and n.text:
            scope = n.get("localSheetId")
            fits = scope is not None and int(scope) < len(sheets)
            if scope is not None and not fits:
                out.warnings.append(f"name {n.get('name')} has no sheet {scope}; taken for the whole workbook")
            out.names.append((n.get("name"), n.text, int(scope) if fits else None))


def _date_styles(styles: ElementTree.Element) -> set[int]:
    """Cell styles whose number format shows a date."""
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter() if _local(n.tag) == "numFmt"}
    dated = lambda i: 14 <= i <= 22 or 45 <= i <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(i, "")), re.I))
    forms = next((x for x in styles if _local(x.tag) == "cellXfs"), ())
    return {i for i, x in enumerate(forms) if dated(int(x.get("numFmtId", 0)))}


def _sheet(z, root, part: str, index: int, name: str, visible: bool, shared: list[str], dates: set[int], out: Loaded, max_cells: int | None) -> None:
    masters: dict[str, tuple[int, int, str]] = {}
    dropped = 0
    for c in (x for x in root.iter() if _local(x.tag) == "c"):
        got = parse_a1(c.get("r", ""))
        if got is None:
            dropped += 1
            continue
        row, col = got[1].top, got[1].left
        parts = {_local(x.tag): x for x in c}
        kind, raw = c.get("t", "n"), parts["v"].text if "v" in parts else None
        if kind == "s":
            value = value_fields("text", shared[int(raw)] if raw is not None else None)
        elif kind == "inlineStr":
            value = value_fields("text", "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"))
        else:
            value = value_fields({"b": "bool", "e": "error", "str": "text", "d": "text"}.get(kind, "number"), raw)
        formula = None
        if (f := parts.get("f")) is not None:
            formula = f.text
            if f.get("t") == "shared":
                if f.text:
                    masters[f.get("si")] = (row, col, f.text)
                elif f.get("si") in masters:
                    r, k, text = masters[f.get("si")]
                    formula = shifted(text, row - r, col - k)
        if value[0] == "empty" and formula is None:
            continue
        out.cells.append((out.hash, out.path, index, name, visible, row, col, *value, int(c.get("s", 0)) in dates or kind == "d", formula))
        if max_cells is not None and len(out.cells) > max_cells:
            raise TooLarge(len(out.cells), max_cells)
    if dropped:
        out.warnings.append(f"{name}: {dropped} cells lie outside a sheet")
    out.merges += [(index, got[1]) for m in root.iter() if _local(m.tag) == "mergeCell" and (got := parse_a1(m.get("ref", "")))]
    rels = f"{part.rsplit('/', 1)[0]}/_rels/{part.rsplit('/', 1)[1]}.rels"
    if rels in z.namelist():
        for r in ElementTree.fromstring(z.read(rels)):
            if r.get("Type", "").endswith("/table"):
                t = ElementTree.fromstring(z.read("xl/" + r.get("Target").replace("../", "")))
                out.tables.append((index, t.get("name"), parse_a1(t.get("ref"))[1], [x.get("name") for x in t.iter() if _local(x.tag) == "tableColumn"]))


def _ods(z: zipfile.ZipFile, out: Loaded, max_cells: int | None, skip_hidden: bool) -> None:
    root = ElementTree.fromstring(z.read("content.xml"))
    get = lambda e, name, default=None: next((v for k, v in e.attrib.items() if _local(k) == name), default)
    untold = 0
    for index, table in enumerate(t for t in root.iter() if _local(t.tag) == "table"):
        name = get(table, "name")
        out.sheets.append((name, True))
        row = 0
        for line in (r for r in table.iter() if _local(r.tag) == "table-row"):
            again = int(get(line, "number-rows-repeated", 1))
            col, found = 0, []
            for c in (x for x in line if _local(x.tag) in ("table-cell", "covered-table-cell")):
                wide = int(get(c, "number-columns-repeated", 1))
                kind, text = get(c, "value-type"), "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
                formula = get(c, "formula")
                if kind or formula:
                    told = from_open(formula) if formula else None
                    untold += formula is not None and told is None
                    if kind in ("float", "percentage", "currency"):
                        value = value_fields("number", get(c, "value"))
                    elif kind == "boolean":
                        value = value_fields("bool", get(c, "boolean-value"))
                    elif kind in ("date", "time"):
                        value = value_fields("text", get(c, f"{kind}-value"))
                    elif formula and text.strip().upper() in ERRORS:
                        value = value_fields("error", text)
                    else:
                        value = value_fields("text", text) if kind else value_fields("text", None)
                    found += [(col + k, value, kind == "date", told if told is not None else formula) for k in range(min(wide, 16_384 - col))]
                col += wide
            for k in range(again if found else 0):
                for at, value, dated, formula in found:
                    out.cells.append((out.hash, out.path, index, name, True, row + k, at, *value, dated, formula))
                if max_cells is not None and len(out.cells) > max_cells:
                    raise TooLarge(len(out.cells), max_cells)
            row += again
    out.names += [(get(n, "name"), (from_open("[" + get(n, "cell-range-address", "") + "]") or ""), None) for n in root.iter() if _local(n.tag) == "named-range"]
    if untold:
        out.warnings.append(f"{untold} formulas could not be told in A1")


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"]))
        self.limit = int(options["max_cells"]) if options.get("max_cells") else None
        self.skip = options.get("skip_hidden", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        yield from load(partition.value, None, self.limit, self.skip).cells
