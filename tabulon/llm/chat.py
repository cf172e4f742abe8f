"""Chat formatting by compiled templates.

A template is text with `{{ expression }}` and `{% statement %}` tags: for / endfor, if / elif /
else / endif, set, generation / endgeneration. It is parsed to a syntax tree, constants are folded,
and the tree becomes Python closures: expressions are functions of the variables, statements are
generators of (text, is it generated) pieces, so a conversation is rendered as its turns stream in.
Sandbox: names are looked up in the given variables only, `.name` and `[key]` in mappings and
sequences only, filters in FILTERS only; no call, no attribute of a Python object.

Texts are escaped reversibly (`\\b` for `\\`, `\\l` for `<`, `\\n` stays), so no text can hold a
control string of the default template, all of which have a `<`.

Defined cases: null texts and roles are empty; turns go by (turn, role, text), null turns first;
repeated rows are repeated turns; a null conv_id is one conversation; an empty table gives an empty
result; further columns are not looked at. A conversation of any length streams through its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% set assistant = 'assist' + 'ant' %}{% for m in messages %}<turn {{ m.role | escape }}>"
    "{% if m.role == assistant %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
TURN = re.compile("<turn ([^<>]*)>([^<]*)</turn>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\([blg])", lambda m: {"b": "\\", "l": "<", "g": ">"}[m[1]], text)


FILTERS: dict[str, Callable] = {"escape": lambda v: escape(shown(v)), "trim": lambda v: shown(v).strip(), "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(), "title": lambda v: shown(v).title(), "length": len, "string": lambda v: shown(v)}


class TemplateError(ValueError):
    pass


def shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


# --- expressions -------------------------------------------------------------------------------
WORD = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>|.()\[\],=]))""")


class Words:
    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            if not (m := WORD.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str:
        return self.items[0][1] if self.items and self.items[0][0] != "text" else ""

    def take(self, *wanted: str) -> str | None:
        if self.items and self.items[0][0] != "text" and self.items[0][1] in wanted:
            return self.items.pop(0)[1]
        return None

    def need(self, what: str) -> str:
        if not self.items or what != "name" and self.items[0][1] != what or what == "name" and self.items[0][0] != "name":
            raise TemplateError(f"expected {what}")
        return self.items.pop(0)[1]


def parse_expression(words: Words) -> tuple:
    left = parse_and(words)
    while words.take("or"):
        left = ("or", left, parse_and(words))
    return left


def parse_and(words: Words) -> tuple:
    left = parse_not(words)
    while words.take("and"):
        left = ("and", left, parse_not(words))
    return left


def parse_not(words: Words) -> tuple:
    return ("not", parse_not(words)) if words.take("not") else parse_comparison(words)


def parse_comparison(words: Words) -> tuple:
    left = parse_sum(words)
    while sign := words.take("==", "!=", "<", "<=", ">", ">=", "in"):
        left = ("binary", sign, left, parse_sum(words))
    return left


def parse_sum(words: Words) -> tuple:
    left = parse_postfix(words)
    while sign := words.take("+", "-", "~"):
        left = ("binary", sign, left, parse_postfix(words))
    return left


def parse_postfix(words: Words) -> tuple:
    node = parse_atom(words)
    while sign := words.take(".", "[", "|"):
        if sign == ".":
            node = ("item", node, ("value", words.need("name")))
        elif sign == "[":
            node = ("item", node, parse_expression(words))
            words.need("]")
        else:
            name = words.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
    return node


def parse_atom(words: Words) -> tuple:
    if not words.items:
        raise TemplateError("an expression ends early")
    if words.take("("):
        node = parse_expression(words)
        words.need(")")
        return node
    kind, text = words.items.pop(0)
    if kind == "text":
        return ("value", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
    if kind == "number":
        return ("value", int(text))
    if kind == "name":
        return ("value", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
    raise TemplateError(f"unexpected {text!r}")


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: shown(a) + shown(b),
}


def item(holder, key):
    if isinstance(holder, dict):
        return holder.get(key)
    if isinstance(holder, (list, tuple, str)) and isinstance(key, int):
        return holder[key] if -len(holder) <= key < len(holder) else None
    raise TemplateError("only mappings and sequences have items")


# --- statements --------------------------------------------------------------------------------
TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> list[tuple]:
    parts, at = [], 0
    for m in TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    body, end = parse_body(parts, ())
    if end:
        raise TemplateError(f"unexpected {end}")
    return body


def whole(words: Words) -> tuple:
    node = parse_expression(words)
    if words.items:
        raise TemplateError(f"unexpected {words.items[0][1]!r}")
    return node


def parse_body(parts: list, ends: tuple[str, ...]) -> tuple[list[tuple], tuple]:
    """Statements up to one of `ends`, and that tag with its words."""
    body = []
    while parts:
        kind, source = parts.pop(0)
        if kind == "text":
            body.append(("text", source))
            continue
        if kind == "out":
            body.append(("out", whole(Words(source))))
            continue
        words = Words(source)
        name = words.need("name")
        if name in ends:
            return body, (name, words)
        if name == "for":
            var = words.need("name")
            words.need("in")
            over = whole(words)
            body.append(("for", var, over, parse_body(parts, ("endfor",))[0]))
        elif name == "if":
            arms, test = [], whole(words)
            while True:
                inner, end = parse_body(parts, ("elif", "else", "endif"))
                arms.append((test, inner))
                if not end or end[0] == "endif":
                    break
                test = whole(end[1]) if end[0] == "elif" else ("value", True)
            body.append(("if", arms))
        elif name == "generation":
            body.append(("generation", parse_body(parts, ("endgeneration",))[0]))
        elif name == "set":
            var = words.need("name")
            words.need("=")
            body.append(("set", var, whole(words)))
        else:
            raise TemplateError(f"no statement {name}")
    if ends:
        raise TemplateError(f"no {ends[-1]}")
    return body, ()


# --- folding -----------------------------------------------------------------------------------
def fold(node: tuple, known: dict) -> tuple:
    kind = node[0]
    if kind == "name" and node[1] in known:
        return ("value", known[node[1]])
    if kind in ("value", "name"):
        return node
    parts = [fold(x, known) if isinstance(x, tuple) else x for x in node[1:]]
    out = (kind, *parts)
    if all(x[0] == "value" for x in parts if isinstance(x, tuple)):
        return ("value", compile_expression(out)({}))
    return out


def fold_body(body: list[tuple], known: dict) -> list[tuple]:
    """Constant expressions become values, constant branches go, neighbouring texts join.

    A name is known after a constant `set` that is the only one of that name in the template."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out" and (e := fold(node[1], known))[0] == "value":
            node = ("text", shown(e[1]))
        elif node[0] == "out":
            node = ("out", e)
        elif node[0] == "set":
            e = fold(node[2], known)
            if e[0] == "value" and known.get("", {}).get(node[1]) == 1:
                known[node[1]] = e[1]
                continue
            node = ("set", node[1], e)
        elif node[0] == "for":
            inner = {k: v for k, v in known.items() if k != node[1]}
            node = ("for", node[1], fold(node[2], known), fold_body(node[3], inner))
        elif node[0] == "generation":
            node = ("generation", fold_body(node[1], known))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test, known)
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, fold_body(inner, dict(known))))
                if test[0] == "value":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "value":
                for x in arms[0][1]:
                    add(out, x)
                continue
            node = ("if", arms)
        add(out, node)
    return out


def add(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def names_bound(body: list[tuple], counts: dict[str, int], nested: bool = False) -> dict[str, int]:
    """How often each name is bound; a `set` inside a block counts twice, as it may not run."""
    for node in body:
        if node[0] == "set":
            counts[node[1]] = counts.get(node[1], 0) + 1 + nested
        elif node[0] == "for":
            counts[node[1]] = counts.get(node[1], 0) + 2
            names_bound(node[3], counts, True)
        elif node[0] == "generation":
            names_bound(node[1], counts, True)
        elif node[0] == "if":
            for _, inner in node[1]:
                names_bound(inner, counts, True)
    return counts


# --- closures ----------------------------------------------------------------------------------
def compile_expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "value":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "filter":
        use, of = FILTERS[node[1]], compile_expression(node[2])
        return lambda names: use(of(names))
    if kind == "not":
        of = compile_expression(node[1])
        return lambda names: not of(names)
    if kind == "binary":
        use, a, b = BINARY[node[1]], compile_expression(node[2]), compile_expression(node[3])
        return lambda names: use(a(names), b(names))
    a, b = compile_expression(node[1]), compile_expression(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names: item(a(names), b(names))


def compile_body(body: list[tuple]) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [compile_statement(x) for x in body]

    def run(names: dict, generated: bool):
        for step in steps:
            yield from step(names, generated)

    return run


def compile_statement(node: tuple):
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda names, generated: ((text, generated),)
    if kind == "out":
        of = compile_expression(node[1])
        return lambda names, generated: ((shown(of(names)), generated),)
    if kind == "generation":
        inner = compile_body(node[1])
        return lambda names, generated: inner(names, True)
    if kind == "set":
        var, of = node[1], compile_expression(node[2])

        def assign(names, generated):
            names[var] = of(names)
            return ()

        return assign
    if kind == "if":
        arms = [(compile_expression(test), compile_body(inner)) for test, inner in node[1]]

        def branch(names, generated):
            for test, inner in arms:
                if test(names):
                    return inner(names, generated)
            return ()

        return branch
    var, over, inner = node[1], compile_expression(node[2]), compile_body(node[3])

    def loop(names, generated):
        inside, items, index = dict(names), iter(over(names) or ()), 0
        following = next(items, loop)
        while following is not loop:
            inside[var], following = following, next(items, loop)
            inside["loop"] = {"index": index + 1, "index0": index, "first": not index, "last": following is loop}
            yield from inner(inside, generated)
            index += 1

    return loop


def compiled(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages to the pieces of their text, each with its loss mark."""
    tree = parse(source)
    run = compile_body(fold_body(tree, {"": names_bound(tree, {})}))
    return lambda messages, **more: run({"messages": messages, **more}, False)


# --- over conversations ------------------------------------------------------------------------
class Reader:
    """Reads formatted text back while it is written: turns, and what the loss mark covers."""

    def __init__(self):
        self.turns, self.lost, self.held = hashlib.sha256(), hashlib.sha256(), ""
        self.n_turns = self.loss_chars = self.chars = 0
        self.marked = ""

    def see(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        self.held += text
        if generated:
            self.marked += text
        while m := TURN.match(self.held):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            loss = unescape(self.marked)
            self.loss_chars += len(loss)
            self.lost.update(loss.encode("utf-8", "surrogatepass"))
            self.held, self.marked = self.held[m.end() :], ""

    def row(self) -> tuple:
        if self.held or self.marked:
            raise ValueError("the output cannot be read back")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.chars


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversations_in(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its messages) of batches sorted by conv_id; messages stream."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    ahead = [next(rows, None)]

    def messages(conv):
        while ahead[0] is not None and ahead[0][0] == conv:
            _, role, text = ahead[0]
            ahead[0] = next(rows, None)
            yield {"role": role or "", "text": text or ""}

    while ahead[0] is not None:
        conv = ahead[0][0]
        stream = messages(conv)
        yield conv, stream
        for _ in stream:
            pass


def ordered(conversations: DataFrame) -> DataFrame:
    """Each conversation's rows together and in order; the sort spills."""
    rows = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.select("conv_id", F.col("role").cast("string"), F.col("text").cast("string"))


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a conversation, read back from its formatted text."""

    def run(batches):
        render, rows = compiled(template), []
        for conv, messages in conversations_in(batches):
            reader = Reader()
            for piece in render(messages):
                reader.see(*piece)
            rows.append((conv, *reader.row()))
            if len(rows) >= 4096:
                yield arrow(rows)
                rows = []
        if rows:
            yield arrow(rows)

    return ordered(conversations).mapInArrow(run, SCHEMA)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, the formatted text and the [start, end) character spans under the loss mark."""

    def run(batches):
        render = compiled(template)
        for conv, messages in conversations_in(batches):
            text, spans, at = [], [], 0
            for piece, generated in render(messages):
                if generated and piece:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] += len(piece)
                    else:
                        spans.append({"start": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(text)]), pa.array([spans], kinds)], names=["conv_id", "text", "loss"])

    return ordered(conversations).mapInArrow(run, "conv_id long, text string, loss array<struct<start:long,end:long>>")
