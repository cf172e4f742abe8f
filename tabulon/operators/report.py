"""Scores, marks and notes over answers: retrieval quality, grounding, ledgers, evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.values import display

STUB_OVER, PROTECTED = 6000, 2


def retrieval_score(hits: DataFrame, wants: DataFrame, k: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: questions, hit@k and the mean reciprocal rank of the first wanted hit.

    hits (ask, doc, score), wants (ask, doc); ties go to the smaller doc."""
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "doc"))
    first = hits.withColumn("rank", rank).join(wants, ["ask", "doc"], "left_semi").groupBy("ask").agg(F.min("rank").alias("rank"))
    asked = wants.select("ask").distinct().join(first, "ask", "left")
    return asked.agg(F.count("*").alias("questions"), *[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= n).cast("double")).alias(f"hit_{n}") for n in k], F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def bare(text: Column) -> Column:
    """Thousands separators don't count when figures are compared."""
    return F.lower(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""))


def grounded(reply: Column, wants: Column, results: Column) -> Column:
    """hit: the reply names a want that a tool result carries; echo: only the reply does; else miss."""
    said = F.filter(wants, lambda w: F.contains(bare(reply), bare(w)))
    carried = F.exists(said, lambda w: F.exists(results, lambda r: F.contains(bare(r), bare(w))))
    return F.when(F.size(said) == 0, "miss").when(carried, "hit").otherwise("echo")


def call_counts(calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Which time this is that the same call is made."""
    return calls.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def elided(history: DataFrame, session: str, order: str, tokens: str, budget: int = STUB_OVER, protect: int = PROTECTED) -> DataFrame:
    """Tool results to stub: those before the newest whose running total, newest first, is over the budget."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    running = F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return history.withColumn("stub", (F.row_number().over(newest) > protect) & (running > budget))


CITATION = r"(?:'(?:[^']|'')+'|[\p{L}_][\p{L}\p{N}_.]*)!\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?"


def citations_in(text: Column) -> Column:
    """Citations of a reply, as written, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CITATION})"), 1))


def numeric_words(text: str, most: int = 3) -> list[float]:
    """The first distinct finite numbers of a question."""
    found = [float(w.replace(",", "")) for w in re.findall(r"(?<![\w.])\d[\d,]*(?:\.\d+)?(?![\w.])", text)]
    return list(dict.fromkeys(found))[:most]


def node_for(nodes: DataFrame, sheet_id: int, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The smallest node whose range holds the citation, else the sheet's own node.

    nodes: (node, sheet_id, top, left, bottom, right), nulls for a sheet."""
    area = (F.col("bottom") - F.col("top") + 1).cast("long") * (F.col("right") - F.col("left") + 1)
    holds = (F.col("top") <= top) & (F.col("left") <= left) & (F.col("bottom") >= bottom) & (F.col("right") >= right)
    return nodes.filter((F.col("sheet_id") == sheet_id) & (holds | F.col("top").isNull())).orderBy(area.asc_nulls_last(), "node").limit(1)


def canvas(nodes: DataFrame, edges: DataFrame, node_kinds: list[str], edge_kinds: list[str], sheet_id: int | None = None, context: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing: kinds switched on, one sheet only or with its neighbours one hop away."""
    shown = nodes.filter(F.col("kind").isin(node_kinds))
    kept = edges.filter(F.col("kind").isin(edge_kinds))
    if sheet_id is not None:
        own = shown.filter(F.col("sheet_id") == sheet_id)
        if context:
            ids = own.select(F.col("node").alias("id"))
            out = kept.join(ids, kept.src == ids.id, "left_semi").select(F.col("dst").alias("id"))
            into = kept.join(ids, kept.dst == ids.id, "left_semi").select(F.col("src").alias("id"))
            near = ids.unionByName(out).unionByName(into).distinct()
            shown = shown.join(near, shown.node == near.id, "left_semi")
        else:
            shown = own
    s, d = shown.select(F.col("node").alias("src")), shown.select(F.col("node").alias("dst"))
    return shown, kept.join(s, "src", "left_semi").join(d, "dst", "left_semi").select(*edges.columns)


def redacted(kind: Column, shown: Column, redact: bool) -> Column:
    """A value, or only what kind it is."""
    return F.when(F.lit(redact), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(shown)


def evidence(cover: dict) -> str:
    """One sentence on how far the hits carry the question."""
    words = lambda ws: ", ".join(f'"{w}"' for w in ws)
    verdict = cover["verdict"]
    if verdict == "NoContentWords":
        return "The question has no word to search for."
    if verdict == "Nothing":
        return f"No word of the question is in the workbook: {words(cover['unmatched'])}."
    if verdict == "Blind":
        return "The best match carries none of the question's words."
    if verdict == "Full":
        return f"The best match carries every word: {words(cover['covered'])}."
    missing = [w for w in cover["content"] if w not in cover["covered"]]
    return f"The best match carries {words(cover['covered'])} but not {words(missing)}."


def value_note(numbers: list[float], found: list[float]) -> str | None:
    """A note on figures of the question that no cell holds."""
    lost = [n for n in numbers if n not in found]
    return f"No cell holds {', '.join(display(n) for n in lost)}." if lost else None
