"""Retrieval: walk from search hits over the stored graph, and render a cited passage.

A walk is bounded by its budget, so each level takes only the edges of its frontier.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPENDENCY = ("DEPENDS_ON", "CROSS_SHEET_REF", "REFERENCES_NAME")


@dataclass
class Entry:
    node: str
    role: str
    hops: int
    via: str | None = None


@dataclass
class Walk:
    entries: list[Entry] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    truncated: bool = False
    stale: list[str] = field(default_factory=list)


def expand(nodes: DataFrame, edges: DataFrame, seeds: list[str], hops: int = 2, budget: int = 40, children: int = 0, least: int = 1) -> Walk:
    """Seeds, the parts of them that carry dependencies, ancestors (free of hops), then dependency edges both ways, strongest first.

    Only what was asked about is searched for such parts. `children` of each node that is walked from come too: columns before
    formula groups, those of most cells first, never those of the workbook itself. A containment that goes in a circle truncates."""
    known = {r.node for r in nodes.filter(F.col("node").isin(seeds)).select("node").collect()}
    walk = Walk(stale=[s for s in seeds if s not in known])
    role: dict[str, Entry] = {}
    has = set(nodes.columns)
    kind = F.col("kind") if "kind" in has else F.lit("").alias("kind")
    cells = F.col("cells") if "cells" in has else F.lit(0)
    described = nodes.select("node", kind.alias("node_kind"), cells.alias("cells"))
    contains = edges.filter("kind = 'CONTAINS'")
    depends = edges.filter(F.col("kind").isin(*DEPENDENCY) & (F.col("weight") >= least))

    def add(entry: Entry) -> bool:
        if entry.node in role:
            return False
        if len(role) >= budget:
            walk.truncated = True
            return False
        role[entry.node] = entry
        return True

    def ancestors(of: list[str]) -> list[str]:
        at, steps, found = of, 0, []
        while at:
            up = contains.filter(F.col("dst").isin(at)).select("src", "dst").collect()
            at = [r.src for r in sorted(up) if add(Entry(r.src, "ancestor", role[r.dst].hops, r.dst))]
            found += at
            steps += 1
            if steps > budget:
                walk.truncated = True
                break
        return found

    def carrying(of: list[str], hop: int) -> list[str]:
        """Parts of these nodes, at any depth, that have a dependency edge."""
        at, found = of, []
        while at:
            inside = contains.filter(F.col("src").isin(at)).select("src", F.col("dst").alias("node"))
            ends = depends.select(F.col("src").alias("node")).unionByName(depends.select(F.col("dst").alias("node")))
            down = sorted(inside.join(ends, "node", "left_semi").select("src", "node").distinct().collect())
            at = [r.node for r in down if add(Entry(r.node, "child", hop, r.src))]
            found += at
        return found

    def listed(of: list[str], hop: int) -> None:
        inside = contains.filter(F.col("src").isin(of)).select("src", F.col("dst").alias("node")).join(described, "node")
        parents = described.filter(F.col("node").isin(of) & (F.col("node_kind") == "workbook")).select(F.col("node").alias("src"))
        rows = inside.join(parents, "src", "left_anti").collect()
        for parent in of:
            own = sorted((r.node_kind == "formula_group", -r.cells, r.node) for r in rows if r.src == parent and r.node not in role)
            for _, _, node in own[:children]:
                add(Entry(node, "child", hop, parent))

    for s in dict.fromkeys(seeds):
        if s in known:
            add(Entry(s, "seed", 0))
    asked = list(role)
    frontier = asked + (carrying(asked, 0) if hops else [])
    above = ancestors(frontier)
    if children:
        listed(frontier + above, 0)
    for hop in range(1, hops + 1):
        near = depends.filter(F.col("src").isin(frontier) | F.col("dst").isin(frontier)).select("src", "dst", "weight").collect()
        steps = [(-r.weight, r.dst, "input", r.src) for r in near if r.src in frontier] + [(-r.weight, r.src, "dependent", r.dst) for r in near if r.dst in frontier]
        frontier = [node for _, node, what, via in sorted(steps) if add(Entry(node, what, hop, via))]
        above = ancestors(frontier)
        if children:
            listed(frontier + above, hop)
        if not frontier:
            break
    walk.entries = list(role.values())
    inside = list(role)
    walk.edges = [tuple(r) for r in depends.filter(F.col("src").isin(inside) & F.col("dst").isin(inside)).select("src", "dst", "kind", "weight").orderBy(F.desc("weight"), "src", "dst").collect()]
    return walk


def render(walk: Walk, labels: dict[str, str], cites: dict[str, str], title: str, most: int = 8000) -> dict:
    """A numbered, cited passage of at most `most` characters; what doesn't fit is counted."""
    order = [e for e in walk.entries if e.role == "seed"] + [e for e in walk.entries if e.role != "seed"]
    number = {e.node: i + 1 for i, e in enumerate(order)}
    parent = {e.via: e.node for e in walk.entries if e.role == "ancestor"}

    def entry(e: Entry, fits: int) -> str:
        where, at = [], parent.get(e.node)
        while at and at not in where:
            where.append(at)
            at = parent.get(at)
        lines = [f"{number[e.node]:>3}. {'*' if e.role == 'seed' else ' '} {labels.get(e.node, e.node)} [{cites.get(e.node, '-')}]"]
        if where:
            lines.append("     in: " + " > ".join(labels.get(x, x) for x in reversed(where)))
        for word, pick in (("reads", lambda s, d: d if s == e.node else None), ("read by", lambda s, d: s if d == e.node else None)):
            to = [f"{number[o]} (x{w:,})" for s, d, _, w in walk.edges if (o := pick(s, d)) and number[o] <= fits]
            if to:
                lines.append(f"     {word}: " + ", ".join(to))
        return "\n".join(lines) + "\n"

    def text(fits: int) -> str:
        head = f"# {title}\n\n{fits} of {len(order)} nodes{', the walk hit its budget' if walk.truncated else ''}. * marks what the search matched.\n\n"
        return head + "".join(entry(e, fits) for e in order[:fits])

    low, high = 0, len(order)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(text(middle)) <= most else (low, middle - 1)
    return {"text": text(low), "citations": [cites[e.node] for e in order[:low] if e.node in cites], "omitted": len(order) - low}
