"""Lookups as joins: exact with the first match, approximate by position, wildcard, and by place.

The looked-up table has a position column (its row in the sheet). Exact keys are reduced to their
first row before the join, so the join never multiplies rows; Spark picks broadcast or shuffle by
size. An approximate lookup wants the last position whose key is of the same kind and at most the
probe, sorted or not: the greatest position among the keys up to the probe. Few thresholds become
literals of the plan; many are merged with the probes by a union and a running maximum over ranges
of the key, so no probe meets more than its own row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.values import Cell, cell, error, tagged


def first_of(table: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(canon, value) of the first row of each key; blanks are no keys."""
    c = Cell(table, key)
    return table.filter(~(c.kind == "empty")).groupBy(c.canon.alias("canon")).agg(F.min_by(tagged(table, value), F.col(position)).alias("found"), F.min(position).alias("place"))


def exact(probes: DataFrame, key: str, table: DataFrame, table_key: str, value: str, position: str, out: str = "found") -> DataFrame:
    """Each probe with the value of the first row whose key equals its own; #N/A if none."""
    c = Cell(probes, key)
    keyed = probes.withColumn("canon", c.canon)
    got = keyed.join(first_of(table, table_key, position, value), "canon", "left")
    result = F.when(F.col("place").isNull(), error("#N/A")).otherwise(F.col("found"))
    result = F.when(c.failed, F.col(f"`{key}`")).otherwise(result) if c.tagged else result
    return got.select(*[F.col(f"`{x}`") for x in probes.columns], result.alias(out))


def match_exact(probes: DataFrame, key: str, table: DataFrame, table_key: str, position: str, out: str = "place") -> DataFrame:
    """MATCH(..., 0): the one-based place of the first equal key, or #N/A."""
    c = Cell(probes, key)
    first = first_of(table, table_key, position, table_key).select("canon", F.col("place").alias("at"))
    top = table.agg(F.min(position).alias("top"))
    got = probes.withColumn("canon", c.canon).join(first, "canon", "left").crossJoin(F.broadcast(top))
    return got.select(*[F.col(f"`{x}`") for x in probes.columns], F.when(F.col("at").isNull(), error("#N/A")).otherwise(cell("number", F.col("at") - F.col("top") + 1)).alias(out))


def thresholds(table: DataFrame, key: str, position: str) -> DataFrame:
    """(num, place): each distinct number of the key with its last position."""
    c = Cell(table, key)
    return table.filter(c.kind == "number").groupBy(c.num.alias("num")).agg(F.max(position).cast("long").alias("place"))


def approximate(probes: DataFrame, key: str, table: DataFrame, table_key: str, value: str, position: str, below: bool = True, out: str = "found") -> DataFrame:
    """The value at the last position whose number is at most the probe (at least, for MATCH -1)."""
    c = Cell(probes, key)
    known = thresholds(table, table_key, position)
    few = known.limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        # Few thresholds are literals of the plan: no shuffle of probes.
        at, top = F.lit(None).cast("long"), -1
        for num, place in sorted(((r["num"], r["place"]) for r in few), reverse=not below):
            if place > top:
                top = place
                at = F.when(c.number_like >= num if below else c.number_like <= num, F.lit(place)).otherwise(at)
        placed = probes.withColumn("place", at)
    else:
        placed = _as_of(probes, c.number_like, known, below)
    values = table.select(F.col(position).cast("long").alias("place"), tagged(table, value).alias("value"))
    got = placed.join(values, "place", "left")
    return got.select(*[F.col(f"`{x}`") for x in probes.columns], F.when(F.col("place").isNull(), error("#N/A")).otherwise(F.col("value")).alias(out))


def _as_of(probes: DataFrame, number: Column, known: DataFrame, below: bool) -> DataFrame:
    """Probes with `place`: ranges of the key are windows of their own, and each also gets the greatest
    place of the ranges before it, a row a range."""
    parts = min(1000, int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(known.approxQuantile("num", [i / parts for i in range(1, parts)], 0.002))) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col("num")))
    mine = probes.select(F.struct(*[F.col(f"`{x}`") for x in probes.columns]).alias("probe"), number.alias("num"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("step"))
    theirs = known.select(F.lit(None).cast(mine.schema["probe"].dataType).alias("probe"), "num", F.lit(0).alias("side"), F.col("place").alias("step"))
    both = mine.unionByName(theirs).withColumn("part", part)
    order = F.col("num") if below else F.desc("num")
    running = Window.partitionBy("part").orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part" if below else F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("part").agg(F.max("step").alias("top")).select("part", F.max("top").over(earlier).alias("before"))  # at most `parts` rows
    joined = both.withColumn("local", F.max("step").over(running)).join(F.broadcast(tops), "part", "left").filter("side = 1")
    return joined.select("probe.*", F.when(F.col("num").isNotNull(), F.greatest("local", "before")).alias("place"))


#: Thresholds that a plan holds as literals.
LITERALS = 256


def wildcard_regex(pattern: str) -> str:
    """`*` any run, `?` any character, `~` escapes; anchored, case ignored."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return rf"(?is)^{out}\z"


def wildcard(table: DataFrame, key: str, pattern: str, value: str, position: str) -> DataFrame:
    """One row: the value of the first row whose text matches the pattern, or #N/A."""
    c = Cell(table, key)
    found = table.filter(c.txt.rlike(wildcard_regex(pattern))).agg(F.min_by(tagged(table, value), F.col(position)).alias("found"), F.count("*").alias("n"))
    return found.select(F.lit(pattern).alias("pattern"), F.when(F.col("n") == 0, error("#N/A")).otherwise(F.col("found")).alias("found"))


def wildcard_join(probes: DataFrame, pattern: str, table: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Each probe pattern with its first match. Distinct patterns meet the table once, as a literal prefix allows."""
    c = Cell(table, key)
    meta = r"[*?~]"
    p = probes.select(F.col(pattern).alias("pattern")).distinct()
    quoted = F.regexp_replace("pattern", r"([\\.^$|()\[\]{}+\-])", r"\\$1")
    regex = F.concat(F.lit(r"(?is)^"), F.replace(F.replace(F.regexp_replace(quoted, r"~([*?~])", "\u0001$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))
    regex = F.regexp_replace(F.regexp_replace(regex, "\u0001\\.\\*", r"\\*"), "\u0001\\.", r"\\?")
    p = p.withColumn("regex", F.regexp_replace(regex, "\u0001~", "~")).withColumn("head", F.lower(F.substring(F.split("pattern", meta)[0], 1, 1)))
    rows = table.select(c.txt.alias("key"), tagged(table, value).alias("found"), F.col(position).alias("place"), F.lower(F.substring(c.txt, 1, 1)).alias("first"))
    hit = p.filter("head <> ''").join(rows, F.col("head") == F.col("first")).unionByName(p.filter("head = ''").join(rows, F.expr("true")))
    first = hit.filter(F.regexp_like("key", F.col("regex"))).groupBy("pattern").agg(F.min_by("found", "place").alias("found"))
    got = probes.join(first, probes[pattern] == first["pattern"], "left").drop(first["pattern"])
    return got.withColumn("found", F.when(F.col("found").isNull(), error("#N/A")).otherwise(F.col("found")))


def index(probes: DataFrame, row: Column, cells: DataFrame, position: str, value: str, height: int) -> DataFrame:
    """INDEX(range, row): the cell at a one-based place; 0 is refused by the caller, past the end is #REF!."""
    placed = probes.withColumn("place", F.floor(row).cast("long"))
    rows = cells.select((F.col(position)).alias("place"), tagged(cells, value).alias("value"))
    got = placed.join(rows, "place", "left")
    bad = (F.col("place") < 1) | (F.col("place") > height)
    return got.select(*[F.col(f"`{x}`") for x in probes.columns], F.when(bad, error("#REF!")).otherwise(F.col("value")).alias("found"))


def transposed(table: DataFrame, header: str, position: str) -> DataFrame:
    """The columns of a table as rows (header, position, value): what a horizontal lookup searches."""
    names = [c for c in table.columns if c not in (header, position)]
    items = [F.struct(F.lit(n).alias("header"), F.lit(i).cast("long").alias("position"), tagged(table, n).alias("value")) for i, n in enumerate(names)]
    return table.select(F.col(header).alias("row_key"), F.explode(F.array(*items)).alias("c")).select("row_key", "c.*")
