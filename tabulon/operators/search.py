"""Word, vector and fused search over documents (doc, label, context, body, values, path)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.stem import stem

# Field weights, the words of a question that carry no content.
FIELDS = {"label": 4.0, "context": 1.5, "body": 1.0, "values": 0.8, "path": 0.3}
FRAME = frozenset(
    """
    a about all an and any are as at be by can do does each for from has have how i in into is it its many me much my of on or
    show so some that the their then there these this to up was we were what when where which who why will with would you your
    """.split()
)
K1, B = 1.2, 0.75
RRF, LEXICAL, DEPTH = 60, 2.0, 50
#: Hits that a probe of one word looks at.
PROBE = 200

RUN = re.compile(r"[^\W_]+")
PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\dA-Z_]+|[A-Z]+|\d+")


def words(text: str | None) -> list[str]:
    """Alphanumeric runs, whole and in their parts (by case, letters and digits, acronyms), lower-cased; none over 40 bytes."""
    out = []
    for run in RUN.findall(text or ""):
        parts = PART.findall(run)
        out += [run.lower(), *(p.lower() for p in parts)] if len(parts) > 1 else [run.lower()]
    return [w for w in out if len(w.encode()) <= 40]


@F.pandas_udf(T.ArrayType(T.StringType()))
def analysed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [stem(w) for w in words(t)])


def plain_words(text: Column) -> Column:
    """The same tokens without compounds and stems, by built-in functions alone."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) <= 40))


def postings(docs: DataFrame, field: str, tokens: Column | None = None) -> DataFrame:
    """(doc, term, tf, length) of one field."""
    t = docs.select("doc", (analysed(field) if tokens is None else tokens).alias("terms")).withColumn("length", F.size("terms"))
    return t.select("doc", "length", F.explode("terms").alias("term")).groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], field: str = "text", tokens: Column | None = None, boost: float = 1.0) -> DataFrame:
    """(doc, score): only documents with a term are shuffled; lengths and counts come from one sum."""
    if not terms:
        return docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    t = docs.select("doc", (analysed(field) if tokens is None else tokens).alias("terms"))
    wanted = list(dict.fromkeys(terms))
    times = lambda w: F.size(F.filter("terms", lambda x: x == w))
    tf = [times(w).alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = t.select("doc", F.size("terms").alias("length"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))]) if len(wanted) > 1 else F.col("tf0")
    return counted.filter(some > 0).crossJoin(F.broadcast(stats)).select("doc", (score * boost).alias("score"))


def term_scores(docs: DataFrame, terms: list[str], fields: dict[str, float] = FIELDS) -> DataFrame:
    """doc, the size weight and s0, s1, .. of each term: boosted BM25 scores summed over the fields.

    One scan counts the terms in every field and one row of sums goes to the scoring."""
    fields = {f: b for f, b in fields.items() if f in docs.columns}
    cells = F.coalesce(F.col("cells"), F.lit(0)).cast("double") if "cells" in docs.columns else F.lit(0.0)
    kept = docs.select("doc", (1 + F.log10(1 + cells) / 4).alias("weight"), *[analysed(F.concat_ws(" ", f) if docs.schema[f].dataType.typeName() == "array" else f).alias(f) for f in fields])
    times = lambda f, w: F.size(F.filter(f, lambda x: x == w))
    counted = kept.select("doc", "weight", *[F.size(f).alias(f"{f}_length") for f in fields], *[times(f, w).alias(f"{f}_{i}") for f in fields for i, w in enumerate(terms)])
    sums = [F.count(F.when(F.col(f"{f}_{i}") > 0, 1)).alias(f"{f}_df{i}") for f in fields for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("n"), *[F.avg(f"{f}_length").alias(f"{f}_mean") for f in fields], *sums)
    c, scores = F.col, []
    for i in range(len(terms)):
        score = F.lit(0.0)
        for f, boost in fields.items():
            idf = F.log(1 + (c("n") - c(f"{f}_df{i}") + 0.5) / (c(f"{f}_df{i}") + 0.5))
            part = idf * c(f"{f}_{i}") * (K1 + 1) / (c(f"{f}_{i}") + K1 * (1 - B + B * c(f"{f}_length") / c(f"{f}_mean")))
            score = score + F.when(c(f"{f}_{i}") > 0, part * boost).otherwise(0.0)
        scores.append(score.alias(f"s{i}"))
    return counted.crossJoin(F.broadcast(stats)).select("doc", "weight", *scores)  # stats is one row


def terms_of(text: str) -> list[str]:
    return list(dict.fromkeys(stem(w) for w in words(text)))


def filtered(docs: DataFrame, kinds: list[str] | None = None, workbook: str | None = None, sheet: str | None = None) -> DataFrame:
    """The documents of these kinds, of this workbook hash, and of exactly this sheet."""
    for test in ([F.col("kind").isin(kinds)] if kinds else []) + ([F.col("workbook_hash") == workbook] if workbook else []) + ([F.col("sheet") == sheet] if sheet else []):
        docs = docs.filter(test)
    return docs


def lexical(docs: DataFrame, question: str, k: int = 10, fields: dict[str, float] = FIELDS, scores=None) -> DataFrame:
    """Documents with their multi-field score times the size weight, best first; ties by document.

    `scores` gives the rows of term_scores for a list of terms; a stored index has its own."""
    terms = terms_of(question)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    total = sum((F.col(f"s{i}") for i in range(1, len(terms))), F.col("s0"))
    found = term_scores(docs, terms, fields) if scores is None else scores(terms)
    key = [c for c in ("workbook_hash", "doc") if c in found.columns]
    best = found.select(*key, (total * F.col("weight")).alias("score")).filter("score > 0").orderBy(F.desc("score"), *key[::-1]).limit(k)
    return docs.join(F.broadcast(best), key).orderBy(F.desc("score"), *key[::-1])  # k rows


def content_words(question: str) -> list[str]:
    """Distinct words that aren't frame words, split at whatever is not alphanumeric."""
    return [w for w in dict.fromkeys(re.split(r"[^\w]+|_", question.lower())) if w and w not in FRAME]


def term_hits(docs: DataFrame, question: str, k: int = PROBE, fields: dict[str, float] = FIELDS, scores=None) -> DataFrame:
    """(word, doc): the top hits of each content word, of one scan for all of them."""
    content = content_words(question)
    each = {w: terms_of(w) for w in content}
    terms = list(dict.fromkeys(t for ts in each.values() for t in ts))
    if not terms:
        return docs.select(F.lit("").alias("word"), "doc").limit(0)
    total = lambda w: sum((F.col(f"s{terms.index(t)}") for t in each[w]), F.lit(0.0))
    probes = F.array(*[F.struct(F.lit(w).alias("word"), (total(w) * F.col("weight")).alias("score")) for w in content])
    hits = (term_scores(docs, terms, fields) if scores is None else scores(terms)).select("doc", F.explode(probes).alias("p")).filter("p.score > 0").select("doc", "p.word", "p.score")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "doc"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("word", "doc")


def coverage(question: str, probes: DataFrame, top: str | None) -> dict:
    """Which content words the best hit carries, which match nothing, and the verdict."""
    content = content_words(question)
    rows = probes.groupBy("word").agg(F.max((F.col("doc") == F.lit(top)).cast("int")).alias("here"), F.count("*").alias("n")).collect()
    hits = {r["word"]: (bool(r["here"]), r["n"]) for r in rows}
    covered = [w for w in content if hits.get(w, (False, 0))[0]]
    unmatched = [w for w in content if w not in hits]
    uncertain = [w for w in content if w in hits and not hits[w][0] and hits[w][1] >= PROBE]
    if not content:
        verdict = "NoContentWords"
    elif len(unmatched) == len(content):
        verdict = "Nothing"
    elif not covered:
        verdict = "Blind"
    else:
        verdict = "Full" if len(covered) == len(content) else "Partial"
    return {"content": content, "covered": covered, "unmatched": unmatched, "uncertain": uncertain, "verdict": verdict}


# --- vectors -----------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    """In double precision; 0 where lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id") -> DataFrame:
    """An exact scan; the query is a literal of the plan, and each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = 10, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (60 + rank + 1), ranks from 0 in the best `depth` of each list."""
    out = None
    for hits, weight in lists:
        top = hits.orderBy(F.desc("score"), key).limit(depth)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1  # of `depth` rows at most
        part = top.select(key, (F.lit(weight) / (RRF + rank + 1)).alias("score"), F.lit(1).alias("lists"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("score").alias("score"), F.sum("lists").alias("lists")).orderBy(F.desc("score"), key).limit(k).select(key, "score", "lists")


def semantic(docs: DataFrame, question: str, embed, k: int = DEPTH) -> DataFrame:
    """(doc, score): the documents whose text is nearest the question's; those with no likeness are left out."""
    from tabulon.operators.layers import embeddable, embedding_text

    spark = docs.sparkSession
    asked = spark.createDataFrame([(question,)], "text string").select(embed("text").alias("v")).first()["v"]
    texts = embeddable(docs).withColumn("text", embedding_text(docs)).withColumn("size", F.length("text"))
    # texts of one length go together, as a model pads a batch to its longest
    vectors = texts.repartitionByRange("size").sortWithinPartitions("size").select("doc", embed("text").alias("embedding"))
    return nearest(vectors, asked, k, "doc").filter("score > 0")


def find(docs: DataFrame, question: str, k: int = 10, embed=None, fields: dict[str, float] = FIELDS, kinds: list[str] | None = None, workbook: str | None = None, sheet: str | None = None) -> tuple[DataFrame, dict]:
    """Hits (doc, score, ..) and how far they carry the question. With an embedder both halves are fused, else words alone.

    No content word, no search; a semantic half that finds nothing or fails leaves the words alone, and `warning` says so."""
    docs = filtered(docs, kinds, workbook, sheet)
    return answered(docs, question, k, None, (lambda depth: semantic(docs, question, embed, depth)) if embed else None, fields)


def find_stored(index, question: str, k: int = 10, embed=None, model: str | None = None, fields: dict[str, float] = FIELDS, kinds: list[str] | None = None, workbook: str | None = None, sheet: str | None = None) -> tuple[DataFrame, dict]:
    """`find` over a stored index (sources/index.py): only postings of the question's terms, stored vectors and the hits are read."""
    where = {"kinds": kinds, "workbook": workbook, "sheet": sheet}
    near = (lambda depth: index.nearest(question, embed, model, depth, **where)) if embed else None
    return answered(index.documents(**where), question, k, lambda terms: index.scores(terms, fields, **where), near, fields)


def answered(docs: DataFrame, question: str, k: int, scores, near, fields: dict[str, float]) -> tuple[DataFrame, dict]:
    """Words, and what `near` finds for a depth if there is one, fused."""
    none = {"content": [], "covered": [], "unmatched": [], "uncertain": [], "verdict": "NoContentWords", "both_halves": False, "corroborated": 0, "warning": None}
    if not content_words(question):
        return docs.withColumn("score", F.lit(0.0)).limit(0), none
    depth = max(k, DEPTH)
    words_half = lexical(docs, question, depth if near else k, fields, scores)
    hits, both, seen, warning = words_half.limit(k), False, 0, None
    if near:
        try:
            found = near(depth)
            close = [tuple(r) for r in found.collect()]  # `depth` rows at most
            both, warning = bool(close), None if close else "no vector is like the question"
        except Exception as e:  # noqa: BLE001  whatever an embedder fails of, words are left, and the answer says why
            warning = f"the semantic half failed: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}"
        if both:
            key = [c for c in found.columns if c != "score"]
            one = F.struct(*key).alias("key")
            spark = docs.sparkSession
            halves = [(words_half.select(one, "score"), LEXICAL), (spark.createDataFrame(close, found.schema).select(one, "score"), 1.0)]
            fused = [(*r["key"], r["score"], r["lists"]) for r in fuse(halves, "key", k, depth).collect()]
            kind = found.select(*key).schema.add("score", T.DoubleType()).add("lists", T.IntegerType())
            hits = docs.join(F.broadcast(spark.createDataFrame(fused, kind)), key).orderBy(F.desc("score"), *[c for c in ("label",) if c in docs.columns], *key[::-1])
            seen = sum(r[-1] == 2 for r in fused)
    top = hits.first()
    cover = coverage(question, term_hits(docs, question, PROBE, fields, scores), top.doc if top else None)
    return hits, cover | {"both_halves": both, "corroborated": seen, "warning": warning}


def hashing_embedder(dim: int = 64):
    """An offline stand-in for an embedding model: signed hashed words, unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        def one(t):
            v = np.zeros(dim)
            for w in words(t):
                h = zlib.crc32(stem(w).encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return text.map(one)

    return embed
