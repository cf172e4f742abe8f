"""The pipeline stage by stage against plain Python on lists."""

import os
import sys

import numpy as np

import corpus_pipeline
from tabulon.llm import langid, quality

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_documents import brute_classes, brute_fingerprint, brute_marks, check_packing  # noqa: E402


def as_dict(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def long_runs(raw, gone):
    """The marked bytes whose run touches more than 50 words."""
    out, at = np.zeros(len(raw), bool), 0
    while at < len(raw):
        end = at
        while end < len(raw) and gone[end] == gone[at]:
            end += 1
        out[at:end] = gone[at] and len(raw[at:end].split()) > 50
        at = end
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, as_dict(docs)
    first, second, third, fourth, last = [f for _, f in corpus_pipeline.STAGES]

    model = quality.learn(docs)
    docs = first(spark, docs, sf)
    one = lambda t: [float(x[0]) for x in quality.scores(model, [t.encode()])[1:]]
    held = {d: t for d, t in held.items() if sum(one(t)) / 2 > 0.5}
    assert as_dict(docs) == held and docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(d in held for d, q in labels.items() if q == 1)

    model = langid.learn(docs, ~langid.held_out())
    docs = second(spark, docs, sf)
    known = {d: langid.predict(model, [t]) for d, t in held.items()}
    held = {d: t for d, t in held.items() if known[d][0][0] != "und" and known[d][1][0] >= model.threshold}
    assert as_dict(docs) == held and docs.columns == columns

    docs = third(spark, docs, sf)
    root = brute_classes([(d, brute_fingerprint(t)) for d, t in sorted(held.items())])
    held = {d: t for d, t in held.items() if root[d] == d}
    assert as_dict(docs) == held and docs.columns == columns

    docs = fourth(spark, docs, sf)
    gone = [long_runs(t.encode(), g) for t, g in zip(held.values(), brute_marks([t.encode() for t in held.values()], 200), strict=True)]
    held = {d: bytes(np.frombuffer(t.encode(), np.uint8)[~g]).decode("utf-8", "ignore") for (d, t), g in zip(held.items(), gone, strict=True)}
    assert as_dict(docs) == held and docs.columns == columns

    assert check_packing(last(spark, docs, sf).collect(), list(held.items())) < 0.01


def test_run_is_the_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in df.collect())
    ran = key(corpus_pipeline.run(spark, sf))
    assert {(r[0], r[4]) for r in ran} == {(r[0], r[4]) for r in key(docs)}


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_a_repeated_passage_of_51_words_goes(spark, sf):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = words(51)
    assert len(passage) < 400
    short = words(49)
    texts = {i: f"{words(60)} {passage} {words(60)}" for i in range(2)} | {2: words(120)} | {i: f"{words(60)} {short} {words(60)}" for i in (3, 4)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = as_dict(corpus_pipeline.repeated_passage_stage(spark, docs, sf))
    assert all(out[i] == texts[i] for i in (2, 3, 4))  # 49 words, and what is left of their neighbours, stay
    for i in range(2):
        assert out[i] == texts[i].replace(f" {passage} ", "")


def test_stages_on_hard_rows(spark, sf):
    """Null ids and texts, repeated rows, a very long text, and columns with the names that stages use inside."""
    rng = np.random.default_rng(11)
    words = ["the", "river", "house", "old", "garden", "of", "and", "quiet", "morning", "in", "a", "slow", "light"]
    prose = lambda n: " ".join(rng.choice(words, n)) + "."
    rows = [(i, prose(80)) for i in range(30)] + [(None, prose(80)), (None, None), (40, None), (41, ""), (42, " \n"), (43, prose(250_000)), (3, "x"), (44, "same " + prose(90))]
    rows += [(45, rows[-1][1])] * 3
    extra = ["text_is_null", "others", "row", "k1", "k2", "marks", "h1", "h2", "fp", "score", "id", "count", "votes", "keep"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}-{i}" for c in extra]) for i, t in rows], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in extra), name
        assert name == "quality classifier" or len(got) > 0
        docs = spark.createDataFrame(got, kind) if name != "quality classifier" else docs  # its scorer has no labels to learn from here
    trimmed = corpus_pipeline.repeated_passage_stage(spark, spark.createDataFrame([(1, None, "a"), (2, "b", "c")], "doc_id long, text string, text_is_null string"), sf)
    assert {tuple(r) for r in trimmed.collect()} == {(1, None, "a"), (2, "b", "c")}
    assert {r["doc_id"] for r in corpus_pipeline.packing_stage(spark, docs, sf).collect()} == {r["doc_id"] for r in docs.collect()}
