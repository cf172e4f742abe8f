"""Whitening, collocations and BPE against brute force, SQL and the tokenizers library."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tabulon.llm import bpe, collocate, queries, whiten

HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "ÄÖ ß 日本 🙂 Σς"), (6, "word, " * 30_000), (7, "same text of a few words here"), (8, "same text of a few words here"), (8, "same text of a few words here"), (None, "no id"), (9, "x" * 50_000), (10, "<|endoftext|> ab<|startoftext|>c")]
DOCS = "doc_id long, text string, lang string, weight string, phrase int, bit string, n int, ids string"


def docs(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "clash", 1, "b", 2, "x") for i, t in rows], DOCS)


# --- BPE ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.tokenizer_path())


def ids_of(v, text):
    return [int(i) for part in v.encode(text) for i in part]


def test_encoding_equals_the_library(vocabulary):
    v, rng = vocabulary, random.Random(3)
    want = lambda t: v.library.encode(t, add_special_tokens=False).ids
    for cp in [*range(0x250), *range(0x2000, 0x2070), 0x130, 0x3A3, 0x1E9E, 0xFB01]:
        for text in (chr(cp), f"a{chr(cp)}b", f"{chr(cp)}x", f"'{chr(cp)}"):
            assert ids_of(v, text) == want(text), (hex(cp), text)
    some = ["a", "b", "the", "ing", "'s", "'ll", " ", "\n", "é", "İ", "Σ", "日本", "🙂", "é", "​", "\xa0", "\x1c", "1", "½", "!?", "<|endoftext|>", "<|", "ﬁ", "Å", " ", "\x00", "한"]
    for _ in range(1500):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        assert ids_of(v, text) == want(text), text
    for letters in ("aeinst", "abcdefghijklmnopqrstuvwxyz", "lo"):
        for _ in range(800):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 50)))
            assert ids_of(v, text) == want(text), text


def by_rank(v, symbols):
    """Merges by rank, the leftmost of the lowest first."""
    row = [ord(s) for s in symbols]
    while True:
        found = [(v.merged[p], i) for i, p in enumerate(zip(row, row[1:])) if p in v.merged]
        if not found:
            return row
        made, i = min(found)
        row[i : i + 2] = [made]


def test_backtracking_equals_merges_by_rank(vocabulary):
    rng = random.Random(5)
    for _ in range(400):
        row = "".join(rng.choice("etaoins") for _ in range(rng.randrange(1, 25)))
        row = row[:-1] + chr(ord(row[-1]) + 256)
        assert vocabulary.symbols(row) == by_rank(vocabulary, row)


def test_slices_do_not_show(vocabulary, monkeypatch):
    text = "Some words, and\tothers\n " * 300
    want = bpe.digest(vocabulary, text)
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert bpe.digest(vocabulary, text) == want


def check_digests(v, rows, got):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = v.library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(v.library.decode(ids, skip_special_tokens=False))))
    assert sorted(want, key=repr) == sorted(map(tuple, got), key=repr)


def test_bpe_digests(spark, sf, vocabulary):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_digests(vocabulary, rows, queries.op13_bpe(spark, sf).collect())


def test_bpe_hard_rows(spark, vocabulary):
    table = docs(spark, HARD)
    check_digests(vocabulary, HARD, bpe.digests(table).collect())
    assert bpe.digests(table.limit(0)).count() == 0 and bpe.encoded(table.limit(0)).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in bpe.encoded(table).collect()}
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(table)).collect()}
    for i, t in HARD:
        assert ids[i] == vocabulary.library.encode(t or "", add_special_tokens=False).ids
        assert texts[i] == vocabulary.library.decode(ids[i], skip_special_tokens=False)
    odd = spark.createDataFrame([(1, [320, None, -5, 10**9]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {tuple(r) for r in bpe.decoded(odd).collect()} == {(1, vocabulary.library.decode([320])), (2, ""), (3, "")}


# --- whitening ---------------------------------------------------------------------------------
def brute_whitening(rows):
    """n, S, exact deviations, and the covariance as fractions rounded once."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    z = [[n * c - s for c, s in zip(r, sums)] for r in x]
    size = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(size)] for i in range(size)])
    return n, np.array(z, object) / n, deviation, cov


def check_whitening(rows, got, k=8):
    n, y, deviation, cov = brute_whitening(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    table: dict = {}
    for r in got:
        table.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(table) == n and all(set(t) == set(range(1, min(k, len(cov)) + 1)) for t in table.values())
    plain = y.astype(float) @ vectors
    for c in range(min(k, len(cov))):
        mine = np.array([table[i][c + 1]["whitened"] for i, _ in rows])
        theirs = plain[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
        assert abs(table[rows[0][0]][c + 1]["explained"] / (values[c] / np.trace(cov)) - 1) < 1e-9
    for (i, _), d in zip(rows, deviation, strict=True):
        assert all(r["deviation"] == d and r["n"] == n and r["identity_error"] < 1e-4 for r in table[i].values())
    assert len({r["identity_error"] for t in table.values() for r in t.values()}) == 1


def test_whitening_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()]
    table = spark.createDataFrame([(i, [float(np.float32(c)) for c in v[:12]]) for i, v in rows], "vec_id long, embedding array<float>")
    check_whitening([(r[0], r[1]) for r in table.collect()], whiten.whitened(table).collect())
    whole = queries.op11_whitening(spark, sf).collect()
    assert len(whole) == 8 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert 0 <= whole[0]["identity_error"] < 1e-9


def test_whitening_of_far_and_unequal_spreads(spark):
    # The other solver is sure of an eigenvalue to rounding of the largest one, so spreads stay within a few powers of ten.
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [1, 3, 10, 30, 100] + 1e6
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    check_whitening(list(enumerate(x.tolist())), whiten.whitened(table, 5).collect(), 5)


def test_whitening_hard_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [float("nan")] * 4), (54, [float("-inf")] * 4), (55, [1.0, 2.0]), (56, [1e300] * 4)]
    kind = "vec_id long, embedding array<double>, component string, n string"
    table = spark.createDataFrame([(i, v, "c", "n") for i, v in good + bad], kind)
    check_whitening(good, whiten.whitened(table).collect())
    assert whiten.whitened(table.limit(0)).count() == 0
    # Repeated ids and a null one are rows of their own.
    twice = spark.createDataFrame([(1, [0.0, 1.0], "", ""), (1, [0.0, 1.0], "", ""), (None, [1.0, 5.0], "", "")], kind)
    out = whiten.whitened(twice).collect()
    assert len(out) == 6 and {r["n"] for r in out} == {3}
    # One direction without spread: its component has no value, and the other one is sound.
    assert {r["component"]: r["whitened"] is None for r in out} == {1: False, 2: True} and out[0]["identity_error"] < 1e-12
    alone = whiten.whitened(spark.createDataFrame([(7, [3.0], "", "")], kind)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in alone] == [(1, 0, None, 0.0)]


def test_deviations_beyond_a_long():
    z = np.array([[1 << 40, 3], [1 << 55, 3], [5, 7]])
    true = [sum((1000 * int(c) - r) ** 2 for c, r in zip(row, (2, -3))) for row in z.tolist()]
    assert whiten.deviations(z, 1000, np.array([2, -3])) == [t if t < 1 << 63 else None for t in true]
    z = np.array([[3_000_000, 5], [2, 9]])
    assert whiten.deviations(z, 1000, np.array([0, 0])) == [9 * 10**18 + 25_000_000, 85_000_000]


def test_jacobi_is_exact_for_small_eigenvalues():
    """A graded matrix: its smallest eigenvalue is 1e-20 of the largest."""
    d = np.array([1e10, 1.0, 1e-10])
    core = np.array([[1.0, 0.3, 0.2], [0.3, 1.0, 0.1], [0.2, 0.1, 1.0]])
    values, vectors = whiten.jacobi(d[:, None] ** 0.5 * core * d**0.5)
    assert abs(values.prod() / (np.linalg.det(core) * d.prod()) - 1) < 1e-12
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-14)
    for size in (0, 1, 2, 7, 33):
        a = np.random.default_rng(size).normal(size=(size, size))
        values, vectors = whiten.jacobi(a @ a.T)
        assert np.allclose(vectors.T * values @ vectors, a @ a.T, atol=1e-10) and (np.diff(values) <= 0).all()


# --- collocations ------------------------------------------------------------------------------
def brute_phrases(rows, least, longest, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = (text or "").translate(lower)
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for lang in n:
        found = []
        often = {p: a for (g, p), a in f.items() if g == lang and a >= least and len(p) > 1}
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, queries.op12_collocations(spark, sf).collect())) == sorted(con.sql(queries.oracle_sql()["op12_collocations"]).fetchall())


@pytest.mark.parametrize("full", [False, True])
def test_collocations_brute_force(spark, full, monkeypatch):
    """Few words, so that phrases repeat; also with a bitmap that has every bit, so that nothing is held back."""
    if full:
        monkeypatch.setattr(collocate, "bitmap_of", lambda counts: np.full(1 << collocate.BITS >> 3, 255, np.uint8))
    rng = random.Random(9)
    words = ["a", "B", "ca", "é", "日", "x\xa0y", "to", "be"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", "\n", "!"]) for _ in range(60))
    rows = [(i, text(), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(i, "to be or not to be", "en") for i in range(100, 140)] + [(200, None, "en"), (201, "", None), (201, "", None), (None, " ,.", "fr"), (202, "q " * 5000, "de")]
    table = spark.createDataFrame([(*r, 0, "w") for r in rows], "doc_id long, text string, lang string, n int, weight string")
    got = collocate.mine(table, least=4, top=40)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 4, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_without_any(spark):
    table = docs(spark, HARD[:5])
    assert collocate.mine(table).count() == 0
    assert collocate.mine(table.limit(0)).count() == 0
