import numpy as np

from tabulon.llm import anisotropic, queries


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted(((-float((x * v).sum()), i) for i, x in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in table], 20, 20)
    got: dict = {}
    for r in sorted(queries.op7_anisotropic(spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    exact = {q: dict(v) for q, v in brute([(r["vec_id"], r["embedding"]) for r in table], 20, len(table)).items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q])


def test_hard_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.5]) for i in range(50)] + [(100, [1.0, 2.0, 3.0, 0.0, 0.0, 0.5])]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 0, "c") for i, v in rows + bad], "vec_id long, embedding array<float>, block int, score string")
    want = brute(list(dict(rows).items()), 20, 20)
    got: dict = {}
    for r in sorted(anisotropic.search(table).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in v] for q, v in want.items()}
    assert anisotropic.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0], 0, ""), (3, [0.5, 0.1], 0, "")], table.schema)
    assert [tuple(r) for r in anisotropic.search(few).collect()] == [(20, 1, 3, 0.5)]


def test_doubles_stay_doubles(spark):
    """Values that no float can hold or tell apart."""
    rows = [(0, [1.0, 0.0]), (1, [1e300, 1.0]), (2, [1 + 1e-12, 0.0]), (3, [1.0, 5.0]), (4, [1.0, -7.0]), (5, [1e-300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["rank"], r["vec_id"], r["score"]) for r in anisotropic.search(table, every=10).orderBy("rank").collect()]
    assert out == [(1, 1, 1e300), (2, 2, 1 + 1e-12), (3, 3, 1.0), (4, 4, 1.0), (5, 5, 1e-300)]


def test_lengths_of_many_sizes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) * np.exp(rng.normal(size=(3000, 1)) * 3)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in anisotropic.search(table, every=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::100] @ x.T
    hits = 0
    for q, row in zip(range(0, 3000, 100), scores, strict=True):
        row[q] = -np.inf
        hits += len(set(np.argsort(-row)[:20].tolist()) & got[q])
    assert hits / (20 * 30) >= 0.95


def test_codes_lower_the_parallel_residual():
    x = np.random.default_rng(2).normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codec = anisotropic.fit(x)
    codec.weight = 8.0
    plain = codec.encode(x, sweeps=0)
    aware = codec.encode(x)
    parallel = lambda c: (((x - codec.decode(c)) * x).sum(axis=1) ** 2).mean()
    assert parallel(aware) < parallel(plain)
    q = x[0]
    assert np.allclose(anisotropic.scan(codec.tables(q), anisotropic.packed(aware)), codec.decode(aware) @ q, atol=1e-5)
