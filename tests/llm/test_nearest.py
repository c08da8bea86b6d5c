from pathlib import Path

import numpy as np
import pytest

from tidewatch.llm import nearest


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in ids[ids % every == 0]:
        s = u @ u[np.flatnonzero(ids == i)[0]]
        out[i] = [(int(j), float(t)) for t, j in sorted((-round(t, 12), j) for t, j in zip(s, ids, strict=True) if j != i)[:k]]
    return out


def table(n=3000, d=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    rows = [(i, [float(np.float32(x)) for x in centres[rng.integers(20)] + 0.5 * rng.standard_normal(d)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(600)]
    rows += [(100_000, None), (100_050, [0.0] * d), (100_100, [float("nan")] + [1.0] * (d - 1)), (100_150, [None] + [1.0] * (d - 1)), (None, same), (50, rows[50][1]), (100_200, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("block", [16_384, 700])
def test_recall_and_scores(spark, block):
    rows = table()
    want = brute([r for r in rows if r[0] != 100_200], 50, 5)
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in nearest.searched(df, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    exact = dict(rows)
    for q, found in got.items():
        for j, s in found:
            a, b = np.array(exact[q]), np.array(exact[j])
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    hot = [q for q in want if q > 3000]
    assert hot and all([j for j, _ in got[q]] == [j for j, _ in want[q]] for q in hot)


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (2000, 4)).astype(np.uint16)
    codes[:300] = codes[0] ^ (rng.random((300, 4, 16)) < 0.15).astype(np.uint16) @ (1 << np.arange(16)).astype(np.uint16)
    index = nearest.Index(codes)
    for radius in (0, 3, 7, 10, 21):
        assert np.array_equal(index.within(codes[0], radius), np.flatnonzero(nearest.distances(codes[0], codes) <= radius))


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.searched(df).collect()] == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert nearest.searched(df.limit(0)).count() == 0


def test_vectors_of_any_size_and_empty_ones(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8)) * 10.0 ** rng.integers(-200, 200, (60, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, []), (150, None)]
    out = nearest.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for r in out:
        assert abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12
    assert sorted((r.query_id, r["rank"]) for r in out) == [(q, k) for q in (0, 50) for k in range(1, 6)]


FOLDER = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(FOLDER).select("vec_id", "embedding").collect() if r.embedding]
    want, got = brute(rows, 50, 5), {}
    for r in nearest.searched(spark.read.parquet(FOLDER)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {j for j, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
