import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.llm import maxscore, near_vectors
from quizlake.llm.components import components


def table(spark, seed: int, n: int = 260):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16))
    v[40:80] = v[40] + 0.05 * rng.normal(size=(40, 16))  # a chain of near copies
    v[100:140] = v[100]  # a hot vector
    v[150] = v[100] * 7
    rows: list = [(i, [float(np.float32(x)) for x in r], "x") for i, r in enumerate(v / 8)]
    rows += [(900, None, "x"), (901, [], "x"), (902, [None] * 16, "x"), (903, [float("nan")] * 16, "x"),
             (904, [float("inf")] * 16, "x"), (905, [0.0] * 16, "x"), (None, rows[0][1], "x"), (906, rows[3][1][:9], "x")]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(3)


def whole(row) -> bool:
    return row[0] is not None and bool(row[1]) and all(x is not None and np.isfinite(x) for x in row[1])


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "STEP_ROWS", 32)
    rows, df = table(spark, 1)
    for k in (1, 7, 400):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0, k).collect()}
        real = [(r[0], np.floor(64 * np.pad(np.array(r[1], float), (0, 16 - len(r[1]))))) for r in rows if whole(r)]
        want = {}
        for q, v in real:
            if q % 20 == 0:
                best = sorted((-int(v @ w), d) for d, w in real if d != q)[:k]
                want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(best)}
        assert got == want
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_search_moves_no_vectors_with_pairs(spark, monkeypatch):
    """A task reads its blocks by itself; the pairs of blocks carry none of them."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    monkeypatch.setattr(maxscore, "RUN_SHARDS", 3)
    rows, df = table(spark, 2)
    found = maxscore.top_k(df, F.col("vec_id") % 20 == 0, 7)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    real = [(r[0], np.floor(64 * np.pad(np.array(r[1], float), (0, 16 - len(r[1]))))) for r in rows if whole(r)]
    want = {}
    for q, v in real:
        if q % 20 == 0:
            best = sorted((-int(v @ w), d) for d, w in real if d != q)[:7]
            want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(best)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()} == want


def test_search_of_large_components(spark):
    rows = [(i, [float((i * 37) % 101) * 4096, float(i) * 1000.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") == 20, 5).orderBy("rank").collect()]
    q = [int(64 * x) for x in rows[20][1]]
    best = sorted((-sum(a * int(64 * b) for a, b in zip(q, r[1], strict=True)), r[0]) for r in rows if r[0] != 20)[:5]
    assert got == [(20, d, -s) for s, d in best]


@pytest.mark.parametrize("size", [1e9, 3e7, 2e4])
def test_search_keeps_vectors_of_any_size(spark, size):
    rows = [(0, [size, 1.0]), (1, [min(size, 1e6) / 2, -3.0]), (2, [-2.0, 7.0]), (3, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    ints = {k: [int(np.floor(64 * x)) for x in v] for k, v in rows}
    want = sorted((-sum(a * b for a, b in zip(ints[0], ints[k], strict=True)), k) for k in (1, 2, 3))
    if -want[0][0] >= 2**63:
        raise AssertionError("the case must fit a long")
    assert got == [(k, -s) for s, k in want]


def test_search_raises_rather_than_rounds(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        maxscore.top_k(df, F.col("vec_id") == 0, 5).collect()


def brute(rows, least):
    real = [(r[0], np.pad(np.array(r[1], float), (0, 16 - len(r[1])))) for r in rows if whole(r) and any(r[1])]
    links = {d: [] for d, _ in real}
    for i, (a, x) in enumerate(real):
        for b, y in real[i + 1 :]:
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].append(b)
                links[b].append(a)
    low = {}
    for d in sorted(links):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = d
                todo += links[x]
    return {r[0]: (len(links.get(r[0], [])), low.get(r[0], r[0])) for r in rows if r[0] is not None}


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    for seed, tile in ((1, 4096), (2, 50)):
        monkeypatch.setattr(near_vectors, "TILE_ROWS", tile)
        rows, df = table(spark, seed)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(df).collect()}
        assert got == brute(rows, 0.95)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
