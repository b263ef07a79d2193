import numpy as np

from graphloom.llm import epsgrid, topk

KIND = "vec_id long, embedding array<float>, label int, component_id string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], KIND)


def cosine_truth(rows, least):
    ok = {k for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    x = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    link = {(a, b) for a in ok for b in ok if a != b and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= least}
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in link:
            root[a] = root[b] = min(root[a], root[b])
    least_id = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}
    return sorted((rows[k][0], sum(a == k for a, _ in link), least_id[root[k]]) for k in range(len(rows)))


def test_grid_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] * rng.uniform(0.5, 2) + rng.normal(scale=rng.choice([0, 0.05, 0.3]), size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, base[0].tolist()) for i in range(30)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("inf")] + [0.0] * 7), (405, base[1].tolist()), (405, base[1].tolist())]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in epsgrid.near_components(make(spark, rows)).collect())
    assert got == cosine_truth(rows, 0.95)


def test_grid_join_splits_blocks_and_leaves_distant_ones(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    x[350:] = x[:350] + rng.normal(scale=0.02, size=(350, 16))
    u = epsgrid._unit(x[np.argsort(x[:, 0])])
    out = []
    epsgrid._meet(u, u, u, u, np.sqrt(0.1), 0.95, (0, 0), True, out)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))}
    assert set(map(tuple, np.concatenate(out).tolist())) == want


def test_grid_join_of_nothing(spark):
    assert epsgrid.near_components(make(spark, [])).count() == 0
    got = epsgrid.near_components(make(spark, [(1, None), (2, None), (None, [1.0]), (None, [1.0])])).collect()
    assert sorted((r.n_links, r.kept) for r in got) == [(0, True)] * 4


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(10)]
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [0.0] * 6), (604, [])]
    df = make(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), rows=64, query_rows=4, lead=3).collect())
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_beyond_doubles_and_few_rows(spark):
    small = make(spark, [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])])
    found = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(small, small.where("vec_id = 0")).collect())
    assert found == [(0, 1, 1), (0, 2, 2)]
    assert topk.top_k(make(spark, []), make(spark, [])).count() == 0
    big = topk._dot(np.array([[3e9, 1.0]]), np.array([[3e9, 2.0]]))
    assert big[0][0] == 9 * 10**18 + 2


def test_top_k_of_repeated_query_rows(spark):
    """Rows that share an id are rows of their own; of those alike in vector, too, one is the query itself."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [0.25, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])]
    df = make(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), k=3).collect())
    ints = [(i, int(256 * v[0])) for i, v in rows]
    want = []
    for a, (i, x) in enumerate(ints):
        if i == 0:
            best = sorted((-x * y, j) for b, (j, y) in enumerate(ints) if b != a)[:3]
            want += [(0, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_cosines_at_the_bound(spark):
    """3-4-5 triangles: cosines of exactly 0.8 link at 0.8, and those a little below do not."""
    rows = [(0, [1.0, 0.0]), (1, [4.0, 3.0]), (2, [4.0, -3.0]), (3, [3.9999, -3.0002])]
    got = {r.vec_id: r.n_links for r in epsgrid.near_components(make(spark, rows), 0.8).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 1}


def test_grid_join_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(epsgrid, "BLOCK", 8)
    monkeypatch.setattr(epsgrid, "GROUP", 1)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 5))
    rows = [(i, (base[i % 60] + rng.normal(scale=rng.choice([0.02, 0.2]), size=5)).astype(np.float32).tolist()) for i in range(400)]
    df = make(spark, rows)
    want = cosine_truth(rows, 0.95)
    for frame in (df, df.withColumn("embedding", df.embedding.cast("array<double>"))):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in epsgrid.near_components(frame).collect()) == want


def test_cosines_at_the_bound_are_links():
    # (1, 0) and (0.6, 0.8) have a cosine of 0.6, whichever way it is added.
    x, y = np.array([[1.0, 0.0]]), np.array([[0.6, 0.8]])
    out = []
    epsgrid._meet(x, y, x, y, np.sqrt(0.8), 0.6, (0, 0), False, out)
    epsgrid._meet(x, y, x, y, np.sqrt(0.8), float(np.nextafter(0.6, 1)), (0, 0), False, out)
    assert [o.tolist() for o in out] == [[[0, 0]]]
