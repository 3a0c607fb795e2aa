import numpy as np

from tessera.llm import embedding_forest
from tessera.llm.embedding_forest import near_duplicates

KIND = "vec_id long, label int, embedding array<float>, rep string"


def brute(rows, threshold=0.98):
    ok = [r[2] is not None and r[1] is not None and None not in r[2] and np.isfinite(np.array(r[2], float)).all() and np.linalg.norm(np.array(r[2], float)) > 0 for r in rows]
    parent = {r[0]: r[0] for r in rows}
    links = {r[0]: 0 for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[1] == b[1]:
                x, y = np.array(a[2], np.float32).astype(float), np.array(b[2], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    u, v = root(a[0]), root(b[0])
                    parent[max(u, v)] = min(u, v)
    return {k: (links[k], root(k), root(k) == k) for k in parent}


def rows(seed, n=400):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = r.standard_normal(16)
        if out and r.random() < 0.4 and out[-1][2] is not None:
            v = np.array(out[int(r.integers(len(out)))][2] or v, float) + r.standard_normal(16) * r.choice([0, 0.02, 0.04, 0.06])
        out.append((i * 3 + 1, int(r.integers(3)), [float(np.float32(x)) for x in v], "x"))
    return out


def check(spark, data, **options):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(data, KIND).repartition(4), **options).collect()}
    assert got == brute(data)


def test_against_brute_force_with_leaves_and_blocks(spark):
    data = rows(1) + [(5000, None, [1.0] * 16, "x"), (5001, 1, None, "x"), (5002, 1, [0.0] * 16, "x"), (5003, 1, [float("nan")] * 16, "x"), (5004, 1, [None] + [1.0] * 15, "x"), (5005, 1, [float("inf")] * 16, "x")]
    check(spark, data, leaf=30, leaf_rows=25, spill=0.05)


def test_every_dimension(spark):
    groups = [rows(2, 300), [(10_000 + i, label, v[:9], x) for i, label, v, x in rows(3, 200)], [(20_000, 1, [1.0] * 40, "x")], [(30_001, 2, [1.0, 1.0], "x"), (30_002, 2, [1.0, 1.01], "x"), (30_003, 0, [1.0, 1.0], "x")]]
    want = {k: v for g in groups for k, v in brute(g).items()}
    assert want[30_002] == (1, 30_001, False)
    df = spark.createDataFrame([r for g in groups for r in g], KIND).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, leaf=30, leaf_rows=25, spill=0.05).collect()}
    assert got == want


def test_recall_at_production_parameters(spark):
    """Planted pairs just above the threshold among thousands of vectors, with the trees as they are in production."""
    r = np.random.default_rng(7)
    n, dim = 6000, 32
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1200, 2):
        w = r.standard_normal(dim)
        w -= (w @ x[i]) * x[i]
        c = r.uniform(0.9802, 0.99)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
    label = r.integers(0, 2, n)
    label[1:1200:2] = label[0:1200:2]
    df = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(n)], "vec_id long, label int, embedding array<double>").repartition(8)
    got = {v.vec_id: (v.n_links, v.component_id) for v in near_duplicates(df).collect()}
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = near.sum(1)
    assert links[:1200].min() >= 1 and {k: v[0] for k, v in got.items()} == dict(enumerate(links.tolist()))


def test_levels_below_the_fitted_ones(spark, monkeypatch):
    monkeypatch.setattr(embedding_forest, "FITTED", 1)
    check(spark, rows(4), leaf=12, leaf_rows=25, spill=0.08)
    forest = embedding_forest.Forest(np.eye(16), 5, 2, 0.0)
    assert forest.direction[0].shape == (1, 16) and forest.below[0].shape == (4, 16)
    assert all(0 <= leaf < 32 for f in forest.leaves(np.eye(16)) for _, leaf in f)


def test_double_precision(spark):
    """A pair that is linked in double precision and not as float, and one the other way round."""
    r, rows = np.random.default_rng(1), []
    while len(rows) < 6:
        v, w = r.standard_normal(4), r.standard_normal(4)
        w -= (w @ v) / (v @ v) * v
        t = 0.98 + r.choice([-1, 1]) * 1e-9
        u = t * v / np.linalg.norm(v) + np.sqrt(1 - t * t) * w / np.linalg.norm(w)
        cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        if (cos(v, u) >= 0.98) != (cos(v.astype(np.float32).astype(float), u.astype(np.float32).astype(float)) >= 0.98):
            rows += [(len(rows), len(rows), v.tolist(), cos(v, u) >= 0.98), (len(rows) + 1, len(rows), u.tolist(), cos(v, u) >= 0.98)]
    got = {x.vec_id: x.n_links for x in near_duplicates(spark.createDataFrame([x[:3] for x in rows], "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {i: int(linked) for i, _, _, linked in rows}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], KIND)).count() == 0
