import numpy as np
import pytest

from kiln.llm import embed_dedup


def brute(rows, cosine=0.9):
    """rows: (id, vector or None); the links and components of all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = [0] * len(rows), list(range(len(rows)))
    for d in {len(rows[i][1]) for i in good}:
        own = np.array([i for i in good if len(rows[i][1]) == d])
        x = np.array([rows[i][1] for i in own], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            links[own[i]] += 1
        changed = True
        while changed:
            changed = False
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = own[i], own[j]
                if label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in set(label)}
    return [(r[0], links[i], least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows)]


def clusters(n, seed=1, dims=64, spread=0.12):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dims))
    for i in range(0, n - 5, 5):  # every fifth starts a group of near copies
        out[i + 1 : i + 4] = out[i] + rng.normal(size=(3, dims)) * spread * np.array([[0.5], [1], [2]])
    return np.float32(out).astype(float)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, c int, key int, own string, links int")


def got(df):
    return sorted(map(repr, map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect())))


def test_odd_rows_equal_brute_force(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(120))]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [3 * x for x in rows[5][1]]), (5, rows[10][1]), (5, rows[50][1]), (None, rows[20][1]), (None, rows[99][1]), (None, [float(i) for i in range(1, 65)])]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] + rows[0][1][1:]), (303, [None] + rows[0][1][1:]), (304, [float("inf")] + rows[0][1][1:]), (305, []), (306, [1.0, 2.0]), (307, [1.0, 2.01]), (308, [1e200] * 3), (309, [1e-200] * 3), (None, None), (310, [5.0]), (311, [-5.0])]
    df = frame(spark, rows)
    want = sorted(map(repr, brute(rows)))
    for options in ({}, {"hashes": 3}, {"bucket": 2}):
        assert got(embed_dedup.near_vectors(df, **options)) == want, options
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_hot_bucket_in_parts(spark):
    """One large group of different near copies and one vector that a third of the rows share."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.15).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(100)]
    rows += [(2000 + i, rows[350][1]) for i in range(200)]
    df = frame(spark, rows)
    want = sorted(map(repr, brute(rows)))
    assert got(embed_dedup.near_vectors(df)) == want
    assert got(embed_dedup.near_vectors(df, bucket=50)) == want


@pytest.mark.parametrize("hashes", [2, 3])
def test_recall_at_the_limit(hashes):
    """Pairs at a cosine of exactly 0.9 meet in one of the tables."""
    rng = np.random.default_rng(5)
    x, z = embed_dedup.unit(rng.normal(size=(4000, 64))), rng.normal(size=(4000, 64))
    z = embed_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    hasher = embed_dedup.Hasher(64, hashes)
    a, b = hasher.keys(x), hasher.keys(0.9 * x + np.sqrt(1 - 0.81) * z)
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert met.mean() >= 0.975
    assert ((a[:-1] == b[1:, :, :1]).any((1, 2))).mean() < 0.05  # others rarely do


def test_counts_once_what_meets_often():
    rng = np.random.default_rng(8)
    x = embed_dedup.unit(rng.normal(size=64)[None] + rng.normal(size=(40, 64)) * 0.1)
    hasher = embed_dedup.Hasher(64, 2)
    keys = hasher.keys(x)
    met = np.zeros((40, 40), int)
    for t in range(hasher.tables):
        for key in np.unique(keys[:, t]):
            inside = (keys[:, t] == key).any(1)
            own = keys[:, t, 0] == key
            for i in range(40):
                for j in range(i + 1, 40):
                    if inside[i] and inside[j] and (own[i] or own[j]):
                        met[i, j] += embed_dedup._first_met(keys[i : i + 1], keys[j : j + 1], np.array([t]), np.array([key]))[0]
    upper = np.triu_indices(40, 1)
    assert set(met[upper].tolist()) <= {0, 1} and met[upper].mean() > 0.95
