import numpy as np
import pytest

from ledgerlake.llm.embedding_e8 import Hasher, embedding_links, nearest_e8


def brute(rows, threshold=0.98):
    """rows: (vec_id, list, label) -> sorted (vec_id, n_links, component_id, kept)."""
    n = len(rows)
    x = [None if v is None or l is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, float) for _, v, l in rows]
    near = [[False] * n for _ in rows]
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                near[i][j] = near[j][i] = True
                up[root(i)] = root(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, sum(near[k]), least.get(root(k)), i is not None and i == least.get(root(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def test_lattice_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    got = nearest_e8(x) / 2
    grid = got[:, None, :] + np.vstack([np.zeros((1, 8)), __import__("ledgerlake.llm.embedding_e8", fromlist=["x"])._neighbours() / 2])
    assert (((x - got) ** 2).sum(1) <= ((x[:, None] - grid) ** 2).sum(2).min(1) + 1e-12).all()
    assert (np.abs(got.sum(1) % 2) < 1e-9).all()


@pytest.mark.parametrize("dims", [3, 16, 64, 100])
def test_recall_at_the_threshold(dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((4000, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = rng.standard_normal(x.shape)
    v -= (v * x).sum(1)[:, None] * x
    v /= np.linalg.norm(v, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * v
    h, zero = Hasher(dims), np.zeros(len(x), np.int64)
    a, b = h.cells(x, zero), h.cells(y, zero)
    met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() > 0.999


@pytest.mark.parametrize("block", [1024, 16])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1, None):
        hub = rng.standard_normal(24)
        for k in range(70):
            rows.append((hub + rng.standard_normal(24) * 0.16 if k % 3 else rng.standard_normal(24), label))
    rows = [(i, np.float32(v).tolist(), l) for i, (v, l) in enumerate(rows)]
    rows += [(500, rows[1][1], 0), (501, rows[1][1], 0), (501, rows[1][1], 1), (None, rows[1][1], 0), (502, None, 0), (503, [0.0] * 24, 0), (504, [float("nan")] * 24, 0), (505, [None, *rows[1][1][1:]], 0), (506, [], 0), (507, [1.0] * 8, 0), (508, [2.0] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    got = sorted((tuple(r) for r in embedding_links(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_links(df).count() == 0
