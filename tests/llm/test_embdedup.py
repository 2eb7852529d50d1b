import numpy as np
import pytest
from lattica.llm import embdedup


def brute(rows):
    ok = [k for k, (i, e) in enumerate(rows) if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for a in ok:
        for b in ok:
            x, y = rows[a][1], rows[b][1]
            if a != b and len(x) == len(y):
                x, y = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
                near[a, b] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            if label[b] < label[a]:
                label[a], changed = label[b], True
    return sorted((str(i), int(near[k].sum()), str(label[k]), i is not None and label[k] == i) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embdedup.near_duplicates(df).collect())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.1]), (9, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (4, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (10, [None, 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [3.0, 0.0, 0.0]), (13, [-1.0, 0.0]), (14, [1e-30, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(df) == brute([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows])
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,largest,tiles", [(2048, 16384, 1), (64, 32, 1), (64, 32, 3)])
def test_clusters(spark, monkeypatch, block, largest, tiles):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    monkeypatch.setattr(embdedup, "LARGEST_TILE", largest)
    monkeypatch.setattr(embdedup, "_tiles_a_block", lambda *_: tiles)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    x = base[rng.integers(0, 40, 500)] + rng.normal(size=(500, 24)) * rng.choice([0.05, 0.3, 0.5], size=(500, 1))
    x[::9] = x[4]
    rows = [(int(i), [float(np.float32(v)) for v in e]) for i, e in zip(rng.permutation(500), x, strict=True)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)) == brute(rows)


def test_tree_and_boxes():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(1000, 6))
    splits = embdedup._tree(p, 3)
    leaf = embdedup._leaf(p, splits, 3)
    assert set(leaf.tolist()) == set(range(8)) and np.bincount(leaf).max() < 200
    low = np.array([p[leaf == k].min(axis=0) for k in range(8)])
    high = np.array([p[leaf == k].max(axis=0) for k in range(8)])
    near = set(embdedup._pairs_of_boxes(low, high, 0.9))
    for a in range(0, 1000, 7):
        for b in range(0, 1000, 11):
            if ((p[a] - p[b]) ** 2).sum() <= 0.2:
                assert tuple(sorted((int(leaf[a]), int(leaf[b])))) in near


def test_blocks_stay_within_memory_and_leave_work_for_every_core():
    for tiles in (1, 16, 1000, 100_000):
        for size in (1 << 10, 1 << 22, 1 << 30):
            for cores in (1, 6, 8000):
                per = embdedup._tiles_a_block(tiles, size, cores)
                assert per == 1 or (per * size <= embdedup.BLOCK_BYTES and (tiles / per) ** 2 / 2 >= 4 * cores)


def test_spanning_connects_the_same():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    a, b = embdedup.spanning(u, v)

    def classes(pairs):
        label = list(range(200))
        for _ in range(200):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert classes(list(zip(u.tolist(), v.tolist(), strict=True))) == classes(list(zip(a.tolist(), b.tolist(), strict=True)))
