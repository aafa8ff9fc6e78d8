import numpy as np

from codetide.llm import vecdedup


def brute(rows, threshold=0.95):
    fine = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {k: v / np.abs(v).max() for k, v in fine.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for a in fine:
        for b in fine:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[x] = y
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def cloud(seed, groups, size, dim, spread):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(groups):
        c = rng.normal(size=dim)
        for _ in range(size):
            rows.append((k, (c + spread * rng.normal(size=dim)).tolist()))
            k += 1
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    return sorted(map(tuple, vecdedup.near_vectors(frame, **options).collect()), key=str)


def test_tight_groups_match_brute_force(spark):
    rows = cloud(1, 20, 15, 32, 0.05) + [(1000 + i, v) for i, v in cloud(2, 60, 1, 32, 1.0)]
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (2001, [2 * x for x in rows[1][1]]), (2002, None), (2003, []), (2004, [0.0] * 32), (2005, [float("nan")] * 32), (2006, [None] + [1.0] * 31), (2007, [float("inf")] + [1.0] * 31), (None, rows[0][1]), (2008, [1.0, 2.0]), (2009, [1e200, 2e200]), (2010, [1e-200, 2e-200])]
    rows += [(3000, [5.0, 0.0]), (3000, [0.0, 5.0]), (3001, [0.01, 5.0]), (None, [1.0, 0.0, 0.0]), (None, [1.0, 0.001, 0.0])]
    assert run(spark, rows, cell_size=40, block=8) == brute(rows)


def test_ids_of_any_kind(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id string, embedding array<float>")
    assert sorted(map(tuple, vecdedup.near_vectors(frame).collect())) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_dense_groups_stay_whole(spark, monkeypatch):
    """A dense group is one cell at every level: no link in it is lost, however small cells should be."""
    monkeypatch.setattr(vecdedup, "SPLIT_SAMPLE", 200)
    rows = cloud(6, 2, 400, 12, 0.03) + [(9000 + i, v) for i, v in cloud(7, 300, 1, 12, 1.0)]
    assert run(spark, rows, cell_size=10, block=64, split_above=100) == brute(rows)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "SAMPLE_BYTES", 8 * 16 * 50)
    rows = cloud(3, 60, 5, 16, 0.05)
    got, expected = run(spark, rows, cell_size=30), brute(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in expected)


def test_recall_across_cell_borders(spark):
    rows = cloud(3, 120, 6, 16, 0.12)
    got, expected = run(spark, rows, cell_size=30, block=64), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in expected)
    assert all(g[1] <= e[1] for g, e in zip(sorted(got), sorted(expected), strict=True))
    assert found >= 0.9 * there > 0
    print("recall", found / there)


def test_second_level_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "SPLIT_SAMPLE", 90)
    rows = cloud(3, 120, 6, 16, 0.12) + [(5000 + i, v) for i, v in cloud(4, 1, 300, 16, 0.01)]
    got, expected = run(spark, rows, cell_size=200, block=64, split_above=120), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in expected)
    assert all(g[1] <= e[1] for g, e in zip(sorted(got), sorted(expected), strict=True))
    assert found >= 0.9 * there > 0
    assert sorted(r for r in got if r[0] >= 5000) == sorted(r for r in expected if r[0] >= 5000)


def test_one_large_group(spark):
    rows = cloud(5, 1, 700, 8, 0.02)
    got = run(spark, rows, block=64)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None)]) == [(4, 0, 4, True)]
