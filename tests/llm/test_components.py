import random

from codetide.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    odd = [(5, 5), (7, 6), (6, 7), (-3, 9)]
    links = chain + star + loose + odd
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    assert got == brute(links)
    assert components(frame.limit(0)).count() == 0
    shuffled = [(rng.random(), a, b) for a, b in chain]
    assert {r["root"] for r in components(spark.createDataFrame([(b, a) for _, a, b in sorted(shuffled)], "u long, v long")).collect()} == {100}
