import random

from pleonasm.llm.linking import components


def test_paths_stars_and_cliques(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(a, b) for a in range(200, 208) for b in range(200, a)] + [(7, 7)]
    edges += [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
