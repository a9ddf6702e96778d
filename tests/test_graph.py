"""Connected components by alternating stars against union-find."""

import random

import pytest

from tissuegrid.functions.graph import star_components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for g, a, b in edges:
        x, y = sorted((root((g, a)), root((g, b))))
        parent[y] = x
    return {n: root(n)[1] for n in parent if root(n) != n}


@pytest.mark.parametrize("seed, n, m", [(0, 40, 30), (1, 300, 200), (2, 60, 400)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(3), rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame(edges, "g int, a long, b long")
    got = {(r.g, r.label): r.root for r in star_components(df, by=["g"]).collect()}
    assert got == brute(edges)


def test_a_star_and_a_chain(spark):
    edges = [(0, 5, i) for i in range(1000, 1400)] + [(1, i, i + 1) for i in range(200)]
    got = star_components(spark.createDataFrame(edges, "g int, a long, b long"), by=["g"]).collect()
    assert {(r.g, r.root) for r in got} == {(0, 5), (1, 0)} and len(got) == 600


def test_no_edges_and_loops(spark):
    df = spark.createDataFrame([(7, 7)], "a long, b long")
    assert star_components(df).count() == 0 and star_components(df.limit(0)).count() == 0
