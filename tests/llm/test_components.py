import random

from brassloom.llm.components import components


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(40)] + [(7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
