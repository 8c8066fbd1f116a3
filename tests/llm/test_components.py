"""Components come from the star rounds, whatever the number of edges."""

import random

from inkwarden.llm import simhash


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def large_star(edges):
    return {(v, min(near | {u})) for u, near in neighbours(edges).items() for v in near if v > u}


def small_star(edges):
    out = set()
    for u, near in neighbours(edges).items():
        less = {v for v in near if v < u}
        out |= {(v, min(less)) for v in less | {u} if less and v != min(less)}
    return out


def test_each_round_is_a_large_star_and_a_small_star(spark, monkeypatch):
    """A path, a hub that is its component's largest node, a cycle, repeated, turned and looped edges."""
    rng = random.Random(3)
    path = rng.sample(range(1000), 200)
    ring = rng.sample(range(3000, 4000), 30)
    edges = [*zip(path, path[1:]), *((2000, 1000 + i) for i in range(60)), *zip(ring, [*ring[1:], ring[0]]), (5001, 5000), (5001, 5000), (5000, 5001), (6000, 6000)]
    tables = []

    def watched(df, tag, write=simhash.materialize):
        out = write(df, tag)
        tables.append({(r["a"], r["b"]) for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "materialize", watched)
    found = {(r["a"], r["b"]) for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    least = lambda nodes: {(v, min(nodes)) for v in nodes if v != min(nodes)}
    assert found == least(path) | least([2000, *range(1000, 1060)]) | least(ring) | {(5001, 5000)}
    assert tables[0] == set(edges)
    for before, after in zip(tables, tables[1:]):
        assert after == small_star(large_star(before))
    assert tables[-1] == tables[-2] == found and len(tables) > 5


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
