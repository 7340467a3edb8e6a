"""Components of chains, stars and random edges, held against a union by hand."""

import random

import pytest

from flockline.llm.components import components


def united(edges):
    label = {v: v for e in edges for v in e}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        label[high] = low
    return {v: top(v) for v in label if top(v) != v}


def chain(rng):
    nodes = rng.sample(range(10_000), 600)
    return list(zip(nodes, nodes[1:], strict=False))


def star(rng):
    return [(500, v) if rng.random() < 0.5 else (v, 500) for v in range(1000) if v != 500]


def scattered(rng):
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(7, 7), (1, 2), (2, 1), (1, 2)]


@pytest.mark.parametrize("make", [chain, star, scattered])
def test_components_equal_union(spark, make):
    edges = make(random.Random(11))
    found = components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()
    assert len(found) == len({r.a for r in found})
    assert {r.a: r.b for r in found} == united(edges)
