"""Components of links in one task and in many, against plain union-find."""

import random

import numpy as np
import pytest

from panelspark.llm.components import _contracted, components


def roots(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)] + [(1100, 5000), (5000, 5001)]
    loose = [(rng.randrange(10_000, 10_300), rng.randrange(10_000, 10_300)) for _ in range(180)]
    ring = [(-i, -(i % 40) - 1) for i in range(1, 41)]
    return [path, hub, loose, ring, path + hub + loose + ring + path[:20] + [(b, a) for a, b in hub]]


@pytest.mark.parametrize("graph", range(5))
def test_contraction_finds_every_part(graph):
    links = graphs()[graph]
    a, b = _contracted(*(np.array(x) for x in zip(*links)))
    want = roots(links)
    assert dict(zip(a.tolist(), b.tolist())) == {x: r for x, r in want.items() if x != r}


@pytest.mark.parametrize("task_links", [1 << 20, 50])
def test_components_over_one_or_many_tasks(spark, task_links):
    links = [x for x in graphs()[4] if x[0] != x[1]]
    random.Random(4).shuffle(links)
    rows = spark.createDataFrame([*links, (None, 3), (4, None), (77, 77)], "a long, b long")
    got = components(rows.repartition(7), task_links).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == roots(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
