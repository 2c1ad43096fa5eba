import random

import pytest

from tidescore.llm.components import components


def expected(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


CHAIN = [(k, k + 1) for k in range(60)]
STAR = [(7, k) for k in range(100, 160)] + [(k, 7) for k in range(3)]
RANDOM = [(random.Random(k).randrange(300), random.Random(k + 999).randrange(300)) for k in range(220)]


@pytest.mark.parametrize("edges", [CHAIN, STAR, RANDOM, CHAIN + [(-5, 30), (200, 201), (200, 201), (9, 9)]])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(found) == len({row.id for row in found})
    proper = [(a, b) for a, b in edges if a != b]
    assert {row.id: row.component for row in found} == expected(proper)


def test_nothing_to_connect(spark):
    edges = spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")
    assert components(edges).count() == 0
