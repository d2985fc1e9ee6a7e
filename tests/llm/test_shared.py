"""Components of graphs against a plain search; names that clash."""

import random

from playtrail.llm.shared import connected_components, free_name


def slow(links):
    around = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    name = {}
    for start in sorted(around):
        todo = [start] if start not in name else []
        while todo:
            node = todo.pop()
            if node not in name:
                name[node] = start
                todo += around[node]
    return name


def test_components_equal_a_plain_search(spark):
    rng = random.Random(1)
    shuffled = rng.sample(range(-500, 500), 200)
    cases = [
        [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(None, 3), (5, None), (7, 7), (1, 2), (1, 2), (2, 1)],
        list(zip(shuffled, shuffled[1:])),  # a long chain in no order
        [(0, i) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1100)],
        [],
    ]
    for links in cases:
        df = spark.createDataFrame(links, "a bigint, b bigint")
        assert {r["node"]: r["component"] for r in connected_components(df).collect()} == slow(links)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_Fp int, __fp int")
    assert free_name(df, "fp") == "___fp" and free_name(df, "x") == "_x"
