import random

from tablewash.llm.components import connected_components


def _expected(links):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return sorted((x, root(x)) for x in list(group))


def test_shapes(spark):
    pick = random.Random(3)
    path = [(i, i + 1) for i in range(-40, 20)]
    backward = [(900 - i, 899 - i) for i in range(30)]
    star = [(500, k) for k in range(501, 540)] + [(k, 700) for k in range(600, 640)]
    some = [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(90)]
    links = path + backward + star + some + some[:10] + [(5000, 5000), (None, 3), (-(2**63), 2**63 - 1)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert sorted(map(tuple, connected_components(frame).collect())) == _expected(links)
    assert connected_components(frame.limit(0)).collect() == []
