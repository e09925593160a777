import random

from skyledger.llm.common import Scratch
from skyledger.llm.components import connected_components


def brute_force(edges):
    of = {x: x for e in edges for x in e}
    while True:
        new = {x: min([of[x], *(of[y] for e in edges if x in e for y in e)]) for x in of}
        if new == of:
            return of
        of = new


def links():
    draw = random.Random(5)
    chain = [(k, k + 1) for k in range(900, 960)]
    hub = [(7, 2000 + k) for k in range(80)]
    return [*chain, *hub, *((draw.randrange(300), draw.randrange(300)) for _ in range(150)), (-3, -9), (-9, -3), (5, 5)]


def found(spark, edges, **few):
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), **few).collect()
    assert len({r["node"] for r in got}) == len(got)
    return {r["node"]: r["component"] for r in got}


def test_few_and_many_edges_give_the_same_classes(spark):
    edges = links()
    want = brute_force([e for e in edges if e[0] != e[1]])
    assert found(spark, edges) == want
    assert found(spark, edges, few=10) == want
    assert found(spark, [(5, 5)]) == found(spark, [(5, 5)], few=-1) == {}


def shuffles(spark, **few):
    """How many shuffles a search over the links starts: their ids are numbered."""
    frame, scratch, numbered = spark.createDataFrame(links(), "u long, v long"), Scratch(spark, "test"), spark.sparkContext._jsc.sc()
    before = numbered.newShuffleId()
    connected_components(frame, scratch, **few)
    return numbered.newShuffleId() - before - 1


def test_rounds_over_few_edges_start_no_shuffles(spark):
    """Each costs the driver memory, which pipeline came near the limit of."""
    assert shuffles(spark) <= 2  # those of the distinct edges and of their count
    assert shuffles(spark, few=10) > 20
