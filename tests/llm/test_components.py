"""Components of long paths, hubs and cycles."""

import random

from vectrail.llm.components import components


def test_paths_hubs_and_cycles(spark):
    rng = random.Random(14)
    names = list(range(1000))
    rng.shuffle(names)
    path, hub, cycle = names[:150], names[150:260], names[260:300]
    edges = list(zip(path, path[1:])) + [(hub[0], x) for x in hub[1:]] + list(zip(cycle, cycle[1:] + cycle[:1])) + [(names[400], names[400])]
    edges += edges[:20]
    rng.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: min(group) for group in (path, hub, cycle) for x in group if x != min(group)}
