import random

import numpy as np
import pyarrow as pa

from loomtable.llm import components as module
from loomtable.llm.components import components
from loomtable.llm.packed import unpack


def _roots(links: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark, tmp_path):
    """Chains, stars, loops, repeated links and negative nodes; an empty table has no components."""
    dice = random.Random(3)
    cases = [
        [],
        [(1, 1)],
        [(5, 2), (2, 5), (9, 2), (-4, 7)],  # stars already: no round
        [(k, k + 1) for k in range(60)],
        [(0, k) for k in range(1, 200)] + [(200, k) for k in range(150, 260)],
        [(dice.randrange(-90, 90), dice.randrange(-90, 90)) for _ in range(110)],
    ]
    for i, links in enumerate(cases):
        got = components(spark.createDataFrame(links, "u long, v long"), f"file://{tmp_path}/{i}").collect()
        assert len(got) == len({r["node"] for r in got})
        assert {r["node"]: r["root"] for r in got} == _roots(links)


def test_many_links_by_stars(spark, tmp_path, monkeypatch):
    """Beyond the links of one task the parts of partitions are joined by stars, with the same result."""
    dice = random.Random(8)
    links = [(k, k + 1) for k in range(300, 360)] + [(dice.randrange(-90, 90), dice.randrange(-90, 90)) for _ in range(90)]
    monkeypatch.setattr(module, "ONE_TASK", 7)
    got = components(spark.createDataFrame(links, "u long, v long").repartition(5), f"file://{tmp_path}/many").collect()
    assert {r["node"]: r["root"] for r in got} == _roots(links) and len(got) == len({r["node"] for r in got})


def test_links_join_in_a_task():
    """A task leaves stars around least nodes, however many batches its links come in, and no row without links."""
    dice = random.Random(9)
    links = [(dice.randrange(-(2**62), 2**62) if k % 9 else k, dice.randrange(30)) for k in range(300)] + [(k, k + 1) for k in range(1000, 1300)]
    u, v = (np.array(x, np.int64) for x in zip(*links, strict=True))
    nodes, roots = module.least_nodes(u, v)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == _roots(links)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[k : k + 50]), pa.array(v[k : k + 50])], names=["u", "v"]) for k in range(0, len(u), 50)]
    (row,) = module._forest(iter(batches))
    stars = {k: r for k, r in _roots(links).items() if k != r}
    assert dict(zip(unpack(row["u"][0].as_py(), "<i8").tolist(), unpack(row["v"][0].as_py(), "<i8").tolist(), strict=True)) == stars
    assert list(module._forest(iter([]))) == []
