"""Baselines beside brute force on small graphs."""

import random

import pytest

from triloom.operators import baselines as B
from triloom.operators.graph import canonical_edges
from triloom.sources import generators as G


def sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r["community_id"], set()).add(r["node"])
    return out


def merged(groups, merge):
    """Every group goes with the largest that holds enough of it."""
    parent = {g: g for g in groups}

    def root(g):
        while parent[g] != g:
            g = parent[g]
        return g

    for c, mine in groups.items():
        held = [
            (-len(other), -len(mine & other), d)
            for d, other in groups.items()
            if (len(mine) < len(other) or (len(mine) == len(other) and c > d)) and len(mine & other) >= (1 - merge) * len(mine)
        ]
        if held:
            parent[c] = min(held)[2]
    out = {}
    for g, members in groups.items():
        out.setdefault(root(g), set()).update(members)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kind", ["ring", "random"])
def test_ego_groups_are_merged_and_lose_nobody(spark, kind):
    if kind == "ring":
        e = G.ring_lattice(G.shape_rings(spark, [("s", [40, 24], [8, 8])])).select("src", "dst")
    else:
        r = random.Random(5)
        pairs = [(i, j) for i in range(24) for j in range(i) if r.random() < (0.6 if i // 8 == j // 8 else 0.08)]
        e = canonical_edges(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    alone = sets(B.ego_communities(e, merge=-1.0).collect())
    found = sets(B.ego_communities(e).collect())
    assert set().union(*found.values()) == set().union(*alone.values())
    assert all(any(g <= c for c in found.values()) for g in alone.values())
    assert len(found) < len(alone)
    assert sorted(map(sorted, found.values())) == merged(alone, 0.25)
