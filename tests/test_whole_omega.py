"""The direct index of covers with large communities."""

import itertools
import random

import pytest
from test_whole_triangles import written

from triloom.operators import omega as O


def test_large_communities_make_no_rows_by_pair(spark):
    n = 3000
    truth = spark.range(n).selectExpr("id % 3 AS community_id", "id AS node")
    found = spark.range(n).selectExpr("id % 5 AS community_id", "id AS node").unionAll(spark.range(0, n, 7).selectExpr("9 AS community_id", "id AS node"))
    totals = spark.createDataFrame([(n,)], "n bigint")
    before = written(spark)
    got = O.omega_direct(truth, found, totals).first()[0]
    assert written(spark) - before < 20 * n
    hist: dict = {}
    kinds = [(i % 3, i % 5, i % 7 == 0) for i in range(n)]
    size = {k: kinds.count(k) for k in set(kinds)}
    for a, b in itertools.combinations_with_replacement(sorted(size), 2):
        pairs = size[a] * size[b] if a != b else size[a] * (size[a] - 1) // 2
        key = (int(a[0] == b[0]), int(a[1] == b[1]) + int(a[2] and b[2]))
        hist[key] = hist.get(key, 0) + pairs
    total = n * (n - 1) // 2
    part = lambda side, k: sum(v for c, v in hist.items() if c[side] == k)
    expected = sum(part(0, k) * part(1, k) for k in range(3)) / total**2
    assert got == pytest.approx((sum(v for c, v in hist.items() if c[0] == c[1]) / total - expected) / (1 - expected), abs=1e-12)


def test_covers_of_many_graphs_with_gaps(spark):
    """Nodes of one cover only, repeated rows and nulls; each graph by itself."""
    r = random.Random(8)
    rows = {s: [(g, r.choice([1, 2, 3, None]), r.choice([*range(12), None])) for g in "xy" for _ in range(40)] for s in "td"}
    t, d = (spark.createDataFrame(rows[s], "g string, community_id int, node int") for s in "td")
    got = dict(map(tuple, O.omega_direct(t, d, spark.createDataFrame([("x", 14), ("y", 12)], "g string, n bigint"), ["g"]).collect()))
    for g, n in (("x", 14), ("y", 12)):
        sets = {s: [{v for h, c, v in rows[s] if h == g and c == k and v is not None} for k in (1, 2, 3)] for s in "td"}
        pairs = list(itertools.combinations(range(n), 2))
        x, y = ([sum(a in c and b in c for c in sets[s]) for a, b in pairs] for s in "td")
        e = sum(x.count(k) * y.count(k) for k in range(4)) / len(pairs) ** 2
        assert got[g] == pytest.approx((sum(map(int.__eq__, x, y)) / len(pairs) - e) / (1 - e), abs=1e-12)
