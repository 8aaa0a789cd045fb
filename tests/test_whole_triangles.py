"""Triangles of graphs with far more pairs of neighbours than triangles, and with hubs."""

import itertools
import random

from triloom.operators.graph import canonical_edges, triangles
from triloom.plans import graph_queries as Q


def graph(spark, pairs):
    return canonical_edges(spark.createDataFrame(list(pairs), "src bigint, dst bigint"))


def brute(pairs):
    near: dict = {}
    for a, b in pairs:
        near.setdefault(min(a, b), set()).add(max(a, b))
    return {(a, b, c) for a, up in near.items() for b in up for c in up & near.get(b, set())}


def written(spark) -> int:
    """Rows written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_neighbours_are_not_shuffled(spark):
    pairs = [(i, 1000 + j) for i in range(90) for j in range(90)] + [(0, 1), (1, 2), (2000, 2001)]
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        got = [tuple(sorted(t)) for t in triangles(graph(spark, pairs)).collect()]
        rows = written(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    assert len(got) == len(set(got)) and set(got) == brute(pairs)
    assert rows < 10 * len(pairs) < 90 * 90 * 89 / 2


def test_hubs_and_rounds(spark):
    r = random.Random(3)
    pairs = {(0, i) for i in range(1, 2300)} | {tuple(sorted(r.sample(range(1, 2300), 2))) for _ in range(900)} | {(1, i) for i in range(2, 2200)}
    want = brute(pairs)
    for at_once in (10**6, 1500):
        got = [tuple(sorted(t)) for t in triangles(graph(spark, pairs), at_once=at_once).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_graphs_stay_apart(spark):
    rows = [(g, a, b) for g, n in (("x", 4), ("y", 5)) for a, b in itertools.combinations(range(n), 2)]
    found = triangles(spark.createDataFrame(rows, "g string, src int, dst int"), ["g"], at_once=4).collect()
    assert sorted((t["g"], *sorted(t[1:])) for t in found) == sorted((g, *t) for g, n in (("x", 4), ("y", 5)) for t in itertools.combinations(range(n), 3))


def test_query_in_rounds(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(40), r.randrange(25)) for _ in range(130)] + [(None, 3), (None, 4), (5, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders: dict = {}
    for o, p in rows:
        if o is not None and p is not None:
            orders.setdefault(o, set()).add(p)
    want: dict = {}
    for t in brute({e for ps in orders.values() for e in itertools.combinations(sorted(ps), 2)}):
        want[t[0]] = want.get(t[0], 0) + 1
    for at_once in (10**6, 20):
        assert dict(map(tuple, Q.triangles(spark, str(tmp_path), at_once=at_once).collect())) == want
