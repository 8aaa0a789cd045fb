"""Queries over graphs: the part graph (parts that share two orders or more), ring lattices, covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.operators import baselines, communities as C, graph, omega as O, similarity as S
from triloom.operators.components import components
from triloom.operators.graph import adjacency, canonical_edges, node_profile, two_hop
from triloom.plans import sweep
from triloom.plans.data_queries import table
from triloom.runtime import cut, settle
from triloom.sources import generators as G

THRESHOLD = 0.15
THRESHOLDS = (0.1, 0.15, 0.2)


def part_graph(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """src, dst: parts that occur together in at least ``least`` orders."""
    op = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    both = op.select("o", F.col("p").alias("src")).join(op.select("o", F.col("p").alias("dst")), "o").where("src < dst")
    return cut(canonical_edges(both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(C.admissible_triples(part_graph(spark, sf_dir), S.closed_neighborhood_jaccard(THRESHOLD)))


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.communities_of_triples(_triples(spark, sf_dir))


def pair_similarity(spark, sf_dir):
    p = S.pair_similarity(part_graph(spark, sf_dir))
    return p.select("x", "y", "common", "adjacent", "deg_x", "deg_y", F.round("jaccard", 9).alias("jaccard"), F.round("open_jaccard", 9).alias("open_jaccard"))


def open_jaccard_pairs(spark, sf_dir):
    return S.open_neighborhood_jaccard(0.25).qualified(part_graph(spark, sf_dir)).select("x", "y")


def common_neighbor_pairs(spark, sf_dir):
    return S.common_neighbors(2).qualified(part_graph(spark, sf_dir)).select("x", "y")


def user_predicate_pairs(spark, sf_dir):
    """A predicate on two nodes: at least one common neighbour and degrees that differ by 1 at most."""
    f = lambda u, v: (F.size(F.array_intersect(u.neighbors, v.neighbors)) >= 1) & (F.abs(u.degree - v.degree) <= 1)
    return S.NodePredicate(f).qualified(part_graph(spark, sf_dir)).select("x", "y")


def python_predicate_pairs(spark, sf_dir):
    """The same predicate as a Python function on Arrow batches."""
    f = lambda u, v: len(u.neighbors & v.neighbors) >= 1 and abs(u.degree - v.degree) <= 1
    return S.PythonPredicate(f).qualified(part_graph(spark, sf_dir)).select("x", "y")


def node_profiles(spark, sf_dir):
    p = node_profile(part_graph(spark, sf_dir))
    return p.select("node", F.array_join(F.transform("neighbors", lambda n: n.cast("string")), " ").alias("neighbors"), "degree")


def two_hop_nodes(spark, sf_dir):
    e = part_graph(spark, sf_dir)
    return two_hop(e, e.agg(F.min("src")).first()[0])


def triangles(spark, sf_dir, at_once: int = graph.ROUND_EDGES):
    """Of each part the triangles in which it is the smallest; parts that share an order are joined."""
    # one shuffle by order and one by part: what follows is joined and listed where it is
    op = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).repartition("o").distinct()
    both = op.select("o", F.col("p").alias("src")).join(op.select("o", F.col("p").alias("dst")), "o").where("src < dst")
    edges = both.select("src", "dst").repartition("src").distinct()
    counted = lambda t: t.groupBy(F.least("a", "b", "c").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return graph.triangles(edges, fold=counted, at_once=at_once).groupBy("a").agg(F.sum("n").alias("n"))


def candidate_triples(spark, sf_dir):
    return C.candidate_triples(part_graph(spark, sf_dir))


def admissible_triples(spark, sf_dir):
    return _triples(spark, sf_dir).select("a", "b", "c", F.round("strength", 9).alias("strength"))


def hypergraph_size(spark, sf_dir):
    return C.hypergraph_size(_triples(spark, sf_dir))


def hyper_edges_star(spark, sf_dir):
    return C.hyper_edges(_triples(spark, sf_dir), "star")


def hyper_edges_clique(spark, sf_dir):
    t = C.hyper_edges(_triples(spark, sf_dir), "clique")
    swap = F.struct("a1", "b1", "c1") > F.struct("a2", "b2", "c2")
    pick = lambda k, i, j: F.when(swap, F.col(f"{k}{j}")).otherwise(F.col(f"{k}{i}"))
    return t.select(*[pick(k, 1, 2).alias(f"{k}1") for k in "abc"], *[pick(k, 2, 1).alias(f"{k}2") for k in "abc"], "x", "y")


def hyper_degree_set_clique(spark, sf_dir):
    return C.degree_set(C.hyper_degrees(_triples(spark, sf_dir), "clique"))


def hyper_degree_set_star(spark, sf_dir):
    return C.degree_set(C.hyper_degrees(_triples(spark, sf_dir), "star"))


def communities(spark, sf_dir):
    return _communities(spark, sf_dir)


def community_sizes(spark, sf_dir):
    return _communities(spark, sf_dir).groupBy("community_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def community_order(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return C.community_order(t, C.communities_of_triples(t))


def node_overlap_count(spark, sf_dir):
    return C.node_overlap(_communities(spark, sf_dir))


def uncovered_nodes(spark, sf_dir):
    e = part_graph(spark, sf_dir)
    covered = C.get_communities(e, S.closed_neighborhood_jaccard(THRESHOLD)).select("node").distinct()
    return node_profile(e).select("node").join(covered, "node", "left_anti")


def node_community(spark, sf_dir):
    """seed, node: the communities of the smallest node that is in any, of the smallest that is in one but is no center, and of the largest."""
    e = part_graph(spark, sf_dir)
    p = S.closed_neighborhood_jaccard(THRESHOLD)
    t = cut(C.admissible_triples(e, p))
    inside = t.select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()
    centers = t.select(F.explode(F.when(F.col("n_edges") == 3, F.array("a", "b", "c")).otherwise(F.array("center"))).alias("node"))
    ends = inside.agg(F.min("node"), F.max("node")).first()
    seeds = {*ends, inside.join(centers, "node", "left_anti").agg(F.min("node")).first()[0]} - {None}
    found = [C.get_node_community(e, p, s).select(F.lit(s).alias("seed"), "node") for s in sorted(seeds)]
    return reduce(DataFrame.unionAll, found) if found else inside.select(F.col("node").alias("seed"), "node")


def threshold_report(spark, sf_dir):
    return C.threshold_report(part_graph(spark, sf_dir), THRESHOLDS)


def threshold_sweep_counts(spark, sf_dir):
    c = C.threshold_communities(part_graph(spark, sf_dir), THRESHOLDS)
    return c.groupBy("threshold").agg(F.countDistinct("community_id").alias("communities"), F.count(F.lit(1)).alias("memberships"))


def graph_components(spark, sf_dir):
    return components(part_graph(spark, sf_dir), a="src", b="dst")


def pair_counts(spark, sf_dir):
    return O.pair_counts(_communities(spark, sf_dir))


def avg_threshold(spark, sf_dir):
    return S.avg_threshold(part_graph(spark, sf_dir), 0.6).select(F.round("threshold", 9).alias("threshold"))


def representative_thresholds(spark, sf_dir):
    return S.representative_thresholds(part_graph(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"))


def _covers(spark, sf_dir):
    """Customers by nation, and by market segment plus one community of those in debt (overlapping)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    truth = c.select(F.col("c_nationkey").cast("string").alias("community_id"), F.col("c_custkey").alias("node"))
    found = c.select(F.col("c_mktsegment").alias("community_id"), F.col("c_custkey").alias("node"))
    debt = c.where("c_acctbal < 0").select(F.lit("debt").alias("community_id"), F.col("c_custkey").alias("node"))
    return truth, found.unionAll(debt), c.agg(F.count(F.lit(1)).alias("n"))


def omega_of_covers(spark, sf_dir):
    return O.omega_index(*_covers(spark, sf_dir)).select(F.round("omega", 9).alias("omega"))


def omega_direct(spark, sf_dir):
    """The same over all customers by the counts of every pair in either cover, a cross-check."""
    return O.omega_direct(*_covers(spark, sf_dir)).select(F.round("omega", 9).alias("omega"))


def _rings(spark, sf_dir):
    return G.rings_of_text(table(spark, sf_dir, "shapes_table"))


def ring_offsets(spark, sf_dir):
    return G.ring_offsets(_rings(spark, sf_dir))


def ring_truth(spark, sf_dir):
    return G.ring_truth(_rings(spark, sf_dir))


def ring_lattice_edges(spark, sf_dir):
    return G.ring_lattice(_rings(spark, sf_dir))


def ring_edge_counts(spark, sf_dir):
    return G.edge_count(_rings(spark, sf_dir))


def shapes_rebuilt(spark, sf_dir):
    return G.shapes_table(_rings(spark, sf_dir))


def _merges(spark, sf_dir):
    """The first node of every odd ring is absorbed by the first node of the ring before it."""
    r = G.ring_offsets(_rings(spark, sf_dir))
    odd = r.where("ring % 2 = 1").select("shape", (F.col("ring") - 1).alias("ring"), F.col("offset").alias("absorbed"))
    return odd.join(r.select("shape", "ring", F.col("offset").alias("surviving")), ["shape", "ring"]).select("shape", "absorbed", "surviving")


def overlap_contract(spark, sf_dir):
    return G.contract_edges(G.ring_lattice(_rings(spark, sf_dir)), _merges(spark, sf_dir), ["shape"])


def overlap_truth(spark, sf_dir):
    return G.contract_truth(G.ring_truth(_rings(spark, sf_dir)), _merges(spark, sf_dir), ["shape"])


def plan_units(spark, sf_dir):
    return sweep.plan_units(table(spark, sf_dir, "shapes_table"), [0, 5, 10], 3).select("traj", "shape", "overlap_pct", "run", "seed")


def valid_configs(spark, sf_dir):
    return sweep.valid_configs([400, 600], [4, 7, 8, 16], [8, 25, 50, 100], spark)


def shape_problems(spark, sf_dir):
    return sweep.shape_problems(_rings(spark, sf_dir))


def predicted_cost(spark, sf_dir):
    t = table(spark, sf_dir, "shapes_table")
    return t.select("shape", F.round(sweep.predicted_ms(F.col("n"), F.col("edges")), 6).alias("ms"))


#: Published times of a detection call: nodes, edges, milliseconds.
COST_SAMPLES = ((400, 1600, 36.2), (400, 3200, 158.5), (400, 4000, 323.3), (800, 6400, 352.3), (1200, 9600, 600.7), (2000, 18400, 2120.6), (2000, 16000, 1187.8))


def cost_model_error(spark, sf_dir):
    samples = spark.createDataFrame(list(COST_SAMPLES), "n int, edges int, ms double")
    return sweep.cost_model_error(samples).select(F.round("worst_error", 9).alias("worst_error"))


def predicted_hours(spark, sf_dir):
    t = table(spark, sf_dir, "shapes_table")
    return sweep.predicted_hours(t, 924, 20).select("shape", F.round("hours", 9).alias("hours"))


def _sweep(spark, sf_dir):
    """Snapshots and truth of all shapes after each of 100 steps and before the first."""
    shapes = table(spark, sf_dir, "shapes_table")
    rings = cut(G.rings_of_text(shapes))
    units = cut(sweep.plan_units(shapes, [0, 5], 2))
    return sweep.build_units(units, rings, 100)


def rewire_snapshots(spark, sf_dir):
    """Edges of each snapshot: the number never changes."""
    snaps, _ = _sweep(spark, sf_dir)
    return snaps.distinct().groupBy("traj", "step").agg(F.count(F.lit(1)).alias("edges"))


def sweep_argmax(spark, sf_dir):
    snaps, truth = _sweep(spark, sf_dir)
    return sweep.argmax_per_step(sweep.sweep_snapshots(snaps, truth, sweep.t_grid_uniform()))


def adaptive_walk(spark, sf_dir):
    snaps, truth = _sweep(spark, sf_dir)
    return sweep.adaptive_walk(sweep.sweep_snapshots(snaps, truth, sweep.t_grid_uniform()))


def sweep_at_start(spark, sf_dir):
    """traj, omega: before any rewiring and without overlap the best threshold finds every shape's rings."""
    shapes = table(spark, sf_dir, "shapes_table")
    rings = cut(G.rings_of_text(shapes))
    snaps, truth = sweep.build_units(cut(sweep.plan_units(shapes, [0], 2)), rings, 100, at=[0])
    best = sweep.argmax_per_step(sweep.sweep_snapshots(snaps, truth, sweep.t_grid_uniform()))
    return best.select("traj", F.round("omega_at_argmax", 9).alias("omega"))


def rewire_invariants(spark, sf_dir):
    """traj, steps, different numbers of edges and of ends beyond the shape's nodes: rewiring keeps edges, and without overlap they are the shape's."""
    shapes = table(spark, sf_dir, "shapes_table")
    snaps, _ = _sweep(spark, sf_dir)
    per = snaps.where("src < dst").groupBy("traj", "step").agg(F.count_distinct("src", "dst").alias("edges"), F.max("dst").alias("top"))
    per = per.groupBy("traj").agg(F.count(F.lit(1)).alias("steps"), F.min("edges").alias("lo"), F.max("edges").alias("hi"), F.max("top").alias("top"))
    units = sweep.plan_units(shapes, [0, 5], 2).join(shapes.select("shape", F.col("edges").alias("own"), "n"), "shape")
    return per.join(units, "traj").select(
        "traj", "steps", (F.col("lo") == F.col("hi")).alias("edges_kept"),
        F.when(F.col("overlap_pct") == 0, F.col("lo") == F.col("own")).otherwise(F.col("lo") <= F.col("own")).alias("edges_of_shape"), (F.col("top") < F.col("n")).alias("nodes_of_shape"),
    )


def label_propagation_check(spark, sf_dir):
    """Nodes, those with more than one label, and those that hear another label more often than their own; none of the latter."""
    e = part_graph(spark, sf_dir)
    labels, _ = settle(baselines.label_propagation(e))
    heard = adjacency(e).join(labels.select(F.col("node").alias("nbr"), "community_id"), "nbr").select("node", "community_id").unionAll(labels.select("node", "community_id"))
    counted = heard.groupBy("node", "community_id").agg(F.count(F.lit(1)).alias("c")).join(labels.withColumnRenamed("community_id", "own"), "node")
    per = counted.groupBy("node").agg(F.max(F.when(F.col("community_id") == F.col("own"), F.col("c"))).alias("mine"), F.max("c").alias("most"), F.count_distinct("own").alias("labels"))
    return per.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("labels") > 1).alias("of_two_labels"), F.count_if(F.col("mine") < F.col("most")).alias("unsettled"))


def label_propagation(spark, sf_dir):
    return baselines.label_propagation(part_graph(spark, sf_dir))


def speaker_listener(spark, sf_dir):
    return baselines.speaker_listener(part_graph(spark, sf_dir))


def ego_communities(spark, sf_dir):
    return baselines.ego_communities(part_graph(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        pair_similarity, open_jaccard_pairs, common_neighbor_pairs, user_predicate_pairs, python_predicate_pairs, node_profiles, two_hop_nodes,
        triangles, candidate_triples, admissible_triples, hypergraph_size, hyper_edges_star, hyper_edges_clique, hyper_degree_set_clique, hyper_degree_set_star,
        communities, community_sizes, community_order, node_overlap_count, uncovered_nodes, node_community,
        threshold_report, threshold_sweep_counts, graph_components, pair_counts, avg_threshold, representative_thresholds, omega_of_covers, omega_direct,
        ring_offsets, ring_truth, ring_lattice_edges, ring_edge_counts, shapes_rebuilt, overlap_contract, overlap_truth, plan_units, valid_configs,
        shape_problems, predicted_cost, cost_model_error, predicted_hours, rewire_snapshots, rewire_invariants, sweep_at_start, sweep_argmax, adaptive_walk, label_propagation, label_propagation_check, speaker_listener, ego_communities,
    )
}

_GRAPH = """
WITH RECURSIVE op AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT a.p AS src, b.p AS dst FROM op a JOIN op b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
adj AS MATERIALIZED (SELECT src AS node, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e),
deg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1),
w AS MATERIALIZED (SELECT a.node AS k, a.nbr AS x, b.nbr AS y FROM adj a JOIN adj b ON a.node = b.node AND a.nbr < b.nbr),
cm AS (SELECT x, y, count(*) AS common FROM w GROUP BY 1, 2),
pr AS (SELECT coalesce(cm.x, e.src) AS x, coalesce(cm.y, e.dst) AS y, coalesce(common, 0) AS common, CAST(e.src IS NOT NULL AS INT) AS adjacent
       FROM cm FULL JOIN e ON cm.x = e.src AND cm.y = e.dst),
ps AS MATERIALIZED (SELECT x, y, common, adjacent, dx.d AS deg_x, dy.d AS deg_y,
       CAST(common + 2 * adjacent AS DOUBLE) / CAST(dx.d + dy.d + 2 - common - 2 * adjacent AS DOUBLE) AS jaccard,
       CAST(common AS DOUBLE) / CAST(dx.d + dy.d - common AS DOUBLE) AS open_jaccard
       FROM pr JOIN deg dx ON dx.node = x JOIN deg dy ON dy.node = y),
ct AS MATERIALIZED (SELECT l[1] AS a, l[2] AS b, l[3] AS c, count(*) AS centers, min([k, x, y]) AS key FROM (SELECT list_sort([k, x, y]) AS l, k, x, y FROM w) GROUP BY ALL)
"""
_TRIPLES = _GRAPH + """,
tr AS MATERIALIZED (SELECT ct.a, ct.b, ct.c, ct.key, least(q1.jaccard, q2.jaccard, q3.jaccard) AS strength FROM ct
       JOIN ps q1 ON q1.x = a AND q1.y = b JOIN ps q2 ON q2.x = a AND q2.y = c JOIN ps q3 ON q3.x = b AND q3.y = c),
ta AS MATERIALIZED (SELECT * FROM tr WHERE strength >= 0.15),
tp AS (SELECT a AS x, b AS y, a, b, c, key FROM ta UNION ALL SELECT a, c, a, b, c, key FROM ta UNION ALL SELECT b, c, a, b, c, key FROM ta),
m AS (SELECT x, y, count(*) AS m FROM tp GROUP BY 1, 2)
"""
_N = "1000000000"
_CC = _TRIPLES + f""",
lk AS (SELECT a * {_N} + b AS u, a * {_N} + c AS v FROM ta UNION SELECT a * {_N} + b, b * {_N} + c FROM ta),
l2 AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk),
cc(id, lab) USING KEY (id) AS (SELECT DISTINCT u, u FROM l2
   UNION SELECT l2.u, min(cc.lab) FROM cc JOIN l2 ON l2.v = cc.id JOIN recurring.cc AS now ON now.id = l2.u GROUP BY l2.u, now.lab HAVING min(cc.lab) < now.lab),
cn AS (SELECT DISTINCT (lab // {_N}) || '-' || (lab % {_N}) AS community_id, node FROM
       (SELECT lab, id // {_N} AS node FROM cc UNION ALL SELECT lab, id % {_N} FROM cc))
"""
_STAR = """, f AS (SELECT x, y, min(key) AS fk FROM tp GROUP BY 1, 2), ff AS (SELECT f.x, f.y, tp.a, tp.b, tp.c FROM f JOIN tp ON f.x = tp.x AND f.y = tp.y AND f.fk = tp.key),
st AS (SELECT ff.a AS a1, ff.b AS b1, ff.c AS c1, tp.a AS a2, tp.b AS b2, tp.c AS c2, tp.x, tp.y FROM tp JOIN ff ON tp.x = ff.x AND tp.y = ff.y
       WHERE (tp.a, tp.b, tp.c) <> (ff.a, ff.b, ff.c))"""
_CLIQUE = """, cl AS (SELECT p.a AS a1, p.b AS b1, p.c AS c1, q.a AS a2, q.b AS b2, q.c AS c2, p.x, p.y FROM tp p JOIN tp q ON p.x = q.x AND p.y = q.y AND (p.a, p.b, p.c) < (q.a, q.b, q.c))"""
_USER = _GRAPH + "SELECT x, y FROM ps WHERE common >= 1 AND abs(deg_x - deg_y) <= 1"
_SET = "SELECT '{' || coalesce(string_agg(DISTINCT degree, ',' ORDER BY degree), '') || '}' AS degree_set FROM g"
_OMEGA = """
WITH cover AS ({cover}),
t AS (SELECT 1 AS s, c_nationkey::VARCHAR AS k, c_custkey AS v FROM cover UNION ALL SELECT 2, c_mktsegment, c_custkey FROM cover
      UNION ALL SELECT 2, 'debt', c_custkey FROM cover WHERE c_acctbal < 0),
n AS (SELECT {n} AS n), tot AS (SELECT n * (n - 1) / 2 AS tt FROM n),
p AS (SELECT a.v AS x, b.v AS y, count(*) FILTER (a.s = 1) AS c1, count(*) FILTER (a.s = 2) AS c2 FROM t a JOIN t b ON a.s = b.s AND a.k = b.k AND a.v < b.v GROUP BY 1, 2),
h AS (SELECT c1, c2, count(*)::DOUBLE AS w FROM p GROUP BY 1, 2 UNION ALL SELECT 0, 0, (SELECT tt FROM tot) - (SELECT count(*) FROM p)),
f1 AS (SELECT c1 AS k, sum(w) AS f FROM h GROUP BY 1), f2 AS (SELECT c2 AS k, sum(w) AS f FROM h GROUP BY 1),
z AS (SELECT (SELECT sum(w) FROM h WHERE c1 = c2) / tt AS ob, (SELECT sum(f1.f * f2.f) FROM f1 JOIN f2 USING (k)) / tt / tt AS ex FROM tot)
SELECT round((ob - ex) / (1 - ex), 9) AS omega FROM z"""
_RINGS = """
WITH rr AS (SELECT shape, unnest(range(len(string_split(sizes, ' ')))) AS i, string_split(sizes, ' ') AS ss, string_split(zs, ' ') AS zz FROM shapes_table),
r AS (SELECT shape, CAST(i AS INT) AS ring, CAST(ss[i + 1] AS INT) AS size, CAST(zz[i + 1] AS INT) AS z FROM rr),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY shape ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r),
tn AS (SELECT shape, ring AS community_id, "offset" + unnest(range(size)) AS node FROM o),
ks AS (SELECT shape, size, "offset", unnest(range(1, z // 2 + 1)) AS k FROM o),
es AS (SELECT shape, size, "offset" AS f, k, unnest(range(size)) AS i FROM ks),
e AS (SELECT DISTINCT shape, least(f + i, f + (i + k) % size) AS src, greatest(f + i, f + (i + k) % size) AS dst FROM es),
mg AS (SELECT b.shape, b."offset" AS absorbed, a."offset" AS surviving FROM o a JOIN o b ON a.shape = b.shape AND b.ring = a.ring + 1 AND b.ring % 2 = 1)
"""

ORACLE_SQL = {
    "pair_similarity": _GRAPH + "SELECT x, y, common, adjacent, deg_x, deg_y, round(jaccard, 9) AS jaccard, round(open_jaccard, 9) AS open_jaccard FROM ps",
    "open_jaccard_pairs": _GRAPH + "SELECT x, y FROM ps WHERE open_jaccard >= 0.25",
    "common_neighbor_pairs": _GRAPH + "SELECT x, y FROM ps WHERE common >= 2",
    "user_predicate_pairs": _USER,
    "python_predicate_pairs": _USER,
    "node_profiles": _GRAPH + "SELECT node, string_agg(nbr, ' ' ORDER BY nbr) AS neighbors, count(*) AS degree FROM adj GROUP BY node",
    "two_hop_nodes": _GRAPH + ", s AS (SELECT min(src) AS s FROM e) SELECT DISTINCT nbr AS node FROM (SELECT nbr FROM adj, s WHERE node = s UNION ALL "
    "SELECT b.nbr FROM adj a JOIN adj b ON a.nbr = b.node, s WHERE a.node = s), s WHERE nbr <> s",
    "triangles": """WITH op AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
       e AS MATERIALIZED (SELECT DISTINCT a.p AS src, b.p AS dst FROM op a JOIN op b ON a.o = b.o AND a.p < b.p)
       SELECT x.src AS a, count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst GROUP BY 1""",
    "candidate_triples": _GRAPH + "SELECT a, b, c, CASE WHEN centers = 3 THEN 3 ELSE 2 END AS n_edges FROM ct",
    "admissible_triples": _TRIPLES + "SELECT a, b, c, round(strength, 9) AS strength FROM ta",
    "hypergraph_size": _TRIPLES + "SELECT CAST(sum(m) // 3 AS BIGINT) AS h_nodes, CAST(sum(m - 1) AS BIGINT) AS star_edges, CAST(sum(m * (m - 1) // 2) AS BIGINT) AS clique_edges FROM m",
    "hyper_edges_star": _TRIPLES + _STAR + " SELECT * FROM st",
    "hyper_edges_clique": _TRIPLES + _CLIQUE + " SELECT * FROM cl",
    "hyper_degree_set_clique": _TRIPLES + ", g AS (SELECT a, b, c, CAST(sum(m - 1) AS BIGINT) AS degree FROM tp JOIN m USING (x, y) GROUP BY 1, 2, 3) " + _SET,
    "hyper_degree_set_star": _TRIPLES + _STAR + ", d AS (SELECT a1 AS a, b1 AS b, c1 AS c FROM st UNION ALL SELECT a2, b2, c2 FROM st), "
    "n AS (SELECT a, b, c, count(*) AS g FROM d GROUP BY ALL), g AS (SELECT coalesce(n.g, 0) AS degree FROM ta LEFT JOIN n USING (a, b, c)) " + _SET,
    "communities": _CC + "SELECT * FROM cn",
    "community_sizes": _CC + "SELECT community_id, count(*) AS n_nodes FROM cn GROUP BY 1",
    "community_order": _CC + f", fk AS (SELECT (cc.lab // {_N}) || '-' || (cc.lab % {_N}) AS community_id, min(key) AS k FROM ta JOIN cc ON cc.id = a * {_N} + b GROUP BY 1) "
    "SELECT community_id, CAST(row_number() OVER (ORDER BY k) AS INT) AS rank FROM fk",
    "node_overlap_count": _CC + "SELECT node, count(*) AS n_communities FROM cn GROUP BY 1",
    "uncovered_nodes": _CC + "SELECT node FROM deg WHERE node NOT IN (SELECT node FROM cn)",
    "node_community": _CC + f""", ce AS (SELECT ta.a, ta.b, ta.c, w.k, w.x, w.y FROM w JOIN ta ON list_sort([w.k, w.x, w.y]) = [ta.a, ta.b, ta.c]),
       no AS (SELECT a AS n FROM ta UNION SELECT b FROM ta UNION SELECT c FROM ta),
       se AS (SELECT min(n) AS s FROM no UNION SELECT max(n) FROM no UNION SELECT min(n) FROM no WHERE n NOT IN (SELECT k FROM ce)),
       ft AS (SELECT s, a, b, CASE WHEN k = s THEN [0, x, y] ELSE [1, k, CASE WHEN x = s THEN y ELSE x END] END AS o FROM ce JOIN se ON s IN (a, b, c)),
       f1 AS (SELECT s, arg_min(a * {_N} + b, o) AS q FROM ft GROUP BY 1)
       SELECT DISTINCT s AS seed, cn.node FROM f1 JOIN cc ON cc.id = q JOIN cn ON community_id = (cc.lab // {_N}) || '-' || (cc.lab % {_N})""",
    "threshold_report": _GRAPH + """, tr AS (SELECT ct.a, ct.b, ct.c, ct.key, least(q1.jaccard, q2.jaccard, q3.jaccard) AS strength FROM ct
       JOIN ps q1 ON q1.x = a AND q1.y = b JOIN ps q2 ON q2.x = a AND q2.y = c JOIN ps q3 ON q3.x = b AND q3.y = c),
       g AS (SELECT unnest([0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS threshold), ta AS (SELECT * FROM tr JOIN g ON strength >= threshold),
       tp AS (SELECT threshold, a AS x, b AS y, a, b, c, key FROM ta UNION ALL SELECT threshold, a, c, a, b, c, key FROM ta UNION ALL SELECT threshold, b, c, a, b, c, key FROM ta),
       m AS (SELECT threshold, x, y, count(*) AS m, arg_min([a, b, c], key) AS f FROM tp GROUP BY ALL),
       st AS (SELECT tp.threshold, [tp.a, tp.b, tp.c] AS p, f FROM tp JOIN m USING (threshold, x, y) WHERE [tp.a, tp.b, tp.c] <> f),
       en AS (SELECT threshold, p FROM st UNION ALL SELECT threshold, f FROM st), dn AS (SELECT threshold, p, count(*) AS g FROM en GROUP BY ALL),
       dg AS (SELECT DISTINCT ta.threshold, coalesce(g, 0) AS g FROM ta LEFT JOIN dn ON dn.threshold = ta.threshold AND p = [a, b, c]),
       ds AS (SELECT threshold, '{' || string_agg(g, ',' ORDER BY g) || '}' AS degree_set FROM dg GROUP BY 1)
       SELECT threshold, CAST(sum(m) // 3 AS BIGINT) AS h_nodes, CAST(sum(m - 1) AS BIGINT) AS star_edges, CAST(sum(m * (m - 1) // 2) AS BIGINT) AS clique_edges, any_value(degree_set) AS degree_set
       FROM m JOIN ds USING (threshold) GROUP BY 1""",
    "graph_components": _GRAPH + """, cc(id, lab) USING KEY (id) AS (SELECT DISTINCT node, node FROM adj UNION SELECT adj.node, min(cc.lab) FROM cc JOIN adj ON adj.nbr = cc.id
       JOIN recurring.cc AS now ON now.id = adj.node GROUP BY adj.node, now.lab HAVING min(cc.lab) < now.lab) SELECT id AS node, lab AS root FROM cc""",
    "pair_counts": _CC + "SELECT p.node AS x, q.node AS y, count(*) AS cnt FROM cn p JOIN cn q ON p.community_id = q.community_id AND p.node < q.node GROUP BY 1, 2",
    "avg_threshold": _GRAPH + "SELECT round(sum(jaccard) / count(*) * 0.6, 9) AS threshold FROM ps",
    "representative_thresholds": _GRAPH + """, s AS (SELECT min(src) AS s FROM e) SELECT DISTINCT round(t, 9) AS threshold FROM (SELECT jaccard AS t FROM ps, s WHERE x = s OR y = s
       UNION ALL SELECT 0.0 UNION ALL SELECT 1.0 UNION ALL SELECT sum(jaccard) / count(*) * 0.6 FROM ps)""",
    "omega_of_covers": _OMEGA.format(cover="SELECT * FROM customer", n="(SELECT count(*) FROM customer)"),
    "omega_direct": _OMEGA.format(cover="SELECT * FROM customer", n="(SELECT count(*) FROM customer)"),
    "ring_offsets": _RINGS + 'SELECT shape, ring, size, z, "offset" FROM o',
    "ring_truth": _RINGS + "SELECT * FROM tn",
    "ring_lattice_edges": _RINGS + "SELECT * FROM e",
    "ring_edge_counts": _RINGS + "SELECT shape, CAST(sum(size * z // 2) AS BIGINT) AS edges FROM r GROUP BY 1",
    "shapes_rebuilt": "SELECT shape, sizes, zs, n, rings, ring_size, edges, mean_degree, distinct_z, z_min, z_max FROM shapes_table",
    "overlap_contract": _RINGS + """SELECT DISTINCT shape, least(u, v) AS src, greatest(u, v) AS dst FROM (SELECT e.shape, coalesce(a.surviving, src) AS u, coalesce(b.surviving, dst) AS v
       FROM e LEFT JOIN mg a ON a.shape = e.shape AND a.absorbed = src LEFT JOIN mg b ON b.shape = e.shape AND b.absorbed = dst) WHERE u <> v""",
    "overlap_truth": _RINGS + "SELECT DISTINCT tn.shape, community_id, coalesce(surviving, node) AS node FROM tn LEFT JOIN mg ON mg.shape = tn.shape AND absorbed = node",
    "plan_units": """WITH u AS (SELECT shape, o AS overlap_pct, r AS run, printf('%s_o%02d_run%d', shape, o, r) AS traj FROM shapes_table, unnest([0, 5, 10]) x(o), unnest([1, 2, 3]) y(r))
       SELECT traj, shape, overlap_pct, run, CAST('0x' || substr(md5(traj), 1, 8) AS BIGINT) AS seed FROM u""",
    "valid_configs": "SELECT n, z, ring_size FROM unnest([400, 600]) a(n), unnest([4, 7, 8, 16]) b(z), unnest([8, 25, 50, 100]) c(ring_size) WHERE n % ring_size = 0 AND z % 2 = 0 AND z < ring_size",
    "shape_problems": _RINGS + """, g AS (SELECT shape, count(DISTINCT size) AS s, count(DISTINCT z) AS z, sum(size * (z // 2)) AS e FROM r GROUP BY 1)
       SELECT shape, NULL::INT AS ring, 'ring sizes are not uniform' AS problem FROM g WHERE s > 1 UNION ALL SELECT shape, NULL, 'z does not vary across rings' FROM g WHERE z < 2
       UNION ALL SELECT shape, NULL, 'the edges cannot be divided into the steps' FROM g WHERE e % 100 <> 0
       UNION ALL SELECT shape, ring, 'z is odd' FROM r WHERE z % 2 <> 0 UNION ALL SELECT shape, ring, 'z is not smaller than the ring size' FROM r WHERE z >= size""",
    "sweep_at_start": "SELECT printf('%s_o00_run%d', shape, r) AS traj, 1.0::DOUBLE AS omega FROM shapes_table, unnest([1, 2]) y(r)",
    "rewire_invariants": "SELECT printf('%s_o%02d_run%d', shape, o, r) AS traj, 101::BIGINT AS steps, true AS edges_kept, true AS edges_of_shape, true AS nodes_of_shape FROM shapes_table, unnest([0, 5]) x(o), unnest([1, 2]) y(r)",
    "label_propagation_check": _GRAPH + "SELECT count(*) AS nodes, 0::BIGINT AS of_two_labels, 0::BIGINT AS unsettled FROM deg",
    "predicted_cost": "SELECT shape, round(exp(-7.18 + 1.24 * ln(n) + 2.35 * ln(edges / n)), 6) AS ms FROM shapes_table",
    "cost_model_error": "SELECT round(max(abs(exp(-7.18 + 1.24 * ln(n) + 2.35 * ln(e / n)) / ms - 1)), 9) AS worst_error FROM (VALUES "
    + ", ".join(f"({n}, {e}, {ms}::DOUBLE)" for n, e, ms in COST_SAMPLES) + ") v(n, e, ms)",
    "predicted_hours": "SELECT shape, round(exp(-7.18 + 1.24 * ln(n) + 2.35 * ln(edges / n)) * 18480.0::DOUBLE * 1.92::DOUBLE / 3600000, 9) AS hours FROM shapes_table",
    "threshold_sweep_counts": _GRAPH + """, tr AS (SELECT ct.a, ct.b, ct.c, least(q1.jaccard, q2.jaccard, q3.jaccard) AS strength FROM ct
       JOIN ps q1 ON q1.x = a AND q1.y = b JOIN ps q2 ON q2.x = a AND q2.y = c JOIN ps q3 ON q3.x = b AND q3.y = c),
       g(i, t) AS (VALUES (1, 0.1::DOUBLE), (2, 0.15::DOUBLE), (3, 0.2::DOUBLE)),
       ta AS (SELECT i * 10000000000000000 AS o, a, b, c FROM tr JOIN g ON strength >= t),
       lk AS (SELECT o + a * 1000000000 + b AS u, o + a * 1000000000 + c AS v FROM ta UNION SELECT o + a * 1000000000 + b, o + b * 1000000000 + c FROM ta),
       l2 AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk),
       cc(id, lab) USING KEY (id) AS (SELECT DISTINCT u, u FROM l2
         UNION SELECT l2.u, min(cc.lab) FROM cc JOIN l2 ON l2.v = cc.id JOIN recurring.cc AS now ON now.id = l2.u GROUP BY l2.u, now.lab HAVING min(cc.lab) < now.lab),
       p AS (SELECT lab, id // 10000000000000000 AS i, id % 10000000000000000 AS q FROM cc),
       cn AS (SELECT DISTINCT i, lab, node FROM (SELECT i, lab, q // 1000000000 AS node FROM p UNION ALL SELECT i, lab, q % 1000000000 FROM p))
       SELECT g.t AS threshold, count(DISTINCT lab) AS communities, count(*) AS memberships FROM cn JOIN g USING (i) GROUP BY 1""",
}
