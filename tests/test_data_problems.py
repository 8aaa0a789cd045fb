"""Deliveries, consolidation and schema drift: edge cases against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from triloom.functions import naming as N
from triloom.operators import schema_drift as D
from triloom.operators.deliveries import DeliveryStore, merge_deliveries, record_identifier
from triloom.runtime import new_table_dir
from triloom.sources import compaction as K

T0 = dt.datetime(2026, 1, 1)
REC = "rec_id bigint, run_id string, p double, algo string, loaded_at timestamp_ntz"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("u4x100z8_o01_run12", "U4X100Z8-O1-RUN00012", True), (" n400_r80x5_skewed_o00_run2\t", "n400-r80x5-skewed_o0_run2", True),
        ("u4x100z8_o01_run1", "u4x100z8_o01_run11", False), ("u4x100z8_o1_run1", "u4x100z8_o10_run1", False), ("odd name", "Odd-Name", True),
    ],
)
def test_trajectory_key(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(N.trajectory_key("a"), N.trajectory_key("b")).first()
    assert (r[0] == r[1]) is same


def test_names_of_nothing(spark):
    r = spark.createDataFrame([(None, " -_", float("nan"))], "a string, b string, c double")
    assert list(r.select(N.squeeze("a"), N.squeeze("b"), N.trajectory_key("b"), N.micro_units("c")).first()) == [None] * 4


def store(spark, rows, cuts=(), schema=REC):
    s = DeliveryStore(spark, new_table_dir(spark, "t"), record_identifier())
    df = spark.createDataFrame(rows, schema)
    return merge_deliveries(s, df, "loaded_at", list(cuts)), df


def brute_drop(rows):
    best = {}
    for i, run, p, algo, at, *_ in rows:
        if run is None or p is None or p != p or algo is None:
            continue
        k = (run.strip().lower().replace("-", "_"), round(p * 1e6), algo.strip().lower())
        best.setdefault(k, []).append((at or dt.datetime.min, i))
    return sorted({i for v in best.values() for _, i in v} - {max(v)[1] for v in best.values()})


def test_deliveries_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(1, 400):
        hot = r.random() < 0.34  # one identifier holds a third of all rows
        run = "hot_o01_run1" if hot else r.choice(["a_o01_run1", "A-o01-run1", "b_o02_run3", None])
        p = 0.5 if hot else r.choice([0.1, 0.1000000001, 0.2, None, float("nan")])
        rows.append((i, run, p, "leiden" if hot else r.choice(["leiden", " Leiden", "demon", None]), T0 + dt.timedelta(days=r.randrange(6)) if r.random() < 0.95 else None))
    for cuts in ((), (T0 + dt.timedelta(days=2),), (T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=4))):
        s, df = store(spark, rows, cuts)
        dropped = sorted(x[0] for x in s.dropped().collect())
        assert dropped == brute_drop(rows)
        kept = [x["rec_id"] for x in s.current().collect()]
        assert sorted(kept + dropped) == [x[0] for x in rows]


def test_deliveries_edges(spark):
    twice = [(1, "a_o1_run1", 0.5, "x", T0, "u", "v")] * 3 + [(2, "a_o1_run1", 0.5, "x", T0, "w", "v")]
    s, _ = store(spark, twice, (), REC + ", __home string, __part string")
    assert [r.asDict() for r in s.current().collect()] == [dict(rec_id=2, run_id="a_o1_run1", p=0.5, algo="x", loaded_at=T0, __home="w", __part="v")]
    assert [r[0] for r in s.dropped().collect()] == [1]
    empty, _ = store(spark, [])
    with pytest.raises(ValueError, match="empty"):
        empty.current()


def test_a_batch_is_applied_once(spark):
    s, df = store(spark, [(1, "a_o1_run1", 0.5, "x", T0), (2, "b_o1_run1", 0.5, "x", T0)])
    v = s.state()["version"]
    s.apply(df, "round-0")
    assert s.state()["version"] == v
    late = spark.createDataFrame([(3, "A_o01_run1", 0.5, "X", T0 + dt.timedelta(days=9))], REC)
    before = s.state()["homes"]
    s.apply(late, "late")
    assert sorted(r["rec_id"] for r in s.current().collect()) == [2, 3]
    assert set(s.state()["homes"]) == set(before)  # it went to its identifier's home


def test_index_is_compacted_and_old_versions_are_deleted(spark, monkeypatch):
    from triloom.operators import deliveries

    monkeypatch.setattr(deliveries, "MOST_INDEX", 2)
    rows = [(i, f"r{i % 7}_o1_run1", 0.1 * (i % 3), "x", T0 + dt.timedelta(days=i % 4, minutes=i)) for i in range(60)]
    s = DeliveryStore(spark, new_table_dir(spark, "t"), record_identifier())
    for k in range(5):
        s.apply(spark.createDataFrame(rows[k * 12 : (k + 1) * 12], REC), f"b{k}")
        assert len(s.state()["index"]) <= 2
    kept = sorted(r["rec_id"] for r in s.current().collect())
    assert sorted(r["rec_id"] for r in s.dropped().collect()) == brute_drop(rows) == sorted(set(range(60)) - set(kept))
    assert s.vacuum() > 0
    assert sorted(r["rec_id"] for r in s.current().collect()) == kept
    s.apply(spark.createDataFrame([(99, "r0_o1_run1", 0.0, "x", T0 + dt.timedelta(days=30))], REC), "last")
    assert len(s.current().collect()) == len(kept)
    assert s.vacuum() > 0
    assert s.vacuum() == 0


FILES = "file_id bigint, path string, n_bytes bigint, modified_at timestamp_ntz, content string, kind string, traj_id string"


def files(spark, rows):
    return spark.createDataFrame([(i, p, n, T0 + dt.timedelta(hours=i), c, "?", "?") for i, (p, n, c) in enumerate(rows)], FILES)


def test_consolidation(spark):
    rows = [
        ("x/trajectories/t1/labels.csv", 10, "p,t_argmax,omega_at_argmax\n0.0,0.1,1\n0.05,0.2,nan\n"),
        ("x\\trajectories\\t1\\labels_2.csv", 10, "﻿5.00e-02;0.3;0.9\r\n\r\n.1;0.3;0.9"),
        ("./trajectories/t1/bak/labels (copy).csv", 10, "p,t_argmax,omega_at_argmax\n0.0,0.1,1\n0.05,0.2,nan\n"),
        ("trajectories/t1/init_meta.json", 5, '{"id": "t1"}'), ("trajectories/t2/init_meta.json", 5, '{"id": "t2'), ("trajectories/t2/init_meta.json", 5, '{"a": 1} x'),
        ("trajectories/t2/init_meta.json", 5, "[1]"), ("trajectories/t2/done", 0, ""), ("trajectories/t1/done", None, None), ("trajectories/t3/graphs.npz", 9, None),
        ("trajectories/t3/labels.csv", 9, None), ("nowhere/labels.csv", 9, "0.1,1,1"), (None, None, None), ("trajectories", 1, "x"), ("trajectories/t4/labels.csv", 1, ""),
        ("trajectories/t5/labels.csv", 1, "0.9," + "x" * 1_000_000),
    ]
    got, report, folder = K.consolidate(files(spark, rows), 12)
    want = [("t1", "labels", 0), ("t1", "labels", 50), ("t1", "labels", 100), ("t1", "init_meta", -1), ("t1", "done", -1), ("t2", "done", -1), ("t5", "labels", 900)]
    assert sorted((r["traj_id"], r["kind"], r["p_milli"]) for r in got.collect()) == sorted(want)
    assert got.where("p_milli = 50").first()["body"].endswith("nan")  # the newest file wins
    assert {r["kind"]: (r["records_read"], r["written"]) for r in report.collect()} == {"labels": (7, 4), "init_meta": (1, 1), "done": (2, 2)}
    assert K.consolidate(files(spark, []), 12)[0].count() == 0


def test_groups_follow_the_bytes(spark):
    df = files(spark, [(f"trajectories/t{i:03d}/labels.csv", 100, "0.1,1,1") for i in range(50)])
    plan = K.plan_groups(K.frozen_manifest(df), 1000)
    sizes = [r["count"] for r in plan.groupBy("group_id").count().collect()]
    assert sizes == [10] * 5


CONFORMING = {
    "id": "a", "shape": "s", "sizes": [1, 2], "zs": [2, 2], "n": 3, "rings": 2, "overlap_pct": 1, "overlap": 0.01, "run": 1, "seed": 5, "n_actual": 3,
    "M_actual": 3, "k_step": 1, "p_step": 0.1, "t_step": 0.1, "n_p": 11, "n_t": 11, "merged_pairs": [[1, 2]],
}


def changed(drop=(), **more):
    return json.dumps({k: v for k, v in CONFORMING.items() if k not in drop} | more)


CASES = [
    (changed(), []), (changed(merged_pairs=[], seed=None), []), (changed(overlap=1), []),
    (changed(["shape"], shape_name="s", git_rev="x"), [("shape", "renamed"), ("git_rev", "added")]),
    (changed(["shape", "sizes"], layout={"shape": "s", "sizes": [1]}), [("shape", "renamed"), ("sizes", "renamed")]),
    (changed(["sizes"], sizesPerRing="[1, 2]"), [("sizes", "renamed"), ("sizes", "retyped")]),
    (changed(["sizes"], mean_degree=2.0), [("sizes", "removed"), ("mean_degree", "added")]),
    (changed(["zs"], degrees=[2, 2]), [("zs", "renamed")]), (changed(["sizes", "zs"], degrees=[2], ring_sizes=[3]), [("zs", "renamed"), ("sizes", "renamed")]),
    (changed(["M_actual", "t_step"], edges_actual=5), [("M_actual", "renamed"), ("t_step", "removed")]), (changed(["M_actual"], m_actual=5), [("M_actual", "renamed")]),
    (changed(shape={"name": "s", "rev": 1}, tags=["a"]), [("shape", "retyped"), ("tags", "added")]), (changed(sizes="1 2", run="1"), [("sizes", "retyped"), ("run", "retyped")]),
    (changed(["run"], run_no=1, writer_no=2), [("run", "renamed"), ("writer_no", "added")]), (changed(["run"], dry_run=True), [("run", "removed"), ("dry_run", "added")]),
    (changed(["id"], traj_id="a"), [("id", "renamed")]), (changed(["n_p"], p_points=11), [("n_p", "renamed")]),
    (changed(**{"odd `name`:<x>, y": {"k": [{"z": 1}]}}), [("odd `name`:<x>, y", "added")]),
    ("{", None), (None, None), ("", None), ("[]", None), ('{"a": 1, "a": 2}', None),
]


def test_drift_of_files(spark):
    df = spark.createDataFrame([(i, c, "x", "y") for i, (c, _) in enumerate(CASES)], "file_id bigint, content string, signature string, changes string")
    got = {}
    for r in D.drift_report(df, "file_id", "content", D.INIT_META, "init_meta").collect():
        got.setdefault(r["file_id"], set()).add((r["field"], r["change"]))
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, set()) == set(want or []), text
    assert D.drift_report(df.where("file_id < 0"), "file_id", "content", D.INIT_META, "x").count() == 0
    flat = {r["file_id"]: r for r in D.unify(df, "content", D.INIT_META, ["file_id", "signature"], {"shape": "named"}).collect()}
    assert flat[5]["sizes"] == [1.0, 2.0]
    assert flat[11]["shape"] == "s"
    assert len(flat) == sum(w is not None for _, w in CASES)


def test_drift_of_rows(spark):
    base = {"overlap": 0.1, "n": 4, "z": 2, "ring_size": 2, "t_best": 0.1, "p": 0.0, "score": 0.913842}
    without = lambda *k: {a: b for a, b in base.items() if a not in k}
    rows = [
        (1, base), (1, base | {"overlap": "0,02"}), (2, without("overlap") | {"overlap_pct": 3}), (2, base), (3, without("score") | {"omega": 0.513842, "score_std": 0.1}),
        (4, without("n") | {"n_nodes": 4, "n_runs": 20}), (5, without("t_best")), (5, without("t_best")), (6, without("t_best")), (6, base), (7, without("overlap") | {"ovl": "9 %"}),
    ]
    df = spark.createDataFrame([(f, i, json.dumps(o)) for i, (f, o) in enumerate(rows)], "file_id bigint, row_id bigint, payload string")
    got = {}
    for r in D.drift_report(df, "file_id", "payload", D.P_SWEEP, "p_sweep").collect():
        got.setdefault(r["file_id"], set()).add((r["field"], r["change"]))
    assert got == {
        1: {("overlap", "retyped")}, 2: {("overlap", "renamed")}, 3: {("score", "renamed"), ("score_std", "added")}, 4: {("n", "renamed"), ("n_runs", "added")},
        5: {("t_best", "removed")}, 7: {("overlap", "renamed"), ("overlap", "retyped")},
    }
    flat = {r["row_id"]: r["overlap"] for r in D.unify(df, "payload", D.P_SWEEP, ["row_id"], {"overlap": "fraction"}).collect()}
    assert [flat[1], flat[2], flat[10]] == pytest.approx([0.02, 0.03, 0.09])


def test_flooding_converges():
    tree = D.parse_tree("OBJECT<layout: OBJECT<shape: STRING, sizes: ARRAY<NUM>>, n: NUM>")
    assert tree == ((("layout",), "object"), (("layout", "shape"), "text"), (("layout", "sizes"), "list<number>"), (("n",), "number"))
    scores = D.flood(tree, tuple(D.INIT_META.items()), ())
    assert scores[("layout", "sizes"), "sizes"] > D.LEAST > scores[("n",), "sizes"]


RENAMED = "OBJECT<M: NUM, layout: OBJECT<shape: STRING>, nNodes: NUM, n_runs: NUM, ring_sizes: ARRAY<NUM>, omega: NUM>"


def test_flooded_scores_decide(monkeypatch):
    """Without the flow there is no match, and with the same score for all pairs there are others."""
    reference = {"n": D.NUM, "shape": D.TEXT, "sizes": D.NUM_LIST, "score": D.NUM}
    evidence = [("omega", "score", 0.9), ("n_runs", "score", 0.2)]
    found = D.correspondences(D.parse_tree(RENAMED), reference, evidence)
    assert found == {"n": ("nNodes",), "shape": ("layout", "shape"), "sizes": ("ring_sizes",), "score": ("omega",)}
    monkeypatch.setattr(D, "flood", lambda members, fields, profiles: {(p, f): 0.5 for p, _ in members for f, _ in fields})
    assert D.correspondences(D.parse_tree(RENAMED), reference, evidence) != found
    monkeypatch.undo()
    for share in ("FROM_NAME", "FROM_KIND", "FROM_PROFILE", "FROM_CARRIER"):
        monkeypatch.setattr(D, share, 0.0)
    D.flood.cache_clear()
    assert D.correspondences(D.parse_tree(RENAMED), reference, evidence) == {}
    D.flood.cache_clear()


def test_profiles_decide_between_equal_names():
    reference = {"n": D.NUM}
    tree = D.parse_tree("OBJECT<n_nodes: NUM, n_runs: NUM>")
    assert D.correspondences(tree, reference, [("n_nodes", "n", 0.9)]) == {"n": ("n_nodes",)}
    assert D.correspondences(tree, reference, [("n_runs", "n", 0.9)]) == {"n": ("n_runs",)}


def test_values_without_meaning_have_no_form(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", " ", "[]", "0.930", "400", "12345", "0,1", "a b1", "[8, 16,8]")], "x string")
    got = [r[0] for r in rows.select(D.value_form(F.col("x"))).collect()]
    assert got == [None, None, None, None, "0.999", "400", "99999", "0,9", "a a9", "[9]"]


def test_file_group_report(spark):
    got, _, folder = K.consolidate(files(spark, [("trajectories/t/labels.csv", 10, "0.1,1,1\n0.2,1,1")]), 5)
    assert K.file_sizes(spark, folder).first()["records"] == 2
    assert got.where(F.col("group_id") != 0).count() == 0


@pytest.mark.parametrize("target", [1, 40, 1000])
def test_one_file_for_each_group(spark, target):
    rows = [(f"trajectories/t{i:02d}/labels.csv", 20, f"0.{i},1,1\n0.999,2,2") for i in range(30)]
    _, _, folder = K.consolidate(files(spark, rows), target)
    sizes = K.file_sizes(spark, folder).collect()
    assert len({r["file"] for r in sizes}) == len({r["group_id"] for r in sizes}) == len(sizes) == -(-30 * 20 // max(target, 20))
    assert sum(r["records"] for r in sizes) == 60
