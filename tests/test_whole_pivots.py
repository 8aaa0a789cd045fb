"""The wide tables hold every run and every threshold that occurs."""

from triloom.plans import report_queries as Q, reports as R


def test_pivots_are_whole(spark, tmp_path):
    rows = [
        ("s", 0, "a", 0.0, 1, 0.9, 0.05), ("s", 0, "a", 0.0, 4, 0.8, 0.1), ("s", 0, "a", 0.0, 19999, 0.7, 0.41), ("s", 0, "a", 0.5, 2, 0.6, None),
        ("u", 0, "a", 0.0, 4, 0.5, 0.41), ("u", 0, "a", 0.0, None, 0.4, 0.33), ("u", 5, "a", 0.0, 126, float("nan"), 0.2),
    ]
    schema = "shape string, overlap_pct int, algo string, p double, run int, omega double, t_argmax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/records.parquet")
    wide = Q.pivot_runs(spark, str(tmp_path))
    assert wide.columns == ["shape", "overlap_pct", "algo", "p", *[f"{k}_{r}" for k in ("run", "t_run") for r in (1, 2, 4, 126, 19999)]]
    got = {tuple(r[:4]): r for r in wide.collect()}
    assert [got["s", 0, "a", 0.0][f"{k}_{r}"] for r in (1, 4, 19999) for k in ("run", "t_run")] == [0.9, 0.05, 0.8, 0.1, 0.7, 0.41]
    assert set(got) == {r[:4] for r in rows}
    grid = Q.pivot_thresholds(spark, str(tmp_path))
    assert grid.columns == ["shape", "t=0.05", "t=0.10", "t=0.33", "t=0.41"]
    assert {tuple(r) for r in grid.collect()} == {("s", 0.9, 0.8, None, 0.7), ("u", None, None, 0.4, 0.5)}


def test_pivot_runs_makes_its_columns_last(spark):
    """Nothing is as wide as the result before the step that returns it; missing cells cost nothing until then."""
    runs = [-3, *range(0, 900, 3), 19999]
    rows = [("s'\"\\é", None, "a", float("nan"), r, r / 7, None if r % 2 else -r / 3) for r in runs]
    rows += [(None, 2**31 - 1, "", -0.0, 3, float("nan"), float("inf")), (None, 2**31 - 1, "", 0.0, 3, -0.5, 0.25), ("u", -1, "a", 1e-320, None, 0.5, 0.5), ("u", -1, "a", 0.1, 4, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "shape string, overlap_pct int, algo string, p double, run int, omega double, t_argmax double")
    by = ["shape", "overlap_pct", "algo", "p"]
    wide = R.pivot_runs(df, by, runs)
    assert wide.dtypes == [*df.dtypes[:4], *[(f"{k}_{r}", "double") for k in ("run", "t_run") for r in runs]]
    held = wide._jdf.queryExecution().executedPlan().initialPlan().children().head()
    while True:
        assert held.output().size() < 20
        if held.children().isEmpty():
            break
        held = held.children().head()
    got = {(r["shape"], r["overlap_pct"], r["algo"], repr(r["p"])): {c: x for c, x in r.asDict().items() if c not in by and x is not None} for r in wide.collect()}
    assert got == {
        ("s'\"\\é", None, "a", "nan"): {**{f"run_{r}": r / 7 for r in runs}, **{f"t_run_{r}": -r / 3 for r in runs if r % 2 == 0}},
        (None, 2**31 - 1, "", "0.0"): {"run_3": -0.5, "t_run_3": float("inf")}, ("u", -1, "a", repr(1e-320)): {}, ("u", -1, "a", "0.1"): {},
    }
    assert R.pivot_runs(df, by, []).count() == 4
