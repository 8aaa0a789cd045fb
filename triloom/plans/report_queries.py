"""Queries over sweep results: the reports on ``records``, ``manifest`` and ``traj_files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.naming import path_parts
from triloom.plans import reports as R, sweep
from triloom.plans.data_queries import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records")


def _mean_curve(spark, sf_dir) -> DataFrame:
    return R.averaged(_records(spark, sf_dir).select("shape", "overlap_pct", "algo", "p", "omega"))


def run_mean_std(spark, sf_dir):
    r = R.run_mean_std(_records(spark, sf_dir), "omega", ["shape", "overlap_pct", "algo"])
    return r.select("shape", "overlap_pct", "algo", "n_runs", *[F.round(c, 9).alias(c) for c in ("mean", "std_samp", "std_pop")])


def strict_mean(spark, sf_dir):
    """Mean and deviation by shape and algorithm, null where any evaluation failed."""
    rows = _records(spark, sf_dir).where("omega IS NOT NULL")
    r = R.stacked_mean_std(rows, ["shape", "algo"])
    return r.select("shape", "algo", *[F.round(R.usable(c), 9).alias(c) for c in ("mean", "std")])


def averaged_curves(spark, sf_dir):
    return _mean_curve(spark, sf_dir).select("shape", "overlap_pct", "algo", "p", F.round("omega_mean", 11).alias("omega_mean"))


def records_dedupe_last(spark, sf_dir):
    rows = _records(spark, sf_dir).select("run_id", "p", "algo", "omega", "loaded_at", "rec_id")
    return R.dedupe_last(rows, ["run_id", "p", "algo"], [F.col("loaded_at"), F.col("rec_id")]).select("rec_id", R.usable("omega").alias("omega"))


def argmax_p(spark, sf_dir):
    """Of each run and algorithm the p with the best omega."""
    return R.best_threshold(_records(spark, sf_dir), ["run_id", "algo"], "omega", "p")


def argmax_floor(spark, sf_dir):
    return R.best_threshold(_records(spark, sf_dir), ["shape", "algo"], "omega", "p", floor=0.95)


def p_crit(spark, sf_dir):
    return R.p_crit(_mean_curve(spark, sf_dir), ["shape", "overlap_pct", "algo"], "omega_mean")


def p_crit_estimate(spark, sf_dir):
    e = R.p_crit_estimate(_records(spark, sf_dir).where("omega IS NOT NULL AND NOT isnan(omega)"), ["shape", "algo"], "run_id")
    return e.select("shape", "algo", F.round("p_crit_est", 9).alias("p_crit_est"))


def coarse_peak(spark, sf_dir):
    """The search over overlaps stops at the first fall of the mean."""
    m = _records(spark, sf_dir).where("omega IS NOT NULL AND NOT isnan(omega)").groupBy("algo", F.col("overlap_pct").cast("double").alias("threshold")).agg(F.round(F.avg("omega"), 9).alias("p_crit_est"))
    return R.coarse_peak(m, ["algo"])


def plateau_width(spark, sf_dir):
    rows = _records(spark, sf_dir).where("step IS NOT NULL")
    w = R.plateau_width(rows, ["run_id", "algo"], 0.01, index="step")
    return w.select("run_id", "algo", F.round("width", 9).alias("width"))


def t_limit(spark, sf_dir):
    rows = _records(spark, sf_dir).where("t_argmax IS NOT NULL AND NOT isnan(t_argmax)").withColumn("t_idx", F.round(F.col("t_argmax") * 100).cast("int"))
    return R.t_limit(rows, 101).select(F.round("t_limit", 9).alias("t_limit"))


def shape_terms(spark, sf_dir):
    return R.shape_terms(table(spark, sf_dir, "shapes_table"))


def shape_spec(spark, sf_dir):
    return R.shape_spec(table(spark, sf_dir, "shapes_table"))


def algorithm_order(spark, sf_dir):
    from pyspark.sql import Window

    names = _records(spark, sf_dir).select("algo").distinct()
    return names.select("algo", F.row_number().over(Window.orderBy(R.algorithm_rank("algo"))).alias("place"))  # a handful of names


def pivot_runs(spark, sf_dir):
    """Columns for every run number that occurs."""
    runs = sorted(r["run"] for r in _records(spark, sf_dir).where("run IS NOT NULL").select("run").distinct().collect())
    return R.pivot_runs(_records(spark, sf_dir), ["shape", "overlap_pct", "algo", "p"], runs)


def pivot_thresholds(spark, sf_dir):
    """A column for every t that occurs, to two decimals."""
    ok = _records(spark, sf_dir).where("omega IS NOT NULL AND NOT isnan(omega)")
    g = ok.groupBy("shape", F.round("t_argmax", 2).alias("t")).agg(F.round(F.avg("omega"), 11).alias("omega"))
    ts = sorted(r["t"] for r in g.where("t IS NOT NULL AND NOT isnan(t)").select("t").distinct().collect())
    return R.pivot_thresholds(g, ["shape"], ts)


def p_slices(spark, sf_dir):
    rows = _records(spark, sf_dir).where("step IS NOT NULL")
    return R.p_slice(rows, [0.0, 0.25, 0.5], 101, "step").groupBy("step", "algo").agg(F.count(F.lit(1)).alias("rows"))


def resume_anti_join(spark, sf_dir):
    """Trajectories of the manifest that have no done file."""
    units = table(spark, sf_dir, "manifest").select(F.lower("traj_id").alias("traj")).distinct()
    parts = path_parts("path")
    files = table(spark, sf_dir, "traj_files").where(F.element_at(parts, -1) == "done")
    done = files.select(F.get(parts, F.array_position(parts, "trajectories").cast("int")).alias("traj"))
    return sweep.pending(units, done)


def duplicate_runs(spark, sf_dir):
    return sweep.duplicate_keys(table(spark, sf_dir, "manifest"), "traj_id")


def records_with_shapes(spark, sf_dir):
    """Rows and mean degree of each shape, joined by name; shapes without a table row keep a null."""
    n = _records(spark, sf_dir).groupBy("shape").agg(F.count(F.lit(1)).alias("rows"))
    return n.join(table(spark, sf_dir, "shapes_table").select("shape", "mean_degree"), "shape", "left")


QUERIES = {
    f.__name__: f
    for f in (
        run_mean_std, strict_mean, averaged_curves, records_dedupe_last, argmax_p, argmax_floor, p_crit, p_crit_estimate, coarse_peak, plateau_width, t_limit,
        shape_terms, shape_spec, algorithm_order, pivot_runs, pivot_thresholds, p_slices, resume_anti_join, duplicate_runs, records_with_shapes,
    )
}

_OK = "WITH v AS (SELECT *, CASE WHEN isnan(omega) THEN NULL ELSE omega END AS o FROM records)"
_CURVE = _OK + ", c AS (SELECT shape, overlap_pct, algo, p, avg(o) AS omega_mean FROM v WHERE o IS NOT NULL GROUP BY ALL)"

ORACLE_SQL = {
    "run_mean_std": _OK + "SELECT shape, overlap_pct, algo, count(o) AS n_runs, round(avg(o), 9) AS mean, round(stddev_samp(o), 9) AS std_samp, round(stddev_pop(o), 9) AS std_pop FROM v GROUP BY ALL",
    "strict_mean": _OK + """, g AS (SELECT shape, algo, count(omega) AS k, count(o) AS good, avg(o) AS m, stddev_pop(o) AS s FROM v GROUP BY ALL)
       SELECT shape, algo, CASE WHEN good < k THEN NULL ELSE round(m, 9) END AS mean, CASE WHEN good < k THEN NULL ELSE round(s, 9) END AS std FROM g WHERE k > 0""",
    "averaged_curves": _CURVE + "SELECT shape, overlap_pct, algo, p, round(omega_mean, 11) AS omega_mean FROM c",
    "records_dedupe_last": "SELECT rec_id, CASE WHEN isnan(omega) THEN NULL ELSE omega END AS omega FROM (SELECT *, row_number() OVER (PARTITION BY run_id, p, algo ORDER BY loaded_at DESC, rec_id DESC) AS nth FROM records) WHERE nth = 1",
    "argmax_p": _OK + "SELECT run_id, algo, p AS t_argmax, o AS omega_at_argmax FROM (SELECT *, row_number() OVER (PARTITION BY run_id, algo ORDER BY o DESC, p) AS nth FROM v WHERE o IS NOT NULL) WHERE nth = 1",
    "argmax_floor": _OK + """SELECT shape, algo, CASE WHEN o <= 0.95 THEN 'nan'::DOUBLE ELSE p END AS t_argmax, o AS omega_at_argmax
       FROM (SELECT *, row_number() OVER (PARTITION BY shape, algo ORDER BY o DESC, p) AS nth FROM v WHERE o IS NOT NULL) WHERE nth = 1""",
    "p_crit": _CURVE + "SELECT shape, overlap_pct, algo, min(p) FILTER (omega_mean < 0.6) AS p_crit FROM c GROUP BY ALL",
    "p_crit_estimate": _OK + ", f AS (SELECT shape, algo, run_id, coalesce(min(p) FILTER (o < 0.6), 1.0) AS c FROM v WHERE o IS NOT NULL GROUP BY ALL) SELECT shape, algo, round(avg(c), 9) AS p_crit_est FROM f GROUP BY ALL",
    "coarse_peak": _OK + """, m AS (SELECT algo, overlap_pct::DOUBLE AS t, round(avg(o), 9) AS s FROM v WHERE o IS NOT NULL AND overlap_pct IS NOT NULL GROUP BY ALL),
       f AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY algo ORDER BY t) THEN 1 ELSE 0 END AS fell FROM m),
       g AS (SELECT *, coalesce(sum(fell) OVER (PARTITION BY algo ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
       SELECT algo, t AS t_best, s AS best FROM (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY s DESC, t) AS nth FROM g WHERE b = 0) WHERE nth = 1""",
    "plateau_width": _OK + """, k AS (SELECT run_id, algo, max(o) AS peak FROM v WHERE step IS NOT NULL GROUP BY ALL),
       i AS (SELECT v.run_id, v.algo, min(step) AS lo, max(step) AS hi FROM v JOIN k USING (run_id, algo) WHERE step IS NOT NULL AND o >= 0.95::DOUBLE * peak GROUP BY ALL)
       SELECT k.run_id, k.algo, CASE WHEN peak IS NULL OR peak <= 0.02 OR lo IS NULL THEN 0.0 ELSE round((hi - lo + 1) * 0.01::DOUBLE, 9) END AS width FROM k LEFT JOIN i USING (run_id, algo)""",
    "t_limit": _OK + """, g AS (SELECT CAST(round(t_argmax * 100) AS INT) AS i, max(o) AS m FROM v WHERE t_argmax IS NOT NULL AND NOT isnan(t_argmax) GROUP BY 1)
       SELECT round(least(1.0, greatest(0.25, coalesce(max(i) / 100.0, 0) + 0.06)), 9)::DOUBLE AS t_limit FROM g WHERE m > 0.02""",
    "shape_terms": """SELECT shape, size, z, count(*) AS count FROM (SELECT shape, unnest(string_split(sizes, ' '))::INT AS size, unnest(string_split(zs, ' '))::INT AS z FROM shapes_table) GROUP BY ALL""",
    "shape_spec": """WITH t AS (SELECT shape, size, z, count(*) AS c FROM (SELECT shape, unnest(string_split(sizes, ' '))::INT AS size, unnest(string_split(zs, ' '))::INT AS z FROM shapes_table) GROUP BY ALL)
       SELECT shape, string_agg('(' || size || ',' || z || ')*' || c, ', ' ORDER BY size DESC, z DESC) AS spec, string_agg('(' || size || ',' || z || ')x' || c, '_' ORDER BY size DESC, z DESC) AS dirname FROM t GROUP BY 1""",
    "algorithm_order": """SELECT algo, CAST(row_number() OVER (ORDER BY coalesce(list_position(['leiden', 'walktrap', 'demon', 'angel'], algo), 1000000), algo) AS INT) AS place FROM (SELECT DISTINCT algo FROM records)""",
    "pivot_runs": _OK + """, l AS (SELECT shape, overlap_pct, algo, p, 'run_' || coalesce(run, min(run) OVER ()) AS k, CASE WHEN run IS NOT NULL THEN o END AS x FROM v
       UNION ALL SELECT shape, overlap_pct, algo, p, 't_run_' || coalesce(run, min(run) OVER ()), CASE WHEN run IS NOT NULL AND NOT isnan(t_argmax) THEN t_argmax END FROM v)
       SELECT * FROM (PIVOT l ON k USING max(x) GROUP BY shape, overlap_pct, algo, p)""",
    "pivot_thresholds": _OK + """, g AS (SELECT shape, round(t_argmax, 2) AS t, round(avg(o), 11) AS m FROM v WHERE o IS NOT NULL GROUP BY ALL),
       l AS (SELECT shape, 't=' || printf('%.2f', coalesce(t, min(t) OVER ())) AS k, CASE WHEN t IS NOT NULL THEN m END AS m FROM g)
       SELECT * FROM (PIVOT l ON k USING max(m) GROUP BY shape)""",
    "p_slices": "SELECT step, algo, count(*) AS rows FROM records WHERE step IN (0, 25, 50) GROUP BY ALL",
    "resume_anti_join": r"""WITH d AS (SELECT regexp_split_to_array(path, '[\\/]+') AS s FROM traj_files)
       SELECT DISTINCT lower(traj_id) AS traj FROM manifest WHERE lower(traj_id) NOT IN (SELECT s[list_position(s, 'trajectories') + 1] FROM d WHERE s[len(s)] = 'done')""",
    "duplicate_runs": "SELECT traj_id, count(*) AS copies FROM manifest GROUP BY 1 HAVING count(*) > 1",
    "records_with_shapes": "SELECT n.shape, rows, mean_degree FROM (SELECT shape, count(*) AS rows FROM records GROUP BY 1) n LEFT JOIN shapes_table s ON n.shape = s.shape",
}
