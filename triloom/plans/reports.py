"""Reports over sweep results: means and deviations over runs, best thresholds, critical points, pivots.

NaN marks a failed evaluation. Unless said otherwise it is left out; ties in a maximum go
to the smallest threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

SIGNAL_FLOOR = 0.02
PLATEAU_SHARE = 0.95
P_CRIT_LEVEL = 0.6
#: The order in which known baselines are shown; others follow by name.
ALGORITHM_ORDER = ("leiden", "walktrap", "demon", "angel")


def usable(x: Column | str) -> Column:
    """NaN as null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x, F.lit(None).cast("double"))


def run_mean_std(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by``, n_runs, mean, std_samp (null for one run), std_pop (0 for one run), mean_strict (NaN if any run is)."""
    v = usable(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n_runs"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_samp"), F.stddev_pop(v).alias("std_pop"),
        F.avg(F.col(value)).alias("mean_strict"),
    )


def averaged(rows: DataFrame) -> DataFrame:
    """Mean omega over runs of each (shape, overlap_pct, algo, p); failed evaluations left out."""
    ok = rows.where(F.col("omega").isNotNull() & ~F.isnan("omega"))
    return ok.groupBy("shape", "overlap_pct", "algo", "p").agg(F.avg("omega").alias("omega_mean"))


def dedupe_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the last in ``order``. An aggregate, so that no key is gathered in a window."""
    names = rows.columns
    last = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("w"))
    return last.select(*[F.col("w")[c].alias(c) for c in names])


def part_rank(path: Column) -> Column:
    """0 for plain record files, 1 for reruns (``_r2``, ``_x``), which win over plain ones."""
    return (path.contains("_r2") | path.contains("_x")).cast("int")


def read_record_parts(spark, run_dir: str, schema: str) -> DataFrame:
    """All ``records*.csv`` of a run, later parts winning on (run_id, p, algo), failed evaluations left out.

    Both ``records.csv`` and ``records_<tag>.csv`` are read; where lines of one part
    repeat a key, the later one wins.
    """
    raw = spark.read.schema(schema).option("header", "true").option("nanValue", "nan").csv(f"{run_dir}/records*.csv")
    rows = raw.select("*", F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__line"))
    last = dedupe_last(rows, ["run_id", "p", "algo"], [part_rank(F.element_at(F.split("__path", "/"), -1)), F.col("__path"), F.col("__line")])
    return last.drop("__path", "__line").where(F.col("omega").isNotNull() & ~F.isnan("omega"))


def latest_run(runs: DataFrame, name: str = "run_dir") -> DataFrame:
    return runs.where(F.col(name).startswith("run_")).agg(F.max(name).alias(name))


def best_threshold(grid: DataFrame, by: Sequence[str], score: str = "omega", t: str = "t", floor: float | None = None) -> DataFrame:
    """``by``, t_argmax, omega_at_argmax. With ``floor``, t_argmax is NaN where the best score is not above it."""
    ok = grid.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = ok.groupBy(*by).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(t))).alias("w"))
    tt = F.col("w.t") if floor is None else F.when(F.col("w.s") <= F.lit(floor), F.lit(float("nan"))).otherwise(F.col("w.t"))
    return best.select(*by, tt.alias("t_argmax"), F.col("w.s").alias("omega_at_argmax"))


def p_crit(curve: DataFrame, by: Sequence[str], score: str = "score", p: str = "p", level: float = P_CRIT_LEVEL) -> DataFrame:
    """``by``, p_crit: the first p at which the score is below the level; null if it never is."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col(score) < F.lit(level), F.col(p))).alias("p_crit"))


def p_crit_estimate(walks: DataFrame, by: Sequence[str], walk: str, score: str = "omega", p: str = "p", level: float = P_CRIT_LEVEL) -> DataFrame:
    """``by``, p_crit_est: mean over walks of the first crossing, 1 for a walk that never crosses."""
    first = walks.groupBy(*by, walk).agg(F.coalesce(F.min(F.when(F.col(score) < F.lit(level), F.col(p))), F.lit(1.0)).alias("c"))
    return first.groupBy(*by).agg(F.avg("c").alias("p_crit_est"))


def coarse_peak(search: DataFrame, by: Sequence[str], t: str = "threshold", score: str = "p_crit_est") -> DataFrame:
    """``by``, t_best, best: the peak of a search that stops after the first fall (the falling point included); null points are left out."""
    w = Window.partitionBy(*by).orderBy(t)
    search = search.where(F.col(t).isNotNull() & F.col(score).isNotNull())
    fell = search.withColumn("__fell", (F.col(score) < F.lag(score).over(w)).cast("int"))
    before = F.coalesce(F.sum("__fell").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = fell.withColumn("__before", before).where("__before = 0")
    best = seen.groupBy(*by).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(t))).alias("w"))
    return best.select(*by, F.col("w.t").alias("t_best"), F.col("w.s").alias("best"))


def plateau_width(grid: DataFrame, by: Sequence[str], step: float, score: str = "omega", index: str = "t_idx") -> DataFrame:
    """``by``, width: of the index range that scores at least 95 % of the peak; 0 without a signal."""
    v = usable(score)
    peak = grid.groupBy(*by).agg(F.max(v).alias("peak"))
    inside = grid.join(peak, list(by)).where(v >= F.lit(PLATEAU_SHARE) * F.col("peak"))
    ends = inside.groupBy(*by).agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    width = F.when(F.col("peak").isNull() | (F.col("peak") <= SIGNAL_FLOOR) | F.col("lo").isNull(), F.lit(0.0))
    return peak.join(ends, list(by), "left").select(*by, width.otherwise((F.col("hi") - F.col("lo") + 1) * F.lit(step)).alias("width"))


def t_limit(grid: DataFrame, n_t: int, score: str = "omega", index: str = "t_idx") -> DataFrame:
    """t_limit: the largest threshold with a signal, plus 0.06, within 0.25 and 1."""
    top = grid.groupBy(index).agg(F.max(usable(score)).alias("m")).where(F.col("m") > SIGNAL_FLOOR)
    high = F.coalesce(F.max(F.col(index) / F.lit(float(n_t - 1))), F.lit(0.0))
    return top.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.25), high + F.lit(0.06))).alias("t_limit"))


def shape_terms(shapes: DataFrame) -> DataFrame:
    """shape, size, z, count: the rings of a shape by (size, z)."""
    zipped = F.arrays_zip(F.split(F.trim("sizes"), r"\s+").alias("size"), F.split(F.trim("zs"), r"\s+").alias("z"))
    rows = shapes.select("shape", F.inline(zipped)).toDF("shape", "size", "z")
    return rows.groupBy("shape", F.col("size").cast("int").alias("size"), F.col("z").cast("int").alias("z")).agg(F.count(F.lit(1)).alias("count"))


def shape_spec(shapes: DataFrame) -> DataFrame:
    """shape, spec ``(size,z)*count, ...`` and dirname ``(size,z)xcount_...``, the largest terms first."""
    t = shape_terms(shapes).groupBy("shape").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "z", "count")))).alias("t"))
    text = lambda sign: lambda x: F.concat(F.lit("("), x["size"].cast("string"), F.lit(","), x["z"].cast("string"), F.lit(f"){sign}"), x["count"].cast("string"))
    return t.select("shape", F.array_join(F.transform("t", text("*")), ", ").alias("spec"), F.array_join(F.transform("t", text("x")), "_").alias("dirname"))


def algorithm_rank(algo: Column | str, order: Sequence[str] = ALGORITHM_ORDER) -> Column:
    """Sort key: the algorithms of ``order`` in that order, then the others by name."""
    algo = F.col(algo) if isinstance(algo, str) else algo
    known = F.array_position(F.array(*[F.lit(a) for a in order]), algo)
    return F.struct(F.when(known > 0, known).otherwise(F.lit(10**6)).alias("known"), algo.alias("name"))


def pivot_runs(rows: DataFrame, by: Sequence[str], runs: Sequence[int], value: str = "omega", t: str = "t_argmax") -> DataFrame:
    """``by``, run_<i> and t_run_<i> of each run.

    Only the cells that are there are shuffled, as lists; a row gets its columns at the very end, by one cast of a VARIANT
    object that has them by name. ``by`` is in it too, as a generator that keeps columns beside it takes several times as long.
    """
    runs = [int(r) for r in runs]
    if not runs:
        return rows.select(*by).distinct()
    wide = T.StructType([rows.schema[c] for c in by] + [T.StructField(f"{k}_{r}", T.DoubleType()) for k in ("run", "t_run") for r in runs])
    best = rows.groupBy(*by, F.col("run").alias("__r")).agg(F.max(usable(value)).alias("run"), F.max(usable(t)).alias("t_run"))
    held = best.groupBy(*by).agg(F.collect_list(F.when(F.col("__r").isNotNull(), F.struct("__r", "run", "t_run"))).alias("__cells"))
    entry = lambda name, x: F.struct(name.alias("k"), x.cast("variant").alias("x"))
    cells = F.flatten(F.transform("__cells", lambda c: F.array(*[entry(F.concat(F.lit(f"{k}_"), c["__r"].cast("string")), c[k]) for k in ("run", "t_run")])))
    named = F.concat(F.array(*[entry(F.lit(c), F.col(c)) for c in by]), F.filter(cells, lambda c: c["x"].isNotNull()))
    return held.select(F.inline(F.array(F.to_variant_object(F.map_from_entries(named)).cast(wide))))


def pivot_thresholds(grid: DataFrame, by: Sequence[str], thresholds: Sequence[float], score: str = "omega") -> DataFrame:
    """``by`` and a column ``t=0.00`` for each threshold."""
    labels = [f"t={t:.2f}" for t in thresholds]
    return grid.withColumn("__l", F.format_string("t=%.2f", "t")).groupBy(*by).pivot("__l", labels).agg(F.first(score, ignorenulls=True))


def p_slice(rows: DataFrame, ps: Sequence[float], n_p: int, index: str = "p_idx") -> DataFrame:
    return rows.where(F.col(index).isin([int(round(p * (n_p - 1))) for p in ps]))


def stacked_mean_std(grids: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, mean and population deviation over stacked grids; NaN in any makes both NaN."""
    bad = F.max(F.isnan("omega").cast("int")) == 1
    return grids.groupBy(*by).agg(
        F.when(bad, F.lit(float("nan"))).otherwise(F.avg("omega")).alias("mean"), F.when(bad, F.lit(float("nan"))).otherwise(F.stddev_pop("omega")).alias("std")
    )
