"""Queries of the training-data problems: splits (2), percentiles (5), packing (6), mixing (7), sentences (8)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.naming import complete_object, path_parts, squeeze, trajectory_key, trajectory_run, trajectory_shape
from triloom.llm import mixing, packing, quantiles
from triloom.llm.sentences import sentence_units
from triloom.llm.splits import QUARANTINE, SplitStore
from triloom.runtime import new_table_dir, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 2: splits ---------------------------------------------------------------------


def related_records(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """man_id with the keys that relate it: trajectory, shape and run, kept seed.

    A shape or run that the manifest lacks is taken from the trajectory's init_meta.json,
    under whichever usual name it stands there, and failing that from the id itself.
    """
    parts = path_parts("path")
    at = F.array_position(parts, "trajectories")
    meta = files.where(F.element_at(parts, -1).startswith("init_meta")).select(
        trajectory_key(F.get(parts, at.cast("int"))).alias("traj"), complete_object("content").alias("v")
    )
    def field(names: tuple[str, ...]) -> F.Column:
        return F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])

    shape = field(("shape.name", "shape[0]", "shape_name", "shapeName", "Shape", "layout.shape", "config.shape"))
    plain = F.try_variant_get("v", "$.shape", "string")
    shape = F.coalesce(shape, F.when(~plain.rlike(r"^\s*[\[{]"), plain))
    meta = meta.where("v IS NOT NULL AND traj IS NOT NULL").groupBy("traj").agg(
        F.min(squeeze(shape)).alias("meta_shape"), F.min(field(("run", "run_no")).try_cast("bigint")).alias("meta_run")
    )
    rows = manifest.select(
        "man_id", trajectory_key("traj_id").alias("traj"), squeeze("shape").alias("shape"), F.col("run").cast("bigint").alias("run"),
        trajectory_shape("traj_id").alias("id_shape"), trajectory_run("traj_id").alias("id_run"), "seed",
    )
    lacking = F.when(F.col("shape").isNull() | F.col("run").isNull(), F.col("traj"))
    rows = rows.withColumn("ask", lacking).join(meta.withColumnRenamed("traj", "ask"), "ask", "left")
    shape = F.coalesce("shape", "meta_shape", "id_shape")
    run = F.coalesce("run", "meta_run", "id_run").cast("string")
    keys = F.array(
        F.concat(F.lit("t:"), F.col("traj")),
        F.concat(F.lit("s:"), shape, F.lit("|"), run),
        F.when(F.col("seed") >= 0, F.concat(F.lit("d:"), F.col("seed").cast("string"))),
    )
    return rows.select(F.col("man_id").alias("id"), F.array_compact(keys).alias("keys"))


#: Where the batches end in which the manifest comes, as shares of its ids: a history and an update, or five batches.
UPDATE, BATCHES = (0.8,), (0.2, 0.4, 0.6, 0.8)


def _split_updates(spark: SparkSession, sf_dir: str, ends: Sequence[float]) -> Iterator[SplitStore]:
    """The store after each batch of the manifest as it grew."""
    rows, seen = settle(
        related_records(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "traj_files").select("path", "content")), lo=F.min("id"), hi=F.max("id")
    )
    store = SplitStore(spark, new_table_dir(spark, "splits"))
    lo, hi = seen["lo"], seen["hi"]
    if lo is None:
        yield store
        return
    edges = [lo, *[lo + int((hi - lo) * s) for s in ends], hi + 1]
    for a, b in zip(edges, edges[1:]):
        store.update(rows.where(F.col("id").between(a, b - 1)), f"from-{a}")
        yield store


def _split_store(spark: SparkSession, sf_dir: str, ends: Sequence[float]) -> SplitStore:
    for store in _split_updates(spark, sf_dir, ends):
        pass
    return store


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_store(spark, sf_dir, UPDATE).groups().select(F.col("id").alias("man_id"), F.col("comp").alias("group_id"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_store(spark, sf_dir, BATCHES).assigned().select(F.col("id").alias("man_id"), F.col("comp").alias("group_id"), "split")


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups after all batches, groups that stand in two splits, and records that went from one split to another on the way."""
    before = None
    moved = 0
    for store in _split_updates(spark, sf_dir, BATCHES):
        now = store.assigned()
        kept = F.lit(None).cast("string")
        if before is not None:
            now = now.join(before.select("id", F.col("split").alias("kept")), "id", "left")
            kept = F.col("kept")
        before, _ = settle(now.select("id", "comp", "split", kept.alias("kept")))
        moved += before.where((F.col("split") != F.col("kept")) & (F.col("split") != QUARANTINE)).count()
    groups = before.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("groups_in_two_splits"),
        F.lit(moved).cast("bigint").alias("records_moved"),
    )


# -- 5: percentiles ----------------------------------------------------------------

QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "records")
    return rows.select(F.to_date("loaded_at").alias("day"), squeeze("algo").alias("algo"), "omega", "elapsed_sec")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each algorithm on each day, and over all days (day null), combined from the days' sketches."""
    k = quantiles.buffer_size()
    built, _ = settle(quantiles.build(_measurements(spark, sf_dir), ["day", "algo"], ["omega", "elapsed_sec"], k))
    daily, _ = settle(quantiles.combine(built, ["day", "algo"], k))
    every = quantiles.combine(daily, ["algo"], k)
    total = quantiles.percentiles(every, ["algo"], QS).withColumn("day", F.lit(None).cast("date"))
    return quantiles.percentiles(daily, ["day", "algo"], QS).unionByName(total)


def _overall(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    built, _ = settle(quantiles.build(_measurements(spark, sf_dir), ["algo"], ["omega", "elapsed_sec"], k))
    return quantiles.percentiles(quantiles.combine(built, ["algo"], k), ["algo"], QS)


def p5_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each algorithm over all rows."""
    return _overall(spark, sf_dir, quantiles.buffer_size())


def _ranked(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """``found`` with ``within``: whether the exact rank of a percentile, counted over all rows, lies within its bound."""
    rows = table(spark, sf_dir, "records").select(
        squeeze("algo").alias("algo"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("omega", "elapsed_sec")]))
    )
    rows = rows.where("x IS NOT NULL AND NOT isnan(x)")
    # values are counted before the join, so it sees each distinct value once
    counts = rows.groupBy("algo", "metric", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.join(found, ["algo", "metric"]).groupBy("algo", "metric", "q", "n", "max_rank_error").agg(
        F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto")
    )
    want = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - F.lit(1e-9)))
    within = (want >= F.col("below") + 1 - F.col("max_rank_error")) & (want <= F.col("upto") + F.col("max_rank_error"))
    return ranked.select("algo", "metric", "q", "n", "max_rank_error", within.alias("within"))


def p5_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact rank of every percentile lies within its bound."""
    return _ranked(spark, sf_dir, p5_overall(spark, sf_dir)).drop("max_rank_error")


#: Buffers so small that the groups of these tables are collapsed several times.
SMALL_BUFFER = 32


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small buffers: whether large groups were collapsed, the exact rank lies within the bound, and the bound within its share of the values."""
    ranked = _ranked(spark, sf_dir, _overall(spark, sf_dir, SMALL_BUFFER))
    collapsed = (F.col("n") <= 2 * SMALL_BUFFER * quantiles.FAN) | (F.col("max_rank_error") > 0)
    share = quantiles.error_share(SMALL_BUFFER, quantiles.MOST)
    return ranked.select("algo", "metric", "q", "n", "within", collapsed.alias("collapsed"), (F.col("max_rank_error") <= F.lit(share) * F.col("n")).alias("bounded"))


# -- 6: packing --------------------------------------------------------------------


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the containers of each capacity; 0 each."""
    packs = table(spark, sf_dir, "pack_sizes")
    sized = packing.measured(table(spark, sf_dir, "documents"))
    placed, _ = settle(packing.pack(sized, packs))
    return packing.packing_check(placed, sized, packs)


# -- 7: mixing ---------------------------------------------------------------------


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.measured(table(spark, sf_dir, "documents"))
    targets = table(spark, sf_dir, "mix_targets")
    mixture, _ = settle(mixing.mix(sized, targets))
    return mixture, mixing.mixture_shares(mixture, sized, targets)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in order, each row with its source's target and actual share."""
    mixture, shares = _mixture(spark, sf_dir)
    return mixture.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")  # MOST_SOURCES rows at most


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listed source, whether it is used no more often than it may be, and its share is as near its feasible one as its documents allow."""
    shares = _mixture(spark, sf_dir)[1]
    uses = (F.col("passes_used") <= F.col("max_repeats")) & (F.col("tokens_used") <= F.col("max_repeats") * F.col("tokens_available"))
    return shares.select("source", uses.alias("uses_kept"), (F.abs("shortfall") <= F.col("share_bound") + F.lit(1e-9)).alias("share_kept"))


# -- 8: sentences ------------------------------------------------------------------


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_splits, p2_invariants, p5_percentiles, p5_overall, p5_within_bound, p5_collapsed, p6_packing, p6_report, p6_invariants, p7_mixture, p7_shares, p7_invariants, p8_found)
}

_GROUPS = r"""
WITH RECURSIVE f AS (SELECT content, [x FOR x IN regexp_split_to_array(path, '[\\/]+') IF x <> '' AND x <> '.'] AS parts FROM traj_files),
j AS (SELECT regexp_replace(regexp_replace(lower(parts[list_position(parts, 'trajectories') + 1]), '[^a-z0-9]+o0*([0-9]+)[^a-z0-9]+run0*([0-9]+)$', '|\1|\2'),
        '[^a-z0-9|]+', '', 'g') AS traj, content::JSON AS c FROM f WHERE parts[len(parts)] LIKE 'init%meta%' AND json_valid(content)),
meta AS (SELECT traj, min(regexp_replace(lower(coalesce(c->>'$.shape.name', c->>'$.shape[0]', c->>'$.shape_name', c->>'$.shapeName', c->>'$.Shape',
        c->>'$.layout.shape', c->>'$.config.shape', c->>'$.shape')), '[^a-z0-9]+', '', 'g')) AS s,
        min(TRY_CAST(coalesce(c->>'$.run', c->>'$.run_no') AS BIGINT)) AS r FROM j GROUP BY traj),
m AS (SELECT man_id, regexp_replace(regexp_replace(regexp_replace(lower(traj_id), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'),
        '[^a-z0-9]+o0*([0-9]+)[^a-z0-9]+run0*([0-9]+)$', '|\1|\2'), '[^a-z0-9|]+', '', 'g') AS traj,
        regexp_replace(lower(shape), '[^a-z0-9]+', '', 'g') AS shape, run, seed FROM manifest),
k AS (SELECT man_id, 't:' || m.traj AS key FROM m
      UNION ALL SELECT man_id, 's:' || coalesce(shape, meta.s) || '|' || coalesce(run, meta.r) FROM m LEFT JOIN meta USING (traj)
      UNION ALL SELECT man_id, 'd:' || seed FROM m WHERE seed >= 0),
e AS (SELECT DISTINCT man_id AS a, min(man_id) OVER (PARTITION BY key) AS b FROM k WHERE key IS NOT NULL),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(id, lab) USING KEY (id) AS (SELECT man_id, man_id FROM manifest
   UNION SELECT l.a, min(cc.lab) FROM cc JOIN l ON l.b = cc.id JOIN recurring.cc AS now ON now.id = l.a
   GROUP BY l.a, now.lab HAVING min(cc.lab) < now.lab)
"""

_RANKS = """
WITH r AS (SELECT regexp_replace(lower(algo), '[^a-z0-9]+', '', 'g') AS algo, omega, elapsed_sec FROM records),
v AS (SELECT algo, 'omega' AS metric, CASE WHEN isnan(omega) THEN NULL ELSE omega END AS x FROM r
      UNION ALL SELECT algo, 'elapsed_sec', CASE WHEN isnan(elapsed_sec) THEN NULL ELSE elapsed_sec END FROM r),
n AS (SELECT algo, metric, count(x) AS n FROM v GROUP BY ALL)
"""
_QS = "FROM n, unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) u(q) WHERE n > 0"

ORACLE_SQL = {
    "p5_within_bound": _RANKS + "SELECT algo, metric, q, n, true AS within " + _QS,
    "p6_invariants": "SELECT pack_name, 0::BIGINT AS over_capacity, 0::BIGINT AS with_gaps, 0::BIGINT AS tokens_missing, 0::BIGINT AS pieces_extra FROM pack_sizes WHERE capacity_tokens >= 1",
    "p7_invariants": "SELECT source, true AS uses_kept, true AS share_kept FROM mix_targets",
    "p5_collapsed": _RANKS + "SELECT algo, metric, q, n, true AS within, true AS collapsed, true AS bounded " + _QS,
    "p2_found": _GROUPS + "SELECT id AS man_id, lab AS group_id FROM cc",
    "p2_invariants": _GROUPS + "SELECT count(*) AS records, count(DISTINCT lab) AS groups, 0::BIGINT AS groups_in_two_splits, 0::BIGINT AS records_moved FROM cc",
}
