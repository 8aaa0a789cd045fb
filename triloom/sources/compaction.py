"""Very many small files brought together into few well-sized ones.

The plan is SQL only. The manifest of the files is frozen (written once to the shared
folder), put in order, its bytes are summed up along the order, and every interval of
``target_bytes`` of that sum is a group. The rewrite reads and parses each content once:
it takes each record out of the file it stands in, keeps one copy of it (an aggregate
with a partial one before the shuffle, so a trajectory or record that fills a third of
all files is folded first), and writes it with the group of the file it was taken from.
A group goes to the task of its own number, so it is one file. What was read is counted
while it is read, and held against what was folded and what is written.

Defined results: a file whose name does not begin with a known kind, whose path has no
trajectory part or whose content is null holds no record, except that an existing
``done`` file is a marker even when empty; the newest file wins among copies of a
record (then the largest file id, then the latest line); lines whose first cell is no
finite number are headers; an ``init_meta`` text that is not one complete JSON object
holds no record; null sizes and negative ones count as 0; other columns are not looked
at; empty input gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triloom.functions.naming import complete_object, path_parts
from triloom.runtime import cut, default_partitions, new_table_dir, observed_values

KINDS = ("labels", "init_meta", "done")


def frozen_manifest(files: DataFrame) -> DataFrame:
    """file_id, traj_id, kind, n_bytes, modified_at of the files that can hold records, written down once."""
    return cut(_with_kind(files, "n_bytes"))


def _with_kind(files: DataFrame, *keep: str) -> DataFrame:
    """file_id, traj_id, kind, modified_at and the columns ``keep``; no other column is read."""
    parts = path_parts("path")
    at = F.array_position(parts, "trajectories")
    name = F.element_at(parts, -1)
    kind = F.when(name.startswith("labels"), "labels")
    kind = kind.when(name.startswith("init_meta"), "init_meta").when(name.startswith("done"), "done")
    traj = F.when((at > 0) & (at + 1 < F.size(parts)), F.get(parts, at.cast("int")))
    known = files.select("file_id", traj.alias("traj_id"), kind.alias("kind"), "modified_at", *keep)
    return known.where("kind IS NOT NULL AND traj_id IS NOT NULL")


def plan_groups(manifest: DataFrame, target_bytes: int) -> DataFrame:
    """file_id -> group_id by cumulative size; each statement is SQL.

    The order (trajectory, kind, file id) is cut into ranges, the sums of the ranges are
    accumulated (as many rows as ranges) and added to the running sums inside them, so
    that no task orders the whole manifest.
    """
    spark = manifest.sparkSession
    n = default_partitions(spark)
    ranged = spark.sql(
        f"""SELECT /*+ REPARTITION_BY_RANGE({n}, traj_id, kind, file_id) */
                   file_id, traj_id, kind, greatest(coalesce(n_bytes, 0), 0) AS bytes FROM {{m}}""",
        m=manifest,
    )
    ranges = cut(spark.sql("SELECT *, spark_partition_id() AS part FROM {r}", r=ranged))
    return spark.sql(
        f"""WITH totals AS (SELECT part, sum(bytes) AS total FROM {{r}} GROUP BY part),
                offsets AS (SELECT part, coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING
                                   AND 1 PRECEDING), 0) AS before FROM totals),
                inside AS (SELECT part, file_id, coalesce(sum(bytes) OVER (PARTITION BY part
                                  ORDER BY traj_id, kind, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                                  AS start FROM {{r}})
           SELECT file_id, CAST((before + start) DIV {int(target_bytes)} AS INT) AS group_id
           FROM inside JOIN offsets USING (part)""",
        r=ranges,
    )


def extract_records(files: DataFrame) -> DataFrame:
    """Every record of every file: traj_id, kind, p_milli, body and where it comes from.

    p_milli is 1000 p rounded for a label line and -1 otherwise; body is the line, the
    object or the marker text.
    """
    known = _with_kind(files, "content")
    lines = known.where("kind = 'labels' AND content IS NOT NULL").select(
        "file_id", "traj_id", "kind", "modified_at", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line", "body")
    )
    p = F.regexp_extract("body", r"^[\s﻿]*[\"']?([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[\"']?\s*(?:[,;\t|]|$)", 1)
    labels = (
        lines.withColumn("p", p.try_cast("double"))
        .where("p IS NOT NULL AND abs(p) < 1e15")
        .select("file_id", "traj_id", "kind", "modified_at", "line", F.round(F.col("p") * 1000).cast("int").alias("p_milli"), "body")
    )
    others = known.where("kind <> 'labels'").where(
        (F.col("kind") == "done") | complete_object("content").isNotNull()
    )
    others = others.select(
        "file_id", "traj_id", "kind", "modified_at", F.lit(0).alias("line"), F.lit(-1).alias("p_milli"),
        F.coalesce("content", F.lit("")).alias("body"),
    )
    return labels.unionByName(others)


def consolidate(files: DataFrame, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame, str]:
    """The consolidated records (traj_id, kind, p_milli, body, file_id, group_id), the reconciliation and the folder of the files.

    The reconciliation has a row for each kind: records read, distinct, written. A loss
    or a duplicate raises.
    """
    spark = files.sparkSession
    plan = plan_groups(frozen_manifest(files), target_bytes)
    read = Observation()
    records = extract_records(files).observe(read, *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    rank = F.struct("modified_at", "file_id", "line")
    kept = records.groupBy("traj_id", "kind", "p_milli").agg(
        F.count(F.lit(1)).alias("copies"), F.max_by(F.struct("file_id", "body"), rank).alias("w")
    )
    kept = kept.select("traj_id", "kind", "p_milli", "copies", "w.file_id", "w.body")
    n_groups = (plan.agg(F.max("group_id")).first()[0] or 0) + 1
    out = new_table_dir(spark, "consolidated")
    (
        kept.join(plan, "file_id")
        .repartitionById(n_groups, F.col("group_id"))
        .sortWithinPartitions("traj_id", "kind", "p_milli")
        .write.parquet(out)
    )
    written = spark.read.parquet(out)
    report = reconcile(spark, observed_values(read) or {}, written)
    wrong = report.where(_WRONG).collect()  # three rows at most
    if wrong:
        # tasks that ran again were counted again: count once more, by itself
        again = extract_records(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
        report = reconcile(spark, {r["kind"]: r["n"] for r in again}, written)
        wrong = report.where(_WRONG).collect()
    if wrong:
        raise RuntimeError(f"consolidation lost or doubled records: {wrong}")
    return written.drop("copies"), report, out


_WRONG = "distinct_records <> written OR NOT records_read <=> copies"


def reconcile(spark: SparkSession, read: dict, written: DataFrame) -> DataFrame:
    """kind, records_read (counted while reading), distinct_records and copies (of what is written), written; at most three rows."""
    counts = {k: n for k, n in read.items() if n}
    seen = spark.createDataFrame(list(counts.items()), "kind string, records_read bigint")
    kept = written.groupBy("kind", "traj_id", "p_milli").agg(F.count(F.lit(1)).alias("c"), F.sum("copies").alias("n"))
    kept = kept.groupBy("kind").agg(F.sum("c").alias("written"), F.count(F.lit(1)).alias("distinct_records"), F.sum("n").alias("copies"))
    return cut(seen.join(kept, "kind", "full"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """file, group_id, records and bytes of the bodies of each group in each file that was written."""
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), "group_id", "body")
    return rows.groupBy("file", "group_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("body")).alias("body_bytes"))
