"""Tables in and out: manifests, edge lists, grids, partitioned results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "shape string, run_id string, overlap_pct int, run int, p double, step int, n int, rings int, ring_size int, zs string, n_actual int, "
    "edges_actual int, k_step int, algo string, omega double, n_communities int, elapsed_sec double, t_argmax double, t_grid_lo double, t_grid_hi double, t_grid_size int"
)
META_SCHEMA = (
    "id string, shape string, sizes array<int>, zs array<int>, n int, rings int, overlap_pct int, overlap double, run int, seed bigint, n_actual int, "
    "M_actual int, k_step int, p_step double, t_step double, n_p int, n_t int, merged_pairs array<array<bigint>>"
)
MANIFEST_COLUMNS = ("id", "shape", "sizes", "zs", "n", "rings", "overlap_pct", "run", "seed", "n_actual", "M_actual", "k_step", "n_p", "n_t")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nanValue", "nan").csv(path if isinstance(path, str) else list(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RECORD_SCHEMA)


def append_csv(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Appends; with ``by`` every value has its own directory."""
    w = rows.write.mode("append").option("header", "true")
    (w.partitionBy(*by) if by else w).csv(path)


def write_sheets(rows: DataFrame, path: str, sheet: str) -> None:
    """What a workbook holds in sheets, as one table partitioned by the sheet's key."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(sheet).parquet(path)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """``u v`` a line, compressed by gzip."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))


def manifest_of(meta: DataFrame) -> DataFrame:
    """The manifest of trajectory metadata: 14 columns, lists as numbers separated by blanks, sorted by id."""
    flat = meta.withColumn("sizes", F.concat_ws(" ", F.transform("sizes", lambda x: x.cast("string")))).withColumn("zs", F.concat_ws(" ", F.transform("zs", lambda x: x.cast("string"))))
    return flat.select(*MANIFEST_COLUMNS).orderBy("id")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Scans ``root/*/init_meta.json``; folders without a done marker count as well, unreadable ones do not."""
    return manifest_of(spark.read.schema(META_SCHEMA).option("multiLine", "true").json(f"{root}/*/init_meta.json").where("id IS NOT NULL"))


def meta_to_json(meta: DataFrame) -> DataFrame:
    return meta.select("id", F.to_json(F.struct(*meta.columns)).alias("json"))


def run_stamp() -> F.Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
