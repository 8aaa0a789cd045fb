"""Queries of the general data problems: small files (1), repeated deliveries (3), drifting schemas (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.operators.deliveries import DeliveryStore, merge_deliveries, record_identifier
from triloom.operators.schema_drift import INIT_META, NUM, NUM_LIST, P_SWEEP, drift_report, unify
from triloom.plans.reports import usable
from triloom.runtime import new_table_dir
from triloom.sources.compaction import consolidate, file_sizes

#: Bytes of source files that one consolidated file is made of.
TARGET_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = consolidate(table(spark, sf_dir, "traj_files"), TARGET_BYTES)
    return records.select("traj_id", "kind", "p_milli")


def p1_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(table(spark, sf_dir, "traj_files"), TARGET_BYTES)[1].select(
        "kind", "records_read", "distinct_records", "written"
    )


#: A target that gives these small tables many groups.
SMALL_TARGET = 20_000


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a small target: the records of every group, the files it is in and the groups its file holds (one each)."""
    _, _, folder = consolidate(table(spark, sf_dir, "traj_files"), SMALL_TARGET)
    sizes = file_sizes(spark, folder)
    held = sizes.groupBy("file").agg(F.count(F.lit(1)).alias("groups_in_file"))
    return sizes.join(held, "file").groupBy("group_id").agg(
        F.sum("records").alias("records"), F.sum("body_bytes").alias("body_bytes"), F.count(F.lit(1)).alias("files"), F.max("groups_in_file").alias("groups_in_file")
    )


def _delivered(spark: SparkSession, rows: DataFrame) -> DeliveryStore:
    """The rows taken in as they came: a history, then what was loaded in the last fifth of the time."""
    lo, hi = rows.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    cuts = [lo + (hi - lo) * share for share in (0.8,)] if lo is not None else []
    store = DeliveryStore(spark, new_table_dir(spark, "deliveries"), record_identifier())
    return merge_deliveries(store, rows, "loaded_at", cuts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "records").select("rec_id", "run_id", "p", "algo", "loaded_at")
    return _delivered(spark, rows).dropped()


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "records").select("rec_id", "run_id", "p", "algo", "loaded_at", "omega", "elapsed_sec")
    return _delivered(spark, rows).current().select("rec_id", usable("omega").alias("omega"), "elapsed_sec")


def _init_meta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "traj_files").select("file_id", "path", "content")
    return files.where(F.element_at(F.split("path", r"[\\/]+"), -1).startswith("init_meta"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = drift_report(_init_meta_files(spark, sf_dir), "file_id", "content", INIT_META, "init_meta")
    sweep = drift_report(table(spark, sf_dir, "p_sweep_raw"), "file_id", "payload", P_SWEEP, "p_sweep")
    return meta.unionByName(sweep)


def p4_init_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(_init_meta_files(spark, sf_dir), "content", INIT_META, ["file_id"], {"overlap": "fraction", "seed": "hexadecimal", "shape": "named"})


def p4_p_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(table(spark, sf_dir, "p_sweep_raw"), "payload", P_SWEEP, ["file_id", "row_id"], {"overlap": "fraction"})


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the consistent init_meta table, those of lists with their place."""
    one = p4_init_meta(spark, sf_dir)
    fields = [F.struct(F.lit(f).alias("field"), (F.array(f) if k == NUM else F.col(f)).alias("v")) for f, k in INIT_META.items() if k in (NUM, NUM_LIST)]
    flat = one.select("file_id", F.inline(F.array(*fields))).select("file_id", "field", F.posexplode("v").alias("place", "value"))
    return flat.where("value IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_reconciliation, p1_groups, p3_found, p3_current, p4_found, p4_init_meta, p4_p_sweep, p4_values)
}

_FILES = r"""
WITH f AS (SELECT content, [x FOR x IN regexp_split_to_array(path, '[\\/]+') IF x <> '' AND x <> '.'] AS parts FROM traj_files),
g AS (SELECT content, parts[list_position(parts, 'trajectories') + 1] AS traj_id, parts[len(parts)] AS name
      FROM f WHERE list_position(parts, 'trajectories') > 0),
k AS (SELECT content, traj_id, CASE WHEN name LIKE 'labels%' THEN 'labels' WHEN name LIKE 'init\_meta%' ESCAPE '\' THEN 'init_meta'
             WHEN name LIKE 'done%' THEN 'done' END AS kind FROM g),
l AS (SELECT traj_id, TRY_CAST(regexp_extract(replace(line, chr(65279), ''), '^\s*([^,;]*)[,;]', 1) AS DOUBLE) AS p FROM
      (SELECT traj_id, unnest(regexp_split_to_array(content, '\r\n|\n|\r')) AS line FROM k WHERE kind = 'labels')),
r AS (SELECT traj_id, kind, CAST(round(p * 1000) AS INT) AS p_milli FROM (SELECT *, 'labels' AS kind FROM l) WHERE p IS NOT NULL
      UNION ALL SELECT traj_id, kind, -1 FROM k WHERE kind = 'init_meta' AND json_valid(content) AND json_type(content) = 'OBJECT'
      UNION ALL SELECT traj_id, kind, -1 FROM k WHERE kind = 'done')
"""

_COPIES = r"""
WITH k AS (SELECT *,
  regexp_replace(regexp_replace(regexp_replace(lower(run_id), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'),
    '[^a-z0-9]+o0*([0-9]+)[^a-z0-9]+run0*([0-9]+)$', '|\1|\2'), '[^a-z0-9|]+', '', 'g') AS r,
  CAST(round(p * 1e6) AS BIGINT) AS pm, regexp_replace(lower(algo), '[^a-z0-9]+', '', 'g') AS a FROM records),
w AS (SELECT *, row_number() OVER (PARTITION BY r, pm, a ORDER BY loaded_at DESC, rec_id DESC) AS nth FROM k)
"""

# What the fields are called in these tables, for the SQL only: the operator has no such list.
_META_PATHS = {
    "id": "traj_id", "shape": "shape_name layout.shape shapeName Shape config.shape", "sizes": "layout.sizes ring_sizes sizesPerRing Sizes", "zs": "degrees", "run": "run_no",
    "M_actual": "edges_actual m_actual", "n_p": "p_points",
}
_SWEEP_PATHS = {"overlap": "Overlap overlap_frac overlap_pct ovl", "n": "n_nodes", "t_best": "tBest", "score": "omega"}


def _drift_sql(reference: dict[str, str], paths: dict[str, str], rows: str) -> str:
    """r: file_id, row, c (JSON); v: every field of a row with the path it stands at, its kind and its value."""
    listed = ", ".join(f"('{f}', '{k}', {[f, *paths.get(f, '').split()]})" for f, k in reference.items())
    return f"""WITH r AS MATERIALIZED ({rows}),
    f(field, kind, names) AS (VALUES {listed}),
    g AS (SELECT file_id, row, field, kind, c, list_filter(names, lambda n: json_type(c, '$.' || n) IS NOT NULL)[1] AS name FROM r, f),
    h AS (SELECT *, json_type(c, '$.' || name) AS t, json_extract(c, '$.' || name) AS x FROM g),
    v AS (SELECT *, CASE WHEN t = 'ARRAY' THEN list_transform(json_extract(x, '$[*]'), lambda e: CASE WHEN json_type(e) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' ELSE json_type(e) END) END AS ts,
          CASE WHEN t = 'NULL' OR (t = 'ARRAY' AND len(ts) = 0) THEN kind WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'text'
               WHEN t = 'ARRAY' AND list_distinct(ts) = ['number'] THEN 'list<number>' WHEN t = 'ARRAY' AND list_distinct(ts) = ['ARRAY'] THEN 'list<list>' ELSE t END AS has FROM h)"""


_META_ROWS = r"""SELECT file_id, file_id AS row, content::JSON AS c FROM traj_files WHERE regexp_extract(path, '[^\\/]*$') LIKE 'init\_meta%' ESCAPE '\'
      AND json_valid(content) AND json_type(content) = 'OBJECT'"""
_SWEEP_ROWS = "SELECT file_id, row_id AS row, payload::JSON AS c FROM p_sweep_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'"


def _changes_sql(origin: str, reference: dict[str, str], paths: dict[str, str], rows: str) -> str:
    return _drift_sql(reference, paths, rows) + f""",
    s AS (SELECT file_id, row, field, 'removed' AS change FROM v WHERE name IS NULL UNION ALL SELECT file_id, row, field, 'renamed' FROM v WHERE name <> field
      UNION ALL SELECT file_id, row, field, 'retyped' FROM v WHERE name IS NOT NULL AND has <> kind
      UNION ALL SELECT file_id, row, k, 'added' FROM (SELECT file_id, row, unnest(json_keys(c)) AS k FROM r) a WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.row = a.row AND split_part(v.name, '.', 1) = k)),
    n AS (SELECT file_id, count(*) AS n FROM r GROUP BY 1)
    SELECT '{origin}' AS origin, s.file_id, field, change FROM s JOIN n ON n.file_id = s.file_id GROUP BY ALL HAVING change <> 'removed' OR count(*) = max(n)"""


def _number_sql(field: str) -> str:
    """The field's number, out of v: text with a decimal comma, in brackets or as a percentage, a seed in hexadecimal."""
    bare = r"""TRY_CAST(replace(regexp_replace(x->>'$', '[\[\]"\s%]', '', 'g'), ',', '.') AS DOUBLE)"""
    if field == "overlap":
        return f"CASE WHEN name ILIKE '%pct' OR contains(x->>'$', '%') THEN {bare} / 100 ELSE {bare} END"
    if field == "seed":
        return f"CASE WHEN regexp_full_match(x->>'$', '[0-9a-fA-F]{{8}}') AND regexp_matches(x->>'$', '[a-fA-F]') THEN CAST('0x' || (x->>'$') AS BIGINT)::DOUBLE ELSE {bare} END"
    return bare


ORACLE_SQL = {
    "p4_found": "SELECT * FROM (" + _changes_sql("init_meta", INIT_META, _META_PATHS, _META_ROWS) + ") UNION ALL SELECT * FROM (" + _changes_sql("p_sweep", P_SWEEP, _SWEEP_PATHS, _SWEEP_ROWS) + ")",
    "p4_p_sweep": _drift_sql(P_SWEEP, _SWEEP_PATHS, _SWEEP_ROWS)
    + " SELECT file_id, row AS row_id, " + ", ".join(f"max({_number_sql(f)}) FILTER (field = '{f}') AS {f}" for f in P_SWEEP) + " FROM v GROUP BY ALL",
    "p4_values": _drift_sql(INIT_META, _META_PATHS, _META_ROWS)
    + ", one AS (SELECT file_id, field, 0 AS place, CASE field " + " ".join(f"WHEN '{f}' THEN {_number_sql(f)}" for f, k in INIT_META.items() if k == NUM) + r""" END AS value FROM v WHERE kind = 'number'),
    many AS (SELECT file_id, field, regexp_extract_all(regexp_replace(x->>'$', '"[A-Za-z_]\w*"\s*:', '', 'g'), '-?[0-9]+(?:\.[0-9]+)?') AS l FROM v WHERE kind = 'list<number>')
    SELECT * FROM one WHERE value IS NOT NULL UNION ALL SELECT file_id, field, unnest(range(len(l)))::INT AS place, unnest(l)::DOUBLE AS value FROM many""",
    "p1_found": _FILES + "SELECT DISTINCT traj_id, kind, p_milli FROM r",
    "p1_reconciliation": _FILES
    + """SELECT kind, count(*) AS records_read, count(DISTINCT traj_id || '/' || p_milli) AS distinct_records,
                count(DISTINCT traj_id || '/' || p_milli) AS written FROM r GROUP BY kind""",
    "p1_groups": r"""WITH f AS (SELECT file_id, n_bytes, modified_at, content, [x FOR x IN regexp_split_to_array(path, '[\\/]+') IF x <> '' AND x <> '.'] AS parts FROM traj_files),
g AS (SELECT *, parts[list_position(parts, 'trajectories') + 1] AS traj_id, parts[len(parts)] AS name FROM f WHERE list_position(parts, 'trajectories') > 0 AND list_position(parts, 'trajectories') + 1 < len(parts)),
k AS (SELECT *, CASE WHEN name LIKE 'labels%' THEN 'labels' WHEN name LIKE 'init\_meta%' ESCAPE '\' THEN 'init_meta' WHEN name LIKE 'done%' THEN 'done' END AS kind FROM g),
s AS (SELECT *, CAST(coalesce(sum(greatest(coalesce(n_bytes, 0), 0)) OVER (ORDER BY traj_id, kind, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000 AS INT) AS group_id FROM k WHERE kind IS NOT NULL),
l AS (SELECT file_id, modified_at, group_id, traj_id, unnest(regexp_split_to_array(content, '\r\n|\n|\r')) AS body, generate_subscripts(regexp_split_to_array(content, '\r\n|\n|\r'), 1) AS line FROM s WHERE kind = 'labels' AND content IS NOT NULL),
r AS (SELECT file_id, modified_at, group_id, traj_id, 'labels' AS kind, line, body, TRY_CAST(regexp_extract(replace(body, chr(65279), ''), '^\s*([^,;]*)[,;]', 1) AS DOUBLE) AS p FROM l
      UNION ALL SELECT file_id, modified_at, group_id, traj_id, kind, 0, coalesce(content, ''), -0.001 FROM s WHERE kind = 'done' OR (kind = 'init_meta' AND json_valid(content) AND json_type(content) = 'OBJECT')),
w AS (SELECT *, row_number() OVER (PARTITION BY traj_id, kind, CAST(round(p * 1000) AS INT) ORDER BY modified_at DESC, file_id DESC, line DESC) AS nth FROM r WHERE p IS NOT NULL)
SELECT group_id, count(*) AS records, CAST(sum(strlen(body)) AS BIGINT) AS body_bytes, 1::BIGINT AS files, 1::BIGINT AS groups_in_file FROM w WHERE nth = 1 GROUP BY 1""",
    "p3_found": _COPIES + "SELECT rec_id FROM w WHERE nth > 1",
    "p3_current": _COPIES + "SELECT rec_id, CASE WHEN isnan(omega) THEN NULL ELSE omega END AS omega, elapsed_sec FROM w WHERE nth = 1",
}
