"""Train, validation and test splits that keep related records together, batch after batch.

``SplitStore`` persists which component every key (author, source, entity ...) was met in
and, for every component, which component it has become part of (its root), the root's
split and weight. Both tables are logs: an update appends the keys that are new and the
components that are new or changed, and nothing else is written. A batch of records is
merged by looking its keys up, linking what they join, and pointer jumping over the links;
only links between components and new records are walked, never old records. Components
that pointed to one that is merged are pointed to its new root, so one look finds a root.
Then

- a component that existed keeps its split,
- components that are new fill the deficits of the splits against their proportions,
- a component that joins components of different splits is quarantined: its records
  belong to no split until someone decides, since moving either side would leak.

A component is named by its smallest record id, so names do not depend on batches. The
weights of the splits are kept with the state, so no update sums up the history. When
``MOST_PARTS`` appended parts have come together, the logs are written anew as one part.

Defined results: a record whose keys are all null is a component of its own; null keys
relate nothing; the same record id again adds its keys to the record; an empty batch
changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.prefix import bucketed_running_sum
from triloom.operators.components import contract
from triloom.runtime import settle
from triloom.sources.versions import VersionLog

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
_KEYS = "key string, comp bigint"
_COMPS = "comp bigint, root bigint, split string, weight bigint, version int"
_RECORD = "r"  # before a record's own key; other keys have k
#: New components are put in order in slots of about so many records.
SLOT_RECORDS = 100_000
MOST_PARTS = 32


def _by_split(comps: DataFrame) -> dict:
    """The weight of each split; a row for each."""
    return {r["split"]: r["w"] for r in comps.groupBy("split").agg(F.sum("weight").alias("w")).collect()}


class SplitStore:
    """Logs at ``path``: keys (key, comp), where a record is a key of its own, and comps (comp, root, split, weight, version).

    The newest version of a component holds; split and weight are those of roots. An
    update switches to its parts by one rename, so a store can be opened again later, and
    an update that fails changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, proportions: Mapping[str, float] = SPLITS, most_parts: int = MOST_PARTS):
        if not proportions or any(p < 0 for p in proportions.values()) or sum(proportions.values()) <= 0:
            raise ValueError("proportions must not be negative, and not all zero")
        total = sum(proportions.values())
        self.proportions = {k: v / total for k, v in proportions.items()}
        self.spark, self.path, self.most_parts = spark, path.rstrip("/"), most_parts
        self.log = VersionLog(spark, path)

    def state(self) -> dict:
        return self.log.read() or {"version": 0, "applied": [], "parts": [], "weights": {}}

    def _keys(self, s: dict) -> DataFrame:
        return self.spark.read.schema(_KEYS).parquet(*[f"{p}/keys" for p in s["parts"]])

    def _comps(self, s: dict, of: DataFrame | None = None) -> DataFrame:
        """comp, root, split, weight as they are now, of all components or those of ``of`` (column comp)."""
        log = self.spark.read.schema(_COMPS).parquet(*[f"{p}/comps" for p in s["parts"]])
        if of is not None:
            log = log.join(of, "comp", "left_semi")
        if len(s["parts"]) == 1:
            return log.drop("version")
        newest = log.groupBy("comp").agg(F.max(F.struct("version", "root", "split", "weight")).alias("now"))
        return newest.select("comp", "now.root", "now.split", "now.weight")

    def update(self, batch: DataFrame, name: str) -> None:
        """Merges records: ``id`` bigint and ``keys`` array of strings. A batch name is applied once."""
        s = self.state()
        if name in s["applied"]:
            return
        version = s["version"] + 1
        here = f"{self.path}/v{version:08d}"
        own = F.concat(F.lit(_RECORD), F.col("id").cast("string"))
        named = F.transform(F.array_compact(F.coalesce("keys", F.array().cast("array<string>"))), lambda k: F.concat(F.lit("k"), k))
        pairs = batch.where("id IS NOT NULL").select("id", F.explode(F.array_append(named, own)).alias("key")).distinct()
        nothing = F.lit(None).cast("bigint")
        if s["parts"]:
            known, seen = settle(pairs.join(self._keys(s), "key", "left"), rows=F.count(F.lit(1)))
            met = self._comps(s, known.select("comp")).select("comp", "root")
            known, _ = settle(known.join(met, "comp", "left").select("id", "key", F.col("root").alias("comp")))
        else:
            known, seen = settle(pairs.withColumn("comp", nothing), rows=F.count(F.lit(1)))
        if not seen["rows"]:
            return
        # a key joins the component that has it, and all records of the batch that have it
        low = known.groupBy("key").agg(F.min(F.least("id", F.coalesce("comp", "id"))).alias("low"))
        links = known.join(low, "key").select(F.explode(F.array("id", "comp")).alias("a"), F.col("low").alias("b"))
        roots = contract(links).withColumnRenamed("node", "comp")
        root = F.coalesce("root", "comp")
        fresh = known.where("comp IS NULL").groupBy("key").agg(F.min("id").alias("comp"))
        fresh.join(roots, "comp", "left").select("key", root.alias("comp")).write.mode("overwrite").parquet(f"{here}/keys")
        # how many records came to each component, and what it was before
        came = known.where(F.col("comp").isNull() & F.col("key").startswith(_RECORD)).select(F.col("id").alias("comp"), F.lit(1).alias("weight"), F.lit(None).cast("string").alias("split"))
        if s["parts"]:
            before = self._comps(s, known.select("comp")).where("comp = root").select("comp", "weight", "split")
            came = came.unionByName(before)
        touched = came.join(roots, "comp", "left").groupBy(root.alias("comp")).agg(
            F.sum("weight").alias("weight"), F.min("split").alias("lo"), F.max("split").alias("hi")
        )
        split = F.when(F.col("lo") != F.col("hi"), QUARANTINE).otherwise(F.col("lo"))
        comps, _ = settle(touched.select("comp", split.alias("split"), "weight"))
        now = _by_split(comps)
        weights = dict(s["weights"])
        for x, w in now.items():
            if x is not None:
                weights[x] = weights.get(x, 0) + w
        if s["parts"]:
            for x, w in _by_split(before).items():
                weights[x] -= w
        filled, _ = settle(self._fill(comps, weights, now.get(None, 0)))
        for x, w in _by_split(filled.where("was IS NULL")).items():
            weights[x] = weights.get(x, 0) + w
        rows = filled.select("comp", F.col("comp").alias("root"), "split", "weight")
        none = (F.lit(None).cast("string").alias("split"), F.lit(0).cast("bigint").alias("weight"))
        if s["parts"]:
            # merged components, and those that pointed to them
            merged = self._comps(s).where("comp <> root").select("comp", F.col("root").alias("old"))
            again = merged.join(roots.select(F.col("comp").alias("old"), "root"), "old").select("comp", "root", *none)
            gone = before.join(roots, "comp").select("comp", "root", *none)
            rows = rows.unionByName(gone).unionByName(again)
        rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{here}/comps")
        s = {"version": version, "applied": [*s["applied"], name], "parts": [*s["parts"], here], "weights": weights}
        self.log.commit(s)
        if len(s["parts"]) > self.most_parts:
            self.compact()

    def compact(self) -> None:
        """Writes the logs anew as one part."""
        s = self.state()
        version = s["version"] + 1
        here = f"{self.path}/v{version:08d}"
        self._keys(s).write.mode("overwrite").parquet(f"{here}/keys")
        self._comps(s).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{here}/comps")
        self.log.commit(s | {"version": version, "parts": [here]})

    def _fill(self, comps: DataFrame, have: Mapping[str, int], new: int) -> DataFrame:
        """``comps`` with ``was``, the split before; components without one get one, so that the splits come near their proportions.

        The new components are laid along a line, the largest first, the line is divided
        in the proportion of the deficits, and a component goes where its middle lies.
        """
        kept = comps.withColumn("was", F.col("split"))
        if not new:
            return kept
        total = new + sum(have.get(x, 0) for x in self.proportions)
        gaps = {s: max(0.0, p * total - have.get(s, 0)) for s, p in self.proportions.items()}
        scale = new / (sum(gaps.values()) or 1)
        ends, at = [], 0.0
        for s in sorted(gaps, key=lambda s: (-gaps[s], s)):
            at += gaps[s] * scale
            ends.append((s, at))
        # slots in the order of falling size: the power of two, then a hash; as many as the records need
        slots = -(-new // SLOT_RECORDS)
        size = 40 - F.floor(F.log2("weight"))
        slot = size * F.lit(slots) + F.pmod(F.xxhash64("comp"), F.lit(slots))
        fresh = comps.where("split IS NULL").withColumn("slot", slot)
        laid = bucketed_running_sum(fresh, "weight", "slot", [F.desc("weight"), "comp"], "upto")
        middle = F.col("upto") - F.col("weight") / 2
        split = F.lit(ends[-1][0])
        for s, end in reversed(ends[:-1]):
            split = F.when(middle < F.lit(end), s).otherwise(split)
        filled = laid.select("comp", split.alias("split"), "weight", F.lit(None).cast("string").alias("was"))
        return kept.where("split IS NOT NULL").unionByName(filled)

    def groups(self) -> DataFrame:
        """id and comp (the smallest id of the component) of every record so far."""
        s = self.state()
        if not s["parts"]:
            return self.spark.createDataFrame([], "id bigint, comp bigint")
        mine = self._keys(s).where(F.col("key").startswith(_RECORD))
        mine = mine.select(F.substring("key", len(_RECORD) + 1, 20).cast("bigint").alias("id"), "comp")
        moved = self._comps(s).where("comp <> root").select("comp", "root")
        return mine.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))

    def assigned(self) -> DataFrame:
        """id, comp (the smallest id of the component) and split of every record so far."""
        s = self.state()
        if not s["parts"]:
            return self.spark.createDataFrame([], "id bigint, comp bigint, split string")
        roots = self._comps(s).where("comp = root").select("comp", "split")
        return self.groups().join(roots, "comp").select("id", "comp", "split")
