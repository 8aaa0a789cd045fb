"""Messages delivered at least once, kept exactly once.

``DeliveryStore`` holds the current copy of every message in partitions of the day on
which the message was first delivered (its home), and an identifier index that says
which partition that is. A batch of messages is merged by

1. looking its identifiers up in the index, which names the affected partitions,
2. reading only these partitions and adding the incoming messages,
3. choosing one winner per identifier (a hash aggregate with map-side combine, so an
   identifier that holds a third of all rows is folded before it is shuffled) and
   joining it to its row by the row id,
4. writing the affected partitions anew beside the old ones and switching to them by
   one atomic rename of a manifest. Readers see the state before or after, never
   between; a batch that was committed is not applied again.

The index grows by the new identifiers of each batch. A batch that is small enough to be
broadcast filters it while it is scanned, so the history is not shuffled for it; when
``MOST_INDEX`` parts have come together they are written as one, and ``vacuum`` deletes
what no state refers to any more.

Defined results: a message with a null or NaN part in its identifier identifies
nothing and is always kept; of equal load times the largest row id wins; a null load
time loses against any other; rows that repeat a row id are one row; an empty batch
changes nothing; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triloom.functions.naming import micro_units, squeeze, trajectory_key
from triloom.runtime import broadcast_bytes, cut, delete_path, hadoop_path, observed_values, plan_bytes, settle
from triloom.sources.versions import VersionLog

_OWN = ("__home", "__part")
_LOST = "lost"
MOST_INDEX = 16


def record_identifier() -> list[Column]:
    """run, p to six decimals and algorithm of a ``records`` row, however written."""
    return [trajectory_key("run_id"), micro_units("p"), squeeze("algo")]


class DeliveryStore:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        identifier: Sequence[Column],
        row_id: str = "rec_id",
        loaded_at: str = "loaded_at",
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, path)
        self.identifier, self.row_id, self.loaded_at = list(identifier), row_id, loaded_at

    def state(self) -> dict:
        """The manifest: home -> directory of its current version, and what was applied."""
        return self.log.read() or {"version": 0, "homes": {}, "index": [], "applied": [], "dropped": []}

    # -- reading ----------------------------------------------------------------

    def _read(self, dirs: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*dirs)

    def _index(self, s: dict) -> DataFrame:
        """__k1, __k2, __home of every identifier."""
        return self._read(s["index"]).where("__new").select("__k1", "__k2", "__home")

    def current(self) -> DataFrame:
        """One row per identified message, and every message without an identifier."""
        s = self.state()
        if not s["homes"]:
            raise ValueError("the store is empty")
        rows = self._read(sorted(s["homes"].values())).drop(*_OWN)
        return rows.withColumnsRenamed({c + s["tail"]: c for c in _OWN})

    def _tail(self, batch: DataFrame) -> str:
        """What is hung on columns of the batch that have the store's own names; no other column ends so."""
        tail = "_"
        while any(c + tail in batch.columns for c in _OWN):
            tail += "_"
        return tail

    def dropped(self) -> DataFrame:
        """The ids of all rows that lost against another copy so far."""
        lost = []
        for d in self.state()["dropped"]:
            fs, p = hadoop_path(self.spark, d)
            lost += [d] if fs.exists(p) else []
        if not lost:
            return self.current().select(self.row_id).where(F.lit(False))
        return self._read(lost).select(self.row_id).distinct()

    # -- writing ----------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_name: str) -> dict:
        """Merges one batch; returns the manifest. A batch name is applied once."""
        s = self.state()
        if batch_name in s["applied"]:
            return s
        s = s | {"tail": s.get("tail") or self._tail(batch)}
        batch = batch.withColumnsRenamed({c: c + s["tail"] for c in batch.columns if c in _OWN})
        v = s["version"] + 1
        here = f"{self.path}/v{v:08d}"
        incoming = batch.select(*self._key(), self._home(), self._rank(), F.lit(True).alias("__new"))
        old = None
        if s["index"]:
            index = self._index(s).withColumnRenamed("__home", "__old")
            incoming, _ = settle(incoming)
            few = incoming.select("__k1", "__k2").distinct()
            if plan_bytes(few) <= broadcast_bytes(self.spark):
                index = index.join(F.broadcast(few), ["__k1", "__k2"], "left_semi")  # of a size just looked at
            incoming = cut(
                incoming.join(index, ["__k1", "__k2"], "left").select(
                    "__k1", "__k2", F.coalesce("__old", "__home").alias("__home"), "__rank", F.col("__old").isNull().alias("__new")
                )
            )
            touched = {r[0] for r in incoming.select("__home").distinct().collect()}  # days: bounded by the calendar
            dirs = [d for h, d in s["homes"].items() if int(h) in touched]
            old = self._read(dirs) if dirs else None
        ranked = incoming
        if old is not None:
            ranked = ranked.union(old.select(*self._key(), "__home", self._rank(), F.lit(False).alias("__new")))
        best = ranked.groupBy("__k1", "__k2").agg(
            F.max("__rank").alias("__rank"), F.min("__home").alias("__home"), F.min("__new").alias("__new")
        )
        # what is new in it is this version's part of the index
        best.select("__k1", "__k2", "__home", "__new", self._row_of("__rank").alias("__row")).write.parquet(f"{here}/index")
        best = self._read([f"{here}/index"])
        rows = batch if old is None else batch.unionByName(old.drop("__home"))
        if self._write(rows, best, f"{here}/data") > best.count():
            # the batch repeats row ids: one row of each is enough
            self._write(rows.dropDuplicates([self.row_id]), best, f"{here}/data")
        homes = [r[0] for r in best.select("__home").distinct().collect()]
        s = {
            "version": v,
            "tail": s["tail"],
            "homes": {**s["homes"], **{str(h): f"{here}/data/__part={h}" for h in homes}},
            "index": [*s["index"], f"{here}/index"],
            "applied": [*s["applied"], batch_name],
            "dropped": [*s["dropped"], f"{here}/data/__part={_LOST}"],
        }
        if len(s["index"]) > MOST_INDEX:
            whole = f"{here}/whole_index"
            self._index(s).withColumn("__new", F.lit(True)).write.mode("overwrite").parquet(whole)
            s["index"] = [whole]
        self.log.commit(s)
        return s

    def vacuum(self) -> int:
        """Deletes the folders of earlier versions that the state does not refer to; returns how many. No reader may still use an earlier state."""
        s = self.state()
        held = {*s["homes"].values(), *s["index"], *s["dropped"]}
        gone = 0
        for v in range(1, s["version"] + 1):
            fs, folder = hadoop_path(self.spark, f"{self.path}/v{v:08d}")
            for kind in ("index", "whole_index"):
                at = f"{self.path}/v{v:08d}/{kind}"
                if at not in held and fs.exists(hadoop_path(self.spark, at)[1]):
                    delete_path(self.spark, at)
                    gone += 1
            _, data = hadoop_path(self.spark, f"{self.path}/v{v:08d}/data")
            for part in fs.listStatus(data) if fs.exists(data) else []:
                at = f"{self.path}/v{v:08d}/data/{part.getPath().getName()}"
                if part.isDirectory() and at not in held:
                    delete_path(self.spark, at)
                    gone += 1
        return gone

    def _write(self, rows: DataFrame, best: DataFrame, to: str) -> int:
        """Winners to the directory of their home, the others to one of their own; returns the winners written.

        The join is on the row id, which is unique, so no identifier is a hot key in it.
        """
        best = best.select("__row", "__home")
        joined = rows.join(best, rows[self.row_id].eqNullSafe(best["__row"]), "left")
        part = F.coalesce(F.col("__home").cast("string"), F.lit(_LOST))
        parted = joined.drop("__row").withColumn("__part", part).hint("rebalance", "__part")
        seen = Observation()
        parted.observe(seen, F.count("__home").alias("kept")).write.mode("overwrite").partitionBy("__part").parquet(to)
        return (observed_values(seen) or {"kept": 0})["kept"]

    def _key(self) -> list[Column]:
        """Two 64-bit hashes of the identifier, together its key.

        A row without a whole identifier gets a key of its own row id.
        """
        whole = F.lit(True)
        for c in self.identifier:
            whole = whole & c.isNotNull()
        parts = [F.coalesce(c.cast("string"), F.lit("")) for c in self.identifier]
        own = F.concat(F.lit("\u0003"), F.col(self.row_id).cast("string"))
        name = F.when(whole, F.concat_ws("\u0002", *parts)).otherwise(own)
        return [F.xxhash64(name).alias("__k1"), F.xxhash64(F.lit("b"), name).alias("__k2")]

    def _home(self) -> Column:
        return F.coalesce(F.unix_date(F.col(self.loaded_at).cast("date")), F.lit(0)).alias("__home")

    def _rank(self) -> Column:
        """Load time, then row id, in one decimal: its maximum needs no sort."""
        at = F.coalesce(F.unix_micros(F.col(self.loaded_at).cast("timestamp")), F.lit(-(1 << 60)))
        row = F.coalesce(F.col(self.row_id).cast("bigint"), F.lit(-(1 << 63))).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
        return (at.cast("decimal(19,0)") * F.lit(Decimal(1 << 64)) + row).cast("decimal(38,0)").alias("__rank")

    def _row_of(self, rank: str) -> Column:
        row = F.pmod(F.col(rank), F.lit(Decimal(1 << 64)).cast("decimal(38,0)")) - F.lit(Decimal(1 << 63))
        row = row.cast("bigint")
        return F.when(row != F.lit(-(1 << 63)), row)


def merge_deliveries(store: DeliveryStore, deliveries: DataFrame, order: str, cuts: Sequence) -> DeliveryStore:
    """Applies ``deliveries`` in rounds: up to the first cut of ``order``, the second, and the rest.

    Rows whose ``order`` is null come in the first round.
    """
    edges = [None, *cuts, None]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = deliveries
        if lo is not None:
            part = part.where(F.col(order) >= F.lit(lo))
        if hi is not None:
            part = part.where((F.col(order) < F.lit(hi)) | (F.col(order).isNull() if lo is None else F.lit(False)))
        store.apply(part, f"round-{k}")
    return store
