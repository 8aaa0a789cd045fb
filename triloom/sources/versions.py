"""A log of versions in the shared folder: the state of a store, switched by one atomic rename."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from triloom.runtime import hadoop_path


class VersionLog:
    """``path/_manifest/<version>.json``; the last one is the state. Two writers cannot commit one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> dict | None:
        fs, folder = hadoop_path(self.spark, f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/_manifest/{max(names)}", wholetext=True).first()[0])

    def commit(self, state: dict) -> None:
        """Makes ``state`` (with its ``version``) the state, or raises if that version exists."""
        fs, tmp = hadoop_path(self.spark, f"{self.path}/_manifest/.{state['version']:08d}.tmp")
        _, final = hadoop_path(self.spark, f"{self.path}/_manifest/{state['version']:08d}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not fs.rename(tmp, final):
            raise RuntimeError(f"version {state['version']} was committed by another writer")
