"""Searches that can be watched, stopped and taken up again: a folder for each run, in a store that Spark reads and writes.

After each generation the search's whole state is stored with a row of progress. Stopping is cooperative: a mark in the
folder ends the search before its next generation, and the jobs that it runs now are cancelled by the run's tag. A run
that is started again goes on from its last stored generation, to the same result as one that was never stopped."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

STATUS = "run string, generation int, generations int, state string, best double, evaluated long, archive long, seconds double, at double"


class Run:
    def __init__(self, spark: SparkSession, root: str, name: str):
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"`{name}` cannot name a run: letters, digits, - and _ can")
        self.spark, self.name, self.folder = spark, name, f"{root.rstrip('/')}/{name}"
        self.tag, self._began = f"mining-{name}", time.time()

    def _text(self, value: dict, path: str) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _found(self, part: str) -> list[str]:
        fs, path = store._fs(self.spark, f"{self.folder}/{part}")
        if not fs.exists(path):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(store._fs(self.spark, s.getPath().toString() + "/_SUCCESS")[1]))

    def latest(self) -> dict | None:
        """The state after the last generation that was stored whole."""
        found = self._found("states")
        return json.loads(self.spark.read.text(found[-1]).first()["value"]) if found else None

    def save(self, generation: int, state: dict) -> None:
        self._text(state, f"{self.folder}/states/{generation:06d}")

    def log(self, generation: int, generations: int, state: str, best: float, evaluated: int, archive: int) -> None:
        now = time.time()
        row = (self.name, generation, generations, state, float(best) if best > float("-inf") else None, evaluated, archive, now - self._began, now)
        self.spark.createDataFrame([row], STATUS).coalesce(1).write.mode("append").parquet(f"{self.folder}/progress")

    def status(self) -> DataFrame:
        """A row for each generation and each change of state, in order."""
        if not store.exists(self.spark, f"{self.folder}/progress"):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(f"{self.folder}/progress").orderBy("at")

    def stop(self) -> None:
        """Ends the search, from any thread or application that shares the folder; jobs of this application at once."""
        self._text({"stop": True}, f"{self.folder}/stop")
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def resume(self) -> None:
        """Takes the mark away, so that the search can be started again."""
        fs, path = store._fs(self.spark, f"{self.folder}/stop")
        fs.delete(path, True)

    def stopping(self) -> bool:
        fs, path = store._fs(self.spark, f"{self.folder}/stop")
        return bool(fs.exists(path))

    @contextmanager
    def tagged(self) -> Iterator[None]:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            yield
        finally:
            context.removeJobTag(self.tag)


def overview(spark: SparkSession, root: str) -> DataFrame:
    """The last row of progress of each run in a folder."""
    fs, path = store._fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    parts = [p for p in (f"{root.rstrip('/')}/{n}/progress" for n in sorted(names)) if store.exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], STATUS)
    rows = spark.read.schema(STATUS).parquet(*parts)
    return rows.groupBy("run").agg(F.max_by(F.struct(*[c.split()[0] for c in STATUS.split(", ")[1:]]), "at").alias("r")).select("run", "r.*")
