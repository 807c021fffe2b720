"""A run of named steps with a manifest: what is finished, and still fits, is not done again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """A table made from the tables of earlier steps; `options` are what else it depends on."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


class Run:
    """Tables below a folder that all machines share, one for each finished step.

    A step's mark is a hash of its name, its options and the marks of the steps it
    needs.  Its table lies in a folder named by the mark, and its manifest, written
    after the table, names that folder: a run that was cut off goes on at the first step
    without one, and a step whose options changed is made again, with all that need it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.made: list[str] = []
        self.skipped: list[str] = []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> dict | None:
        at = self._path(f"{self.root}/_steps/{name}.json")
        return json.loads(self.spark.read.text(at.toString(), wholetext=True).first()["value"]) if self._files().exists(at) else None

    def _write(self, name: str, manifest: dict) -> None:
        files, at = self._files(), f"{self.root}/_steps/{name}.json"
        out = files.create(self._path(at + ".tmp"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        files.delete(self._path(at), False)
        files.rename(self._path(at + ".tmp"), self._path(at))

    def __call__(self, steps: list[Step]) -> dict[str, DataFrame]:
        """The tables of all steps, in order; only those without a manifest of their mark are made."""
        tables: dict[str, DataFrame] = {}
        marks: dict[str, str] = {}
        for step in steps:
            if missing := [n for n in step.needs if n not in marks]:
                raise ValueError(f"{step.name} needs {missing}, which come later or not at all")
            if step.name in marks:
                raise ValueError(f"two steps are named {step.name}")
            mark = hashlib.sha1(json.dumps([step.name, step.options, [marks[n] for n in step.needs]], sort_keys=True).encode()).hexdigest()[:16]
            marks[step.name] = mark
            at = f"{self.root}/{step.name}-{mark}"
            done = self._manifest(step.name)
            if done and done["mark"] == mark:
                self.skipped.append(step.name)
            else:
                step.make({n: tables[n] for n in step.needs}).write.mode("overwrite").parquet(at)
                self._write(step.name, {"mark": mark, "table": at, "options": step.options})
                self.made.append(step.name)
            tables[step.name] = self.spark.read.parquet(at)
        return tables
