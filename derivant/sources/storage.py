"""Shared storage for results that cut a lineage, and relations kept as a few tables in it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="derivant-")
        context.setCheckpointDir(where)
    return where


@dataclass(frozen=True)
class Table:
    """A frame in shared storage, which outlives executors."""

    frame: DataFrame
    rows: int
    path: str

    def delete(self) -> None:
        spark = self.frame.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, name: str = "relation") -> Table:
    """df written to shared storage, its rows counted as they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return Table(spark.read.schema(df.schema).parquet(path), seen.get["n"], path)


@dataclass
class Parts:
    """A growing relation as at most ``most`` tables, the oldest first.

    A table holds what was new at some time; with ``replace`` its rows take the place of
    older ones with equal keys. When there are too many, the youngest ones are rewritten
    as one until each is at least twice the next, so a row is rewritten a logarithmic
    number of times and a plan that reads the relation does not grow.
    """

    keys: Sequence[str]
    replace: bool
    most: int = 8
    tables: list[Table] = field(default_factory=list)
    #: Tables that this relation does not read any more; frames made before still may.
    dead: list[Table] = field(default_factory=list)

    def _read(self, tables: Sequence[Table]) -> DataFrame:
        out = tables[0].frame
        for t in tables[1:]:
            if self.replace:
                out = out.join(t.frame.select(*self.keys), list(self.keys), "left_anti")
            out = out.unionByName(t.frame)
        return out

    def frame(self) -> DataFrame:
        return self._read(self.tables)

    def add(self, table: Table) -> None:
        self.tables.append(table)
        if len(self.tables) > self.most:
            last, rows = len(self.tables) - 2, self.tables[-1].rows + self.tables[-2].rows
            while last and self.tables[last - 1].rows < 2 * rows:
                last -= 1
                rows += self.tables[last].rows
            merged = stored(self._read(self.tables[last:]), "merged")
            self.dead += self.tables[last:]
            self.tables[last:] = [merged]
