"""Where lineage is cut: Spark's reliable checkpoints, in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; one of our own only where driver and executors are one process."""
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lakemill-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a column of consecutive numbers from 1 in order of its partitions; no task sees all rows.

    The only rows that come to the driver are the partitions' counts.
    """
    df = cut(df.withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    base, at = [], 0
    for k, n in sorted((r[0], r[1]) for r in df.groupBy(part).count().collect()):
        base.append((k, at))
        at += n
    bases = df.sparkSession.createDataFrame(base, "_part long, _base long")
    return df.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + place + 1).drop("_part", "_base")


class Store:
    """Small files below a path that only Spark may know how to reach; rename replaces in one step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def write(self, name: str, text: str) -> None:
        out = self.at(name).getFileSystem(self.conf).create(self.at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        found = self.at(name).getFileSystem(self.conf).open(self.at(name))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def rename(self, old: str, new: str) -> None:
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(new).toUri(), self.conf)
        context.rename(self.at(old), self.at(new), kinds)
