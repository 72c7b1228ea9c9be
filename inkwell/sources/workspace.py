"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Remove a job's shuffle files when its result is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables in the folder that driver and executors share (spark.checkpoint.dir).

    A table written here cuts lineage: losing an executor afterwards costs nothing that was written, and the shuffle
    files behind it are freed at once. Only on one machine, as in tests, may the session name no folder; a
    temporary one is made then. On a cluster that raises an error, as executors wouldn't see each other's files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^\]]*\])?", master):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            base = tempfile.mkdtemp(prefix="inkwell-")
            atexit.register(shutil.rmtree, base, True)
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def cut(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """The table, written and read again; compression: a codec of Spark's Parquet writer other than the session's."""
        path = f"{self.base}/{self.count:03d}"
        self.count += 1
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
