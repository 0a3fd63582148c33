"""Small files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name below the folder that all executors share; a temporary folder stands in for it in a single process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kelpie-")
        atexit.register(shutil.rmtree, own, True)
        base = "file://" + own
    return f"{base.rstrip('/')}/kelpie-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for what has to be the same in several jobs; removed at exit."""
    spark, path, schema = df.sparkSession, shared_folder(df.sparkSession), df.schema
    df.write.parquet(path)

    def remove() -> None:
        try:
            Files(spark).delete(path)
        except Exception:  # the session has ended; the cluster clears its folder
            pass

    atexit.register(remove)
    return spark.read.schema(schema).parquet(path)


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.hadoop = spark._jvm.org.apache.hadoop
        #: Called with (step, path) before each change; tests make it fail.
        self.before = lambda step, path: None

    def _at(self, path: str):
        target = self.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def is_file(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target) and fs.getFileStatus(target).isFile()

    def make_folder(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def names(self, folder: str) -> list[str]:
        fs, target = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def size(self, path: str) -> int:
        fs, target = self._at(path)
        return fs.getContentSummary(target).getLength()

    def read_bytes(self, path: str) -> bytes:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")

    def write_text(self, path: str, text: str) -> None:
        """Written beside the target and renamed, so that the target is whole or absent."""
        self.before("write", path)
        fs, target = self._at(path)
        _, beside = self._at(path + ".tmp")
        stream = fs.create(beside, True)
        stream.write(text.encode("utf-8"))
        stream.close()
        self.rename(path + ".tmp", path)

    def rename(self, source: str, target: str) -> None:
        self.before("rename", target)
        fs, a = self._at(source)
        _, b = self._at(target)
        if not fs.rename(a, b):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self.before("delete", path)
        fs, target = self._at(path)
        fs.delete(target, True)
