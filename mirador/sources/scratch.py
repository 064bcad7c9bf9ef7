"""Tables written down between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if the master is local, as in tests; else an error, since a
    machine's own folder is no shared one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="mirador-tables-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/mirador-{name}-{uuid.uuid4().hex}"


class Tables:
    """Tables written so far by one operator; on leaving, all go but those that are kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """df as written and read again; its lineage ends there."""
        path = new_folder(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        if keep:
            self.kept.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *failed) -> None:
        from mirador.sources.io import remove

        for path in self.paths:
            if failed[0] is not None or path not in self.kept:
                remove(self.spark, path)
