"""Written intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session on one machine (tests) that has none gets a temporary folder; a cluster's must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpusmill-"))
    return folder.rstrip("/")


class Written:
    """A table written once: lineage ends here, and a lost executor costs no recomputation."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.path = f"{shared_folder(self.spark)}/corpusmill-{uuid.uuid4().hex}"
        self.schema = rows.schema
        rows.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Tables that results still read; they go when the program ends.
kept: list[Written] = []


@atexit.register
def _drop_kept() -> None:
    while kept:
        table = kept.pop()
        if SparkContext._active_spark_context is table.spark.sparkContext:
            table.drop()


def written(rows: DataFrame) -> DataFrame:
    """A table that a result reads; it stays as long as the program."""
    kept.append(Written(rows))
    return kept[-1].read()


class Scratch:
    """Tables of one operator call, dropped at its end: `with Scratch() as tmp: rows = tmp(rows)`."""

    def __enter__(self) -> Scratch:
        self.tables: list[Written] = []
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.tables.append(Written(rows))
        return self.tables[-1].read()

    def __exit__(self, *error) -> None:
        for table in self.tables:
            table.drop()
