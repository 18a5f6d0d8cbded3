"""Tables of a data folder, and reusable readers for the text formats of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, modified and length of every file below `root` with the suffix; contents aren't read unless asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines of text files, gzip included."""
    return spark.read.text(path)


def model_rows(lines: DataFrame, word_model: bool = False) -> DataFrame:
    """(gram, freq) of a model file: `gram TAB freq` for characters, `freq TAB word` for words. A malformed line is an error, a blank one isn't."""
    parts = F.split("value", "\t")
    gram, freq = (parts[1], parts[0]) if word_model else (parts[0], parts[1])
    good = lines.where(F.trim("value") != "")
    checked = F.when(F.size(parts) == 2, freq).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), F.col("value"))))
    return good.select(gram.alias("gram"), checked.cast("bigint").alias("freq"))


def anchor_pairs(lines: DataFrame, columns: int, first: int, second: int) -> DataFrame:
    """(w1, w2) of an anchor list with `/` between `columns` columns; comment lines start with # or &."""
    parts = F.split("value", "/")
    pick = lambda k: F.trim(parts[k])
    kept = lines.where(~F.substring("value", 1, 1).isin("#", "&") & (F.size(parts) == columns))
    return kept.select(pick(first).alias("w1"), pick(second).alias("w2")).where("w1 <> '' and w2 <> ''")


def typo_pairs(lines: DataFrame, order: str | Column) -> DataFrame:
    """(typo, correction): lines with a correction that differs; the last of repeated typos counts."""
    parts = F.split("value", "\t")
    kept = lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("typo"), F.trim(parts[1]).alias("correction"), F.col(order).alias("at") if isinstance(order, str) else order.alias("at"))
    return kept.where("typo <> correction and correction <> ''").groupBy("typo").agg(F.max_by("correction", "at").alias("correction"))
