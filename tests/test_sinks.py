"""Written translation memories and token texts: read back whole; a failed job leaves nothing."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import formats, sinks

ROWS = [("en", "a & b <c>", "de", "ä “x”"), ("en", " ", "de", "no source"), ("en", None, "de", "none"), ("en", "same", "de", "same"), ("en", "same", "de", "same"), ("", "long " * 50_000, "de", "l"), ("en", "line\nbreak", "fr", "y")]
SCHEMA = "src_lang string, src_text string, tgt_lang string, tgt_text string"


def read(spark, path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tmx").load(str(path)).select("path", F.col("content").cast("string").alias("xml"))
    return sorted(tuple(r) for r in formats.tmx_units(files, "path", "xml").select("src_lang", "src_text", "tgt_lang", "tgt_text").collect())


def names(path):
    return sorted(p.name for p in path.iterdir() if not p.name.endswith(".crc")) if path.exists() else []


def test_memories_come_back(spark, tmp_path):
    sinks.register(spark)
    want = sorted(r for r in ROWS if (r[1] or "").strip())
    out = tmp_path / "tmx"
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.format("corpusmill_tmx").mode("append").save(str(out))
    assert read(spark, out) == want and all(n.startswith("part-") for n in names(out))
    spark.createDataFrame(ROWS[:1], SCHEMA).write.format("corpusmill_tmx").mode("append").save(str(out))
    assert read(spark, out) == sorted([*want, ROWS[0]])
    spark.createDataFrame(ROWS[3:4], SCHEMA).write.format("corpusmill_tmx").mode("overwrite").save(str(out))
    assert read(spark, out) == [ROWS[3]]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "tmx"
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    bad = rows.withColumn("tgt_text", F.when(F.length("src_text") > 1000, F.raise_error(F.lit("no"))).otherwise(F.col("tgt_text")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("corpusmill_tmx").mode("append").save(str(out))
    assert names(out) == []


def test_token_texts(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "vrt"
    spark.createDataFrame([('<text id="1">\n</text>',), (None,)], "vrt string").coalesce(1).write.format("corpusmill_vrt").mode("append").save(str(out))
    assert [p.read_text() for p in out.glob("part-*.vrt")] == ['<text id="1">\n</text>\n']
