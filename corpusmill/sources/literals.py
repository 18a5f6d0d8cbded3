"""Small tables written in code, as a DataFrame and as SQL; and documents dressed by such a table.

A table of cases dresses every document in one of them, in turn by its id: ◊ in a case is the document's text as small ASCII words, ◆ the same without blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    parts = [f"chr({ord(p)})" if _control(p) else "'" + p.replace("'", "''") + "'" for p in re.split(r"([\x00-\x1f\x7f-\x9f])", v) if p]
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _control(p: str) -> bool:
    return len(p) == 1 and (ord(p) < 32 or 127 <= ord(p) < 160)


def values(columns: str, rows: list[tuple]) -> str:
    """`(values ...) as t(columns)`."""
    return "(values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") as t({columns})"


def _case_ids(rows: list[tuple]) -> list:
    return list(dict.fromkeys(r[0] for r in rows))


def dressed(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """Every document in its case: the table's columns, the first one being the document's id. Rows with the same first value are one case."""
    cases = _case_ids(rows)
    table = spark.createDataFrame([(cases.index(r[0]), *r) for r in rows], f"__case int, {schema}")
    key, *names = table.columns[1:]
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(words == "", "x").otherwise(words).alias("__words"), F.pmod("doc_id", F.lit(len(cases))).cast("int").alias("__case"))
    kinds = dict(table.dtypes)
    plain = F.replace("__words", F.lit(" "), F.lit(""))
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("◊"), F.col("__words")), F.lit("◆"), plain) if kinds[c] == "string" else F.col(c)
    return docs.join(F.broadcast(table), "__case").select(F.col("doc_id").alias(key), *(fill(c).alias(c) for c in names))


def dressed_sql(columns: str, rows: list[tuple], cases: list[tuple] | None = None) -> str:
    """The same as SQL. cases: the table that dresses the documents, if rows are something that follows from it."""
    ids = _case_ids(cases or rows)
    key, *names = (c.strip() for c in columns.split(","))
    text = {c for k, c in enumerate(names, 1) if any(isinstance(r[k], str) for r in rows)}
    fill = ", ".join(f"replace(replace({c}, '◊', w), '◆', replace(w, ' ', '')) as {c}" if c in text else c for c in names)
    docs = "select doc_id, doc_id % {n} as __case, case when w = '' then 'x' else w end as w from (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) as w from documents)"
    table = values(f"__case, __id, {', '.join(names)}", [(ids.index(r[0]), *r) for r in rows])
    return f"(select doc_id as {key}, {fill} from ({docs.format(n=len(ids))}) join {table} using (__case))"
