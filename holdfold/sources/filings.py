"""Readers of regulatory files: index lines, envelopes, XML and text tables, zipped TSV, JSON columns."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an information table, in order, with the tags they come from (fixed values of the public format).
INFO_TAGS = (
    ("issuer", "nameOfIssuer"), ("title_of_class", "titleOfClass"), ("cusip", "cusip"), ("figi", "figi"), ("value", "value"),
    ("shares", "sshPrnamt"), ("share_type", "sshPrnamtType"), ("put_call", "putCall"), ("discretion", "investmentDiscretion"),
    ("voting_sole", "Sole"), ("voting_shared", "Shared"), ("voting_none", "None"),
)


def index_lines(lines: DataFrame, forms: Sequence[str] = ("13F-HR", "13F-HR/A")) -> DataFrame:
    """(form, company, cik, filed, path) from lines of a fixed-width form index in a column ``value``; other lines and forms are left out."""
    pattern = r"^(\S+(?: \S+)?)\s{2,}(.+?)\s{2,}(\d{1,10})\s+(\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = lines.where(F.col("value").rlike(pattern))
    rows = rows.select(part(1).alias("form"), F.trim(part(2)).alias("company"), part(3).cast("long").alias("cik"), part(4).cast("date").alias("filed"), part(5).alias("path"))
    return rows.where(F.col("form").isin(*forms))


def json_columns(documents: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """Rows from JSON objects of parallel arrays, one column per field; all are strings."""
    schema = "struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">"
    zipped = documents.select("*", F.from_json(column, schema).alias("_j")).select("*", F.explode(F.arrays_zip(*[F.col(f"_j.{f}").alias(f) for f in fields])).alias("_r"))
    return zipped.select(*[c for c in documents.columns if c != column], *[F.col(f"_r.{f}").alias(f) for f in fields])


def envelope_documents(filings: DataFrame, column: str = "raw") -> DataFrame:
    """(other columns, number, type, body) for each document of an SGML envelope."""
    parts = F.regexp_extract_all(column, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    rows = filings.select(*[c for c in filings.columns if c != column], F.posexplode(parts).alias("number", "_d"))
    kind = F.trim(F.regexp_extract("_d", r"<TYPE>([^\r\n<]*)", 1))
    text = F.regexp_extract("_d", r"(?s)<TEXT>(.*?)</TEXT>", 1)
    return rows.withColumns({"type": kind, "body": F.trim(text)}).drop("_d")


def information_table(documents: DataFrame, column: str = "body") -> DataFrame:
    """Rows of XML information tables, namespaces ignored; numbers are null where they don't parse."""
    clean = F.regexp_replace(column, r"<(/?)[A-Za-z0-9]+:", "<$1")
    entries = F.regexp_extract_all(clean, F.lit(r"(?s)<infoTable\b[^>]*>(.*?)</infoTable>"), 1)
    rows = documents.select(*[c for c in documents.columns if c != column], F.explode(entries).alias("_e"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("_e", rf"(?s)<{tag}\b[^>]*>([^<]*)</{tag}>", 1)), F.lit(""))
    numeric = {"value", "shares", "voting_sole", "voting_shared", "voting_none"}
    number = lambda c: F.regexp_replace(c, "[$,]", "").try_cast("double")
    return rows.withColumns({name: number(value(tag)) if name in numeric else value(tag) for name, tag in INFO_TAGS}).drop("_e")


def text_table(documents: DataFrame, column: str = "body") -> DataFrame:
    """Rows of legacy text tables: issuer, class, cusip, value and shares, split at runs of spaces."""
    rows = documents.select(*[c for c in documents.columns if c != column], F.explode(F.split(column, r"\r?\n")).alias("_l"))
    pattern = r"^\s*(\S.*?)\s{2,}(\S.*?)\s+([0-9A-Z]{9})\s+([\d,]+)\s+([\d,]+)(?:\s+(\S+))?.*$"
    part = lambda k: F.regexp_extract("_l", pattern, k)
    number = lambda k: F.regexp_replace(part(k), ",", "").try_cast("double")
    rows = rows.where(F.col("_l").rlike(pattern))
    return rows.withColumns({"issuer": part(1), "title_of_class": part(2), "cusip": part(3), "value": number(4), "shares": number(5), "share_type": F.nullif(part(6), F.lit(""))}).drop("_l")


def zipped_table(files: DataFrame, member: str, columns: Sequence[str]) -> DataFrame:
    """Rows (as strings) of one tab-separated member of each archive in a ``binaryFile`` DataFrame.

    The member's name is matched without regard to case; a missing member or column raises.
    """
    names = list(columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if n.rsplit("/", 1)[-1].lower() == member.lower()]
                    if not found:
                        raise ValueError(f"{path} has no {member}")
                    with z.open(found[0]) as f:
                        for part in pd.read_csv(f, sep="\t", dtype=str, chunksize=50_000):
                            missing = [c for c in names if c not in part.columns]
                            if missing:
                                raise ValueError(f"{path}: {member} lacks {missing}")
                            yield part[names].assign(path=path)

    return files.select("path", "content").mapInPandas(read, ", ".join(f"{c} string" for c in [*names, "path"]))


def with_reference(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """A CSV panel under a given schema; raises where the header lacks a required column."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return spark.read.option("header", True).schema(schema).csv(path)


def manifest(index: DataFrame, api: DataFrame) -> DataFrame:
    """Index rows with acceptance times of the API where it has them, else the end of the filing day; one row per accession, the smallest path of those filed first."""
    late = F.to_timestamp(F.concat(F.col("filed").cast("string"), F.lit(" 23:59:59")))
    rest = [c for c in index.columns if c not in ("accession", "filed", "path")]
    first = index.groupBy("accession").agg(F.min(F.struct("filed", "path", *rest)).alias("_r")).select("accession", "_r.*")
    times = api.groupBy("accession").agg(F.min("accepted").alias("accepted"))
    return first.join(times, "accession", "left").withColumn("accepted", F.coalesce("accepted", late))


def column_store(df: DataFrame, path: str, by: str) -> None:
    """Writes a panel partitioned by period, so that a scan of one period reads its files alone; a large period is written by several tasks."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
