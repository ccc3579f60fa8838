"""Reference files: symbol directories, fund censuses, series lists, identifier caches, benchmarks, price stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normal_ticker, truthy, valid_figi, valid_identifier
from .filings import zipped_table

#: Names that one column has had over the years, by the name that it gets (fixed values of the public files).
SERIES_COLUMNS = {
    "ticker": ("class ticker", "class-contract-ticker-symbol"), "series_id": ("series id", "series-id"), "class_id": ("class id", "class-contract-id"), "series_name": ("series name",),
    "class_name": ("class name", "class-contract-name"), "cik": ("cik", "cik number"), "registrant_name": ("name of investment company", "company name", "entity name"),
}
#: Fields of a mapping response (fixed values of the public service).
MAPPING_FIELDS = ("figi", "securityType", "securityType2", "marketSector", "ticker", "name", "exchCode", "compositeFIGI", "shareClassFIGI", "securityDescription")


def symbol_directory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(ticker, name, is_exchange_etf, exchange, exchange_source) from pipe-separated directories; trailers and test issues are left out; a file without the flag raises."""
    out = None
    for path in paths:
        data = spark.read.option("header", True).option("sep", "|").csv(path)
        if "ETF" not in data.columns:
            raise ValueError(f"{path} has no ETF field")
        symbol = next((c for c in ("Symbol", "NASDAQ Symbol", "ACT Symbol") if c in data.columns), None)
        if symbol is None:
            raise ValueError(f"{path} has no symbol field")
        get = lambda c, other, data=data: F.coalesce(F.col(f"`{c}`"), F.lit(other)) if c in data.columns else F.lit(other)
        rows = data.where(~F.coalesce(F.col(f"`{data.columns[0]}`").startswith("File Creation Time"), F.lit(False)) & (get("Test Issue", "N") != "Y"))
        source = path.rstrip("/").rsplit("/", 1)[-1]
        rows = rows.select(F.coalesce(normal_ticker(F.col(f"`{symbol}`")), F.lit("")).alias("ticker"), get("Security Name", "").alias("name"), truthy(F.col("ETF")).alias("is_exchange_etf"), get("Exchange", "NASDAQ").alias("exchange"), F.lit(source).alias("exchange_source"))
        out = rows if out is None else out.unionByName(rows)
    best = out.where("ticker <> ''").groupBy("ticker", "exchange_source").agg(F.min(F.struct("name", "is_exchange_etf", "exchange")).alias("_r"))
    return best.select("ticker", "_r.name", "_r.is_exchange_etf", "_r.exchange", "exchange_source")


def fund_census(archives: DataFrame, with_list: bool = True) -> DataFrame:
    """One row per reported class of an exchange-traded fund, from census archives (path, content): funds, their classes and their submissions joined.

    A fund counts if its own flag says so or, ``with_list``, the archive's list of such funds names it.
    """
    fund = zipped_table(archives, "FUND_REPORTED_INFO.tsv", ("FUND_ID", "ACCESSION_NUMBER", "FUND_NAME", "SERIES_ID", "IS_ETF", "IS_INDEX", "IS_MULTI_INVERSE_INDEX"))
    shares = zipped_table(archives, "SHARES_OUTSTANDING.tsv", ("FUND_ID", "CLASS_NAME", "CLASS_ID", "TICKER"))
    sent = zipped_table(archives, "SUBMISSION.tsv", ("ACCESSION_NUMBER", "CIK", "FILING_DATE", "REPORT_ENDING_PERIOD"))
    flag = truthy(F.col("IS_ETF"))
    if with_list:
        listed = zipped_table(archives, "ETF.tsv", ("FUND_ID",)).distinct().withColumn("_listed", F.lit(True))
        fund, flag = fund.join(listed, ["path", "FUND_ID"], "left"), flag | F.coalesce("_listed", F.lit(False))
    day = lambda c: F.to_date(F.try_to_timestamp(F.initcap(F.lower(c)), F.lit("dd-MMM-yyyy")))
    rows = fund.where(flag).join(shares, ["path", "FUND_ID"], "left").join(sent, ["path", "ACCESSION_NUMBER"], "left")
    rows = rows.select(
        F.coalesce(normal_ticker(F.col("TICKER")), F.lit("")).alias("ticker"), F.col("FUND_NAME").alias("fund_name"), F.col("SERIES_ID").alias("series_id"), F.col("CLASS_NAME").alias("class_name"), F.col("CLASS_ID").alias("class_id"), F.col("CIK").alias("cik"),
        truthy(F.col("IS_INDEX")).alias("is_index_fund"), truthy(F.col("IS_MULTI_INVERSE_INDEX")).alias("is_multi_inverse_index"), day(F.col("FILING_DATE")).alias("filing_date"), day(F.col("REPORT_ENDING_PERIOD")).alias("report_end"),
        F.col("ACCESSION_NUMBER").alias("accession"), F.element_at(F.split("path", "/"), -1).alias("source_archive"),
    )
    key = ["ticker", "accession", "series_id", "class_id"]
    rest = [c for c in rows.columns if c not in key]
    best = rows.where("ticker <> ''").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return best.select(*key, "_r.*")


def series_classes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Series and classes from yearly CSV files whose column names differ; files without a ticker column are left out; the year is that of the file's name."""
    out = None
    for path in paths:
        data = spark.read.option("header", True).csv(path)
        plain = {c.lower().strip(): c for c in data.columns}
        found = {name: next((plain[n] for n in names if n in plain), None) for name, names in SERIES_COLUMNS.items()}
        if not found["ticker"]:
            continue
        year = F.nullif(F.regexp_extract(F.lit(path.rstrip("/").rsplit("/", 1)[-1]), r"(20\d{2})", 1), F.lit("")).cast("int")
        cells = {n: F.col(f"`{c}`") if c else F.lit(None).cast("string") for n, c in found.items()}
        rows = data.select(F.coalesce(normal_ticker(cells.pop("ticker")), F.lit("")).alias("ticker"), *[c.alias(n) for n, c in cells.items()], year.alias("source_year")).where("ticker <> ''")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in SERIES_COLUMNS) + ", source_year int")
    key = ["ticker", "series_id", "class_id", "source_year"]
    rest = [c for c in out.columns if c not in key]
    best = out.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return best.select(*key, "_r.*")


def identifier_cache(lines: DataFrame) -> DataFrame:
    """Mapping alternatives from cached responses, JSON lines in a column ``value``, the last line of an identifier counting by ``queried_at``.

    An identifier without alternatives has one row, with mapping_error and a null mapping_rank.
    """
    item = "struct<" + ",".join(f"{f}:string" for f in MAPPING_FIELDS) + ">"
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", f"instrument_id string, queried_at string, response struct<data:array<{item}>,error:string>").alias("r")).select("r.*").where("instrument_id is not null")
    last = parsed.groupBy("instrument_id").agg(F.max_by(F.struct("queried_at", "response"), F.coalesce("queried_at", F.lit(""))).alias("l")).select("instrument_id", "l.*")
    rows = last.select("instrument_id", "queried_at", F.col("response.error").alias("_error"), F.posexplode_outer("response.data").alias("mapping_rank", "_item"))
    error = F.when(F.col("_item").isNull(), F.coalesce("_error", F.lit("No identifier found"))).otherwise("")
    rows = rows.select("instrument_id", "queried_at", "mapping_rank", error.alias("mapping_error"), *[F.col(f"_item.{f}").alias(f) for f in MAPPING_FIELDS])
    return rows.withColumn("ticker_norm", normal_ticker(F.coalesce("ticker", F.lit(""))))


def alias_records(mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(alias, derived_from, ticker_norm): identifiers of ``wanted`` (instrument_id) that mapped ones name as their own, by US listings alone; already mapped ones are left out."""
    us = mappings.where(F.upper("exchCode") == "US")
    named = us.select("instrument_id", "ticker_norm", F.explode(F.array("figi", "compositeFIGI", "shareClassFIGI")).alias("alias")).withColumn("alias", F.upper("alias"))
    targets = wanted.select(F.upper("instrument_id").alias("alias")).where(valid_figi(F.col("alias"))).distinct()
    known = mappings.select(F.col("instrument_id").alias("alias")).distinct()
    found = named.join(targets, "alias").join(known, "alias", "left_anti")
    return found.groupBy("alias").agg(F.min(F.struct("instrument_id", "ticker_norm")).alias("_r")).select("alias", F.col("_r.instrument_id").alias("derived_from"), "_r.ticker_norm")


def identifier_pairs(holdings: DataFrame) -> DataFrame:
    """(instrument_id, cusip, alias_status): exact pairs that filings report together, ambiguous where one identifier has several."""
    pairs = holdings.where("id_source = 'filing_figi'").select(F.upper(F.trim("instrument_id")).alias("instrument_id"), F.upper(F.trim("cusip")).alias("cusip"))
    pairs = pairs.where(valid_figi(F.col("instrument_id")) & valid_identifier(F.col("cusip"))).distinct()
    counts = pairs.groupBy("instrument_id").agg(F.count("*").alias("_n"))
    return pairs.join(counts, "instrument_id").select("instrument_id", "cusip", F.when(F.col("_n") > 1, "ambiguous").otherwise("exact_filing_pair").alias("alias_status"))


def in_decimals(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Benchmark returns in decimals: where the median over ``values`` of their median sizes is over a half, they are percent."""
    medians = rows.agg(*[F.percentile(F.abs(F.col(c)), F.lit(0.5)).alias(c) for c in values])
    middle = medians.select(F.explode(F.array(*[F.col(c) for c in values])).alias("m")).agg((F.percentile("m", F.lit(0.5)) > 0.5).alias("_percent"))
    return rows.crossJoin(F.broadcast(middle)).select(*[c for c in rows.columns if c not in values], *[(F.col(c) / F.when(F.col("_percent"), 100.0).otherwise(1.0)).alias(c) for c in values])


def extend_prices(spark: SparkSession, path: str, fresh: DataFrame, by: Column | None = None) -> DataFrame:
    """Appends to the store at ``path`` the rows (instrument, day, ...) of ``fresh`` that it hasn't yet, by year, with the store's columns; the store is returned.

    What is there stays, so an interrupted download goes on where it ended; of rows that repeat in
    ``fresh`` the smallest counts.
    """
    year = by if by is not None else F.year("day")
    rest = [c for c in fresh.columns if c not in ("instrument", "day")]
    rows = fresh.groupBy("instrument", "day").agg(F.min(F.struct(*rest)).alias("_r")).select("instrument", "day", "_r.*").withColumn("year", year)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.schema(rows.schema).parquet(path)
        rows = rows.join(old.select("instrument", "day"), ["instrument", "day"], "left_anti")
    rows.hint("rebalance", "year").write.mode("append").partitionBy("year").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def back_projected(shares: DataFrame, calendar: DataFrame, returns: DataFrame) -> DataFrame:
    """(instrument, day, shares): reported shares as a step function over ``calendar`` (instrument, day), and before the first report that one, less what splits between then and it added.

    ``shares``: instrument, day, shares; ``returns``: instrument, day, split (new shares for one old).
    """
    window = Window.partitionBy("instrument").orderBy("day")
    rows = calendar.join(shares, ["instrument", "day"], "full_outer").join(returns.select("instrument", "day", F.ln("split").alias("_s")), ["instrument", "day"], "left")
    rows = rows.withColumns({"_known": F.last("shares", True).over(window.rowsBetween(Window.unboundedPreceding, 0)), "_cum": F.sum(F.coalesce("_s", F.lit(0.0))).over(window.rowsBetween(Window.unboundedPreceding, 0))})
    whole = Window.partitionBy("instrument")
    first = F.min(F.when(F.col("shares").isNotNull(), F.struct("day", "shares", "_cum"))).over(whole)
    rows = rows.withColumn("_first", first)
    before = F.col("_first.shares") * F.exp(F.col("_cum") - F.col("_first._cum"))
    return rows.select("instrument", "day", F.coalesce("_known", before).alias("shares"))
