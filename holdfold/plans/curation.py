"""Queries on readers, curation, reference files, sinks and streams, each with SQL of its own.

The files that the readers take are first written from the given tables, in the folder that
executors share, and read again.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers
from ..operators import inference
from ..sources import curation, filings, reference, sinks
from ..streaming import events as streams
from .operators import ORACLE_SQL, oracle, query, relation, shared_path, table

#: How the covers are made from the filings, in both dialects: amendments, notices, and another manager for each seventh.
COVERS = """SELECT r.accession, r.cik, r.cik AS filer_id, r.period_end, r.known AS filing_date, CASE r.kind WHEN 'ORIGINAL' THEN '13F-HR' ELSE '13F-HR/A' END AS form,
CASE WHEN r.accession % 11 = 0 THEN '13F NOTICE' ELSE '13F HOLDINGS REPORT' END AS report_type, CASE WHEN r.kind <> 'ORIGINAL' THEN r.kind END AS amendment_type,
CASE WHEN r.cik % 7 = 0 THEN r.cik + 1 END AS other, coalesce(n, 0) AS n_rows, coalesce(value, 0) AS book_usd
FROM revisions r LEFT JOIN (SELECT accession, count(*) AS n, round(sum(value), 2) AS value FROM holdings GROUP BY accession) h USING (accession)"""


@query(
    oracle(f"""WITH RECURSIVE c AS ({COVERS}), e AS (SELECT DISTINCT a.period_end, a.filer_id AS x, b.filer_id AS y FROM c a JOIN (SELECT DISTINCT filer_id FROM c) b ON a.other = b.filer_id),
both_ AS (SELECT * FROM e UNION SELECT period_end, y, x FROM e), nodes AS (SELECT DISTINCT period_end, filer_id AS x FROM c),
reach(period_end, x, y) AS (SELECT period_end, x, x FROM nodes UNION SELECT r.period_end, r.x, b.y FROM reach r JOIN both_ b ON b.period_end = r.period_end AND b.x = r.y),
g AS (SELECT period_end, x AS filer_id, min(CAST(y AS VARCHAR)) AS grp FROM reach GROUP BY period_end, x),
j AS (SELECT c.*, g.grp, CASE WHEN n_rows = 0 THEN 0 WHEN form LIKE '%/A' THEN 1 WHEN report_type LIKE '%NOTICE%' THEN 0 ELSE 2 END AS class FROM c JOIN g USING (period_end, filer_id)),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_end, grp ORDER BY class DESC, book_usd DESC, n_rows DESC, CAST(accession AS VARCHAR)) AS rn FROM j WHERE class > 0) z WHERE rn = 1)
SELECT j.accession, j.filer_id, CAST(j.period_end AS VARCHAR) || '|' || j.grp AS group_id, w.accession IS NOT NULL OR (j.form LIKE '%/A' AND s.filer_id IS NOT NULL) AS keep
FROM j LEFT JOIN w ON w.accession = j.accession LEFT JOIN (SELECT DISTINCT period_end, filer_id FROM w) s ON s.period_end = j.period_end AND s.filer_id = j.filer_id""")
)
def reporting_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks for filers that report for one another, amendments following their parents."""
    covers = relation(spark, sf_dir, COVERS).withColumn("accession", F.col("accession").cast("string"))
    covers = covers.withColumn("other_managers", F.array_compact(F.array(F.col("other").cast("long"))))
    return curation.reporting_groups(covers).select(F.col("accession").cast("long").alias("accession"), "filer_id", "group_id", "keep")


#: Holdings in the units that filings give them in: by accession dollars, thousands, or neither plainly.
REPORTED = """SELECT h.accession, h.shares, CASE h.accession % 4 WHEN 0 THEN h.value WHEN 1 THEN h.value / 1000000 WHEN 2 THEN h.value / 800 ELSE h.value * 40000000 END AS value_reported,
'SH' AS share_type, CASE WHEN h.accession % 13 = 0 THEN 'PUT' ELSE '' END AS put_call FROM holdings h"""


@query(
    oracle(f"""WITH h AS ({REPORTED}), c AS ({COVERS}), s AS (SELECT accession, quantile_cont(value_reported / shares, 0.5) AS med, quantile_cont(value_reported / shares, 0.9) AS q90 FROM h WHERE put_call = '' AND shares > 0 AND value_reported > 0 GROUP BY accession),
t AS (SELECT accession, count(*) AS n, sum(value_reported) AS total FROM h GROUP BY accession),
j AS (SELECT c.accession, filing_date < DATE '1998-01-01' AS before, coalesce(amendment_type = 'NEW HOLDINGS', false) AS partial, coalesce(n, 0) AS n, coalesce(total, 0) AS total, med, q90 FROM c LEFT JOIN s USING (accession) LEFT JOIN t USING (accession)),
k AS (SELECT *, NOT partial AND total * 1000 > 3e12 AND total >= 1e8 AS absurd FROM j),
l AS (SELECT *, coalesce(med < 0.5 AND q90 < 1, false) AND NOT absurd AS th, coalesce(med > 2 AND q90 > 20, false) AS dl FROM k),
m AS (SELECT *, NOT partial AND NOT th AND NOT dl AND n >= 20 AND total > 0 AND total < 50000 AS small FROM l)
SELECT accession, CASE WHEN th THEN 1e3 WHEN dl THEN 1e0 WHEN small THEN 1e3 WHEN before AND NOT absurd THEN 1e3 ELSE 1e0 END AS value_scale,
CASE WHEN th OR dl OR small THEN 'detected' WHEN before AND absurd THEN 'plausibility' ELSE 'calendar' END AS scale_source FROM m""")
)
def reported_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars or thousands, by implied prices, book size, date and plausibility."""
    covers = relation(spark, sf_dir, COVERS)
    return curation.value_scale(relation(spark, sf_dir, REPORTED), covers, "1998-01-01").select("accession", "value_scale", "scale_source")


@query(
    oracle(f"""WITH c AS ({COVERS}) SELECT c.accession, c.cik, c.period_end, c.filing_date, c.form, c.report_type, c.n_rows::DOUBLE AS n_rows_declared, coalesce(CAST(c.other AS VARCHAR), '') AS managers, count(h.accession) AS rows_, round(sum(h.value), 2) AS value
FROM c LEFT JOIN (SELECT accession, round(value, 2) AS value FROM holdings) h USING (accession) GROUP BY ALL""")
)
def bulk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk set's tables of strings, reshaped to holdings and covers."""
    covers = relation(spark, sf_dir, COVERS).withColumn("accession_number", F.col("accession").cast("string"))
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    tables = {
        "SUBMISSION": covers.select("accession_number", F.col("cik").cast("string").alias("cik"), day("period_end").alias("periodofreport"), day("filing_date").alias("filing_date"), F.col("form").alias("submissiontype")),
        "COVERPAGE": covers.select("accession_number", F.col("report_type").alias("reporttype"), F.col("amendment_type").alias("amendmenttype"), F.col("form").alias("submissiontype")),
        "SUMMARYPAGE": covers.select("accession_number", F.col("n_rows").cast("string").alias("tableentrytotal")),
        "OTHERMANAGER2": covers.where("other is not null").select("accession_number", F.col("other").cast("string").alias("othermanager_cik")),
        "INFOTABLE": relation(spark, sf_dir, "SELECT CAST(accession AS STRING) AS accession_number, instrument AS nameofissuer, '037833100' AS cusip, CAST(round(value, 2) AS STRING) AS value, CAST(shares AS STRING) AS sshprnamt FROM holdings"),
    }
    holdings, frames = curation.bulk_frames(tables)
    sums = holdings.groupBy("accession").agg(F.count("*").alias("rows_"), F.round(F.sum("value_reported"), 2).alias("value"))
    out = frames.join(sums, "accession", "left").withColumn("managers", F.array_join(F.col("other_managers").cast("array<string>"), ","))
    return out.select(F.col("accession").cast("long").alias("accession"), "cik", "period_end", "filing_date", "form", "report_type", "n_rows_declared", "managers", F.coalesce("rows_", F.lit(0)).alias("rows_"), "value")


@query(
    oracle(f"""WITH c AS ({COVERS}), h AS (SELECT accession, sum(round(value)) AS total FROM holdings GROUP BY accession)
SELECT c.accession, CASE WHEN c.accession % 10 = 1 OR n_rows = 0 THEN 'empty' WHEN c.accession % 10 = 2 THEN 'legacy_text' ELSE 'xml' END AS regime,
CASE WHEN c.accession % 10 = 1 THEN 0 ELSE n_rows END AS n_rows, c.report_type, c.amendment_type, n_rows + CASE WHEN c.accession % 10 = 3 THEN 5 ELSE 0 END AS rows_declared,
CASE WHEN (c.accession % 10 = 1 OR n_rows = 0) THEN CASE WHEN n_rows + CASE WHEN c.accession % 10 = 3 THEN 5 ELSE 0 END > 0 THEN 'parse failure: cover declares ' || (n_rows + CASE WHEN c.accession % 10 = 3 THEN 5 ELSE 0 END) || ' entries, none found' ELSE 'no information table found' END
  ELSE array_to_string(list_filter([CASE WHEN c.accession % 10 = 3 THEN 'rows ' || n_rows || ' against ' || (n_rows + 5) END, CASE WHEN c.accession % 10 = 4 THEN 'value total off' END], lambda x: x IS NOT NULL), '; ') END AS warnings,
CASE WHEN c.accession % 10 <> 1 THEN total END AS value_usd FROM c LEFT JOIN h USING (accession)""")
)
def submission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with XML or printed covers and tables, parsed and reconciled with what their covers declare."""
    h = relation(spark, sf_dir, "SELECT accession, instrument, round(shares) AS shares, round(value) AS value FROM holdings")
    entry = F.format_string("<n:infoTable><n:nameOfIssuer>%s</n:nameOfIssuer><n:titleOfClass>COM</n:titleOfClass><n:cusip>037833100</n:cusip><n:value>%.0f</n:value><n:sshPrnamt>%.0f</n:sshPrnamt><n:sshPrnamtType>SH</n:sshPrnamtType></n:infoTable>", "instrument", "value", "shares")
    line = F.format_string("%s   COM   037833100   %,.0f   %,.0f SH", "instrument", "value", "shares")
    bodies = h.groupBy("accession").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("xml"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"), F.sum("value").alias("total"))
    c = relation(spark, sf_dir, COVERS).join(bodies, "accession", "left")
    case = F.col("accession") % 10
    declared = F.col("n_rows") + F.when(case == 3, 5).otherwise(0)
    total = F.coalesce("total", F.lit(0.0)) * F.when(case == 4, 2).otherwise(1)
    kind = F.coalesce(F.concat(F.lit("<amendmentInfo><amendmentType>"), "amendment_type", F.lit("</amendmentType></amendmentInfo>")), F.lit(""))
    xml = F.concat(F.lit("<x:coverPage><x:reportType>"), "report_type", F.lit("</x:reportType>"), kind, F.lit("</x:coverPage><x:summaryPage><x:tableEntryTotal>"), declared.cast("string"), F.lit("</x:tableEntryTotal><x:tableValueTotal>"), F.format_string("%.0f", total), F.lit("</x:tableValueTotal></x:summaryPage>"))
    mark = lambda on, text: F.concat(F.when(on, F.lit("[X] ")).otherwise(F.lit("[ ] ")), F.lit(text))
    printed = F.concat_ws(
        "\n", mark(F.col("report_type") == "13F HOLDINGS REPORT", "13F HOLDINGS REPORT."), mark(F.col("report_type") == "13F NOTICE", "13F NOTICE."), mark(F.coalesce(F.col("amendment_type") == "RESTATEMENT", F.lit(False)), "is a\n restatement."),
        mark(F.coalesce(F.col("amendment_type") == "NEW HOLDINGS", F.lit(False)), "adds new holdings entries."), F.concat(F.lit("Form 13F Information Table Entry Total:  "), declared.cast("string")), F.concat(F.lit("Information Table Value Total: $"), F.format_string("%,.0f", total)),
    )
    cover = F.when(case == 2, printed).otherwise(xml)
    body = F.when(case == 1, F.lit("")).when(case == 2, F.coalesce("text", F.lit(""))).otherwise(F.coalesce("xml", F.lit("")))
    raw = c.select(F.col("accession").cast("string").alias("accession"), F.col("filing_date"), F.concat(F.lit("<SEC-DOCUMENT><DOCUMENT><TYPE>13F-HR\n<TEXT>"), cover, F.lit("</TEXT></DOCUMENT><DOCUMENT><TYPE>INFORMATION TABLE\n<TEXT>"), body, F.lit("</TEXT></DOCUMENT></SEC-DOCUMENT>")).alias("raw"))
    found, rows = curation.submissions(raw, "1990-01-01", 0.0)
    sums = rows.groupBy("accession").agg(F.sum("value").alias("value_usd"))
    out = found.join(sums, "accession", "left")
    return out.select(F.col("accession").cast("long").alias("accession"), "regime", "n_rows", "report_type", "amendment_type", F.col("rows_declared").cast("long").alias("rows_declared"), F.array_join("warnings", "; ").alias("warnings"), "value_usd")


@query(oracle("SELECT accession, known AS filed, CASE WHEN accession % 3 = 0 THEN CAST(known AS VARCHAR) || ' 21:30:00' ELSE CAST(known AS VARCHAR) || ' 23:59:59' END AS accepted FROM revisions"))
def filing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows, some repeated, with acceptance times where the other source has them."""
    index = relation(spark, sf_dir, "SELECT accession, known AS filed, concat('p/', accession) AS path FROM revisions UNION ALL SELECT accession, known AS filed, concat('q/', accession) AS path FROM revisions WHERE accession % 2 = 0")
    api = relation(spark, sf_dir, "SELECT accession, to_timestamp(concat(CAST(known AS STRING), ' 21:30:00')) AS accepted FROM revisions WHERE accession % 3 = 0")
    return filings.manifest(index, api).select("accession", "filed", F.date_format("accepted", "yyyy-MM-dd HH:mm:ss").alias("accepted"))


_ROUND = "SELECT filer_id, instrument, round(value, 2) AS value FROM numbered"


@query(oracle("SELECT filer_id, instrument, round(value, 2) AS value FROM numbered WHERE q = (SELECT max(q) FROM numbered)"))
def latest_quarter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quarter's books out of a store partitioned by quarter: the scan reads its files alone."""
    path = shared_path(spark, "panel")
    rows = relation(spark, sf_dir, "SELECT q, filer_id, instrument, round(value, 2) AS value FROM numbered")
    filings.column_store(rows, path, "q")
    kept = spark.read.parquet(path)
    last = kept.agg(F.max("q")).first()[0]
    return kept.where(F.col("q") == (last if last is not None else 0)).select("filer_id", "instrument", "value")


@query("SELECT p_partkey, 'BBG' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS figi, p_partkey % 2 = 0 AS is_figi, 'A-B' || p_partkey AS ticker, p_partkey % 3 = 0 AS flag, '0000320193-24-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS accession FROM part")
def identifier_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIGIs, tickers, flags and accession numbers as column functions read them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("n"))
    figi = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("bbg"), "n")).otherwise(F.concat(F.lit("BBX"), "n"))
    return p.select(
        "p_partkey", F.concat(F.lit("BBG"), "n").alias("figi"), identifiers.valid_figi(figi).alias("is_figi"), identifiers.normal_ticker(F.concat(F.lit(" a.b "), F.col("p_partkey").cast("string"))).alias("ticker"),
        identifiers.truthy(F.element_at(F.array(F.lit(" yes"), F.lit("N"), F.lit("")), F.col("p_partkey").cast("int") % 3 + 1)).alias("flag"),
        identifiers.accession_of(F.concat(F.lit("edgar/data/320193/000032019324"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".txt"))).alias("accession"),
    )


@query("SELECT 'T' || p_partkey AS ticker, p_name AS name, p_partkey % 5 = 0 AS is_exchange_etf, 'one.txt' AS exchange_source FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0 UNION ALL SELECT 'T' || p_partkey, p_name, p_partkey % 5 = 0, 'other.txt' FROM part WHERE p_partkey % 2 = 1")
def exchange_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipe-separated directories with different headers, test issues and a trailer."""
    path, p = shared_path(spark, "directory"), table(spark, sf_dir, "part")
    flag = F.when(F.col("p_partkey") % 5 == 0, "Y").otherwise("N")
    one = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("T"), "p_partkey").alias("Symbol"), F.col("p_name").alias("Security Name"), F.when(F.col("p_partkey") % 7 == 0, "Y").otherwise("N").alias("Test Issue"), flag.alias("ETF"))
    one = one.union(spark.createDataFrame([("File Creation Time: 0101", None, None, None)], "a string, b string, c string, d string"))
    other = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("t"), "p_partkey").alias("ACT Symbol"), F.col("p_name").alias("Security Name"), F.lit("N").alias("Exchange"), flag.alias("ETF"))
    for name, df in (("one.txt", one), ("other.txt", other)):
        df.write.option("header", True).option("sep", "|").csv(f"{path}/{name}")
    return reference.symbol_directory(spark, [f"{path}/one.txt", f"{path}/other.txt"]).select("ticker", "name", "is_exchange_etf", "exchange_source")


@query("SELECT 'F' || p_partkey AS ticker, p_name AS fund_name, 'S' || (p_partkey // 10) AS series_id, 'C' || p_partkey AS class_id, CAST(p_size AS VARCHAR) AS cik, p_partkey % 4 = 0 AS is_index_fund, DATE '2023-03-31' AS report_end FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 9 = 0")
def census_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census archives, one per brand, zipped on the executors and joined again from their members."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        members: dict[str, list[str]] = {
            "FUND_REPORTED_INFO.tsv": ["FUND_ID\tACCESSION_NUMBER\tFUND_NAME\tSERIES_ID\tIS_ETF\tIS_INDEX\tIS_MULTI_INVERSE_INDEX"], "SHARES_OUTSTANDING.tsv": ["FUND_ID\tCLASS_NAME\tCLASS_ID\tTICKER"],
            "SUBMISSION.tsv": ["ACCESSION_NUMBER\tCIK\tFILING_DATE\tREPORT_ENDING_PERIOD"], "ETF.tsv": ["FUND_ID"],
        }
        for k, name, size in zip(pdf["p_partkey"], pdf["p_name"], pdf["p_size"], strict=True):
            members["FUND_REPORTED_INFO.tsv"].append(f"{k}\tA{k}\t{name}\tS{k // 10}\t{'Y' if k % 2 == 0 else 'N'}\t{'Y' if k % 4 == 0 else 'N'}\tN")
            members["SHARES_OUTSTANDING.tsv"].append(f"{k}\tclass\tC{k}\tf{k}")
            members["SUBMISSION.tsv"].append(f"A{k}\t{size}\t15-MAY-2023\t31-MAR-2023")
            members["ETF.tsv"] += [str(k)] if k % 9 == 0 else []
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, lines in members.items():
                z.writestr(name, "\n".join(lines) + "\n")
        return pd.DataFrame({"path": [f"archives/{pdf['p_brand'].iloc[0]}.zip"], "content": [out.getvalue()]})

    archives = p.groupBy("p_brand").applyInPandas(pack, "path string, content binary")
    return reference.fund_census(archives).select("ticker", "fund_name", "series_id", "class_id", "cik", "is_index_fund", "report_end")


@query("SELECT 'K' || p_partkey AS ticker, 'S' || p_size AS series_id, CASE WHEN p_partkey % 2 = 1 THEN 'C' || p_partkey END AS class_id, 2020 + p_partkey % 2 AS source_year FROM part")
def series_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly lists whose columns are named differently, brought under one schema."""
    path, p = shared_path(spark, "series"), table(spark, sf_dir, "part")
    key, series = F.concat(F.lit("k"), "p_partkey"), F.concat(F.lit("S"), "p_size")
    p.where("p_partkey % 2 = 0").select(key.alias("Class Ticker"), series.alias("Series ID")).write.option("header", True).csv(f"{path}/list-2020.csv")
    p.where("p_partkey % 2 = 1").select(series.alias("Series-ID"), F.concat(F.lit("C"), "p_partkey").alias("Class-Contract-ID"), key.alias("Class-Contract-Ticker-Symbol")).write.option("header", True).csv(f"{path}/list-2021.csv")
    p.select(series.alias("Other")).write.option("header", True).csv(f"{path}/list-2022.csv")
    return reference.series_classes(spark, [f"{path}/list-{y}.csv" for y in (2020, 2021, 2022)]).select("ticker", "series_id", "class_id", "source_year")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = F.struct(F.concat(F.lit("BBG"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("figi"), F.concat(F.lit("t"), "p_partkey").alias("ticker"), F.when(F.col("p_partkey") % 3 == 0, "US").otherwise("LN").alias("exchCode"))
    error = F.when(F.col("p_partkey") % 5 == 0, F.lit("No identifier found."))
    record = F.struct(F.concat(F.lit("ID"), "p_partkey").alias("instrument_id"), F.lit("2024-01-01").alias("queried_at"), F.struct(F.when(error.isNull(), F.array(item, item)).alias("data"), error.alias("error")).alias("response"))
    older = F.struct(F.concat(F.lit("ID"), "p_partkey").alias("instrument_id"), F.lit("2023-01-01").alias("queried_at"), F.struct(F.lit("old").alias("error")).alias("response"))
    return p.select(F.to_json(record).alias("value")).union(p.select(F.to_json(older).alias("value")))


@query("SELECT 'ID' || p_partkey AS instrument_id, r AS mapping_rank, CASE WHEN p_partkey % 5 = 0 THEN 'No identifier found.' ELSE '' END AS mapping_error, CASE WHEN p_partkey % 5 <> 0 THEN 'T' || p_partkey ELSE '' END AS ticker_norm FROM part, (VALUES (0), (1), (NULL)) v(r) WHERE (p_partkey % 5 = 0) = (r IS NULL)")
def mapping_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached mapping responses, an older line of each superseded, as rows of alternatives."""
    path = shared_path(spark, "cache")
    _cache(spark, sf_dir).write.text(path)
    return reference.identifier_cache(spark.read.text(path)).select("instrument_id", "mapping_rank", "mapping_error", "ticker_norm")


@query("SELECT 'BBG' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS alias, 'ID' || p_partkey AS derived_from, 'T' || p_partkey AS ticker_norm FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0")
def mapping_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers resolved through what mapped ones name as theirs, by US listings alone."""
    wanted = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("BBG"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("instrument_id"))
    return reference.alias_records(reference.identifier_cache(_cache(spark, sf_dir)), wanted)


@query(
    "WITH p AS (SELECT 'BBG' || lpad(CAST(p_partkey // 3 AS VARCHAR), 9, '0') AS instrument_id, CASE WHEN p_partkey % 2 = 0 THEN '037833100' ELSE '594918104' END AS cusip FROM part WHERE p_partkey % 4 <> 0), d AS (SELECT DISTINCT * FROM p) SELECT instrument_id, cusip, CASE WHEN count(*) OVER (PARTITION BY instrument_id) > 1 THEN 'ambiguous' ELSE 'exact_filing_pair' END AS alias_status FROM d"
)
def filing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier pairs reported together, ambiguous ones flagged."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.lit("bbg"), F.lpad(F.floor(F.col("p_partkey") / 3).cast("string"), 9, "0")).alias("instrument_id"), F.when(F.col("p_partkey") % 2 == 0, " 037833100").otherwise("594918104").alias("cusip"), F.when(F.col("p_partkey") % 4 == 0, "name").otherwise("filing_figi").alias("id_source"))
    odd = p.select(F.lit("BBG000000000").alias("instrument_id"), F.lit("037833010").alias("cusip"), F.lit("filing_figi").alias("id_source"))
    return reference.identifier_pairs(rows.union(odd))


@query(oracle("SELECT day, round(avg(ret), 6) + 0e0 AS mkt, round(max(ret), 6) + 0e0 AS top FROM prices WHERE ret IS NOT NULL GROUP BY day"))
def benchmark_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark returns given in percent, brought to decimals by their size."""
    rows = relation(spark, sf_dir, "SELECT day, avg(ret) * 100 AS mkt, max(ret) * 100 AS top FROM prices WHERE ret IS NOT NULL GROUP BY day")
    return reference.in_decimals(rows, ["mkt", "top"]).select("day", (F.round("mkt", 6) + F.lit(0.0)).alias("mkt"), (F.round("top", 6) + F.lit(0.0)).alias("top"))


@query(oracle("SELECT instrument, day, round(price, 8) AS price FROM prices"))
def price_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price store extended by two overlapping downloads."""
    path = shared_path(spark, "prices")
    rows = relation(spark, sf_dir, "SELECT instrument, day, round(price, 8) AS price FROM prices")
    middle = "1998-01-01"
    reference.extend_prices(spark, path, rows.where(F.col("day") < middle))
    return reference.extend_prices(spark, path, rows.where(F.col("day") >= "1996-01-01")).select("instrument", "day", "price")


@query(
    oracle("""WITH c AS (SELECT instrument, day, row_number() OVER (PARTITION BY instrument ORDER BY day) AS i FROM prices), s AS (SELECT instrument, day, i, CASE WHEN i = 10 THEN 1000e0 WHEN i % 40 = 0 THEN 1000e0 + i END AS shares, CASE WHEN i = 5 THEN 2e0 ELSE 1e0 END AS split FROM c)
SELECT instrument, day, round(coalesce(last_value(shares IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY day), CASE WHEN max(i) OVER (PARTITION BY instrument) >= 10 THEN 1000e0 / CASE WHEN i < 5 THEN 2 ELSE 1 END END), 4) AS shares FROM s""")
)
def shares_back_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares outstanding as a step function, before the first report less what a split added."""
    rows = relation(spark, sf_dir, "SELECT instrument, day, row_number() OVER (PARTITION BY instrument ORDER BY day) AS i FROM prices")
    shares = rows.withColumn("shares", F.when(F.col("i") == 10, 1000.0).when(F.col("i") % 40 == 0, 1000.0 + F.col("i"))).where("shares is not null")
    out = reference.back_projected(shares.select("instrument", "day", "shares"), rows.select("instrument", "day"), rows.select("instrument", "day", F.when(F.col("i") == 5, 2.0).otherwise(1.0).alias("split")))
    return out.select("instrument", "day", F.round("shares", 4).alias("shares"))


@query(
    oracle("""SELECT 'books' AS name, count(*) AS n, round(sum(value), 0) AS total FROM numbered UNION ALL SELECT 'revisions', count(*), 0 FROM revisions UNION ALL SELECT 'lags', count(DISTINCT kind), 0 FROM revisions
UNION ALL SELECT 'rejections', 2, (SELECT count(*) FROM holdings WHERE shares <= 10) + (SELECT count(*) FROM holdings WHERE value <= 20000)""")
)
def curated_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated layer written, as Parquet by quarter, compressed CSV and JSON, and counted as read back."""
    path = shared_path(spark, "curated")
    books = relation(spark, sf_dir, "SELECT q, filer_id, instrument, value FROM numbered")
    lags = relation(spark, sf_dir, "SELECT kind, collect_set(accession) AS accessions FROM revisions GROUP BY kind")
    rejected = relation(spark, sf_dir, "SELECT 'small' AS reason, count(*) AS n FROM holdings WHERE shares <= 10 UNION ALL SELECT 'cheap', count(*) FROM holdings WHERE value <= 20000")
    sinks.save_curated(path, {"books": books, "revisions": relation(spark, sf_dir, "SELECT * FROM revisions")}, rejected, {"books": "q"})
    sinks.save_csv(lags, f"{path}/lags.csv.gz")
    read = spark.read
    counted = lambda name, df, total: df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("name"), "n", F.round("total", 0).cast("double").alias("total"))
    out = counted("books", read.parquet(f"{path}/books"), F.sum("value"))
    out = out.unionByName(counted("revisions", read.parquet(f"{path}/revisions"), F.lit(0.0)))
    out = out.unionByName(counted("lags", read.option("header", True).csv(f"{path}/lags.csv.gz"), F.lit(0.0)))
    return out.unionByName(counted("rejections", read.schema("reason string, n long").json(f"{path}/rejections"), F.sum("n")))


@query(
    oracle("""WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM prices) d), s AS (SELECT instrument, period_end AS day, round(sum(value), 2) AS value FROM numbered GROUP BY instrument, period_end),
b AS (SELECT s.instrument, s.value, min(c.i) AS i FROM s JOIN cal c ON c.day >= s.day GROUP BY s.instrument, s.day, s.value), n AS (SELECT *, lead(i) OVER (PARTITION BY instrument ORDER BY i) AS nxt FROM b)
SELECT c.day, n.instrument, n.value FROM n JOIN cal c ON c.i >= n.i AND c.i <= n.i + 75 AND (n.nxt IS NULL OR c.i < n.nxt)""")
)
def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarterly signal written as a daily step function, each value held for 75 days of the calendar at most."""
    path = shared_path(spark, "signal")
    signal = relation(spark, sf_dir, "SELECT instrument, period_end AS day, round(sum(value), 2) AS value FROM numbered GROUP BY instrument, period_end")
    sinks.save_panel(signal, relation(spark, sf_dir, "SELECT DISTINCT day FROM prices"), path)
    return spark.read.parquet(path).select("day", "instrument", "value")


@query()
def trial_adjusted_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of names' monthly returns, deflated for as many trials as there are names."""
    from . import analytics

    rows = relation(spark, sf_dir, f"WITH {analytics.MONTHLY} SELECT instrument, avg(ret) / stddev_samp(ret) AS sharpe, count(ret) AS n, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM mret WHERE ret IS NOT NULL GROUP BY instrument HAVING count(ret) > 12")
    return inference.deflated_sharpe(rows, 25)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _to_memory(stream: DataFrame, path: str, mode: str) -> DataFrame:
    run = stream.writeStream.outputMode(mode).format("memory").queryName(f"t{uuid.uuid4().hex}").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(run.name)


@query("SELECT CAST(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour, every half hour, by a stream run to its end."""
    out = _to_memory(streams.tumbling(_events(spark, sf_dir), "1 hour", "30 minutes"), shared_path(spark, "sliding"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, session"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of half an hour, by a stream run to its end."""
    path = shared_path(spark, "sessions")
    found = streams.sessions(_events(spark, sf_dir), "1799999999 microseconds")  # Spark joins what is a whole gap apart
    streams.drained_whole(found, f"{path}/out", f"{path}/checkpoint")
    out = spark.read.schema(found.schema).parquet(f"{path}/out")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read twice over, each once in the stream's output."""
    path = shared_path(spark, "once")
    source, again = (_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts") for _ in range(2))
    once = streams.deduplicated(source.union(again), ["event_id"], "60 days").select("event_id", "user_id", "event_type")
    streams.drained(once, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(once.schema).parquet(f"{path}/out")


@query(
    """WITH o AS (SELECT user_id, event_id, ts, value, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM o)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS seen, life > 1 AND (before IS NULL OR ts - before > INTERVAL 2 HOUR) AS stale FROM g"""
)
def stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per user that is dropped when its last event is more than two hours old, by a stateful stream run to its end."""
    path = shared_path(spark, "stale")
    streams.drained(streams.expiring(_events(spark, sf_dir), "2 hours"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(streams.EXPIRING).parquet(f"{path}/out")


@query("WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part) SELECT p_partkey, place, word, length(word) AS size FROM w")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a user's own table function, registered and called from SQL."""
    from pyspark.sql.functions import udtf

    class Words:
        def eval(self, name: str):
            for place, word in enumerate(name.split(" ") if name is not None else []):
                yield place, word, len(word)

    spark.udtf.register("hf_words", udtf(Words, returnType="place int, word string, size int"))
    table(spark, sf_dir, "part").createOrReplaceTempView("hf_named")
    return spark.sql("SELECT p_partkey, w.place, w.word, w.size FROM hf_named, LATERAL hf_words(p_name) w")


@query(oracle("SELECT coalesce(kind, 'all') AS kind, coalesce(CAST(year(known) AS VARCHAR), 'all') AS year, count(*) AS n, count(DISTINCT filer_id) AS filers FROM revisions GROUP BY CUBE (kind, year(known))"))
def filings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings by kind and year, with all their totals."""
    return relation(spark, sf_dir, "SELECT coalesce(kind, 'all') AS kind, coalesce(CAST(year(known) AS STRING), 'all') AS year, count(*) AS n, count(DISTINCT filer_id) AS filers FROM revisions GROUP BY CUBE (kind, year(known))")


@query()
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct holders and median positions per quarter, approximately, with the exact ones beside them."""
    return relation(spark, sf_dir, "SELECT q, approx_count_distinct(filer_id) AS holders_about, count(DISTINCT filer_id) AS holders, approx_percentile(value, 0.5, 1000) AS median_about, percentile(value, 0.5) AS median FROM numbered GROUP BY q")


ORACLE_SQL["curated_layer"] = ORACLE_SQL["curated_layer"].replace("count(*), 0 FROM revisions", "count(*), 0e0 FROM revisions")
