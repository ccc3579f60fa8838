"""From filings as they arrive to covers and holdings that can be summed: submissions, units, reporting groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .filings import envelope_documents, information_table, text_table

#: Bounds of a complete book in dollars: no real one is larger, none that must be reported is smaller (fixed values).
LARGEST_BOOK, SMALLEST_BOOK = 3e12, 1e8
#: Rows that make a table too long to be a small one, and implied prices that tell thousands from dollars (fixed values).
MANY_ROWS, CHEAP, DEAR = 20, (0.5, 1.0), (2.0, 20.0)
#: How a printed cover marks a box, and the texts beside the boxes and totals (fixed values of the public form).
CHECKED = r"\[\s*[xX]\s*\]"
REPORTS = (("13F COMBINATION REPORT", r"13F\s+COMBINATION\s+REPORT"), ("13F NOTICE", r"13F\s+NOTICE"), ("13F HOLDINGS REPORT", r"13F\s+HOLDINGS\s+REPORT"))
AMENDMENTS = (("NEW HOLDINGS", r"adds\s+new\s+holdings"), ("RESTATEMENT", r"is\s+a\s+restatement"))


def number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double")


def _yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "y", "yes", "1"), F.lit(False))


def cover_page(documents: DataFrame, column: str = "body") -> DataFrame:
    """``documents`` with the cover's fields from XML, whatever the namespace; fields that aren't there are null."""
    clean = F.regexp_replace(column, r"<(/?)[A-Za-z0-9]+:", "<$1")
    first = lambda tag: F.nullif(F.trim(F.regexp_extract(clean, rf"(?is)<{tag}\b[^>]*>([^<]*)</{tag}>", 1)), F.lit(""))
    kind = first("amendmentType")
    managers = F.regexp_extract_all(clean, F.lit(r"(?is)<otherManager2?\b[^>]*>(?:(?!</otherManager).)*?<cik\b[^>]*>\s*(\d+)\s*</cik>"), F.lit(1))
    return documents.withColumns(
        {
            "report_type": first("reportType"),
            "manager": first("name"),
            "amendment_type": kind,
            "amendment_no": first("amendmentNo").try_cast("int"),
            "is_amendment": kind.isNotNull() | _yes(first("isAmendment")),
            "confidential": _yes(first("confDeniedExpired")) | _yes(first("isConfidentialOmitted")),
            "rows_declared": first("tableEntryTotal").try_cast("double").cast("int"),
            "value_declared": number(first("tableValueTotal")),
            "other_managers": F.array_sort(F.array_distinct(F.transform(managers, lambda x: x.cast("long")))),
        }
    ).drop(column)


def cover_text(documents: DataFrame, column: str = "body") -> DataFrame:
    """The same fields from a printed cover's boxes and totals."""
    flat = F.regexp_replace(column, r"\s+", " ")
    box = lambda text: flat.rlike(rf"(?i){CHECKED}\s*{text}")
    total = lambda name: F.nullif(F.regexp_extract(flat, rf"(?i)Information\s+Table\s+{name}\s+Total:\s*\$?\s*([\d,]+)", 1), F.lit(""))
    kind = F.coalesce(*[F.when(box(text), name) for name, text in AMENDMENTS])
    return documents.withColumns(
        {
            "report_type": F.coalesce(*[F.when(box(text), name) for name, text in REPORTS]),
            "manager": F.lit(None).cast("string"),
            "amendment_type": kind,
            "amendment_no": F.nullif(F.regexp_extract(flat, r"(?i)Amendment\s+Number:\s*([0-9]+)", 1), F.lit("")).cast("int"),
            "is_amendment": kind.isNotNull() | flat.rlike(rf"(?i)Check\s+here\s+if\s+Amendment\s*{CHECKED}"),
            "confidential": flat.rlike(r"(?i)CONFIDENTIAL\s+TREATMENT"),
            "rows_declared": number(total("Entry")).cast("int"),
            "value_declared": number(total("Value")),
            "other_managers": F.array().cast("array<bigint>"),
        }
    ).drop(column)


COVER = ("report_type", "manager", "amendment_type", "amendment_no", "is_amendment", "confidential", "rows_declared", "value_declared", "other_managers")


def value_scale(holdings: DataFrame, covers: DataFrame, cutover: str = "2023-01-03", small_book: float = 50_000.0) -> DataFrame:
    """(accession, value_scale, scale_source): whether a filing reports dollars or thousands of them.

    Prices implied by plain share rows decide first (``detected``); then, of complete tables that
    are long, whether the book is too small; then the filing date against ``cutover``
    (``calendar``), unless thousands would make a book that can't be (``plausibility``).
    ``holdings``: accession, share_type, put_call, shares, value_reported; ``covers``: accession,
    filing_date, amendment_type, of which one row of an accession counts.
    """
    plain = (F.upper(F.coalesce("share_type", F.lit("SH"))) == "SH") & (F.trim(F.coalesce("put_call", F.lit(""))) == "") & (F.col("shares") > 0) & (F.col("value_reported") > 0)
    implied = F.when(plain, F.col("value_reported") / F.col("shares"))
    stats = holdings.withColumn("_p", implied).groupBy("accession").agg(F.percentile("_p", F.lit(0.5)).alias("med"), F.percentile("_p", F.lit(0.9)).alias("q90"), F.count("*").alias("rows_"), F.sum("value_reported").alias("total"))
    rows = covers.groupBy("accession").agg(F.min("filing_date").alias("filed"), F.max(F.upper(F.trim(F.coalesce("amendment_type", F.lit(""))))).alias("kind")).join(stats, "accession", "left")
    rows = rows.withColumns({"total": F.coalesce("total", F.lit(0.0)), "rows_": F.coalesce("rows_", F.lit(0))})
    partial = F.col("kind") == "NEW HOLDINGS"
    absurd = ~partial & (F.col("total") * 1000 > LARGEST_BOOK) & (F.col("total") >= SMALLEST_BOOK)
    thousands = F.coalesce((F.col("med") < CHEAP[0]) & (F.col("q90") < CHEAP[1]), F.lit(False)) & ~absurd
    dollars = F.coalesce((F.col("med") > DEAR[0]) & (F.col("q90") > DEAR[1]), F.lit(False))
    small = ~partial & ~thousands & ~dollars & (F.col("rows_") >= MANY_ROWS) & (F.col("total") > 0) & (F.col("total") < small_book)
    before = F.coalesce(F.col("filed") < F.lit(cutover).cast("date"), F.lit(False))
    scale = F.when(thousands, 1000.0).when(dollars, 1.0).when(small, 1000.0).when(before & absurd, 1.0).when(before, 1000.0).otherwise(1.0)
    source = F.when(thousands | dollars | small, "detected").when(before & absurd, "plausibility").otherwise("calendar")
    return rows.select("accession", scale.alias("value_scale"), source.alias("scale_source"))


def reporting_groups(covers: DataFrame) -> DataFrame:
    """``covers`` with group_id and keep: who speaks for filers that report for one another in a period.

    Filers and the managers that their covers name are connected within a period.  Of a group's
    filings with rows that are neither notices nor amendments the one with the largest book stays
    (then the most rows, then the smallest accession); where there is none, of its amendments.
    Amendments stay with the filer that speaks.  Needs filer_id, cik, period_end, accession, form,
    report_type, other_managers, n_rows and book_usd.
    """
    node = lambda period, filer: F.concat_ws("|", period.cast("string"), filer.cast("string"))
    filers = covers.groupBy(F.col("cik").alias("_other")).agg(F.max("filer_id").alias("_filer"))
    named = covers.select("period_end", "filer_id", F.explode("other_managers").alias("_other")).join(filers, "_other")
    edges = named.select(node(F.col("period_end"), F.col("filer_id")).alias("src"), node(F.col("period_end"), F.col("_filer")).alias("dst")).where("src <> dst")
    groups = graph.groups(edges).select(F.col("node").alias("_node"), F.col("group").alias("_group"))
    rows = covers.withColumn("_node", node(F.col("period_end"), F.col("filer_id"))).join(groups, "_node", "left")
    rows = rows.withColumns({"group_id": F.coalesce("_group", "_node"), "_notice": F.upper(F.coalesce("report_type", F.lit(""))).contains("NOTICE"), "_amends": F.coalesce(F.col("form").endswith("/A"), F.lit(False))})
    some = F.coalesce(F.col("n_rows") > 0, F.lit(False))
    order = F.struct(F.when(some & ~F.col("_notice") & ~F.col("_amends"), 2).when(some & F.col("_amends"), 1).alias("class"), F.col("book_usd").alias("book"), F.col("n_rows").alias("n"))
    best = rows.where(some & (F.col("_amends") | ~F.col("_notice"))).groupBy("group_id").agg(F.max(order).alias("_best"))
    judged = rows.join(best, "group_id", "left").withColumn("_wins", some & (F.col("_amends") | ~F.col("_notice")) & (order == F.col("_best")))
    winner = judged.where("_wins").groupBy("group_id").agg(F.min("accession").alias("_winner"))
    judged = judged.join(winner, "group_id", "left").withColumn("_wins", F.coalesce(F.col("accession") == F.col("_winner"), F.lit(False)))
    speaks = judged.where("_wins").select("period_end", "filer_id", F.lit(True).alias("_speaks")).distinct()
    out = judged.join(speaks, ["period_end", "filer_id"], "left")
    keep = F.col("_wins") | (F.col("_amends") & F.coalesce("_speaks", F.lit(False)))
    return out.select(*covers.columns, "group_id", keep.alias("keep"))


def bulk_frames(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(holdings, covers) from a bulk set's tables of strings: SUBMISSION, COVERPAGE and INFOTABLE, and SUMMARYPAGE, OTHERMANAGER and OTHERMANAGER2 where there are.

    Nothing is deduplicated, repaired or rescaled here; columns that a set lacks are null.
    """
    day = lambda c: F.to_date(F.try_to_timestamp(F.initcap(F.lower(c)), F.lit("dd-MMM-yyyy")))
    meta = tables["SUBMISSION"]
    for name in ("COVERPAGE", "SUMMARYPAGE"):
        if name in tables:
            new = [c for c in tables[name].columns if c not in meta.columns]
            meta = meta.join(tables[name].select("accession_number", *new), "accession_number", "left")
    get = lambda df, c, kind="string": (F.col(c) if c in df.columns else F.lit(None)).try_cast(kind)
    managers = None
    for name in ("OTHERMANAGER", "OTHERMANAGER2"):
        own = next((c for c in tables[name].columns if c.endswith("cik")), None) if name in tables else None
        if own:
            part = tables[name].select("accession_number", F.col(own).try_cast("long").alias("m")).where("m is not null")
            managers = part if managers is None else managers.union(part)
    if managers is not None:
        meta = meta.join(managers.groupBy("accession_number").agg(F.sort_array(F.collect_set("m")).alias("_managers")), "accession_number", "left")
    covers = meta.select(
        F.col("accession_number").alias("accession"), get(meta, "cik", "long").alias("cik"), day(F.col("periodofreport")).alias("period_end"), day(F.col("filing_date")).alias("filing_date"), F.col("submissiontype").alias("form"),
        get(meta, "reporttype").alias("report_type"), get(meta, "amendmenttype").alias("amendment_type"), get(meta, "amendmentno", "double").alias("amendment_no"), get(meta, "filingmanager_name").alias("company"),
        get(meta, "tableentrytotal", "double").alias("n_rows_declared"), get(meta, "tablevaluetotal", "double").alias("value_total_declared"),
        F.coalesce(F.upper(get(meta, "isconfidentialomitted")).isin("Y", "TRUE", "1"), F.lit(False)).alias("confidential_omitted"), F.lit("bulk").alias("source"),
        (F.coalesce("_managers", F.array().cast("array<bigint>")) if managers is not None else F.array().cast("array<bigint>")).alias("other_managers"),
    )
    info = tables["INFOTABLE"]
    names = {"issuer": "nameofissuer", "title_of_class": "titleofclass", "cusip": "cusip", "figi": "figi", "share_type": "sshprnamttype", "put_call": "putcall", "discretion": "investmentdiscretion", "other_manager": "othermanager"}
    holdings = info.select(F.col("accession_number").alias("accession"), *[get(info, c).alias(n) for n, c in names.items()], get(info, "value", "double").alias("value_reported"), get(info, "sshprnamt", "double").alias("shares"))
    return holdings, covers


def submissions(raw: DataFrame, cutover: str = "2023-01-03", small_book: float = 50_000.0) -> tuple[DataFrame, DataFrame]:
    """(filings, rows) of envelopes (accession, filing_date, raw).

    The table is that of the last document called one that has rows, as XML or else as text; where
    none has, of the first document that does.  The cover is XML of the last form document that
    says anything, or else the first printed one.  ``filings`` has the cover's fields, regime
    (xml, legacy_text or empty), n_rows, value_scale, scale_source and warnings: a table that is
    missing though rows were declared, and rows or totals that are off what was declared.
    """
    documents = envelope_documents(raw, "raw")
    bare = raw.where(~F.col("raw").contains("<DOCUMENT>")).select("accession", "filing_date", F.lit(0).alias("number"), F.lit("INFORMATION TABLE").alias("type"), F.col("raw").alias("body"))
    documents = documents.select("accession", "filing_date", "number", "type", "body").unionByName(bare)
    keys = ["accession", "number"]
    slim = documents.select(*keys, "type", "body")
    fields = ["issuer", "title_of_class", "cusip", "value", "shares", "share_type"]
    xml = information_table(slim).select(*keys, "type", *fields, "put_call", F.lit("xml").alias("regime"))
    text = text_table(slim).select(*keys, "type", *fields, F.lit(None).cast("string").alias("put_call"), F.lit("legacy_text").alias("regime"))
    rows = xml.unionByName(text)
    table = F.col("type").contains("INFORMATION TABLE") | F.col("type").isin("XML", "INFOTABLE")
    rank = F.struct(table.alias("table"), F.when(table, F.col("number")).otherwise(-F.col("number")).alias("place"), (F.col("regime") == "xml").alias("xml"))
    chosen = rows.groupBy("accession").agg(F.max(rank).alias("_best"))
    rows = rows.join(chosen, "accession").where(rank == F.col("_best")).drop("_best", "type", "number")
    said = F.col("report_type").isNotNull() | F.col("rows_declared").isNotNull()
    fields_of = F.struct(*COVER)
    of_xml = cover_page(slim.where(F.col("type").startswith("13F-") & F.substring("body", 1, 2000).contains("<"))).where(said).groupBy("accession").agg(F.max_by(fields_of, "number").alias("_xml"))
    of_text = cover_text(slim).where(said | F.col("amendment_type").isNotNull()).groupBy("accession").agg(F.min_by(fields_of, "number").alias("_text"))
    filings = raw.select("accession", "filing_date").join(of_xml, "accession", "left").join(of_text, "accession", "left").withColumn("_cover", F.coalesce("_xml", "_text"))
    filings = filings.select("accession", "filing_date", *[F.col(f"_cover.{c}").alias(c) for c in COVER])
    counts = rows.groupBy("accession").agg(F.max("regime").alias("regime"), F.count("*").alias("n_rows"), F.sum("value").alias("_sum"))
    scales = value_scale(rows.withColumnRenamed("value", "value_reported"), filings, cutover, small_book)
    filings = filings.join(counts, "accession", "left").join(scales, "accession", "left").withColumns({"regime": F.coalesce("regime", F.lit("empty")), "n_rows": F.coalesce("n_rows", F.lit(0))})
    empty, declared = F.col("n_rows") == 0, F.col("rows_declared")
    off_rows = F.abs(F.col("n_rows") - declared) > F.greatest(F.lit(2.0), declared * 0.02)
    off_value = (F.col("value_declared") > 0) & (F.abs(F.col("_sum") - F.col("value_declared")) / F.col("value_declared") > 0.05)
    warnings = F.when(empty & (declared > 0), F.array(F.concat(F.lit("parse failure: cover declares "), declared.cast("string"), F.lit(" entries, none found")))).when(empty, F.array(F.lit("no information table found"))).otherwise(
        F.array_compact(F.array(F.when((declared > 0) & off_rows, F.concat(F.lit("rows "), F.col("n_rows").cast("string"), F.lit(" against "), declared.cast("string"))), F.when(off_value, F.lit("value total off"))))
    )
    one = F.when(empty, 1.0).otherwise(F.col("value_scale"))
    filings = filings.withColumns({"warnings": warnings, "value_scale": one, "scale_source": F.when(empty, "default").otherwise(F.col("scale_source"))}).drop("_sum")
    rows = rows.join(filings.select("accession", "value_scale"), "accession").withColumn("value_usd", F.col("value") * F.col("value_scale")).drop("value_scale")
    return filings, rows
