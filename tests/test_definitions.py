"""Cases worked out by hand: folds as of a date, portfolio algebra, demand, units, groups, covers, splits, times."""

import datetime
import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import holdfold
from holdfold.functions import calendar
from holdfold.operators import bitemporal, demand, inference, latent, portfolio, storage
from holdfold.plans.domain import Domain
from holdfold.sources import curation, filings, reference, sinks

D = datetime.date.fromisoformat


def test_book_as_of_dates(spark):
    holdings = spark.createDataFrame([("orig", "X", 100.0, 1000.0), ("orig", "Y", 200.0, 2000.0), ("restate", "X", 100.0, 1000.0), ("restate", "Y", 900.0, 9000.0), ("addl", "Z", 50.0, 500.0)], "accession string, instrument string, shares double, value double")
    p = D("2020-03-31")
    revisions = spark.createDataFrame([("orig", "F", p, "", None, D("2020-05-14")), ("restate", "F", p, "RESTATEMENT", 1.0, D("2020-11-20")), ("addl", "F", p, "NEW HOLDINGS", 2.0, D("2021-04-01"))], "accession string, cik string, period_end date, kind string, amendment_no double, known date")
    book = lambda day: {r.instrument: r.shares for r in bitemporal.as_of(holdings, revisions, F.lit(day).cast("date")).collect()}
    assert book("2020-04-01") == {} and book("2020-06-30") == {"X": 100, "Y": 200}
    assert book("2020-11-21") == {"X": 100, "Y": 900} == book("2021-03-31")
    assert book("2021-04-02") == {"X": 100, "Y": 900, "Z": 50}


def test_versions_of_one_time_go_by_number_those_without_first(spark):
    day, p = D("2020-05-01"), D("2020-03-31")
    rows = [("b", 1, p, "RESTATEMENT", 1.0, day), ("c", 1, p, "ORIGINAL", None, day), ("a", 1, p, "RESTATEMENT", 2.0, day)]
    got = bitemporal.versions(spark.createDataFrame(rows, "accession string, cik int, period_end date, kind string, amendment_no double, known date"))
    assert {r.accession: r.seq for r in got.collect()} == {"c": 0, "b": 1, "a": 2}


def test_strict_versions_per_cik(spark):
    p = D("2023-12-31")
    rows = [("1a", 1, "A", 100.0, "2024-02-01", None), ("1b", 1, "B", 20.0, "2024-02-05", "NEW HOLDINGS"), ("1c", 1, "A", 150.0, "2024-02-10", "RESTATEMENT"), ("1d", 1, "C", 30.0, "2024-02-12", "NEW HOLDINGS"), ("2a", 2, "D", 40.0, "2024-02-03", None)]
    revisions = spark.createDataFrame([(a, c, "FAMILY", p, k, D(d)) for a, c, _, _, d, k in rows], "accession string, cik int, filer_id string, period_end date, kind string, known date")
    holdings = spark.createDataFrame([(a, i, v, v) for a, _, i, v, _, _ in rows], "accession string, instrument string, shares double, value double")
    got = bitemporal.strict_panel(holdings, revisions, F.lit("2024-02-15").cast("date")).collect()
    assert {r.instrument: r.value for r in got} == {"A": 150, "C": 30, "D": 40} and {r.available for r in got} == {D("2024-02-12")}


def test_portfolio_algebra_by_hand(spark):
    book = lambda **w: spark.createDataFrame([(1, k, float(v)) for k, v in w.items()], "date int, name string, weight double")
    got = lambda df: {r.name: r.weight for r in df.collect()}
    assert got(portfolio.normalise(book(A=2, B=-1), "long")) == {"A": 1, "B": -0.5}
    assert got(portfolio.normalise(book(A=2, B=3, C=-4), "split")) == {"A": 0.4, "B": 0.6, "C": -1}
    assert got(portfolio.normalise(book(A=1, B=-0.25), "equalize")) == {"A": 1, "B": -1}
    assert got(portfolio.added(book(A=1, B=-1), portfolio.scaled(book(B=1, C=2), 0.5))) == {"A": 1, "B": -0.5, "C": 1}
    assert got(portfolio.masked(book(A=1, B=2), book(A=9))) == {"A": 1, "B": 0}
    members = spark.createDataFrame([(m, 1, n, w) for m, n, w in (("p", "A", 1.0), ("q", "A", 2.0), ("r", "A", -1.0), ("p", "B", 1.0), ("q", "B", 0.0), ("r", "B", 0.0))], "member string, date int, name string, weight double")
    assert {(r.member, r.name): r.weight for r in portfolio.agreeing(members, 0.6).collect() if r.weight} == {("p", "A"): 1, ("q", "A"): 2}
    with pytest.raises(ValueError):
        portfolio.normalise(book(A=1), "other")


def test_period_returns_by_hand(spark):
    w = spark.createDataFrame([(1, "A", 0.6), (1, "B", -0.2), (2, "A", 0.5)], "date int, name string, weight double")
    r = spark.createDataFrame([(1, "A", 0.1), (1, "B", 0.05), (2, "A", -0.1)], "date int, name string, ret double")
    borrow, cash = spark.createDataFrame([(1, "B", 0.01)], "date int, name string, rate double"), spark.createDataFrame([(1, 0.002), (2, 0.002)], "date int, rate double")
    got = {x.date: x for x in portfolio.period_returns(w, r, borrow, cash, 0.001).collect()}
    assert got[1].gross == pytest.approx(0.05) and got[1].cost == pytest.approx(0.2 * 0.01 + 0.8 * 0.001) and got[1].cash == pytest.approx(0.6 * 0.002)
    assert got[2].net == pytest.approx(-0.05 - (0.1 + 0.2) * 0.001 + 0.5 * 0.002)


def test_demand_by_hand(spark):
    rows = [(1, "E", D("2024-02-01"), 10.0), (1, "E", D("2024-02-09"), -3.0)]
    assert [r.running for r in demand.arrivals(spark.createDataFrame(rows, "period_end int, fund string, available date, delta double")).orderBy("available").collect()] == [10, 7]
    state = spark.createDataFrame([("m", 1, "E", 10.0), ("m", 2, "E", 20.0), ("n", 2, "E", 10.0)], "filer_id string, period_end int, fund string, shares double")
    own = {r.period_end: r for r in demand.ownership_change(state, spark.createDataFrame([(1, "E", 100.0), (2, "E", 100.0)], "period_end int, fund string, outstanding double")).collect()}
    assert own[2].own == pytest.approx(0.3) and own[2].d_own == pytest.approx(0.2) and own[1].d_own is None
    p = D("2024-03-31")
    flow = spark.createDataFrame([(p, "E", 0.1, 1000.0)], "period_end date, fund string, d_own double, assets double")
    stocks = spark.createDataFrame([(p, "A", 1200.0), (p, "B", 400.0)], "period_end date, name string, cap double")
    basket = lambda day: spark.createDataFrame([(p, D(day), "E", "A", 0.6), (p, D(day), "E", "B", 0.4)], "period_end date, effective date, fund string, name string, weight double")
    assert {r.name: round(r.pressure, 6) for r in demand.look_through(flow, basket("2024-03-31"), stocks).collect()} == {"A": 0.05, "B": 0.1}
    with pytest.raises(Exception, match="takes effect after"):
        demand.look_through(flow, basket("2024-04-01"), stocks).collect()


HELD = "accession string, share_type string, put_call string, shares double, value_reported double"
FILED = "accession string, filing_date date, amendment_type string"


def test_units_by_hand(spark):
    cases = {  # accession: (values, shares, filed, amendment, scale, source)
        "thousands": ([15_000.0] * 8, [100_000.0] * 8, "2019-05-15", None, 1000, "detected"),
        "dollars": ([15_000_000.0] * 8, [100_000.0] * 8, "2024-02-14", None, 1, "detected"),
        "late thousands": ([15_000.0] * 8, [100_000.0] * 8, "2024-02-14", None, 1000, "detected"),
        "small": ([100.0] * 25, [100.0] * 25, "2024-02-14", None, 1000, "detected"),
        "partial": ([100.0] * 25, [100.0] * 25, "2024-02-14", "NEW HOLDINGS", 1, "calendar"),
        "early": ([100.0] * 3, [100.0] * 3, "2019-02-14", None, 1000, "calendar"),
        "absurd": ([6.6e9], [6.6e9], "2019-02-14", None, 1, "plausibility"),
    }
    h = [(k, "SH", "", s, v) for k, (values, shares, *_) in cases.items() for v, s in zip(values, shares, strict=True)]
    got = {r.accession: (r.value_scale, r.scale_source) for r in curation.value_scale(spark.createDataFrame(h, HELD), spark.createDataFrame([(k, D(c[2]), c[3]) for k, c in cases.items()], FILED)).collect()}
    assert got == {k: (c[4], c[5]) for k, c in cases.items()}


COVERS = "filer_id string, cik int, period_end string, accession string, form string, report_type string, other_managers array<int>, n_rows int, book_usd double"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("AGG", 1, "agg", "13F-HR", "13F COMBINATION REPORT", [2], 120, 5e9), ("SUB", 2, "sub", "13F-HR", "13F HOLDINGS REPORT", [], 40, 8e8)], {"agg": True, "sub": False}),
        ([("A", 1, "orig", "13F-HR", "13F HOLDINGS REPORT", [], 100, 1e9), ("A", 1, "amd", "13F-HR/A", "13F HOLDINGS REPORT", [], 101, 1.02e9)], {"orig": True, "amd": True}),
        ([("AGG", 1, "agg", "13F-HR", "13F COMBINATION REPORT", [2], 120, 5e9), ("SUB", 2, "sub", "13F-HR", None, [], 40, 8e8), ("SUB", 2, "sub_a", "13F-HR/A", None, [], 41, 8.1e8)], {"agg": True, "sub": False, "sub_a": False}),
        ([("A", 1, "amd", "13F-HR/A", "13F HOLDINGS REPORT", [], 80, 9e8)], {"amd": True}),
        ([("A", 1, "a", "13F-HR", "13F NOTICE", [2], 0, 0.0), ("B", 2, "b", "13F-HR", "13F HOLDINGS REPORT", [], 5, 1e6)], {"a": False, "b": True}),
    ],
)
def test_reporting_groups_by_hand(spark, rows, want):
    covers = spark.createDataFrame([(f, c, "2020-03-31", a, form, kind, o, n, b) for f, c, a, form, kind, o, n, b in rows], COVERS)
    out = curation.reporting_groups(covers).collect()
    assert {r.accession: r.keep for r in out} == want
    assert len({r.group_id for r in out}) == 1


ENVELOPE = """<SEC-DOCUMENT>1.txt
<DOCUMENT>
<TYPE>13F-HR
<TEXT>
<edgarSubmission xmlns="x"><formData><coverPage><reportType>13F HOLDINGS REPORT</reportType><filingManager><name>TEST ADVISORS LP</name></filingManager>
<otherManagers2Info><otherManager2><sequenceNumber>1</sequenceNumber><otherManager><cik>0000000042</cik></otherManager></otherManager2></otherManagers2Info></coverPage>
<summaryPage><tableEntryTotal>{n}</tableEntryTotal><tableValueTotal>{total}</tableValueTotal></summaryPage></formData></edgarSubmission>
</TEXT></DOCUMENT>
<DOCUMENT><TYPE>INFORMATION TABLE
<TEXT>
<ns1:informationTable>{rows}</ns1:informationTable>
</TEXT></DOCUMENT></SEC-DOCUMENT>"""
ROW = "<ns1:infoTable><ns1:nameOfIssuer>ACME</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>037833100</ns1:cusip><ns1:value>{v}</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>{s}</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt></ns1:infoTable>"
PRINTED = """Check here if Amendment [X]; Amendment Number: 3
This Amendment (Check only one.): [ ] is a restatement.
                                  [x] adds new
                                      holdings entries.
[X]  13F HOLDINGS REPORT.
[ ]  13F NOTICE.
Form 13F Information Table Entry Total:   1
Form 13F Information Table Value Total:   $1,234
CONFIDENTIAL TREATMENT REQUESTED"""


def test_submissions_by_hand(spark):
    three = "".join(ROW.format(v=1_000_000, s=10_000) for _ in range(3))
    raw = [("good", ENVELOPE.format(n=3, total=3_000_000, rows=three)), ("lost", ENVELOPE.format(n=9, total=3_000_000, rows="")), ("off", ENVELOPE.format(n=30, total=9_000_000, rows=three)), ("bare", three), ("none", "<SEC-DOCUMENT></SEC-DOCUMENT>")]
    raw.append(("old", f"<SEC-DOCUMENT><DOCUMENT><TYPE>13F-HR\n<TEXT>{PRINTED}\nACME CORP    COM    037833100    1,234    10,000 SH</TEXT></DOCUMENT></SEC-DOCUMENT>"))
    df = spark.createDataFrame([(a, D("2024-02-14"), r) for a, r in raw], "accession string, filing_date date, raw string")
    found, rows = curation.submissions(df)
    got = {r.accession: r for r in found.collect()}
    assert (got["good"].regime, got["good"].n_rows, got["good"].value_scale, got["good"].warnings, got["good"].other_managers, got["good"].manager) == ("xml", 3, 1, [], [42], "TEST ADVISORS LP")
    assert got["lost"].regime == "empty" and got["lost"].warnings == ["parse failure: cover declares 9 entries, none found"]
    assert got["off"].warnings == ["rows 3 against 30", "value total off"] and got["bare"].n_rows == 3 and got["none"].warnings == ["no information table found"]
    old = got["old"]
    assert (old.regime, old.report_type, old.amendment_type, old.amendment_no, old.is_amendment, old.confidential, old.rows_declared, old.value_declared) == ("legacy_text", "13F HOLDINGS REPORT", "NEW HOLDINGS", 3, True, True, 1, 1234)
    assert rows.where("accession = 'good'").agg(F.sum("value_usd")).first()[0] == 3_000_000


def test_splits_in_deltas_on_a_callers_tables(spark):
    """Twelve holders through a two for one split: no trade, no buyers; the engine runs on tables it is given."""
    p0, p1 = D("2020-03-31"), D("2020-06-30")
    revisions = [(f"{p}-{f}", f, f, D("2020-05-01") if p == p0 else D("2020-08-01"), p, "ORIGINAL") for p in (p0, p1) for f in range(12)]
    holdings = [(f"{p}-{f}", "NAME", (10.0 + f) * (2 if p == p1 else 1), 500.0) for p in (p0, p1) for f in range(12)] + [(f"{p}-{f}", "REST", 10.0 + (p == p1) * (f + 1) ** 2, 500.0) for p in (p0, p1) for f in range(12)]
    engine = Domain(spark, {"revisions": spark.createDataFrame(revisions, "accession string, cik int, filer_id int, known date, period_end date, kind string"), "holdings": spark.createDataFrame(holdings, "accession string, instrument string, shares double, value double")})
    moves = {(r.filer_id, r.instrument): r.d_shares for r in engine.run("position_deltas").collect()}
    assert all(moves[f, "NAME"] == 0 for f in range(12)) and moves[2, "REST"] == 9
    ti = {r.instrument: r for r in engine.run("trade_imbalance").collect()}
    assert ti["NAME"].ti is None and ti["NAME"].n_active == 0 and ti["REST"].ti == 1
    stats = engine.run("filer_stats").collect()
    assert all(r.hhi == 0.5 and r.hhi_norm == 0 for r in stats)


def test_store_is_written_once_whoever_is_first(spark):
    """Two engines of one key: the second reads what the first wrote, and one that comes second to write leaves nothing behind."""
    p = D("2020-03-31")
    given = {"revisions": spark.createDataFrame([("a", 1, 1, D("2020-05-01"), p, "ORIGINAL")], "accession string, cik int, filer_id int, known date, period_end date, kind string"), "holdings": spark.createDataFrame([("a", "X", 1.0, 1.0)], "accession string, instrument string, shares double, value double")}
    first, second = (Domain(spark, given, "samekey") for _ in range(2))
    assert first.sql("SELECT * FROM numbered").count() == second.sql("SELECT * FROM numbered").count() == 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{storage.shared_folder(spark)}/store-samekey")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert sorted(f.getPath().getName() for f in fs.listStatus(path)) == ["folded", "numbered"]
    late = Domain(spark, given, "samekey")
    fs.delete(path.getParent().suffix("/store-samekey/numbered/_columns"), True)  # looks unfinished, as to one who is writing it too
    assert late.sql("SELECT * FROM numbered").count() == 1
    assert sorted(f.getPath().getName() for f in fs.listStatus(path)) == ["folded", "numbered"]


def test_one_position_is_fully_concentrated(spark):
    p = D("2020-03-31")
    engine = Domain(spark, {"revisions": spark.createDataFrame([("a", 1, 1, D("2020-05-01"), p, "ORIGINAL")], "accession string, cik int, filer_id int, known date, period_end date, kind string"), "holdings": spark.createDataFrame([("a", "X", 1.0, 1.0)], "accession string, instrument string, shares double, value double")})
    assert engine.run("filer_stats").first().hhi_norm == 1


def test_residual_duplicates_between_two_filers(spark):
    p = D("2020-03-31")
    engine = Domain(spark, {"revisions": spark.createDataFrame([(str(f), f, f, D("2020-05-01"), p, "ORIGINAL") for f in (1, 2, 3)], "accession string, cik int, filer_id int, known date, period_end date, kind string"), "holdings": spark.createDataFrame([("1", "X", 5.0, 1.0), ("2", "X", 5.0, 1.0), ("3", "X", 6.0, 1.0), ("3", "Y", 0.0, 0.0), ("1", "Y", 0.0, 0.0)], "accession string, instrument string, shares double, value double")})
    assert sorted((r.filer_id, r.filers) for r in engine.run("residual_duplicates").collect()) == [(1, 2), (2, 2)]


def test_known_on_follows_the_clocks(spark):
    times = ["2024-01-10 20:59:59", "2024-01-10 21:00:00", "2024-07-10 19:59:59", "2024-07-10 20:00:00", "2024-07-11 03:00:00"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(calendar.known_on(F.to_timestamp("t")).alias("d")).collect()
    assert [str(r.d) for r in got] == ["2024-01-10", "2024-01-11", "2024-07-10", "2024-07-11", "2024-07-11"]


def test_nmf_finds_what_two_factors_made(spark):
    rng = np.random.default_rng(0)
    w, h = rng.random((30, 2)) * (rng.random((30, 2)) > 0.3), rng.random((2, 8)) * (rng.random((2, 8)) > 0.3)
    v = w @ h
    a, b = latent.factorise(v, 2, 500)
    assert (a >= 0).all() and (b >= 0).all() and np.linalg.norm(v - a @ b) < 0.02 * np.linalg.norm(v)
    assert latent.heldout_error(v, 2) < 0.1 < latent.heldout_error(v, 1)
    df = spark.createDataFrame([(1, i, f"n{j}", float(v[i, j])) for i in range(30) for j in range(8)], "q int, r int, i string, w double")
    out = latent.nmf(df, "q", "r", "i", "w", grid=(1, 2, 3)).collect()
    assert {r.factor for r in out} == {0, 1} and max(r.error for r in out) < 0.05


def test_controlled_residual_against_lstsq(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"q": 1, "k": range(40), "y": rng.normal(size=40), "a": rng.normal(size=40), "b": rng.normal(size=40), "s": [str(k % 3) for k in range(40)]})
    pdf.loc[3, "a"] = np.nan
    got = {r.k: r.residual for r in inference.controlled_residual(spark.createDataFrame(pdf), ["q"], "k", "y", ["a", "b"], "s").collect()}
    ok = pdf["a"].notna()
    z = pdf[["a", "b"]].apply(lambda s: s.clip(*s.quantile([0.01, 0.99])))
    design = np.column_stack([np.ones(ok.sum()), z[ok], pd.get_dummies(pdf["s"], drop_first=True, dtype=float)[ok]])
    want = pdf["y"][ok] - design @ np.linalg.lstsq(design, pdf["y"][ok], rcond=None)[0]
    assert np.allclose([got[k] for k in pdf["k"][ok]], want) and (got[3] is None or np.isnan(got[3]))


def test_reference_files_reject_what_lacks_columns(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Symbol|Name\nA|B\n")
    with pytest.raises(ValueError, match="no ETF field"):
        reference.symbol_directory(spark, [str(tmp_path / "d.txt")])
    (tmp_path / "p.csv").write_text("day,price\n2024-01-02,5\n")
    with pytest.raises(ValueError, match="lacks"):
        filings.with_reference(spark, str(tmp_path / "p.csv"), "day date, price double", ["day", "volume"])
    assert filings.with_reference(spark, str(tmp_path / "p.csv"), "day date, price double", ["day"]).first().price == 5
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("OTHER.tsv", "A\n1\n")
    with pytest.raises(Exception, match="has no"):
        filings.zipped_table(spark.createDataFrame([("x.zip", bytearray(out.getvalue()))], "path string, content binary"), "SUBMISSION.tsv", ["A"]).collect()


def test_mapping_cache_keeps_identifiers_without_answers(spark):
    lines = [json.dumps({"instrument_id": "A", "queried_at": "1", "response": {"data": []}}), "", json.dumps({"instrument_id": "B", "queried_at": "1", "response": {"error": "bad"}})]
    got = {r.instrument_id: r for r in reference.identifier_cache(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["A"].mapping_error == "No identifier found" and got["B"].mapping_error == "bad" and got["A"].mapping_rank is None


def test_saved_panel_ends_after_its_limit(spark, tmp_path):
    days = [(D("2024-01-01") + datetime.timedelta(days=k),) for k in range(30)]
    signal = spark.createDataFrame([("A", D("2024-01-03"), 1.0), ("A", D("2024-01-20"), 2.0), ("B", D("2023-12-30"), 5.0)], "instrument string, day date, value double")
    sinks.save_panel(signal, spark.createDataFrame(days, "day date"), str(tmp_path / "p"), 5)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "p")).collect():
        got.setdefault((r.instrument, r.value), []).append(r.day.day)
    assert {k: (min(v), max(v), len(v)) for k, v in got.items()} == {("A", 1.0): (3, 8, 6), ("A", 2.0): (20, 25, 6), ("B", 5.0): (1, 6, 6)}


def test_bare_shared_folder_is_on_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert storage.qualified(spark, "/somewhere/shared") == "file:/somewhere/shared"
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./somewhere", "file:///tmp")
    try:
        assert storage.qualified(spark, "/somewhere/shared") == "viewfs://store/somewhere/shared"
    finally:
        conf.set("fs.defaultFS", before)


def test_packed_holds_every_module(tmp_path):
    with zipfile.ZipFile(holdfold.packed(str(tmp_path))) as z:
        names = set(z.namelist())
    assert {"holdfold/__init__.py", "holdfold/catalogue.py", "holdfold/plans/domain.py", "holdfold/operators/latent.py"} <= names
