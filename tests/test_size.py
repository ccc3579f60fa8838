"""What large tables ask of queries: results that the driver doesn't hold, and copies that aren't compared one by one."""

import datetime as dt
import difflib
import math

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from holdfold.functions import identifiers
from holdfold.plans import curation, evaluation, operators
from holdfold.plans.dialect import DuckDB, Spark
from holdfold.plans.domain import Domain

T0 = dt.datetime(2024, 1, 1)


def _folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, path, at):
    return _folder(spark, path, events=([(k, T0 + dt.timedelta(minutes=m), user, "view", 1.0, None) for k, (user, m) in enumerate(at)], EVENTS))


def test_sessions_lie_in_files(spark, tmp_path):
    """Sessions that are still open at the end count too; a gap of half an hour ends one."""
    out = curation.stream_sessions(spark, _events(spark, tmp_path, [(1, 0), (1, 29), (1, 59), (2, 10), (2, 10), (None, 5)]))
    assert out.inputFiles()
    assert {(r.user_id, r.start.minute, r.n) for r in out.collect()} == {(1, 0, 2), (1, 59, 1), (2, 10, 2), (None, 5, 1)}


def test_a_score_that_does_not_vary(spark):
    """Each filer holds each name in each quarter, so the change of holders is 0 everywhere: NaN for it, numbers for the others."""
    days = [dt.date(2020, 3 * k, 28) for k in range(1, 5)]
    quarters = spark.createDataFrame([(d, q) for q, d in enumerate(days)], "period_end date, q long")
    at = [(q, i, (7 * q + 3 * i * i) % 5 + 1.0) for q in range(4) for i in range(4)]
    moves = spark.createDataFrame([(q, f"n{i}", x, 2.0, 10 * x, 20.0 + i) for q, i, x in at], "q long, instrument string, shares double, shares_before double, value double, value_before double")
    market = spark.createDataFrame([(days[q], f"n{i}", 10 + (q + i) % 3 + x, 1e3, 0.1, 1e6) for q, i, x in at], "period_end date, instrument string, price double, adv double, vol double, cap double")
    got = {r.factor: r for r in Domain(spark, {"quarters": quarters, "moves": moves, "market": market}).run("factor_table").collect()}
    assert math.isnan(got["holders"]["mean"]) and math.isnan(got["holders"]["t"]) and got["holders"]["n"] == 3
    assert all(math.isfinite(got[k]["mean"]) and math.isfinite(got[k]["t"]) for k in ("flow", "ownership"))


def test_correlation_and_quotient_are_those_of_the_sql(spark):
    pairs = {"varies": [(1, 2), (2, 1), (3, 7)], "constant": [(1, 2), (1, 5)], "one": [(1, 2)], "nulls": [(None, 2)], "holes": [(1, 2), (None, 9), (2, 3), (4, None), (5, 1)]}
    rows = ", ".join(f"('{g}', CAST({'NULL' if x is None else x} AS DOUBLE), CAST({'NULL' if y is None else y} AS DOUBLE))" for g, xs in pairs.items() for x, y in xs)
    sums = "(VALUES (1e0, 0e0), (-1e0, 0e0), (0e0, 0e0), (3e0, 2e0), (NULL, 0e0), (1e0, NULL)) v(a, b)"
    found = []
    for d, run in ((Spark(), lambda q: [tuple(r) for r in spark.sql(q).collect()]), (DuckDB(), lambda q: duckdb.sql(q).fetchall())):
        c = run(f"SELECT g, round({d.corr('x', 'y')}, 9) AS c FROM (VALUES {rows}) v(g, x, y) GROUP BY g")
        found.append(sorted(str(r) for r in c + run(f"SELECT a, b, {d.over('a', 'b')} AS c FROM {sums}")))
    assert found[0] == found[1]


def test_deduplicated_events_lie_in_files(spark, tmp_path):
    """Each event once, also one of weeks later and one without a user."""
    out = curation.stream_deduplicated(spark, _events(spark, tmp_path, [(1, 0), (1, 0), (2, 50_000), (None, 3)]))
    assert out.inputFiles()
    assert sorted((r.event_id, r.user_id, r.event_type) for r in out.collect()) == [(0, 1, "view"), (1, 1, "view"), (2, 2, "view"), (3, None, "view")]


PART = "p_partkey long, p_name string, p_brand string, p_size int"
NAMES = ("red bolt", "Bolt, RED", "big  gear", "hot gear wheel", "gear wheel", "", None, "red big")
PARTS = [(7 * k % 1201, NAMES[k % 8], None if k % 101 == 0 else f"b{k % 3 // 2}", k % 5 // 4) for k in range(1200)] + [(5, "red bolt", "b0", 0), (5, "red bolt", "b0", 0), (None, "red bolt", "b0", 0)]


def test_copies_of_names_are_compared_once(spark, tmp_path, monkeypatch):
    """1,203 parts of eight names: the SQL's pairs, from a comparison for each two names of a brand."""
    compared = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def similarity(a, b):
        compared.add(1)
        return len({*a} & {*b}) / len({*a} | {*b}) if a or b else None

    monkeypatch.setattr(identifiers, "token_similarity", similarity)
    path = _folder(spark, tmp_path, part=(PARTS, PART))
    got = sorted(tuple(r) for r in evaluation.similar_names(spark, path).collect())
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(operators.ORACLE_SQL["similar_names"]).fetchall()) and len(got) > 50_000
    assert compared.value <= 1_000


def test_ratios_of_names_are_found_once(spark, tmp_path, monkeypatch):
    """Every pair of a brand and size, those of null names too, from a ratio for each two names."""
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(identifiers, "sequence_ratio", ratio)
    got = operators.name_similarity(spark, _folder(spark, tmp_path, part=(PARTS, PART))).collect()
    groups: dict = {}
    for key, name, brand, size in PARTS:
        if key is not None and brand is not None:
            groups.setdefault((brand, size), []).append((key, name))
    known = {(x, y): None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x in NAMES for y in NAMES}
    want = sorted(str((k, j, known[x, y])) for rows in groups.values() for k, x in rows for j, y in rows if k < j)
    assert sorted(str((r.p_partkey, r.other, r.ratio)) for r in got) == want
    assert {r.jaccard for r in got if r.ratio is None} == {None} and 1.0 in {r.jaccard for r in got}
    assert compared.value <= 256
