"""Queries on operators that take a caller's own tables, with SQL of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitemporal, demand, portfolio
from . import analytics
from .dialect import DuckDB, Spark
from .operators import oracle, query, relation

DAYS = ("1996-03-31", "1997-09-30", "1999-12-31")
_DAYS = ", ".join(f"(DATE '{x}')" for x in DAYS)


@query(
    oracle(f"""WITH t(day) AS (VALUES {_DAYS}), v AS (SELECT t.day, r.*, row_number() OVER (PARTITION BY t.day, cik, period_end ORDER BY known, accession) AS seq FROM revisions r JOIN t ON r.known <= t.day),
b AS (SELECT *, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN seq END) OVER (PARTITION BY day, cik, period_end) AS base FROM v), l AS (SELECT * FROM b WHERE base IS NULL OR seq >= base),
h AS (SELECT l.day, l.cik, l.period_end, l.seq, h.instrument, h.shares, h.value FROM l JOIN holdings h USING (accession)),
n AS (SELECT *, max(seq) OVER (PARTITION BY day, cik, period_end, instrument) AS last FROM h)
SELECT CAST(day AS VARCHAR) AS day, cik, period_end, instrument, round(sum(shares), 2) AS shares, round(sum(value), 2) AS value FROM n WHERE seq = last GROUP BY ALL""")
)
def as_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as they were knowable on several dates."""
    holdings, revisions = relation(spark, sf_dir, "SELECT * FROM holdings"), relation(spark, sf_dir, "SELECT * FROM revisions")
    out = [bitemporal.as_of(holdings, revisions, F.lit(day).cast("date")).withColumn("day", F.lit(day)) for day in DAYS]
    return reduce(DataFrame.unionByName, out).select("day", "cik", "period_end", "instrument", F.round("shares", 2).alias("shares"), F.round("value", 2).alias("value"))


@query(
    oracle("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY known, accession) AS seq FROM revisions),
b AS (SELECT *, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN seq END) OVER (PARTITION BY cik, period_end) AS base FROM v), l AS (SELECT *, max(known) OVER (PARTITION BY filer_id, period_end) AS last FROM b WHERE seq >= base)
SELECT filer_id, period_end, instrument, round(sum(value), 2) AS value, max(last) AS available FROM l JOIN holdings USING (accession) GROUP BY filer_id, period_end, instrument""")
)
def strict_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final books per filer, additions only where a base is, with the date from which all of a book was known."""
    holdings, revisions = relation(spark, sf_dir, "SELECT * FROM holdings"), relation(spark, sf_dir, "SELECT * FROM revisions")
    return bitemporal.strict_panel(holdings, revisions, F.lit("9999-01-01").cast("date")).select("filer_id", "period_end", "instrument", F.round("value", 2).alias("value"), "available")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, f"WITH {analytics.SIGNALS}, {analytics.legs(Spark())} SELECT q AS date, instrument AS name, w * vol AS weight FROM wts WHERE w <> 0 AND vol IS NOT NULL")


_DUCK = DuckDB()
_WEIGHTS = f"{analytics.SIGNALS}, {analytics.legs(_DUCK)}, w AS (SELECT q AS date, instrument AS name, w * vol AS weight FROM wts WHERE w <> 0 AND vol IS NOT NULL)"


@query(
    oracle(f"""WITH {_WEIGHTS}, s AS (SELECT *, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS lo, -sum(CASE WHEN weight < 0 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS sh FROM w),
l AS (SELECT date, name, weight / nullif(lo, 0) AS x FROM s), p AS (SELECT date, name, CASE WHEN weight >= 0 THEN coalesce(weight / nullif(lo, 0), 0) ELSE weight / nullif(sh, 0) END AS x FROM s), e AS (SELECT date, name, CASE WHEN weight >= 0 THEN weight ELSE weight * coalesce(lo / nullif(sh, 0), 0) END AS x FROM s),
u AS (SELECT date, name, 0.5 * x AS x FROM p UNION ALL SELECT date, name, x FROM e)
SELECT l.date, l.name, round(l.x, 6) AS by_long, round(t.x, 6) AS mixed, round(CASE WHEN length(l.name) % 2 = 0 THEN t.x ELSE 0 END, 6) + 0e0 AS masked FROM l JOIN (SELECT date, name, sum(x) AS x FROM u GROUP BY date, name) t ON l.date = t.date AND l.name = t.name""")
)
def portfolio_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios normalised in three ways, scaled, added and masked."""
    w = _weights(spark, sf_dir)
    mixed = portfolio.added(portfolio.scaled(portfolio.normalise(w, "split"), 0.5), portfolio.normalise(w, "equalize"))
    masked = portfolio.masked(mixed, mixed.where(F.length("name") % 2 == 0)).withColumnRenamed("weight", "masked")
    out = portfolio.normalise(w, "long").withColumnRenamed("weight", "by_long").join(mixed.withColumnRenamed("weight", "mixed"), ["date", "name"]).join(masked, ["date", "name"])
    return out.select("date", "name", *[F.round(c, 6).alias(c) if c != "masked" else (F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("by_long", "mixed", "masked")])


@query(
    oracle(f"""WITH {_WEIGHTS}, s AS (SELECT date, name, weight / sum(abs(weight)) OVER (PARTITION BY date) AS w FROM w), d AS (SELECT DISTINCT date FROM s), k AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM d),
t AS (SELECT date, sum(abs(x)) AS traded FROM (SELECT date, name, sum(w) AS x FROM (SELECT date, name, w FROM s UNION ALL SELECT k.date, name, -w FROM s JOIN k ON s.date = k.before) u GROUP BY date, name) v GROUP BY date),
g AS (SELECT s.date, sum(w * coalesce(fwd, 0)) AS gross, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) * 0.002 AS borrow, sum(w) AS net FROM s LEFT JOIN panel_ p ON p.q = s.date AND p.instrument = s.name GROUP BY s.date)
SELECT g.date, round(gross, 6) AS gross, round(borrow + traded * 0.0005, 6) AS cost, round((1 - net) * 0.001, 6) AS cash, round(gross - borrow - traded * 0.0005 + (1 - net) * 0.001, 6) AS net FROM g JOIN t ON g.date = t.date""")
)
def costed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly returns with borrowing, fees on what is traded, and cash on what isn't invested."""
    w = _weights(spark, sf_dir)
    gross = w.groupBy("date").agg(F.sum(F.abs("weight")).alias("_g"))
    w = w.join(gross, "date").select("date", "name", (F.col("weight") / F.col("_g")).alias("weight"))
    returns = relation(spark, sf_dir, f"WITH {analytics.SIGNALS} SELECT q AS date, instrument AS name, fwd AS ret FROM panel_")
    out = portfolio.period_returns(w, returns, returns.select("date", "name", F.lit(0.002).alias("rate")), w.select("date").distinct().withColumn("rate", F.lit(0.001)), 0.0005)
    return out.select("date", *[F.round(c, 6).alias(c) for c in ("gross", "cost", "cash", "net")])


@query(
    oracle("""WITH f AS (SELECT r.period_end, r.filer_id, min(r.known) AS known FROM revisions r GROUP BY ALL), m AS (SELECT m.q, k.period_end, m.instrument AS fund, f.known, m.shares - m.shares_before AS delta FROM moves m JOIN quarters k ON k.q = m.q JOIN f ON f.period_end = k.period_end AND f.filer_id = m.filer_id)
SELECT period_end, fund, known AS available, round(sum(sum(delta)) OVER (PARTITION BY period_end, fund ORDER BY known), 4) + 0e0 AS running FROM m GROUP BY period_end, fund, known""")
)
def arrival_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand known of each name as filings arrive."""
    rows = relation(spark, sf_dir, "SELECT k.period_end, m.instrument AS fund, f.known AS available, m.shares - m.shares_before AS delta FROM moves m JOIN quarters k ON k.q = m.q JOIN (SELECT period_end, filer_id, min(known) AS known FROM revisions GROUP BY period_end, filer_id) f ON f.period_end = k.period_end AND f.filer_id = m.filer_id")
    return demand.arrivals(rows).groupBy("period_end", "fund", "available").agg((F.round(F.max("running"), 4) + F.lit(0.0)).alias("running"))


@query(
    oracle("""WITH b AS (SELECT n.q, n.filer_id AS fund, max(n.book) AS assets, sum(n.shares) AS shares FROM numbered n JOIN funds f ON f.fund = n.filer_id GROUP BY n.q, n.filer_id),
o AS (SELECT q, fund, assets, shares / (10 * assets) AS own FROM b), d AS (SELECT q, fund, assets, own - lag(own) OVER (PARTITION BY fund ORDER BY q) AS d_own FROM o),
p AS (SELECT n.q, n.instrument AS name, sum(d.d_own * d.assets * n.w) AS flow FROM numbered n JOIN d ON d.q = n.q AND d.fund = n.filer_id GROUP BY n.q, n.instrument)
SELECT k.period_end, p.name, round(p.flow / m.cap * 1000, 6) AS pressure FROM p JOIN quarters k ON k.q = p.q JOIN market m ON m.period_end = k.period_end AND m.instrument = p.name""")
)
def fund_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership change of funds passed through to the names in their baskets, over their caps; a basket from the future raises."""
    own = relation(spark, sf_dir, "SELECT n.period_end, n.filer_id AS fund, sum(n.shares) AS shares, max(n.book) AS assets FROM numbered n JOIN funds f ON f.fund = n.filer_id GROUP BY n.period_end, n.filer_id")
    change = demand.ownership_change(own, own.select("period_end", "fund", (F.col("assets") * 10).alias("outstanding"))).join(own.select("period_end", "fund", "assets"), ["period_end", "fund"])
    basket = relation(spark, sf_dir, "SELECT period_end, period_end AS effective, filer_id AS fund, instrument AS name, w AS weight FROM numbered")
    stocks = relation(spark, sf_dir, "SELECT period_end, instrument AS name, cap FROM market")
    return demand.look_through(change, basket, stocks).select("period_end", "name", F.round(F.col("pressure") * 1000, 6).alias("pressure"))
