"""Plans on filing-time states of managers and names, abnormal breadth, paired differences and events after filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crosssection, inference
from .analytics import SIGNALS, pct_rank
from .dialect import Spark, plan
from .holdings import COPYCAT, TRAIL
from .operators import query, relation

#: Positions that an eligible book has, share of the old book with a return, quarters of churn and of persistence that count.
LEAST_POSITIONS, COVERED, SMOOTH, PERSIST = 3, 0.5, 4, 4

#: Per filer and quarter: churn against the drifted old book, smoothed over eligible quarters, and quality.
MANAGERS = f"""px AS (SELECT q, x.instrument, x.price, x.vol, x.adv FROM market x JOIN quarters USING (period_end)),
rets AS (SELECT a.q, a.instrument, a.price / b.price - 1 AS r FROM px a JOIN px b ON a.q = b.q + 1 AND a.instrument = b.instrument),
usual AS (SELECT q, avg(r) AS r FROM rets GROUP BY q),
stats AS (SELECT q, filer_id, sum(value) AS book, count(*) >= {LEAST_POSITIONS} AS eligible, row_number() OVER (PARTITION BY filer_id ORDER BY q) AS filing FROM numbered GROUP BY q, filer_id),
x AS (SELECT m.q, m.filer_id, m.instrument, m.value, m.value_before, r.r IS NOT NULL AS mapped, m.value_before * (1 + greatest(coalesce(r.r, u.r, 0e0), -0.999e0)) AS drift
  FROM moves m JOIN stats s ON s.q = m.q AND s.filer_id = m.filer_id LEFT JOIN rets r ON r.q = m.q AND r.instrument = m.instrument LEFT JOIN usual u ON u.q = m.q),
w AS (SELECT *, coalesce(value / nullif(sum(value) OVER p, 0), 0) AS weight, coalesce(value / nullif(sum(value) OVER p, 0), 0) - coalesce(drift / nullif(sum(drift) OVER p, 0), 0) AS change FROM x WINDOW p AS (PARTITION BY q, filer_id)),
churned AS (SELECT q, filer_id, 0.5 * sum(abs(change)) AS churn, sum(CASE WHEN mapped THEN value_before ELSE 0 END) / nullif(sum(value_before), 0) AS covered FROM w GROUP BY q, filer_id),
judged AS (SELECT c.q, c.filer_id, c.churn FROM churned c JOIN stats s ON s.q = c.q AND s.filer_id = c.filer_id JOIN stats b ON b.q = c.q - 1 AND b.filer_id = c.filer_id WHERE s.eligible AND b.eligible AND covered >= {COVERED}),
smoothed AS (SELECT *, round(avg(churn) OVER (PARTITION BY filer_id ORDER BY q ROWS BETWEEN {SMOOTH - 1} PRECEDING AND CURRENT ROW), 9) AS smooth FROM judged),
managers AS (SELECT q, filer_id, churn, smooth, least(greatest(1 - {pct_rank("smooth", "q")}, 0.05e0), 0.95e0) AS quality FROM smoothed)"""
#: Per filer, name and quarter of a filing: trade, conviction, and how many of the filer's filings in a row it was held in.
STATES = f"""held AS (SELECT n.q, s.filing, n.filer_id, n.instrument, n.value, round(n.w, 9) AS w FROM numbered n JOIN stats s ON s.q = n.q AND s.filer_id = n.filer_id WHERE s.eligible AND n.value > 0),
runs AS (SELECT *, filing - row_number() OVER (PARTITION BY filer_id, instrument ORDER BY filing) AS run, {pct_rank("w", "q, filer_id")} AS conviction FROM held),
aged AS (SELECT *, row_number() OVER (PARTITION BY filer_id, instrument, run ORDER BY filing) AS age FROM runs),
states AS (SELECT w.q, w.filer_id, w.instrument, CASE WHEN m.filer_id IS NOT NULL THEN w.change ELSE 0e0 END AS trade, coalesce(m.quality, 0e0) AS quality, coalesce(m.smooth, 0e0) AS smooth, m.filer_id IS NOT NULL AS judged,
  coalesce(a.value, 0e0) AS state_value, coalesce(a.conviction, 0e0) AS conviction, least(coalesce(a.age, 0), {PERSIST}) / {float(PERSIST)}e0 AS persistence, coalesce(a.age, 0) AS age
  FROM w LEFT JOIN managers m ON m.q = w.q AND m.filer_id = w.filer_id LEFT JOIN aged a ON a.q = w.q AND a.filer_id = w.filer_id AND a.instrument = w.instrument)"""


@plan
def manager_quality(d: Spark) -> str:
    """Churn of each filing against the old book drifted by returns, its mean over eligible filings, and the quality that low churn is."""
    return f"WITH {MANAGERS} SELECT q, filer_id, round(churn, 6) AS churn, round(smooth, 6) AS smooth, round(quality, 8) AS quality FROM managers"


@plan
def filing_states(d: Spark) -> str:
    """State of each filer's names at its filings: drift-adjusted trade, quality, conviction, persistence, their product, and consensus."""
    return f"""WITH {MANAGERS}, {STATES}
SELECT q, filer_id, instrument, round(trade, 6) + 0e0 AS trade, round(trade * quality, 6) + 0e0 AS sticky, round(conviction, 8) AS conviction, persistence, round(conviction * quality * persistence, 13) AS ccp, CASE WHEN conviction >= 0.9 THEN round(quality, 8) ELSE 0e0 END AS consensus, age = 1 AS new_holder FROM states"""


#: Per name and quarter: sums of the states, and what is public of the name.
NAMES = """names AS (SELECT q, instrument, sum(CASE WHEN age > 0 THEN 1 ELSE 0 END) AS n_holders, sum(state_value) AS state_value, sum(state_value * smooth) / nullif(sum(CASE WHEN judged THEN state_value ELSE 0 END), 0) AS fragility,
  sum(conviction * quality * persistence) AS ccp, sum(CASE WHEN conviction >= 0.9 THEN quality ELSE 0 END) AS consensus, sum(trade * quality) AS sticky, sum(CASE WHEN age = 1 THEN 1 ELSE 0 END) AS new_holders FROM states GROUP BY q, instrument)"""


@plan
def name_states(d: Spark) -> str:
    """Names' scores at each quarter's filings: holders, sums of states, and churn of owners."""
    return f"WITH {MANAGERS}, {STATES}, {NAMES} SELECT q, instrument, n_holders, round(state_value, 2) AS state_value, round(fragility, 6) AS fragility, round(ccp, 5) AS ccp, round(consensus, 5) AS consensus, round(sticky, 5) + 0e0 AS sticky, new_holders FROM names"


@query()
def abnormal_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth that seven public traits and style don't explain, its change, and fragility with the market's shocks."""
    rows = relation(
        spark,
        sf_dir,
        f"""WITH {MANAGERS}, {STATES}, {NAMES}, born AS (SELECT instrument, min(q) AS first_q FROM px GROUP BY instrument),
index_ AS (SELECT day, avg(ret) AS m FROM prices WHERE ret IS NOT NULL GROUP BY day),
beta AS (SELECT CAST(year(p.day) * 4 + quarter(p.day) - 7979 AS BIGINT) + 1 AS q, instrument, covar_samp(ret, m) / nullif(var_samp(m), 0) AS beta FROM prices p JOIN index_ i ON p.day = i.day WHERE ret IS NOT NULL GROUP BY CAST(year(p.day) * 4 + quarter(p.day) - 7979 AS BIGINT), instrument)
SELECT n.q, n.instrument, ln(1 + n_holders) AS log_breadth, ln(1 + state_value) AS log_value, r.r AS momentum, p.vol, b.beta, ln(p.adv) AS log_adv, ln(p.price) AS log_price, ln(1 + n.q - first_q) AS log_age, CAST(crc32(n.instrument) % 3 AS STRING) AS style, fragility
FROM names n JOIN px p ON p.q = n.q AND p.instrument = n.instrument JOIN born o ON o.instrument = n.instrument LEFT JOIN rets r ON r.q = n.q AND r.instrument = n.instrument LEFT JOIN beta b ON b.q = n.q AND b.instrument = n.instrument""",
    )
    found = inference.controlled_residual(rows, ["q"], "instrument", "log_breadth", ["log_value", "momentum", "vol", "beta", "log_adv", "log_price", "log_age"], "style")
    out = rows.join(found, ["q", "instrument"], "left")
    before = out.select((F.col("q") + 1).alias("q"), "instrument", F.col("residual").alias("_before"))
    out = out.join(before, ["q", "instrument"], "left")
    z = crosssection.zscore(F.col("fragility"), ["q"], True)
    shock = crosssection.zscore(F.col("momentum"), ["q"], True)
    return out.select("q", "instrument", F.round("residual", 6).alias("abnormal_level"), F.round(F.col("residual") - F.col("_before"), 6).alias("abnormal_adoption"), F.round(z, 5).alias("fragility_z"), F.round(z * F.greatest(-shock, F.lit(0.0)), 5).alias("fragility_reversal"))


@plan
def paired_ic(d: Spark) -> str:
    """Rank correlation with returns over one and two quarters, of the flow signal less that of size, paired by quarter and horizon."""
    return f"""WITH {SIGNALS}, h AS (SELECT q, instrument, s, cap, 1 AS horizon, fwd AS y FROM panel_ UNION ALL SELECT a.q, a.instrument, a.s, a.cap, 2, (1 + a.fwd) * (1 + b.fwd) - 1 FROM panel_ a JOIN panel_ b ON b.q = a.q + 1 AND b.instrument = a.instrument),
v AS (SELECT q, horizon, instrument, 'flow' AS strategy, s AS x, y FROM h WHERE s IS NOT NULL AND y IS NOT NULL UNION ALL SELECT q, horizon, instrument, 'size', cap, y FROM h WHERE s IS NOT NULL AND y IS NOT NULL),
r AS (SELECT q, horizon, strategy, {pct_rank("x", "q, horizon, strategy")} AS rx, {pct_rank("y", "q, horizon, strategy")} AS ry FROM v),
ic AS (SELECT q, horizon, strategy, corr(rx, ry) AS ic FROM r GROUP BY q, horizon, strategy),
p AS (SELECT a.q, a.horizon, a.ic - b.ic AS delta FROM ic a JOIN ic b ON a.q = b.q AND a.horizon = b.horizon AND a.strategy = 'flow' AND b.strategy = 'size'),
u AS (SELECT q, horizon, delta, delta - avg(delta) OVER (PARTITION BY horizon) AS u, row_number() OVER (PARTITION BY horizon ORDER BY q) AS i FROM p WHERE delta IS NOT NULL),
l AS (SELECT a.horizon, sum(a.u * b.u) AS g FROM u a JOIN u b ON a.horizon = b.horizon AND a.i = b.i + 1 GROUP BY a.horizon)
SELECT u.horizon, count(*) AS n, round(avg(delta), 6) AS mean, round(avg(delta) / sqrt((sum(u * u) + max(coalesce(g, 0))) / count(*) / count(*)), 4) AS t FROM u LEFT JOIN l ON l.horizon = u.horizon GROUP BY u.horizon"""


@plan
def paired_returns(d: Spark) -> str:
    """Daily return of names traded by judged managers less the equal-weighted one, paired by day, in the whole sample and its halves."""
    return """WITH held AS (SELECT DISTINCT q, instrument FROM moves WHERE shares > shares_before), r AS (SELECT day, instrument, ret, CAST(year(day) * 4 + quarter(day) - 7979 AS BIGINT) AS q FROM prices WHERE ret IS NOT NULL),
a AS (SELECT r.day, avg(ret) AS x FROM r JOIN held h ON h.q = r.q - 1 AND h.instrument = r.instrument GROUP BY r.day), b AS (SELECT day, avg(ret) AS x FROM r GROUP BY day),
s AS (SELECT a.day, a.x AS structural, b.x AS baseline, a.x - b.x AS spread FROM a JOIN b ON a.day = b.day),
t AS (SELECT 'full' AS sample, s.* FROM s UNION ALL SELECT CASE WHEN day < DATE '1998-01-01' THEN 'early' ELSE 'late' END, s.* FROM s)
SELECT sample, count(*) AS n_days, round(corr(structural, baseline), 5) AS correlation, round(avg(spread) * 252, 5) AS ann_return, round(stddev_samp(spread) * sqrt(252e0), 5) AS ann_vol FROM t GROUP BY sample"""


@plan
def copycat_pop(d: Spark) -> str:
    """Excess over the day's median of names that leaders entered, on the five trading days after the filing: leaders that much money follows, and others."""
    return f"""WITH {COPYCAT}, spread_ AS (SELECT q + i AS q, follower, leader, overlap - usual AS x FROM scored {d.each(TRAIL + 1)} WHERE overlap - usual > 1e-12),
means AS (SELECT q, follower, leader, avg(x) AS x FROM spread_ GROUP BY q, follower, leader),
shadow AS (SELECT m.q, leader, sum(x * aum) AS shadow FROM means m JOIN stats s ON s.q = m.q AND s.filer_id = m.follower GROUP BY m.q, leader),
cut AS (SELECT q, {d.quantile("shadow", 2 / 3)} AS high FROM shadow GROUP BY q),
first_ AS (SELECT filer_id, period_end, min(known) AS known FROM revisions WHERE kind = 'ORIGINAL' GROUP BY filer_id, period_end),
cal AS (SELECT day, row_number() OVER (ORDER BY day) AS at_ FROM (SELECT DISTINCT day FROM prices) x),
marks AS (SELECT day, at_ FROM cal UNION ALL SELECT DISTINCT known AS day, NULL AS at_ FROM first_), filled AS (SELECT DISTINCT day, max(at_) OVER (ORDER BY day) AS at_ FROM marks),
med AS (SELECT day, {d.quantile("ret", 0.5)} AS m FROM prices WHERE ret IS NOT NULL GROUP BY day), ex AS (SELECT p.instrument, c.at_, p.ret - m.m AS x FROM prices p JOIN med m ON m.day = p.day JOIN cal c ON c.day = p.day WHERE p.ret IS NOT NULL),
ev AS (SELECT f.q, f.filer_id, f.instrument, t.at_, CASE WHEN s.shadow IS NULL THEN 'plain' WHEN s.shadow >= c.high THEN 'followed' ELSE 'between' END AS kind FROM fresh f JOIN lead_ k ON k.q = f.q AND k.filer_id = f.filer_id JOIN quarters z ON z.q = f.q
  JOIN first_ o ON o.filer_id = f.filer_id AND o.period_end = z.period_end JOIN filled t ON t.day = o.known LEFT JOIN shadow s ON s.q = f.q - 1 AND s.leader = f.filer_id LEFT JOIN cut c ON c.q = f.q - 1),
days AS (SELECT kind, instrument, at_ + i + 1 AS at_, i + 1 AS k FROM ev {d.each(5)} WHERE at_ IS NOT NULL)
SELECT kind, k, count(*) AS n, round(avg(x), 6) AS excess FROM days d JOIN ex ON ex.at_ = d.at_ AND ex.instrument = d.instrument GROUP BY kind, k"""
