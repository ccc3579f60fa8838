"""Plans on benchmarks, attribution, calendars, standardised scores, variants and placebos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, identifiers
from ..operators import inference
from ..sources import filings
from .analytics import MONTHLY, RESIDUAL, SIGNALS, bins, legs, pct_rank
from .dialect import DuckDB, Spark, plan
from .holdings import flow_history
from .operators import alike, oracle, ordered_pairs, query, relation, shared_path, spread

#: Months with what was known of a name before them: last month's return, momentum, and the cap and volume of the last quarter's end.
TRAITS = f"""{MONTHLY}, lagged AS (SELECT instrument, month, ret, lag(ret) OVER w AS before, CASE WHEN count(ret) OVER v >= 8 THEN exp(sum(ln(1 + ret)) OVER v) - 1 END AS mom,
  CASE WHEN count(ret) OVER y >= 8 THEN stddev_samp(ret) OVER y END AS vol, CAST(year(month) * 4 + quarter(month) - 7979 AS BIGINT) AS q FROM mret
  WINDOW w AS (PARTITION BY instrument ORDER BY month), v AS (PARTITION BY instrument ORDER BY month ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING), y AS (PARTITION BY instrument ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
known_ AS (SELECT k.q + 1 AS q, x.instrument, ln(greatest(x.cap, 1)) AS size_, ln(x.adv) AS liquid FROM market x JOIN quarters k USING (period_end)),
traits AS (SELECT l.*, size_, liquid FROM lagged l LEFT JOIN known_ k ON k.q = l.q AND k.instrument = l.instrument)"""


def _spread(x: str, name: str, d: Spark) -> str:
    """Mean return of the upper third by ``x`` less that of the lower, by month."""
    return f"""{name} AS (SELECT month, avg(CASE WHEN bin = 2 THEN ret END) - avg(CASE WHEN bin = 0 THEN ret END) AS {name} FROM (
  SELECT month, ret, {bins(d, "rn", "n", 3)} AS bin FROM (SELECT month, ret, row_number() OVER (PARTITION BY month ORDER BY {x}, instrument) AS rn, count(*) OVER (PARTITION BY month) AS n FROM traits WHERE ret IS NOT NULL AND {x} IS NOT NULL) r) b GROUP BY month)"""


def benchmarks(d: Spark) -> str:
    """CTEs up to ``bench``: monthly market, small less big, momentum, reversal and illiquidity."""
    parts = ", ".join(_spread(x, name, d) for x, name in (("size_", "big"), ("mom", "mom_"), ("before", "winners"), ("liquid", "liquid_")))
    return f"""{TRAITS}, mkt_ AS (SELECT month, avg(ret) AS mkt FROM traits WHERE ret IS NOT NULL GROUP BY month), {parts},
bench AS (SELECT m.month, mkt, -big AS smb, mom_ AS mom, -winners AS strev, -liquid_ AS illiq FROM mkt_ m LEFT JOIN big ON big.month = m.month LEFT JOIN mom_ ON mom_.month = m.month LEFT JOIN winners ON winners.month = m.month LEFT JOIN liquid_ ON liquid_.month = m.month)"""


@plan
def classical_traits(d: Spark) -> str:
    """Size, momentum, low volatility, liquidity and reversal of each name and month, as z-scores of what was known before it."""
    z = lambda x, sign="": f"round(CASE WHEN stddev_pop({x}) OVER m > 1e-9 THEN {sign}({x} - avg({x}) OVER m) / stddev_pop({x}) OVER m END, 5) + 0e0"
    return f"WITH {TRAITS} SELECT instrument, month, {z('size_')} AS size, {z('mom')} AS momentum, {z('vol', '-')} AS low_vol, {z('liquid')} AS liquidity, {z('before', '-')} AS reversal FROM traits WINDOW m AS (PARTITION BY month)"


@plan
def benchmark_factors(d: Spark) -> str:
    """Monthly benchmark returns: the mean, and spreads of outer thirds by what was known before the month."""
    return f"WITH {benchmarks(d)} SELECT month, round(mkt, 6) AS mkt, round(smb, 6) + 0e0 AS smb, round(mom, 6) + 0e0 AS mom, round(strev, 6) + 0e0 AS strev, round(illiq, 6) + 0e0 AS illiq FROM bench"


#: The rungs: what a strategy's return is regressed on, each with the last one's and more.
LADDER = {"raw": (), "market": ("mkt",), "size": ("mkt", "smb"), "momentum": ("mkt", "smb", "mom"), "reversal": ("mkt", "smb", "mom", "strev"), "illiquidity": ("mkt", "smb", "mom", "strev", "illiq")}


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark()
    sql = f"""WITH {SIGNALS}, {legs(d)}, {benchmarks(d)}, s AS (SELECT 'flow' AS strategy, t.month, sum(w.w * t.ret) AS ret FROM wts w JOIN traits t ON t.q = w.q + 1 AND t.instrument = w.instrument WHERE w.w <> 0 AND t.ret IS NOT NULL GROUP BY t.month
UNION ALL SELECT 'reversed', t.month, -sum(w.w * t.ret) FROM wts w JOIN traits t ON t.q = w.q + 1 AND t.instrument = w.instrument WHERE w.w <> 0 AND t.ret IS NOT NULL GROUP BY t.month)
SELECT s.*, mkt, smb, mom, strev, illiq FROM s JOIN bench b ON b.month = s.month"""
    return relation(spark, sf_dir, sql).dropna()


@query()
def alpha_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercepts of strategies' monthly returns, raw and on ever more benchmarks, with Bartlett errors over four lags."""
    rows = _strategies(spark, sf_dir)
    out = None
    for rung, factors in LADDER.items():
        part = inference.ols_hac(rows, "strategy", "ret", list(factors), "month").where("name = 'intercept'").select(F.lit(rung).alias("rung"), "strategy", F.round("beta", 7).alias("alpha"), F.round("t", 4).alias("t"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of strategies on all benchmarks, and the part of the mean return that each gives."""
    rows = _strategies(spark, sf_dir)
    names = list(LADDER["illiquidity"])
    found = inference.ols_hac(rows, "strategy", "ret", names, "month")
    means = rows.groupBy("strategy").agg(*[F.avg(c).alias(c) for c in names])
    mean = F.coalesce(*[F.when(F.col("name") == c, F.col(c)) for c in names], F.lit(1.0))
    return found.join(means, "strategy").select("strategy", "name", F.round("beta", 5).alias("beta"), F.round("t", 4).alias("t"), F.round(F.col("beta") * mean, 7).alias("part"))


@plan
def factor_table(d: Spark) -> str:
    """Rank correlations of three scores with the next return: mean, spread, ratio, Newey-West t of four lags, hit rate."""
    return f"""WITH {SIGNALS}, o AS (SELECT q, instrument, sum(shares - shares_before) / nullif(sum(shares_before), 0) AS dio, sum(CASE WHEN shares > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END) AS dn FROM moves GROUP BY q, instrument),
v AS (SELECT p.q, p.instrument, 'flow' AS factor, s AS x, fwd FROM panel_ p UNION ALL SELECT p.q, p.instrument, 'ownership', o.dio, fwd FROM panel_ p JOIN o ON o.q = p.q AND o.instrument = p.instrument UNION ALL SELECT p.q, p.instrument, 'holders', CAST(o.dn AS DOUBLE), fwd FROM panel_ p JOIN o ON o.q = p.q AND o.instrument = p.instrument),
r AS (SELECT q, factor, {pct_rank("x", "q, factor")} AS a, {pct_rank("fwd", "q, factor")} AS b FROM v WHERE x IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT q, factor, {d.corr("a", "b")} AS ic FROM r GROUP BY q, factor),
u AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor) AS u, row_number() OVER (PARTITION BY factor ORDER BY q) AS i FROM ic WHERE ic IS NOT NULL),
l AS (SELECT b.*, b.i + k AS later, k FROM u b CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x),
g AS (SELECT a.factor, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 5e0) END * a.u * l.u) AS g FROM u a JOIN l ON l.factor = a.factor AND l.later = a.i GROUP BY a.factor)
SELECT u.factor, count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / nullif(stddev_samp(ic), 0), 5) AS ir, round({d.over("avg(ic)", "sqrt(max(g) / count(*) / count(*))")}, 4) AS t, round(avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit FROM u JOIN g ON g.factor = u.factor GROUP BY u.factor"""


@plan
def lead_signal_test(d: Spark) -> str:
    """Spread of this quarter's return by the next quarter's signal: a t above 2.5 means the signal has seen the return, one below -2.5 that returns lead trading."""
    return f"""WITH {SIGNALS}, x AS (SELECT q, instrument, fwd, lead(s) OVER (PARTITION BY instrument ORDER BY q) AS later, lead(q) OVER (PARTITION BY instrument ORDER BY q) AS at_ FROM panel_),
n AS (SELECT q, fwd, row_number() OVER (PARTITION BY q ORDER BY later, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM x WHERE later IS NOT NULL AND fwd IS NOT NULL AND at_ = q + 1),
s AS (SELECT q, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS spread FROM (SELECT q, fwd, {bins(d, "rn", "n", 5)} AS bin FROM n WHERE n >= 10) b GROUP BY q),
t AS (SELECT count(*) AS events, avg(spread) AS mean, avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(count(*)) AS t FROM s)
SELECT events, round(mean, 6) AS lead_spread, round(t, 4) AS t, CASE WHEN t > 2.5 THEN 'fails' WHEN t < -2.5 THEN 'returns lead' ELSE 'passes' END AS verdict FROM t"""


@plan
def double_sort(d: Spark) -> str:
    """Quintile spread of the signal within terciles of volatility, and less the spread of the quarter as a whole."""
    five = lambda source, by: f"(SELECT *, {bins(d, 'rn', 'n', 5)} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {source}) z)"
    return f"""WITH {SIGNALS}, t AS (SELECT q, instrument, s, fwd, row_number() OVER (PARTITION BY q ORDER BY vol, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM panel_ WHERE fwd IS NOT NULL AND vol IS NOT NULL AND s IS NOT NULL),
u AS (SELECT q, instrument, s, fwd, {bins(d, "rn", "n", 3)} AS tercile FROM t),
inner_ AS (SELECT q, tercile, count(*) AS n, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS spread FROM {five("u", "q, tercile")} a GROUP BY q, tercile),
outer_ AS (SELECT q, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS spread FROM {five("u", "q")} a GROUP BY q)
SELECT i.q, tercile, n, round(i.spread, 6) AS spread, round(i.spread - o.spread, 6) AS delta FROM inner_ i JOIN outer_ o ON o.q = i.q"""


@plan
def ndcg(d: Spark) -> str:
    """Discounted gain at ten of names ordered by the books seen by day 45, against their final value, names not seen counting as zero."""
    return f"""WITH seen AS (SELECT DISTINCT filer_id, k.q FROM revisions r JOIN quarters k USING (period_end) WHERE {d.days("known", "r.period_end")} <= 45),
v AS (SELECT n.q, n.instrument, round(sum(n.value), 2) AS truth, round(sum(CASE WHEN s.filer_id IS NOT NULL THEN n.value ELSE 0 END), 2) AS guess FROM numbered n LEFT JOIN seen s ON s.q = n.q AND s.filer_id = n.filer_id GROUP BY n.q, n.instrument),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY guess DESC, instrument) AS i, row_number() OVER (PARTITION BY q ORDER BY truth DESC, instrument) AS best FROM v)
SELECT q, round(sum(CASE WHEN i <= 10 THEN truth / (ln(i + 1) / ln(2e0)) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN truth / (ln(best + 1) / ln(2e0)) ELSE 0 END), 0), 6) AS ndcg10 FROM r GROUP BY q"""


@plan
def universe_filter(d: Spark) -> str:
    """Price floor, rolling median volume and history; on a day with too few names the last day's mask that had enough."""
    return f"""WITH r AS (SELECT instrument, day, price, {d.quantile("dollars", 0.5)} OVER w AS adv, count(*) OVER w AS n FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
c AS (SELECT day, {d.quantile("adv", 0.2)} AS p20 FROM r GROUP BY day),
e AS (SELECT instrument, r.day, price >= 4 AND adv >= p20 AND n >= 57 AS ok FROM r JOIN c ON r.day = c.day),
days AS (SELECT day, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS names FROM e GROUP BY day),
source_ AS (SELECT day, max(CASE WHEN names >= 10 THEN day END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS used FROM days)
SELECT s.day, s.used, e.instrument FROM source_ s JOIN e ON e.day = s.used WHERE e.ok"""


@plan
def rebalance_calendars(d: Spark) -> str:
    """Last weekday of each month and quarter, and each Friday, of the days that prices cover."""
    back = lambda day: f"CASE WHEN {d.days(day, "DATE '1995-01-02'")} % 7 = 5 THEN {d.plus(day, -1)} WHEN {d.days(day, "DATE '1995-01-02'")} % 7 = 6 THEN {d.plus(day, -2)} ELSE {day} END"
    end = lambda unit, n: d.plus(d.months(f"CAST(date_trunc('{unit}', day) AS DATE)", n), -1)
    friday = d.plus("CAST(date_trunc('week', day) AS DATE)", 4)
    spans = " UNION ".join(f"SELECT '{name}' AS calendar, {expr} AS at_ FROM span" for name, expr in (("month", back(end("month", 1))), ("quarter", back(end("quarter", 3))), ("week", friday)))
    return f"WITH span AS (SELECT DISTINCT day FROM prices), limits AS (SELECT min(day) AS a, max(day) AS b FROM span), every AS ({spans}) SELECT calendar, at_ AS day FROM every JOIN limits ON at_ >= a AND at_ <= b"


@plan
def decision_dates(d: Spark) -> str:
    """When each quarter's books are acted on, by the delay that a study allows, and the filers then known."""
    lags = " UNION ALL ".join(f"SELECT {k} AS lag" for k in (30, 40, 45, 50, 60, 70, 71, 75, 80))
    return f"""WITH l AS ({lags}), f AS (SELECT period_end, filer_id, min({d.days("known", "period_end")}) AS delay FROM revisions GROUP BY period_end, filer_id), c AS (SELECT period_end, delay, count(*) AS n FROM f GROUP BY period_end, delay)
SELECT q.period_end, lag, {d.plus("q.period_end", "lag")} AS decided, coalesce(sum(CASE WHEN delay <= lag THEN n END), 0) AS filers FROM quarters q CROSS JOIN l LEFT JOIN c ON c.period_end = q.period_end GROUP BY q.period_end, lag"""


@plan
def score_filers(d: Spark) -> str:
    """Weighted percent ranks of a filer's concentration, book, number of names and turnover; a rank that is missing counts as the median one."""
    rank = lambda x, name: f"CASE WHEN {x} IS NOT NULL THEN {pct_rank(x, f'q, {x} IS NULL')} END AS {name}"
    middle = lambda x: f"coalesce({x}, m_{x})"
    return f"""WITH t AS (SELECT q, filer_id, 2 * sum(abs(value - value_before)) / nullif(sum(value + value_before), 0) AS turn, max(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END) AS had FROM moves GROUP BY q, filer_id),
s AS (SELECT n.q, n.filer_id, round(sum(w * w), 9) AS hhi, max(book) AS book, count(*) AS names, max(CASE WHEN had = 1 THEN round(turn, 9) END) AS turn FROM numbered n LEFT JOIN t ON t.q = n.q AND t.filer_id = n.filer_id GROUP BY n.q, n.filer_id),
r AS (SELECT q, filer_id, {rank("hhi", "a")}, {rank("book", "b")}, {rank("names", "c")}, {rank("turn", "e")} FROM s),
m AS (SELECT q, {", ".join(f"{d.quantile(x, 0.5)} AS m_{x}" for x in "abce")} FROM r GROUP BY q)
SELECT r.q, filer_id, round((0.4 * {middle("a")} + 0.3 * {middle("b")} + 0.1 * (1 - {middle("c")}) + 0.2 * (1 - {middle("e")})) / 1.0, 6) AS score FROM r JOIN m ON m.q = r.q"""


@plan
def footprint_history(d: Spark) -> str:
    """A filer's footprint with smoothed turnover and the number of its quarters: book, names, top weight, impact, turnover."""
    return """WITH t AS (SELECT q, filer_id, 2 * sum(abs(value - value_before)) / nullif(sum(value + value_before), 0) AS turn FROM moves GROUP BY q, filer_id),
s AS (SELECT n.q, n.filer_id, max(book) AS book, count(*) AS names, max(w) AS top1, 10000 * sum(value * vol * sqrt(value / nullif(adv, 0))) / max(book) AS bps FROM numbered n JOIN market x USING (period_end, instrument) GROUP BY n.q, n.filer_id),
h AS (SELECT s.*, turn, row_number() OVER (PARTITION BY s.filer_id ORDER BY s.q) AS quarters_, turn * power(2e0, (s.q - 40) / 2e0) AS x, CASE WHEN turn IS NOT NULL THEN power(2e0, (s.q - 40) / 2e0) END AS k FROM s LEFT JOIN t ON t.q = s.q AND t.filer_id = s.filer_id)
SELECT q, filer_id, round(book, 2) AS book, names, round(top1, 6) AS top1, round(bps, 4) AS impact_bps, round(turn, 6) AS turnover, round(sum(x) OVER w / sum(k) OVER w, 6) AS turnover_ewma, quarters_ AS history FROM h WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS UNBOUNDED PRECEDING)"""


@plan
def flow_by_fragility(d: Spark) -> str:
    """Centred rank of the flow to volume times the rank of fragility, and the share of the cap that filers hold."""
    return f"""WITH {flow_history(d)}, s AS (SELECT n.q, n.instrument, at_, sum(n.value * u) AS x, max(m.cap) AS cap FROM numbered n JOIN market m ON m.period_end = n.period_end AND m.instrument = n.instrument JOIN dev ON dev.q = n.q AND dev.filer_id = n.filer_id GROUP BY n.q, n.instrument, at_),
g AS (SELECT q, instrument, round(sum(x * x) / (max(cap) * max(cap)), 12) AS frag FROM s GROUP BY q, instrument),
c AS (SELECT m.q, m.instrument, round(sum((shares - shares_before) * price) / nullif(max(adv) * 63, 0), 9) AS caf, sum(value) / nullif(max(cap), 0) AS own FROM moves m JOIN quarters k ON m.q = k.q JOIN market x ON x.period_end = k.period_end AND x.instrument = m.instrument GROUP BY m.q, m.instrument),
j AS (SELECT c.*, coalesce(frag, 0e0) AS frag FROM c LEFT JOIN g ON g.q = c.q AND g.instrument = c.instrument)
SELECT q, instrument, round(own, 6) AS own_share, round(({pct_rank("caf", "q")} - 0.5e0) * {pct_rank("frag", "q")}, 6) + 0e0 AS caf_x_fragility FROM j"""


@plan
def standardised_flow(d: Spark) -> str:
    """The flow signal winsorised, as a z-score, and that with log cap and log volume taken out."""
    z = "CASE WHEN stddev_pop(ws) OVER (PARTITION BY q) > 1e-12 THEN (ws - avg(ws) OVER (PARTITION BY q)) / stddev_pop(ws) OVER (PARTITION BY q) ELSE 0e0 END"
    return f"""WITH {SIGNALS}, lim AS (SELECT q, {d.quantile("s", 0.01)} AS lo, {d.quantile("s", 0.99)} AS hi FROM panel_ GROUP BY q), l AS (SELECT p.q, instrument, cap, adv, least(greatest(s, lo), hi) AS ws FROM panel_ p JOIN lim ON p.q = lim.q),
zs AS (SELECT *, {z} AS z FROM l), {RESIDUAL.format(rank="z", rows="zs")} SELECT e.q, e.instrument, round(z, 5) + 0e0 AS z, round(resid, 5) + 0e0 AS neutral FROM e JOIN zs ON zs.q = e.q AND zs.instrument = e.instrument"""


@plan
def signed_flow_beta(d: Spark) -> str:
    """Holders' betas to the common flow, from what was seen before, times the quarter's common flow, over a name's volume."""
    return f"""WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id),
g AS (SELECT q, sum(flow * aum) / sum(aum) AS g FROM f WHERE flow IS NOT NULL GROUP BY q), p AS (SELECT f.q, filer_id, flow, g FROM f JOIN g ON g.q = f.q WHERE flow IS NOT NULL),
b AS (SELECT q, filer_id, CASE WHEN count(*) OVER w >= 8 THEN (avg(flow * g) OVER w - avg(flow) OVER w * avg(g) OVER w) / nullif(avg(g * g) OVER w - avg(g) OVER w * avg(g) OVER w, 0) END AS beta FROM p WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n.q, n.instrument, round(sum(n.value * beta) / max(x.adv) * max(g.g), 4) + 0e0 AS signed_beta FROM numbered n JOIN b ON b.q = n.q AND b.filer_id = n.filer_id JOIN g ON g.q = n.q JOIN market x ON x.period_end = n.period_end AND x.instrument = n.instrument WHERE beta IS NOT NULL GROUP BY n.q, n.instrument"""


@plan
def imbalance_variants(d: Spark) -> str:
    """Trade and volume imbalance over filers of both quarters, over all filers, and over all filers by issuer (the name's first seven letters)."""
    body = "sum(CASE WHEN shares > shares_before THEN 1 ELSE 0 END) AS b, sum(CASE WHEN shares < shares_before THEN 1 ELSE 0 END) AS s, sum(greatest(shares - shares_before, 0)) AS bv, sum(greatest(shares_before - shares, 0)) AS sv"
    return f"""WITH f AS (SELECT DISTINCT q, filer_id FROM numbered), both_ AS (SELECT a.q, a.filer_id FROM f a JOIN f b ON b.q = a.q - 1 AND b.filer_id = a.filer_id),
issuer AS (SELECT q, filer_id, substr(instrument, 1, 7) AS instrument, sum(shares) AS shares, sum(shares_before) AS shares_before FROM moves GROUP BY q, filer_id, substr(instrument, 1, 7)),
v AS (SELECT 'common' AS variant, m.q, instrument, {body} FROM moves m JOIN both_ b ON b.q = m.q AND b.filer_id = m.filer_id GROUP BY m.q, instrument
UNION ALL SELECT 'all', q, instrument, {body} FROM moves GROUP BY q, instrument UNION ALL SELECT 'issuer', q, instrument, {body} FROM issuer GROUP BY q, instrument)
SELECT variant, q, instrument, round((b - s) / nullif(CAST(b + s AS DOUBLE), 0), 6) AS ti, round((bv - sv) / nullif(bv + sv, 0), 6) AS vi FROM v"""


@plan
def window_dressing_pressure(d: Spark) -> str:
    """Filers' mean excess of selling losers over the other names in the eight quarters before, and what that presses on the quarter's losers, over their volume."""
    return f"""WITH px AS (SELECT q, x.instrument, x.price, x.adv FROM market x JOIN quarters USING (period_end)), r AS (SELECT a.q, a.instrument, a.price / b.price - 1 <= -0.1 AS loser, a.adv FROM px a JOIN px b ON b.q = a.q - 1 AND b.instrument = a.instrument),
sold AS (SELECT m.q, m.filer_id, avg(CASE WHEN loser THEN CASE WHEN shares < shares_before THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN NOT loser THEN CASE WHEN shares < shares_before THEN 1e0 ELSE 0e0 END END) AS wd FROM moves m JOIN r ON r.q = m.q AND r.instrument = m.instrument WHERE shares_before > 0 GROUP BY m.q, m.filer_id),
past AS (SELECT q, filer_id, CASE WHEN count(wd) OVER w >= 4 THEN avg(wd) OVER w END AS wd FROM sold WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT m.q, m.instrument, round(sum(greatest(p.wd, 0) * m.value_before) / max(r.adv), 5) AS pressure FROM past p JOIN moves m ON m.q = p.q AND m.filer_id = p.filer_id JOIN r ON r.q = m.q AND r.instrument = m.instrument WHERE r.loser AND p.wd IS NOT NULL AND m.value_before > 0 GROUP BY m.q, m.instrument"""


@plan
def nowcast_ema(d: Spark) -> str:
    """Ownership change from filers seen by day 30, over their coverage, beside the halving mean of the four changes before, and a book that mixes what is fresh with the last of the others."""
    return f"""WITH seen AS (SELECT DISTINCT filer_id, k.q FROM revisions r JOIN quarters k USING (period_end) WHERE {d.days("known", "r.period_end")} <= 30),
c AS (SELECT m.q, m.instrument, sum(m.shares - m.shares_before) / nullif(sum(m.shares_before), 0) AS truth, sum(CASE WHEN s.filer_id IS NOT NULL THEN m.shares - m.shares_before ELSE 0 END) / nullif(sum(m.shares_before), 0) AS part,
  sum(CASE WHEN s.filer_id IS NOT NULL THEN m.shares_before ELSE 0 END) / nullif(sum(m.shares_before), 0) AS cover, sum(CASE WHEN s.filer_id IS NOT NULL THEN m.value ELSE m.value_before END) AS mixed FROM moves m LEFT JOIN seen s ON s.q = m.q AND s.filer_id = m.filer_id GROUP BY m.q, m.instrument),
e AS (SELECT *, lag(truth, 1) OVER w AS l1, lag(truth, 2) OVER w AS l2, lag(truth, 3) OVER w AS l3, lag(truth, 4) OVER w AS l4 FROM c WINDOW w AS (PARTITION BY instrument ORDER BY q))
SELECT q, instrument, round(part / greatest(cover, 0.15e0), 6) + 0e0 AS scaled, round((coalesce(l1 * 0.5, 0) + coalesce(l2 * 0.25, 0) + coalesce(l3 * 0.125, 0) + coalesce(l4 * 0.0625, 0)) / nullif(CASE WHEN l1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN l2 IS NULL THEN 0 ELSE 0.25 END + CASE WHEN l3 IS NULL THEN 0 ELSE 0.125 END + CASE WHEN l4 IS NULL THEN 0 ELSE 0.0625 END, 0), 6) + 0e0 AS ema, round(mixed, 2) AS mixed FROM e"""


@plan
def forced_supply_windows(d: Spark) -> str:
    """Excess over the quarter's median of the names that distressed filers must sell, in the quarter of the pressure and the next, beside a placebo of filers without distress."""
    return f"""WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id),
px AS (SELECT q, x.instrument, x.price, x.adv FROM market x JOIN quarters USING (period_end)), r AS (SELECT a.q, a.instrument, least(greatest(a.price / b.price - 1, -0.5e0), 0.5e0) AS ret FROM px a JOIN px b ON b.q = a.q - 1 AND b.instrument = a.instrument),
ex AS (SELECT r.q, instrument, ret - m AS x FROM r JOIN (SELECT q, {d.quantile("ret", 0.5)} AS m FROM r GROUP BY q) k ON k.q = r.q),
s AS (SELECT n.q, n.instrument, CASE WHEN flow < -0.1 THEN 'distressed' ELSE 'placebo' END AS kind, sum(abs(flow) * aum * n.w) / max(px.adv) AS supply FROM numbered n JOIN f ON f.q = n.q AND f.filer_id = n.filer_id JOIN px ON px.q = n.q AND px.instrument = n.instrument WHERE flow IS NOT NULL GROUP BY n.q, n.instrument, CASE WHEN flow < -0.1 THEN 'distressed' ELSE 'placebo' END),
t AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY supply DESC, instrument) AS rn, count(*) OVER (PARTITION BY q, kind) AS n FROM s), hit AS (SELECT q, instrument, kind FROM t WHERE rn <= greatest(CAST(floor(n * 0.2) AS BIGINT), 3))
SELECT kind, count(a.x) AS n, round(avg(a.x), 6) AS pressure, round(avg(b.x), 6) AS reversal FROM hit h LEFT JOIN ex a ON a.q = h.q AND a.instrument = h.instrument LEFT JOIN ex b ON b.q = h.q + 1 AND b.instrument = h.instrument GROUP BY kind"""


@plan
def diffusion_placebo(d: Spark) -> str:
    """Correlation of spilled shocks with the next return, beside the same with the shocks dealt to other names, over names whose own shock is at most the median."""
    shock = "SELECT q, instrument, sum(greatest(value_before - value, 0)) / nullif(sum(value_before), 0) AS x FROM moves GROUP BY q, instrument"
    # the shuffled shock is that of the next name in the order of names, so both sides of the check deal alike
    spill = lambda x: f"SELECT h.q, h.instrument, sum(v * (xs - x) + vxs - v * x) / sum(v * (names - 1) + vs - v) AS spill FROM (SELECT n.*, count(*) OVER w AS names, sum(v) OVER w AS vs, sum(x) OVER w AS xs, sum(v * x) OVER w AS vxs FROM (SELECT n.q, n.filer_id, n.instrument, n.value AS v, coalesce(s.{x}, 0) AS x FROM numbered n JOIN shock s ON s.q = n.q AND s.instrument = n.instrument) n WINDOW w AS (PARTITION BY n.q, filer_id)) h WHERE names > 1 GROUP BY h.q, h.instrument"
    return f"""WITH {SIGNALS}, shock0 AS ({shock}), shock AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY q ORDER BY instrument), first_value(x) OVER (PARTITION BY q ORDER BY instrument)) AS y FROM shock0),
a AS ({spill("x")}), b AS ({spill("y")}), lim AS (SELECT q, {d.quantile("x", 0.5)} AS m FROM shock GROUP BY q)
SELECT p.q, count(*) AS n, round(corr(a.spill, p.fwd), 5) AS honest, round(corr(b.spill, p.fwd), 5) AS placebo FROM panel_ p JOIN shock s ON s.q = p.q AND s.instrument = p.instrument JOIN lim ON lim.q = p.q JOIN a ON a.q = p.q AND a.instrument = p.instrument JOIN b ON b.q = p.q AND b.instrument = p.instrument
WHERE p.fwd IS NOT NULL AND s.x <= lim.m GROUP BY p.q HAVING count(*) >= 4"""


@plan
def integrity_checks(d: Spark) -> str:
    """Violation counts: identifiers that are empty, repeated versions, additions before any base, books from the future, splits that are none, weights that don't add up."""
    return f"""SELECT 'empty_names' AS rule, count(*) AS violations FROM holdings WHERE instrument IS NULL OR instrument = ''
UNION ALL SELECT 'repeated_accessions', count(*) - count(DISTINCT accession) FROM revisions
UNION ALL SELECT 'additions_without_base', count(*) FROM (SELECT cik, period_end FROM revisions GROUP BY cik, period_end HAVING max(CASE WHEN kind <> 'NEW HOLDINGS' THEN 1 ELSE 0 END) = 0) x
UNION ALL SELECT 'seen_too_early', count(*) FROM visible WHERE known > {d.plus("period_end", 60)}
UNION ALL SELECT 'splits_of_nothing', count(*) FROM splits WHERE factor <= 0 OR abs(factor - 1) <= 0.15
UNION ALL SELECT 'weights_off', count(*) FROM (SELECT q, filer_id FROM numbered GROUP BY q, filer_id HAVING abs(sum(w) - 1) > 1e-6) y
UNION ALL SELECT 'filings_without_rows', count(*) FROM revisions r LEFT JOIN (SELECT DISTINCT accession FROM holdings) h ON h.accession = r.accession WHERE h.accession IS NULL"""


@query()
def clustered_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the signal, cap and volume with effects of quarter taken out, errors by quarter."""
    rows = relation(spark, sf_dir, f"WITH {SIGNALS}, x AS (SELECT q, fwd, s, ln(cap) AS cap, ln(adv) AS adv FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL) SELECT q, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY q) AS {c}' for c in ('fwd', 's', 'cap', 'adv'))} FROM x")
    return inference.clustered_ols(rows, "fwd", ["s", "cap", "adv"], "q")


@query(oracle("SELECT CASE kind WHEN 'ORIGINAL' THEN '13F-HR' ELSE '13F-HR/A' END AS form, cik, known AS filed, year(known) || 'Q' || quarter(known) AS index_quarter FROM revisions WHERE known >= DATE '1996-01-01' AND known < DATE '1998-01-01'"))
def index_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form indexes of the quarters asked for, out of a folder of all quarters."""
    path = shared_path(spark, "index")
    lines = relation(spark, sf_dir, "SELECT concat(year(known), 'Q', quarter(known)) AS quarter, format_string('%-12s%-40s%-12d%-12s%s', CASE kind WHEN 'ORIGINAL' THEN '13F-HR' ELSE '13F-HR/A' END, concat('FILER ', filer_id), cik, CAST(known AS STRING), concat('edgar/data/', accession, '.txt')) AS value FROM revisions")
    lines.hint("rebalance", "quarter").write.partitionBy("quarter").text(path)
    wanted = [r.label for r in calendar.quarters_between(spark, "1996-01-01", "1997-12-31").collect()]
    kept = spark.read.schema("value string, quarter string").text(path).where(F.col("quarter").isin(*wanted))
    out = None
    for quarter in wanted:
        part = filings.index_lines(kept.where(F.col("quarter") == quarter).select("value")).withColumn("index_quarter", F.lit(quarter))
        out = part if out is None else out.unionByName(part)
    return out.select("form", "cik", "filed", "index_quarter")


@query(
    """WITH w AS (SELECT p_partkey AS k, p_brand AS b, list_sort(list_distinct(list_filter(string_split(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS t FROM part)
SELECT a.k AS one, z.k AS other, round(len(list_intersect(a.t, z.t)) / len(list_distinct(a.t || z.t))::DOUBLE, 6) AS similarity FROM w a JOIN w z ON a.b = z.b AND a.k < z.k
WHERE len(list_intersect(a.t, z.t)) / len(list_distinct(a.t || z.t))::DOUBLE >= 0.5 AND len(list_filter(list_intersect(a.t, z.t), lambda x: x NOT IN ('BIG', 'SMALL', 'RED', 'BLUE'))) > 0"""
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one brand that share half of their words, one of them at least not a generic one."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", identifiers.name_tokens(F.col("p_name"), ()).alias("words"))
    other = lambda rows: rows.select(*[F.col(c).alias(c if c in ("p_brand", "word") else f"other_{c}") for c in rows.columns])
    names = p.select("p_brand", "words").distinct().withColumn("word", F.explode("words")).where(~F.col("word").isin("BIG", "SMALL", "RED", "BLUE"))
    names = names.join(other(names), ["p_brand", "word"]).drop("word").withColumn("similarity", identifiers.token_similarity(F.col("words"), F.col("other_words"))).where("similarity >= 0.5").distinct()
    groups = alike(p, ["p_brand", "words"], "p_partkey")
    pairs = groups.join(names, ["p_brand", "words"]).join(other(groups), ["p_brand", "other_words"])
    pairs = spread(pairs.select("ids", "other_ids", "similarity").where(F.array_min("ids") < F.array_max("other_ids")))
    return ordered_pairs(pairs, "one", "other").select("one", "other", F.round("similarity", 6).alias("similarity"))


#: Words that say what kind of company one is (fixed values), left out when names are compared.
LEGAL = ("INC", "LLC", "LP", "LTD", "CORP", "CO", "PLC", "SA", "AG", "L", "P")
_NAMED = """SELECT l.cik, l.first_q, l.last_q, concat_ws(' ', c_mktsegment, n_name, CASE l.cik % 4 WHEN 0 THEN 'L.P.' WHEN 1 THEN 'LLC' WHEN 2 THEN concat('ADVISORS ', l.cik % 9) ELSE 'Inc' END) AS name
FROM (SELECT cik, min(year(known) * 4 + quarter(known)) AS first_q, max(year(known) * 4 + quarter(known)) AS last_q FROM revisions GROUP BY cik) l JOIN {customer} ON c_custkey = l.cik JOIN {nation} ON n_nationkey = c_nationkey"""


@query(
    oracle(f"""WITH n AS ({_NAMED.format(customer="customer", nation="nation")}), t AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN {LEGAL})) AS w FROM n)
SELECT a.cik AS predecessor, b.cik AS successor, b.first_q - a.last_q AS gap, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) AS similarity
FROM t a JOIN t b ON a.cik <> b.cik AND b.first_q - a.last_q IN (1, 2) WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE >= 0.5""")
)
def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filers that begin one or two quarters after another one ends, with half of their names' words in common, legal forms apart."""
    named = relation(spark, sf_dir, _NAMED.format(customer="hf_customer", nation="hf_nation"))
    rows = named.select("cik", "first_q", "last_q", identifiers.name_tokens(F.col("name"), LEGAL).alias("w"))
    ended = rows.select(F.col("cik").alias("predecessor"), F.col("w").alias("a"), F.col("last_q"), F.explode(F.array(F.col("last_q") + 1, F.col("last_q") + 2)).alias("q")).withColumn("token", F.explode("a"))
    begun = rows.select(F.col("cik").alias("successor"), F.col("w").alias("b"), F.col("first_q").alias("q")).withColumn("token", F.explode("b"))
    pairs = ended.join(begun, ["q", "token"]).where("predecessor <> successor").drop("token").distinct()
    pairs = pairs.withColumn("similarity", identifiers.token_similarity(F.col("a"), F.col("b"))).where("similarity >= 0.5")
    return pairs.select("predecessor", "successor", (F.col("q") - F.col("last_q")).alias("gap"), F.round("similarity", 6).alias("similarity"))


@plan
def name_crosswalk(d: Spark) -> str:
    """Instruments by normalised name: the one that most rows say, names that have no such majority left out."""
    t = d.table
    key = d.replace_regex("upper(p_name)", "[^A-Z0-9]+", " ")
    return f"""WITH n AS (SELECT trim({key}) AS name, p_brand AS instrument FROM {t("part")}), v AS (SELECT name, instrument, count(*) AS votes FROM n WHERE name <> '' GROUP BY name, instrument),
r AS (SELECT *, sum(votes) OVER (PARTITION BY name) AS all_, row_number() OVER (PARTITION BY name ORDER BY votes DESC, instrument) AS rn, count(*) OVER (PARTITION BY name) AS choices FROM v)
SELECT name, instrument, votes, choices FROM r WHERE rn = 1 AND 2 * votes > all_"""


@plan
def manager_features(d: Spark) -> str:
    """Book, names, top weight, turnover as the smaller of buys and sells over the mean book, and flags of style: index-like, concentrated, trading."""
    return """WITH m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument),
a AS (SELECT n.q, n.filer_id, max(book) AS aum, count(*) AS names, max(w) AS top1, 1 - sum(least(w, wm)) AS active FROM numbered n JOIN m ON m.q = n.q AND m.instrument = n.instrument GROUP BY n.q, n.filer_id),
t AS (SELECT q, filer_id, least(sum(greatest(value - value_before, 0)), sum(greatest(value_before - value, 0))) / nullif((sum(value) + sum(value_before)) / 2, 0) AS turn FROM moves GROUP BY q, filer_id)
SELECT a.q, a.filer_id, round(aum, 2) AS aum, names, round(top1, 6) AS top1, round(active, 6) AS active_share, round(turn, 6) AS turnover, round(active, 9) < 0.25 AS index_like, round(top1, 9) > 0.25 AS concentrated, coalesce(round(turn, 9) > 0.5, false) AS trading FROM a LEFT JOIN t ON t.q = a.q AND t.filer_id = a.filer_id"""
