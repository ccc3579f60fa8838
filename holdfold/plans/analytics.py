"""Plans on cross-sections, time windows, evaluation and portfolios."""

from __future__ import annotations

from .dialect import DuckDB, Spark, plan


def pct_rank(x: str, by: str) -> str:
    """Average rank over count, as a share."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0) / count(*) OVER (PARTITION BY {by})"


def bins(d: Spark, rn: str, n: str, k: int) -> str:
    """Quantile bin from 0 of the row with number ``rn`` of ``n``, in integers."""
    return f"CASE WHEN {n} > 1 THEN greatest({d.idiv(f'({rn} - 1) * {k} + {n} - 2', f'{n} - 1')}, 1) - 1 ELSE 0 END"


#: Per quarter and instrument: a signal (ownership flow), cap, volume, and next quarter's return.
SIGNALS = """sig AS (SELECT m.q, m.instrument, sum(m.value - m.value_before) / nullif(max(x.adv), 0) AS s, max(x.cap) AS cap, max(x.adv) AS adv, max(x.price) AS price, max(x.vol) AS vol
  FROM moves m JOIN quarters k ON m.q = k.q JOIN market x ON x.period_end = k.period_end AND x.instrument = m.instrument GROUP BY m.q, m.instrument),
panel_ AS (SELECT a.*, b.price / a.price - 1 AS fwd FROM sig a LEFT JOIN sig b ON b.q = a.q + 1 AND b.instrument = a.instrument)"""


@plan
def xs_transforms(d: Spark) -> str:
    """Percent rank, quintile, winsorised value, and z-scores of both kinds per quarter."""
    return f"""WITH {SIGNALS},
lim AS (SELECT q, {d.quantile("s", 0.01)} AS lo, {d.quantile("s", 0.99)} AS hi FROM panel_ GROUP BY q),
w AS (SELECT p.q, instrument, s, least(greatest(s, lo), hi) AS ws, row_number() OVER (PARTITION BY p.q ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY p.q) AS n FROM panel_ p JOIN lim ON p.q = lim.q)
SELECT q, instrument, round({pct_rank("s", "q")}, 6) AS pct, {bins(d, "rn", "n", 5)} AS quintile, round(ws, 6) AS winsorised,
round((ws - avg(ws) OVER (PARTITION BY q)) / nullif(stddev_pop(ws) OVER (PARTITION BY q), 0), 5) AS z0, round((ws - avg(ws) OVER (PARTITION BY q)) / nullif(stddev_samp(ws) OVER (PARTITION BY q), 0), 5) AS z1 FROM w"""


RESIDUAL = """r AS (SELECT q, instrument, {rank} AS y, ln(cap) AS a, ln(adv) AS b FROM {rows}),
c AS (SELECT *, y - avg(y) OVER w AS dy, a - avg(a) OVER w AS da, b - avg(b) OVER w AS db FROM r WINDOW w AS (PARTITION BY q)),
m AS (SELECT q, count(*) AS n, sum(dy * da) AS ya, sum(dy * db) AS yb, sum(da * da) AS aa, sum(db * db) AS bb, sum(da * db) AS ab FROM c GROUP BY q),
e AS (SELECT c.q, instrument, round(CASE WHEN n >= 20 AND aa * bb - ab * ab > 1e-9 THEN dy - (ya * bb - yb * ab) / (aa * bb - ab * ab) * da - (yb * aa - ya * ab) / (aa * bb - ab * ab) * db ELSE dy END, 9) AS resid FROM c JOIN m ON c.q = m.q)"""


@plan
def xs_residual(d: Spark) -> str:
    """Rank residual on log cap and log volume, closed form from grouped moments, ranked again."""
    return f"""WITH {SIGNALS}, {RESIDUAL.format(rank=pct_rank("s", "q"), rows="panel_")}
SELECT q, instrument, round(resid, 5) + 0e0 AS residual, round({pct_rank("resid", "q")}, 6) AS ranked FROM e"""


@plan
def signal_pipeline(d: Spark) -> str:
    """Winsor, log of the positive part, rank, residual on log cap and log volume, rank again, and the mean of two quarters."""
    return f"""WITH {SIGNALS},
lim AS (SELECT q, {d.quantile("s", 0.01)} AS lo, {d.quantile("s", 0.99)} AS hi FROM panel_ GROUP BY q),
l AS (SELECT p.q, instrument, cap, adv, ln(1 + greatest(least(greatest(s, lo), hi), 0)) AS x FROM panel_ p JOIN lim ON p.q = lim.q),
{RESIDUAL.format(rank=pct_rank("x", "q"), rows="l")}, t AS (SELECT q, instrument, {pct_rank("resid", "q")} AS r FROM e)
SELECT q, instrument, round(r, 6) AS ranked, round(avg(r) OVER (PARTITION BY instrument ORDER BY q ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS smooth FROM t"""


EVENT = """b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL)"""


@plan
def quintile_event(d: Spark) -> str:
    """Equal and value weighted spread of the outer quintiles, information coefficient, members."""
    return f"""WITH {SIGNALS}, {EVENT},
f AS (SELECT *, {bins(d, "rn", "n", 5)} AS bin, {pct_rank("s", "q")} AS rs, {pct_rank("fwd", "q")} AS rf FROM b)
SELECT q, count(*) AS n, round(avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END), 6) AS ew, round(sum(CASE WHEN bin = 4 THEN fwd * cap END) / sum(CASE WHEN bin = 4 THEN cap END) - sum(CASE WHEN bin = 0 THEN fwd * cap END) / sum(CASE WHEN bin = 0 THEN cap END), 6) AS vw,
round(corr(rs, rf), 6) AS ic, round(corr(s, fwd), 6) AS pearson FROM f GROUP BY q"""


@plan
def event_summary(d: Spark) -> str:
    """Mean spread with Newey-West t (four lags), Sharpe, hit rate, monotonicity of the quintiles' means, one-sided turnover of the top one, breakeven cost in basis points."""
    return f"""WITH {SIGNALS}, {EVENT},
f AS (SELECT q, instrument, fwd, {bins(d, "rn", "n", 5)} AS bin FROM b),
e AS (SELECT q, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS x, avg(CASE WHEN bin = 0 THEN fwd END) AS b0, avg(CASE WHEN bin = 1 THEN fwd END) AS b1, avg(CASE WHEN bin = 2 THEN fwd END) AS b2, avg(CASE WHEN bin = 3 THEN fwd END) AS b3, avg(CASE WHEN bin = 4 THEN fwd END) AS b4 FROM f GROUP BY q),
c AS (SELECT q, x, x - avg(x) OVER () AS u, avg(x) OVER () AS mean_, count(*) OVER () AS n, row_number() OVER (ORDER BY q) AS i FROM e),
lags AS (SELECT c.*, i + lag AS later, lag FROM c CROSS JOIN (SELECT 0 AS lag UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) l),
lagged AS (SELECT z.lag, sum(a.u * z.u) AS g FROM c a JOIN lags z ON a.i = z.later GROUP BY z.lag),
s AS (SELECT sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / 5e0) * g END) AS v FROM lagged),
mono AS (SELECT (CASE WHEN avg(b1) >= avg(b0) THEN 1 ELSE 0 END + CASE WHEN avg(b2) >= avg(b1) THEN 1 ELSE 0 END + CASE WHEN avg(b3) >= avg(b2) THEN 1 ELSE 0 END + CASE WHEN avg(b4) >= avg(b3) THEN 1 ELSE 0 END) / 4e0 AS monotonicity FROM e),
top_ AS (SELECT q, instrument FROM f WHERE bin = 4), turns AS (SELECT a.q, avg(CASE WHEN z.instrument IS NULL THEN 1e0 ELSE 0e0 END) AS turn FROM top_ a LEFT JOIN top_ z ON z.q = a.q - 1 AND z.instrument = a.instrument WHERE a.q > (SELECT min(q) FROM top_) GROUP BY a.q),
cost AS (SELECT avg(turn) AS turn FROM turns)
SELECT max(n) AS n, round(max(mean_), 6) AS mean, round(max(mean_) / sqrt(max(v) / max(n) / max(n)), 4) AS nw_t, round(max(mean_) / stddev_samp(x) * 2, 4) AS sharpe, round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit, max(monotonicity) AS monotonicity, round(max(turn), 6) AS turnover, round(max(mean_) / nullif(4 * max(turn), 0) * 10000, 3) AS breakeven_bps FROM c CROSS JOIN s CROSS JOIN mono CROSS JOIN cost"""


@plan
def split_halves(d: Spark) -> str:
    """Spread in either half of the sample."""
    return f"""WITH {SIGNALS}, {EVENT},
e AS (SELECT q, avg(CASE WHEN bin = 4 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS x FROM (SELECT q, fwd, {bins(d, "rn", "n", 5)} AS bin FROM b) f GROUP BY q),
h AS (SELECT x, CASE WHEN row_number() OVER (ORDER BY q) <= {d.idiv("count(*) OVER ()", "2")} THEN 1 ELSE 2 END AS half FROM e)
SELECT half, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 4) AS t FROM h GROUP BY half"""


@plan
def fama_macbeth(d: Spark) -> str:
    """Slope of returns on the ranked signal per quarter, and its mean over strictly earlier quarters."""
    return f"""WITH {SIGNALS}, r AS (SELECT q, fwd, {pct_rank("s", "q")} AS r FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL),
l AS (SELECT q, regr_slope(fwd, r) AS slope FROM r GROUP BY q)
SELECT q, round(slope, 6) AS slope, round(avg(slope) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS past FROM l"""


@plan
def gram_accumulation(d: Spark) -> str:
    """Expanding sums of products, and the slope from them."""
    return f"""WITH {SIGNALS}, g AS (SELECT q, count(*) AS n, sum(s) AS sx, sum(fwd) AS sy, sum(s * s) AS sxx, sum(s * fwd) AS sxy FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL GROUP BY q),
c AS (SELECT q, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM g WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING))
SELECT q, n, round((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 7) AS slope FROM c"""


@plan
def signal_correlation(d: Spark) -> str:
    """Mean over quarters of the rank correlation of signals."""
    return f"""WITH {SIGNALS}, r AS (SELECT q, {pct_rank("s", "q")} AS a, {pct_rank("cap", "q")} AS b, {pct_rank("vol", "q")} AS c FROM panel_ WHERE vol IS NOT NULL),
m AS (SELECT q, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r GROUP BY q) SELECT round(avg(ab), 5) AS flow_cap, round(avg(ac), 5) AS flow_vol, round(avg(bc), 5) AS cap_vol FROM m"""


@plan
def factor_mimicking(d: Spark) -> str:
    """Return of a portfolio long positive and short negative z, by z."""
    return f"""WITH {SIGNALS}, z AS (SELECT q, fwd, (ln(cap) - avg(ln(cap)) OVER (PARTITION BY q)) / nullif(stddev_pop(ln(cap)) OVER (PARTITION BY q), 0) AS z FROM panel_ WHERE fwd IS NOT NULL)
SELECT q, round(sum(greatest(z, 0) * fwd) / nullif(sum(greatest(z, 0)), 0) - sum(greatest(-z, 0) * fwd) / nullif(sum(greatest(-z, 0)), 0), 6) AS ret FROM z GROUP BY q"""


@plan
def rolling_stats(d: Spark) -> str:
    """Rolling mean, median and deviation over 21 rows where 15 are there."""
    gate = lambda x: f"CASE WHEN count(ret) OVER w >= 15 THEN round({x} OVER w, 6) END"
    return f"SELECT instrument, day, {gate('avg(ret)')} AS mean, {gate(d.quantile('ret', 0.5))} AS median, {gate('stddev_samp(ret)')} AS sd, round(max(price) OVER w, 6) AS high FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"


MONTHLY = """mon AS (SELECT instrument, CAST(date_trunc('month', day) AS DATE) AS month, max_by(price, day) AS price, sum(dollars) AS dollars FROM prices GROUP BY instrument, CAST(date_trunc('month', day) AS DATE)),
mret AS (SELECT *, price / lag(price) OVER (PARTITION BY instrument ORDER BY month) - 1 AS ret, row_number() OVER (PARTITION BY instrument ORDER BY month) AS i FROM mon)"""


@plan
def monthly_returns(d: Spark) -> str:
    return f"WITH {MONTHLY} SELECT instrument, month, i, round(ret, 6) AS ret FROM mret"


@plan
def momentum(d: Spark) -> str:
    """Compounded return of months 12 to 2 before, with at least 8 of the 11."""
    return f"WITH {MONTHLY} SELECT instrument, month, CASE WHEN count(ret) OVER w >= 8 THEN round(exp(sum(ln(1 + ret)) OVER w) - 1, 6) END AS mom FROM mret WINDOW w AS (PARTITION BY instrument ORDER BY month ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)"


@plan
def forward_returns(d: Spark) -> str:
    """Compounded return over the next 1, 3 and 6 months, only where all are there."""
    cols = ", ".join(f"CASE WHEN count(ret) OVER w{h} = {h} THEN round(exp(sum(ln(1 + ret)) OVER w{h}) - 1, 6) END AS fwd{h}" for h in (1, 3, 6))
    windows = ", ".join(f"w{h} AS (PARTITION BY instrument ORDER BY month ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 3, 6))
    return f"WITH {MONTHLY} SELECT instrument, month, {cols} FROM mret WINDOW {windows}"


@plan
def forward_sum_return(d: Spark) -> str:
    """Sum of simple returns from the second day after a quarter's end until 91 days after it: a day belongs to the last quarter's end or the one before."""
    if isinstance(d, DuckDB):
        rows = f"prices JOIN quarters ON day > {d.plus('period_end', 1)} AND day <= {d.plus('period_end', 91)}"
    else:
        start = "CAST(date_trunc('quarter', day) AS DATE)"
        ends = " UNION ALL ".join(f"SELECT *, {d.plus(d.months(start, -3 * k), -1)} AS period_end FROM prices" for k in (0, 1))
        rows = f"({ends}) p JOIN quarters USING (period_end) WHERE day > {d.plus('period_end', 1)} AND day <= {d.plus('period_end', 91)}"
    return f"SELECT period_end, instrument, count(ret) AS days, round(sum(ret), 5) AS fwd FROM {rows} GROUP BY period_end, instrument"


@plan
def drawdowns(d: Spark) -> str:
    """Cumulative value, running peak and drawdown of each instrument's monthly returns."""
    return f"""WITH {MONTHLY}, c AS (SELECT instrument, month, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY instrument ORDER BY month ROWS UNBOUNDED PRECEDING)) AS v FROM mret)
SELECT instrument, month, round(v, 6) AS value, round(v / max(v) OVER (PARTITION BY instrument ORDER BY month ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM c"""


@plan
def ewm_mean(d: Spark) -> str:
    """Exponentially weighted mean, half-life two, missing values skipped while weights decay.

    Weights are powers of two against the series' end, so one running sum does what the check does by pairs.
    """
    if isinstance(d, DuckDB):
        return f"""WITH {MONTHLY} SELECT a.instrument, a.month, round(sum(b.ret * power(0.5e0, (a.i - b.i) / 2e0)) / sum(power(0.5e0, (a.i - b.i) / 2e0)), 6) AS ewm
FROM mret a JOIN mret b ON a.instrument = b.instrument AND b.i <= a.i WHERE b.ret IS NOT NULL GROUP BY a.instrument, a.month"""
    return f"""WITH {MONTHLY}, p AS (SELECT *, CASE WHEN ret IS NOT NULL THEN power(2e0, (i - max(i) OVER (PARTITION BY instrument)) / 2e0) END AS k FROM mret),
s AS (SELECT instrument, month, sum(ret * k) OVER w AS x, sum(k) OVER w AS k FROM p WINDOW w AS (PARTITION BY instrument ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT instrument, month, round(x / k, 6) AS ewm FROM s WHERE k IS NOT NULL"""


@plan
def expanding_quantile(d: Spark) -> str:
    """Eightieth percentile of all strictly earlier months, from the 12th on."""
    return f"WITH {MONTHLY} SELECT instrument, month, CASE WHEN count(ret) OVER w >= 12 THEN round({d.quantile('ret', 0.8)} OVER w, 6) END AS p80 FROM mret WINDOW w AS (PARTITION BY instrument ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@plan
def expanding_percentile(d: Spark) -> str:
    """Share of a filer's earlier turnovers that aren't above the present one, from four on; a filer's own history is one array."""
    turns = "SELECT q, filer_id, 2 * sum(abs(value - value_before)) / nullif(sum(value + value_before), 0) AS x FROM moves GROUP BY q, filer_id"
    if isinstance(d, DuckDB):
        return f"""WITH t AS ({turns})
SELECT a.q, a.filer_id, count(b.x) AS past, CASE WHEN count(b.x) >= 4 THEN round(avg(CASE WHEN b.x <= a.x THEN 1e0 ELSE 0e0 END), 6) END AS pct FROM t a JOIN t b ON a.filer_id = b.filer_id AND b.q < a.q GROUP BY a.q, a.filer_id, a.x"""
    return f"""WITH t AS ({turns}), h AS (SELECT q, filer_id, x, collect_list(x) OVER w AS past, count(*) OVER w AS rows_ FROM t WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT q, filer_id, CAST(size(past) AS BIGINT) AS past, CASE WHEN size(past) >= 4 THEN round(size(filter(past, y -> y <= x)) / CAST(rows_ AS DOUBLE), 6) END AS pct FROM h WHERE rows_ > 0"""


@plan
def step_function(d: Spark) -> str:
    """A quarterly value carried on to later months, at most five."""
    return f"""WITH {MONTHLY}, v AS (SELECT CAST(date_trunc('month', {d.plus("period_end", 45)}) AS DATE) AS month, instrument, sum(value) AS value FROM panel GROUP BY CAST(date_trunc('month', {d.plus("period_end", 45)}) AS DATE), instrument),
j AS (SELECT m.instrument, m.month, v.value FROM mret m LEFT JOIN v ON m.instrument = v.instrument AND m.month = v.month)
SELECT instrument, month, round({d.last_seen("value")} OVER (PARTITION BY instrument ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 2) AS value FROM j"""


@plan
def rolling_beta(d: Spark) -> str:
    """Beta to the equal-weighted index from moments over 126 rows, 60 at least."""
    return """WITH i AS (SELECT day, avg(ret) AS m FROM prices WHERE ret IS NOT NULL GROUP BY day),
j AS (SELECT instrument, p.day, ret, m FROM prices p JOIN i ON p.day = i.day WHERE ret IS NOT NULL)
SELECT instrument, day, CASE WHEN count(*) OVER w >= 60 THEN round((avg(ret * m) OVER w - avg(ret) OVER w * avg(m) OVER w) / nullif(avg(m * m) OVER w - avg(m) OVER w * avg(m) OVER w, 0), 4) + 0e0 END AS beta FROM j WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"""


@plan
def stress_flag(d: Spark) -> str:
    """Five-day sum below the lagged lower decile of the 252 rows before."""
    return f"""WITH s AS (SELECT instrument, day, sum(ret) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5 FROM prices)
SELECT instrument, day, round(s5, 6) AS s5, s5 < {d.quantile("s5", 0.1)} OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS stressed FROM s"""


@plan
def shock_calendar(d: Spark) -> str:
    """Rebalance dates: the last trading day of each month, and of each quarter."""
    return "SELECT CAST(date_trunc('month', day) AS DATE) AS month, max(day) AS last_day, CAST(max(date_trunc('quarter', day)) AS DATE) AS quarter FROM prices GROUP BY CAST(date_trunc('month', day) AS DATE)"


@plan
def business_day_offset(d: Spark) -> str:
    """Third trading day after each quarter's end, from the numbered calendar."""
    return "WITH c AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM prices) x), e AS (SELECT period_end, max(i) AS i FROM quarters JOIN c ON day <= period_end GROUP BY period_end) SELECT e.period_end, c.day FROM e JOIN c ON c.i = e.i + 3"


@plan
def knowledge_time(d: Spark) -> str:
    """New York date on which an event in UTC counts as known: the next one from four in the afternoon, by that day's clocks."""
    t, local = d.table, d.local("ts")
    return f"SELECT event_id, CAST({local} AS DATE) AS local_day, CASE WHEN extract(hour FROM {local}) >= 16 THEN {d.plus(f'CAST({local} AS DATE)', 1)} ELSE CAST({local} AS DATE) END AS known FROM {t('events')}"


@plan
def acceptance_hours(d: Spark) -> str:
    t = d.table
    return f"SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour, event_type, count(*) AS n FROM {t('events')} GROUP BY extract(hour FROM ts), event_type"


@plan
def deadline_roll(d: Spark) -> str:
    """Filing deadline 45 days after a period, moved from a weekend to Monday."""
    due = d.plus("period_end", 45)
    weekday = f"{d.days(due, "DATE '1995-01-02'")} % 7"
    return f"SELECT period_end, CASE WHEN {weekday} = 5 THEN {d.plus('period_end', 47)} WHEN {weekday} = 6 THEN {d.plus('period_end', 46)} ELSE {due} END AS deadline FROM quarters"


@plan
def portfolio_weights(d: Spark) -> str:
    """Demeaned rank, gross one, capped, demeaned and normalised again."""
    return f"""WITH {SIGNALS}, r AS (SELECT q, instrument, {pct_rank("s", "q")} AS r FROM panel_),
a AS (SELECT q, instrument, r - avg(r) OVER (PARTITION BY q) AS x FROM r),
b AS (SELECT q, instrument, least(greatest(x / nullif(sum(abs(x)) OVER (PARTITION BY q), 0), -0.06e0), 0.06e0) AS x FROM a),
c AS (SELECT q, instrument, x - avg(x) OVER (PARTITION BY q) AS x FROM b)
SELECT q, instrument, round(x / nullif(sum(abs(x)) OVER (PARTITION BY q), 0), 6) + 0e0 AS weight FROM c"""


LEGS = """lim AS (SELECT q, {hi} AS hi, {lo} AS lo, count(*) AS n FROM panel_ WHERE s IS NOT NULL GROUP BY q),
legs AS (SELECT p.q, instrument, fwd, vol, cap, CASE WHEN s >= hi THEN 1e0 WHEN s <= lo THEN -1e0 ELSE 0e0 END AS side FROM panel_ p JOIN lim ON p.q = lim.q WHERE n >= 10),
wts AS (SELECT *, CASE WHEN side <> 0 THEN side / sum(abs(side)) OVER (PARTITION BY q, side) ELSE 0e0 END AS w FROM legs)"""


def legs(d: Spark) -> str:
    return LEGS.format(hi=d.quantile("s", 0.8), lo=d.quantile("s", 0.2))


@plan
def from_indicator(d: Spark) -> str:
    """Long the upper, short the lower quintile by the quantile of the day, each leg's weights adding to one."""
    return f"WITH {SIGNALS}, {legs(d)} SELECT q, instrument, round(w, 6) AS weight FROM wts WHERE w <> 0"


@plan
def normalise_portfolio(d: Spark) -> str:
    """Scaled by the long side, legs scaled apart, and the short side set equal to the long one."""
    return f"""WITH {SIGNALS}, {legs(d)}, x AS (SELECT q, instrument, w * vol AS w FROM wts WHERE w <> 0 AND vol IS NOT NULL)
SELECT q, instrument, round(w / nullif(sum(greatest(w, 0)) OVER p, 0), 6) AS by_long, round(CASE WHEN w > 0 THEN w / sum(greatest(w, 0)) OVER p ELSE w / nullif(sum(greatest(-w, 0)) OVER p, 0) END, 6) AS by_leg,
round(CASE WHEN w < 0 THEN w * sum(greatest(w, 0)) OVER p / nullif(sum(greatest(-w, 0)) OVER p, 0) ELSE w END, 8) AS equalised FROM x WINDOW p AS (PARTITION BY q)"""


@plan
def volatility_weights(d: Spark) -> str:
    return f"WITH {SIGNALS}, {legs(d)} SELECT q, instrument, round(w / vol / nullif(sum(abs(w) / vol) OVER (PARTITION BY q), 0), 6) AS weight FROM wts WHERE w <> 0 AND vol > 0"


@plan
def period_returns(d: Spark) -> str:
    """Next quarter's return of the weights, less fees on trades and borrow on shorts."""
    return f"""WITH {SIGNALS}, {legs(d)}, held AS (SELECT q, instrument, w FROM wts WHERE w <> 0),
tr AS (SELECT coalesce(a.q, b.q + 1) AS q, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS traded FROM held a FULL OUTER JOIN held b ON a.q = b.q + 1 AND a.instrument = b.instrument GROUP BY coalesce(a.q, b.q + 1))
SELECT w.q, round(sum(w * coalesce(fwd, 0)), 6) AS gross, round(sum(w * coalesce(fwd, 0)) - 0.0005e0 * max(traded) - 0.005e0 / 4 * sum(greatest(-w, 0)), 6) AS net, round(max(traded), 6) AS traded FROM wts w JOIN tr ON w.q = tr.q GROUP BY w.q"""


@plan
def backtest_stats(d: Spark) -> str:
    """Annualised return, volatility, Sharpe, maximal drawdown, hit rate, skewness and kurtosis with pandas' corrections."""
    return f"""WITH {SIGNALS}, {legs(d)}, p AS (SELECT q, sum(w * fwd) AS r FROM wts WHERE fwd IS NOT NULL GROUP BY q),
c AS (SELECT q, r, exp(sum(ln(greatest(1 + r, 0.01e0))) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING)) AS v FROM p), k AS (SELECT q, r, v / max(v) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c),
m AS (SELECT count(*) AS n, avg(r) AS a FROM p), z AS (SELECT max(n) AS n, sum(power(r - a, 2)) / max(n) AS m2, sum(power(r - a, 3)) / max(n) AS m3, sum(power(r - a, 4)) / max(n) AS m4 FROM p CROSS JOIN m)
SELECT round(avg(r) * 4, 6) AS annual, round(stddev_samp(r) * 2, 6) AS vol, round(avg(r) / stddev_samp(r) * 2, 4) AS sharpe, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit,
round(max(sqrt(z.n * (z.n - 1)) / (z.n - 2) * m3 / power(m2, 1.5e0)), 4) AS skew, round(max((z.n - 1e0) / ((z.n - 2) * (z.n - 3)) * ((z.n + 1) * m4 / m2 / m2 - 3 * (z.n - 1))), 4) AS kurtosis FROM k CROSS JOIN z"""


DRIFT = """rb AS (SELECT k.period_end, w.instrument, w.w, s.price AS p0 FROM wts w JOIN quarters k ON w.q = k.q JOIN sig s ON s.q = w.q AND s.instrument = w.instrument WHERE w.w <> 0),
nxt AS (SELECT period_end, lead(period_end) OVER (ORDER BY period_end) AS until FROM quarters),
dr AS (SELECT r.period_end, p.day, r.instrument, r.w * p.price / r.p0 AS x FROM rb r JOIN nxt n ON r.period_end = n.period_end JOIN prices p ON p.instrument = r.instrument AND p.day > r.period_end AND p.day <= n.until),
drifted AS (SELECT period_end, day, instrument, x / nullif(sum(greatest(x, 0)) OVER (PARTITION BY day), 0) AS w FROM dr)"""


@plan
def rebalance_drift(d: Spark) -> str:
    """Between rebalances weights drift with prices, shorts on the long side's base: closed form from the last rebalance strictly before the day."""
    return f"WITH {SIGNALS}, {legs(d)}, {DRIFT} SELECT day, instrument, round(w, 6) AS weight FROM drifted"


@plan
def rebalance_trades(d: Spark) -> str:
    """What a rebalance trades: the new weights less those that the old ones had drifted to by their last day."""
    return f"""WITH {SIGNALS}, {legs(d)}, {DRIFT}, last_ AS (SELECT period_end, instrument, max_by(w, day) AS w FROM drifted WHERE w IS NOT NULL GROUP BY period_end, instrument),
old AS (SELECT n.until AS period_end, instrument, w FROM last_ l JOIN nxt n ON l.period_end = n.period_end), new AS (SELECT period_end, instrument, w FROM rb)
SELECT coalesce(n.period_end, o.period_end) AS period_end, coalesce(n.instrument, o.instrument) AS instrument, round(coalesce(n.w, 0) - coalesce(o.w, 0), 6) + 0e0 AS trade
FROM new n FULL OUTER JOIN old o ON n.period_end = o.period_end AND n.instrument = o.instrument"""


@plan
def fee_ladder(d: Spark) -> str:
    """Mean net return over a grid of fees and leg sizes."""
    return f"""WITH {SIGNALS}, grid AS (SELECT fee, top_ FROM (SELECT 0e0 AS fee UNION ALL SELECT 0.0005e0 UNION ALL SELECT 0.002e0) f CROSS JOIN (SELECT 3 AS top_ UNION ALL SELECT 5) t),
r AS (SELECT q, fwd, row_number() OVER (PARTITION BY q ORDER BY s DESC, instrument) AS hi, row_number() OVER (PARTITION BY q ORDER BY s, instrument) AS lo FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL),
e AS (SELECT fee, top_, q, avg(CASE WHEN hi <= top_ THEN fwd END) - avg(CASE WHEN lo <= top_ THEN fwd END) - 4 * fee AS x FROM r CROSS JOIN grid GROUP BY fee, top_, q)
SELECT fee, top_, round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x) * 2, 4) AS sharpe FROM e GROUP BY fee, top_"""


@plan
def tilt_weights(d: Spark) -> str:
    """Cap weights tilted by the exponential of the rank, with caps repaired by a log-linear fit and held to a tenth."""
    return f"""WITH {SIGNALS}, l AS (SELECT q, instrument, s, ln(cap) AS y, ln(adv) AS x FROM panel_),
f AS (SELECT q, regr_slope(y, x) AS b, avg(y) AS my, avg(x) AS mx FROM l GROUP BY q),
e AS (SELECT l.q, instrument, s, y, my + b * (x - mx) AS fit FROM l JOIN f ON l.q = f.q),
c AS (SELECT q, instrument, s, exp(CASE WHEN abs(y - fit) > 2.5e0 * stddev_samp(y - fit) OVER (PARTITION BY q) THEN fit ELSE y END) AS cap FROM e),
w AS (SELECT q, instrument, s, least(cap / sum(cap) OVER (PARTITION BY q), 0.1e0) AS w FROM c),
t AS (SELECT q, instrument, w * exp(2 * 2 * ({pct_rank("s", "q")} - 0.5e0)) AS t FROM w)
SELECT q, instrument, round(t / sum(t) OVER (PARTITION BY q), 6) AS weight FROM t"""


@plan
def skill_shrinkage(d: Spark) -> str:
    """Empirical-Bayes shrinkage of filers' mean flows."""
    return """WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS x FROM moves GROUP BY q, filer_id),
a AS (SELECT filer_id, avg(x) AS a, var_samp(x) / count(x) AS s2 FROM f WHERE x IS NOT NULL GROUP BY filer_id HAVING count(x) >= 8),
t AS (SELECT greatest(var_samp(a) - avg(s2), 1e-8) AS tau2 FROM a)
SELECT filer_id, round(a, 5) AS raw, round(a * tau2 / (tau2 + s2), 5) AS shrunk FROM a CROSS JOIN t"""


@plan
def impact_costs(d: Spark) -> str:
    """Square-root impact cost of trading a name at several sizes of capital."""
    return f"WITH {SIGNALS}, g AS (SELECT 1000e0 AS capital UNION ALL SELECT 10000e0 UNION ALL SELECT 100000e0) SELECT q, capital, round(sum(capital / 25 * vol * sqrt(capital / 25 / adv)), 4) AS cost, round(sum(vol * sqrt(capital / 25 / adv)) / 25 * 10000, 4) AS bps FROM panel_ CROSS JOIN g WHERE vol IS NOT NULL GROUP BY q, capital"


@plan
def top_fraction(d: Spark) -> str:
    """The top fifth of a quarter's names, three at least; each filer's three largest positions beside."""
    return """WITH r AS (SELECT q, filer_id, instrument, w, row_number() OVER (PARTITION BY q, filer_id ORDER BY w DESC, instrument) AS rn, count(*) OVER (PARTITION BY q, filer_id) AS n FROM numbered)
SELECT q, filer_id, instrument, rn FROM r WHERE rn <= greatest(CAST(floor(n * 0.2) AS BIGINT), 3)"""


@plan
def matched_controls(d: Spark) -> str:
    """For each distressed filer, a calm one of the same size tercile, chosen by a fixed order."""
    return f"""WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id HAVING sum(value_before) > 0),
t AS (SELECT *, {bins(d, "rn", "n", 3)} AS tercile FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY aum, filer_id) AS rn, count(*) OVER (PARTITION BY q) AS n FROM f) x),
a AS (SELECT q, tercile, filer_id, row_number() OVER (PARTITION BY q, tercile ORDER BY filer_id * 7919 % 101, filer_id) AS k FROM t WHERE flow < -0.3),
b AS (SELECT q, tercile, filer_id, row_number() OVER (PARTITION BY q, tercile ORDER BY filer_id * 6007 % 103, filer_id) AS k FROM t WHERE abs(flow) < 0.3)
SELECT a.q, a.tercile, a.filer_id AS distressed, b.filer_id AS control FROM a JOIN b ON a.q = b.q AND a.tercile = b.tercile AND a.k = b.k"""


@plan
def position_dashboard(d: Spark) -> str:
    """Mean, dispersion, tail share and concentration of positions under three weightings."""
    parts = " UNION ALL ".join(f"SELECT q, '{name}' AS scheme, w, {x} AS k FROM numbered" for name, x in (("equal", "1e0"), ("value", "value"), ("root", "sqrt(value)")))
    return f"WITH s AS ({parts}) SELECT q, scheme, round(sum(w * k) / sum(k), 6) AS mean, round(sqrt(greatest(sum(w * w * k) / sum(k) - power(sum(w * k) / sum(k), 2), 0)), 5) AS dispersion, round(sum(CASE WHEN w > 0.2 THEN k ELSE 0 END) / sum(k), 6) AS tail, round(sum(k * k) / power(sum(k), 2), 6) AS hhi FROM s GROUP BY q, scheme"


@plan
def pivot_kinds(d: Spark) -> str:
    """Filings per period by kind, as columns, and the rows again."""
    return """WITH p AS (SELECT period_end, sum(CASE WHEN kind = 'ORIGINAL' THEN 1 ELSE 0 END) AS original, sum(CASE WHEN kind = 'RESTATEMENT' THEN 1 ELSE 0 END) AS restated, sum(CASE WHEN kind = 'NEW HOLDINGS' THEN 1 ELSE 0 END) AS added FROM revisions GROUP BY period_end)
SELECT period_end, 'original' AS kind, original AS n FROM p UNION ALL SELECT period_end, 'restated', restated FROM p UNION ALL SELECT period_end, 'added', added FROM p"""


@plan
def asof_strict(d: Spark) -> str:
    """Monthly returns with the latest quarter strictly before, by instrument: a union and the last value seen."""
    return f"""WITH {MONTHLY}, u AS (SELECT instrument, month AS ts, 0 AS side, ret, CAST(NULL AS DOUBLE) AS cap, CAST(NULL AS DATE) AS src FROM mret UNION ALL SELECT instrument, period_end, 1, NULL, cap, period_end FROM market)
SELECT instrument, ts AS month, round(ret, 6) AS ret, round(cap0, 2) AS cap, src0 AS period_end FROM (SELECT *, {d.last_seen("cap")} OVER w AS cap0, {d.last_seen("src")} OVER w AS src0 FROM u WINDOW w AS (PARTITION BY instrument ORDER BY ts, side ROWS UNBOUNDED PRECEDING)) x WHERE side = 0"""


@plan
def range_join_dated(d: Spark) -> str:
    """Filings with the validity range that they fall into, first match by start."""
    return f"""WITH v AS (SELECT filer_id, period_end AS from_, {d.plus("period_end", 120)} AS to_, count(*) AS n FROM revisions WHERE kind = 'ORIGINAL' GROUP BY filer_id, period_end),
j AS (SELECT r.accession, v.from_, v.n, row_number() OVER (PARTITION BY r.accession ORDER BY v.from_) AS rn FROM revisions r JOIN v ON r.filer_id = v.filer_id AND r.known BETWEEN v.from_ AND v.to_)
SELECT accession, from_, n FROM j WHERE rn = 1"""


@plan
def fund_performance(d: Spark) -> str:
    """Excess return of filers' books, information ratio, and persistence between halves."""
    return """WITH r AS (SELECT a.q, a.instrument, a.price / b.price - 1 AS r FROM (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) a JOIN (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) b ON a.q = b.q + 1 AND a.instrument = b.instrument),
b AS (SELECT n.q, filer_id, sum(w * r) / sum(w) AS r FROM numbered n JOIN r ON r.q = n.q + 1 AND r.instrument = n.instrument GROUP BY n.q, filer_id),
m AS (SELECT q, avg(r) AS m FROM b GROUP BY q), x AS (SELECT b.q, filer_id, r - m AS ex FROM b JOIN m ON b.q = m.q)
SELECT filer_id, count(*) AS n, round(avg(ex), 6) AS excess, round(avg(ex) / nullif(stddev_samp(ex), 0) * 2, 4) AS ir, round(avg(CASE WHEN q <= 13 THEN ex END), 6) AS first_half, round(avg(CASE WHEN q > 13 THEN ex END), 6) AS second_half FROM x GROUP BY filer_id"""


@plan
def manager_stress(d: Spark) -> str:
    """Each quarter's books, their weights frozen for the next four quarters: drawdown and pain by month, standardised over filers."""
    return f"""WITH {MONTHLY}, dated AS (SELECT instrument, ret, month, CAST(year(month) * 4 + quarter(month) - 7979 AS BIGINT) AS at_ FROM mret),
h AS (SELECT q, q + i + 1 AS at_, filer_id, instrument, w FROM numbered {d.each(4)}),
b AS (SELECT q, filer_id, month, sum(w * coalesce(ret, 0)) AS r, sum(CASE WHEN ret < -0.05 THEN w ELSE 0 END) AS pain FROM h JOIN dated m ON h.instrument = m.instrument AND h.at_ = m.at_ GROUP BY q, filer_id, month),
c AS (SELECT *, sum(ln(greatest(1 + r, 0.01e0))) OVER (PARTITION BY q, filer_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS v FROM b), e AS (SELECT q, filer_id, month, pain, 1 - exp(v - max(v) OVER (PARTITION BY q, filer_id ORDER BY month ROWS UNBOUNDED PRECEDING)) AS dd FROM c)
SELECT q, filer_id, month, round(CASE WHEN stddev_pop(dd) OVER p > 1e-9 THEN (dd - avg(dd) OVER p) / stddev_pop(dd) OVER p END + CASE WHEN stddev_pop(pain) OVER p > 1e-9 THEN (pain - avg(pain) OVER p) / stddev_pop(pain) OVER p END, 4) + 0e0 AS stress FROM e WINDOW p AS (PARTITION BY q, month)"""


@plan
def restatement_event(d: Spark) -> str:
    """Return around a change between consecutive versions, in its direction, less the median."""
    return f"""WITH v AS (SELECT r.filer_id, r.period_end, r.known, h.instrument, h.value, row_number() OVER (PARTITION BY r.filer_id, r.period_end, h.instrument ORDER BY r.known, r.accession) AS i FROM revisions r JOIN holdings h USING (accession) WHERE kind <> 'NEW HOLDINGS'),
c AS (SELECT a.known, a.instrument, a.value - b.value AS delta FROM v a JOIN v b ON a.filer_id = b.filer_id AND a.period_end = b.period_end AND a.instrument = b.instrument AND a.i = b.i + 1),
f AS (SELECT instrument, day, sum(ret) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS r5 FROM prices), m AS (SELECT day, {d.quantile("r5", 0.5)} AS med FROM f GROUP BY day)
SELECT CAST(date_trunc('quarter', known) AS DATE) AS quarter, count(*) AS n, round(avg(sign(delta) * (least(greatest(r5, -0.5e0), 0.5e0) - med)), 6) AS car FROM c JOIN f ON f.instrument = c.instrument AND f.day = c.known JOIN m ON m.day = c.known WHERE abs(delta) >= 1000 GROUP BY CAST(date_trunc('quarter', known) AS DATE)"""


@plan
def imbalance_grid(d: Spark) -> str:
    """Contrarian profit over a grid of imbalance quantiles and horizons."""
    return f"""WITH {MONTHLY}, t AS (SELECT m.q, k.period_end, instrument, (sum(CASE WHEN shares > shares_before THEN 1 ELSE 0 END) - sum(CASE WHEN shares < shares_before THEN 1 ELSE 0 END)) / CAST(count(*) AS DOUBLE) AS i FROM moves m JOIN quarters k ON m.q = k.q WHERE shares <> shares_before GROUP BY m.q, k.period_end, instrument),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY abs(i) DESC, instrument) AS rn FROM t),
f AS (SELECT instrument, month, sum(ret) OVER (PARTITION BY instrument ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS h1, sum(ret) OVER (PARTITION BY instrument ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS h3 FROM mret),
g AS (SELECT top_ FROM (SELECT 3 AS top_ UNION ALL SELECT 6 UNION ALL SELECT 12) x)
SELECT top_, count(*) AS n, round(avg(-sign(i) * h1), 6) AS pnl1, round(avg(-sign(i) * h3), 6) AS pnl3 FROM r CROSS JOIN g JOIN f ON f.instrument = r.instrument AND f.month = CAST(date_trunc('month', r.period_end) AS DATE) WHERE rn <= top_ GROUP BY top_"""
